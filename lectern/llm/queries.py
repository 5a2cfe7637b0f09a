"""The registered queries of this subpackage."""

from __future__ import annotations

from lectern.llm.alignment import op13_cross_tokenizer
from lectern.llm.bpe import op4_byte_bpe
from lectern.llm.decontaminate import op9_decontamination
from lectern.llm.divergence import ORACLE_SQL as DIVERGENCE_SQL
from lectern.llm.divergence import op11_source_divergence
from lectern.llm.jaccard import op10_ngram_jaccard
from lectern.llm.language import op8_language_id
from lectern.llm.lines import op6_line_dedup
from lectern.llm.media import op7_media_columns
from lectern.llm.passages import op12_substring_dedup
from lectern.llm.repeats import op2_suffix_dedup
from lectern.llm.secrets import op1_secret_scan
from lectern.llm.token_counts import op5_token_counts
from lectern.llm.toxicity import op3_toxicity

QUERIES = {
    f.__name__: f
    for f in (op1_secret_scan, op2_suffix_dedup, op3_toxicity, op4_byte_bpe, op5_token_counts, op6_line_dedup, op7_media_columns, op8_language_id, op9_decontamination, op10_ngram_jaccard, op11_source_divergence, op12_substring_dedup, op13_cross_tokenizer)
}

ORACLES: dict[str, str] = {"op11_source_divergence": DIVERGENCE_SQL}
