"""Alignment of two tokenizers against brute force."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as public
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lectern.llm import alignment

TEXTS = [
    None, "", "plain words and numbers 12345", "plain words and numbers 12345", "  two  spaces ", "tab\tand\nlines\n\n\nmore", "naïve café – “quoted” … 日本語テキスト 한국어 emoji 👩‍👩‍👧 end", "<|endoftext|> <s> </s> <unk> <0x41> ▁ x",
    "a" * 9000, " " * 9000 + "x", "ab1" * 3000, "\x00\x01 control", "ﬁ ligature ½ ①", "Ünïcödé " * 300, "x", "don't we'll THEY'RE",
]


def tokens(text, a, b):
    """Pairs of id and bytes of both sides, or none."""
    if not text:
        return [], []
    whole = (" " + text).encode()
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
    left = [(i, bytes(of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    return (left, right) if b"".join(x for _, x in left) == b"".join(x for _, x in right) == whole else ([], [])


def brute(texts):
    a = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    rows, held = [], Counter()
    for text in texts:
        left, right = tokens(text, a, b)
        groups, i, j = [], 0, 0
        while i < len(left):
            x, y = [left[i][0]], [right[j][0]]
            size_x, size_y = len(left[i][1]), len(right[j][1])
            i, j = i + 1, j + 1
            while size_x != size_y:
                if size_x < size_y:
                    x.append(left[i][0])
                    size_x, i = size_x + len(left[i][1]), i + 1
                else:
                    y.append(right[j][0])
                    size_y, j = size_y + len(right[j][1]), j + 1
            groups.append((x, y))
        links = Counter()
        for x, y in groups:
            for p, n in Counter(x).items():
                for q, m in Counter(y).items():
                    links[p, q] += n * m
        held.update(links.keys())
        rows.append((len(left), len(right), groups, links))
    best = Counter()
    for (p, _), n in held.items():
        best[p] = max(best[p], n)
    out = []
    for n_a, n_b, groups, links in rows:
        listed = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        digest = hashlib.sha256(listed.encode()).hexdigest() if groups else ""
        out.append((n_a, n_b, len(groups), sum(links.values()), sum(n for (p, q), n in links.items() if held[p, q] == best[p]), sum(n * held[k] for k, n in links.items()), digest))
    return out


def test_equals_brute_force_on_hard_texts(spark, tmp_path):
    rows = [(None if i == 3 else i // 2, t, "x", 1) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, row string, pairs int").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(((r[0], *w) for r, w in zip(rows, brute(TEXTS), strict=True)), key=repr)
    got = sorted(map(tuple, alignment.op13_cross_tokenizer(spark, str(tmp_path)).collect()), key=repr)
    assert got == want
    assert sum(w[1] > 0 for w in want) > 8 and sum(w[1] == 0 for w in want) >= 2


def test_both_joins_and_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    args = public.path("byte_bpe_50k.json"), public.PATTERN, public.path("piece_bpe_32k.model")
    rows = docs.select("doc_id", "text").collect()
    want = sorted((r["doc_id"], *w) for r, w in zip(rows, brute([r["text"] for r in rows]), strict=True))
    assert sorted(map(tuple, alignment.cross_tokenizer(docs, *args).collect())) == want
    assert sorted(map(tuple, alignment.cross_tokenizer(docs, *args, broadcast_pairs=0).collect())) == want


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert alignment.op13_cross_tokenizer(spark, str(tmp_path)).count() == 0


def test_encoders_agree_on_every_character():
    a = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    with open(public.path("byte_bpe_50k.json"), "rb") as f, open(public.path("piece_bpe_32k.model"), "rb") as g:
        sides = alignment.Sides(f.read(), public.PATTERN, g.read())
    for start in range(0, 0x30000, 512):
        text = "".join(f"a{chr(c)}b {chr(c)}1{chr(c)}" for c in range(start, start + 512) if not 0xD800 <= c < 0xE000)
        assert sides.encode_a([text], [text.encode()])[0] == a.encode(" " + text, add_special_tokens=False).ids, hex(start)


@pytest.mark.parametrize("seed", range(20))
def test_union_find(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 60))
    a, b = rng.integers(0, n, (2, int(rng.integers(0, 60))))
    label = list(range(n))
    for _ in range(n):
        for x, y in zip(a, b, strict=True):
            label[x] = label[y] = min(label[x], label[y])
    assert alignment.components(a, b, n).tolist() == label
