"""Column functions that cut file names: into tokens of a cohort, and into chunks whose words and numbers are compared across a folder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import names

# Words of structure that belong to the number behind them, marks of chapters, and chunks that stand for one.
STRUCTURE = ("part", "pt", "ch", "chap", "chapter", "track", "trk", "disc", "cd", "side", "vol", "volume", "section", "sect")
FRONT_MATTER = "epilogue|prologue|intro(?:duction)?|outro|preface|foreword|afterword|interlude|appendix"

_BRACKET = r"\([^()]*\)|\[[^\]]*\]"
#: A run of padding with a hyphen in it, or a hyphen without a letter or digit on one of its sides.
_SEPARATOR = r"(?U)(?=[\s._]*-)[\s._-]{2,}|(?<![^\W_])-|-(?![^\W_])"
_DOTS = r"(?<=[A-Za-z])\.(?=\d)|(?<=\d)\.(?=[A-Za-z])"
_SPACED_CUT = rf"(?U)[()\[\]_]+|(?<=\s)-+|-+(?=\s)|{_DOTS}"
_KEBAB_CUT = rf"(?U)[()\[\]_\-]+|{_DOTS}"
_COMPOUND = r"[0-9]{1,3}(?:[-/x][0-9]{1,3})+"


def _filled(parts: Column) -> Column:
    return F.filter(F.transform(parts, names.stripped), lambda p: p != "")


def segments(name: Column) -> Column:
    """A name cut at its hyphens, but for those inside a word (``X-Wing``, ``27-60``)."""
    return _filled(F.split(F.regexp_replace(name, _SEPARATOR, "\u0001"), "\u0001| - "))


def cohort_tokens(name: Column) -> Column:
    """Tokens of a name: of each segment first its ``(...)`` and ``[...]``, then the text around them. Null gives none."""
    cut = lambda s: F.concat(F.regexp_extract_all(s, F.lit(f"({_BRACKET})"), F.lit(1)), F.split(s, _BRACKET))
    return _filled(F.flatten(F.transform(segments(F.coalesce(name, F.lit(""))), cut)))


def comparable(text: Column) -> Column:
    """A text in lower case with single blanks."""
    return names.squeezed(F.lower(text))


def chunks(stem: Column) -> Column:
    """A stem cut at brackets, underscores and dots between letters and digits, and at its dashes: those beside white space, or, in a stem without any, all.

    A number of several parts in front of a chunk's text (``01-04-Keith``) is a chunk of its own.
    """
    cut = F.when(stem.rlike(r"(?U)\s"), F.split(stem, _SPACED_CUT)).otherwise(F.split(stem, _KEBAB_CUT))
    glued = rf"(?Udi)^({_COMPOUND})-(.+)$"
    opened = lambda c: F.when(c.rlike(glued), F.array(F.regexp_extract(c, glued, 1), names.stripped(F.regexp_extract(c, glued, 2)))).otherwise(F.array(c))
    return F.flatten(F.transform(_filled(cut), opened))


def spaced(chunk: Column) -> Column:
    """A chunk to show: blanks where letters meet capitals or digits, commas to blanks."""
    s = F.regexp_replace(chunk, "(?<=[a-z])(?=[A-Z])", " ")
    s = F.regexp_replace(s, r"(?Ui)(?<=[^\W\d_])-(?=[0-9]{1,3}\s+of\s+[0-9])", " ")
    s = F.regexp_replace(s, r"(?i)(?<=[0-9])(of)(?=[0-9])", " $1 ")
    s = F.regexp_replace(s, "(?<=[A-Za-z])(?=[0-9])", " ")
    return names.squeezed(F.replace(s, F.lit(","), F.lit(" ")))


def words(chunk: Column) -> Column:
    return F.filter(F.split(F.lower(spaced(chunk)), " "), lambda w: w != "")


def is_index(word: Column) -> Column:
    """A number, several joined, one with a letter, or a part's mark."""
    return word.rlike(rf"(?i)^(?:[0-9]+(?:\.[0-9]+)?|{_COMPOUND}|[0-9]{{1,3}}[a-z])$") | names.part_of(word).isNotNull()


def signature(chunk: Column) -> Column:
    """A chunk's words without numbers, words of structure in front of one, and ``of`` beside one, joined by blanks."""
    all_of = F.transform(words(chunk), lambda w: F.struct(w.alias("w"), is_index(w).alias("i")))
    beside = lambda k: F.coalesce(F.get(all_of, k)["i"], F.lit(False))
    text = lambda x, k: ~x["i"] & ~(x["w"].isin(*STRUCTURE) & beside(k + 1)) & ~((x["w"] == "of") & (beside(k + 1) | beside(k - 1)))
    return F.array_join(F.transform(F.filter(all_of, text), lambda x: x["w"]), " ")


def chapter_mark(chunk: Column) -> Column:
    """Whether a chunk is ``Chap 01`` or the like, or front matter."""
    return F.lower(spaced(chunk)).rlike(rf"(?U)^(?:(?:{'|'.join(STRUCTURE)})\s+[0-9]+(?:\.[0-9]+)?|{FRONT_MATTER})$")


def title_chunks(stem: Column, cut: Column) -> Column:
    """Chunks from the first that a title may start with: compound numbers in front go, numbers too unless they hang on the title; the last chunk stays."""
    first = lambda parts, start, keep: F.array_min(F.concat(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: (k >= start) & keep(F.get(parts, k))), F.array(F.size(parts) - 1)))
    joined = lambda c: (F.size(words(c)) > 0) & F.forall(words(c), lambda w: w.rlike(rf"(?i)^{_COMPOUND}$"))
    begin = first(cut, F.lit(0), lambda c: ~joined(c))
    weak = F.coalesce(~names.sequence_affix(stem)["strong"], F.lit(False))
    start = F.when(weak, begin).otherwise(first(cut, begin, lambda c: signature(c) != ""))
    return F.when(F.size(cut) > 0, F.slice(cut, start + 1, F.size(cut))).otherwise(cut)


_TRAILING = r"(?U)\s+[0-9]{1,3}(?:\.[0-9]{1,2})?\s*$"


def without_number(text: Column) -> Column:
    return names.stripped(F.regexp_replace(text, _TRAILING, ""))


def series_of(cut: Column) -> Column:
    """(series, sequence) of the first chunk that ends in a number, ``N of M`` left out; null if there is none."""
    shown = F.transform(cut, lambda c: names.stripped(F.regexp_replace(spaced(c), r"(?Ui)\b[0-9]{1,3}\s+of\s+[0-9]{1,3}\b", " ")))
    found = F.get(F.filter(shown, lambda s: s.rlike(_TRAILING)), F.lit(0))
    number = F.regexp_extract(found, r"(?U)\s+([0-9]{1,3}(?:\.[0-9]{1,2})?)\s*$", 1).cast("double")
    return F.when(found.isNotNull(), F.struct(F.when(without_number(found) != "", without_number(found)).alias("series"), number.alias("sequence")))
