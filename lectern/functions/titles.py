"""Whether titles are borne out by the names around them: what is left of each once known things are taken out, and a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import chunks, names, quality
from lectern.functions.similarity import match_title

# Words that are no part of a title's identity.
STOPWORDS = ("of", "the", "a", "an", "and", "or", "to", "in", "on", "at", "by", "for", "with")
NO_TITLE = ("track", "disc", "disk", "cd", "chapter", "chap", "volume", "vol", "part", "side", "unabridged", "abridged", "intro", "outro", "prologue", "epilogue", "no", "none", "title", "notitle", "untitled", "unknown")
EDGES = r"[!-/:-@\[-`{-~ ]+"


def plain_words(text: Column) -> Column:
    """Distinct runs of ASCII letters and digits in lower case, in order, without single characters and numbers."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: (F.length(w) >= 2) & ~w.rlike("^[0-9]+$")))


def title_words(text: Column) -> Column:
    return F.array_except(plain_words(text), F.array(*map(F.lit, (*STOPWORDS, *NO_TITLE))))


def says_something(text: Column) -> Column:
    return F.coalesce(F.size(title_words(text)) > 0, F.lit(False))


def echoes(name: Column, title: Column) -> Column:
    """Whether a name is the title but for case, blanks and marks at the ends; false with an empty side."""
    key = lambda x: F.regexp_replace(F.lower(names.squeezed(x)), rf"^{EDGES}|{EDGES}$", "")
    return F.coalesce((key(name) != "") & (key(name) == key(title)), F.lit(False))


def without_terms(text: Column, terms: Column) -> Column:
    """A text's words less those of the terms (an array) that have two characters or more."""
    gone = F.filter(F.flatten(F.transform(terms, chunks.words)), lambda w: F.length(w) >= 2)
    return F.array_join(F.filter(F.split(chunks.spaced(text), " "), lambda w: ~F.array_contains(gone, F.lower(w))), " ")


def without_affixes(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``text`` less a series' code (``SB 01 - ``) and a sure sequence number, and as a title to match.

    Each step is a column of its own: written as one expression, what the steps repeat would multiply.
    """
    rest = names.stripped(F.regexp_replace(text, r"(?Ui)^\s*(?:book|bk|[A-Za-z]{1,5})\s*\d{1,3}\s*[-:.]\s*", ""))
    rows = rows.withColumn("_rest", rest).withColumn("_code", F.when(F.col("_rest").rlike(r"\p{L}") & (F.col("_rest") != names.stripped(F.col(text))), F.col("_rest")).otherwise(F.col(text)))
    rows = rows.withColumn("_affix", names.sequence_affix(F.col("_code")))
    rows = rows.withColumn("_plain", F.when(F.col("_affix.strong"), F.col("_affix.cleaned")).otherwise(F.col("_code")))
    return rows.withColumn(text, match_title(F.col("_plain"), strip_year=False)).drop("_rest", "_code", "_affix", "_plain")


def _if_said(text: Column) -> Column:
    return F.when(says_something(text), text).otherwise("")


def title_residuals(rows: DataFrame, title: str, known: str, authors: str, out: str) -> DataFrame:
    """``rows`` with what a title says beyond series and franchise; empty for junk and for the name of a lone author."""
    echo = (F.size(authors) == 1) & echoes(F.col(title), F.get(authors, F.lit(0)))
    junk = quality.structural_marker(F.col(title)) | F.coalesce(echo, F.lit(False))
    rows = without_affixes(rows.withColumn("_junk", junk).withColumn("_t", F.col(title)), "_t").withColumn("_t", without_terms(F.col("_t"), F.col(known)))
    return rows.withColumn(out, F.when(F.col("_junk"), "").otherwise(_if_said(F.col("_t")))).drop("_junk", "_t")


def name_residuals(rows: DataFrame, name: str, known: str, out: str) -> DataFrame:
    """``rows`` with what a folder's or a file's name says beyond authors, series and franchise."""
    rows = rows.withColumn("_base", names.folder_title(F.col(name))["title"]).withColumn("_t", F.when(F.col("_base") != "", F.col("_base")).otherwise(F.col(name)))
    rows = without_affixes(rows.withColumn("_t", without_terms(F.col("_t"), F.col(known))), "_t")
    return rows.withColumn(out, F.when(quality.structural_marker(F.col(name)), "").otherwise(_if_said(F.col("_t")))).drop("_base", "_t")
