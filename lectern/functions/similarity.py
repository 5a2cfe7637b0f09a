"""Similarity of names: the ratio of two texts, its upper bounds, and the title and author score of a match.

The sequence part of a ratio is that of the standard library's ``difflib``: twice the length of the longest matching blocks,
found one inside the other, by the sum of both lengths. It runs on Arrow columns; the bounds that spare most pairs are cheaper:
by lengths in the JVM, by character counts before blocks are looked for. Names repeat, so a worker keeps the ratios of the last
pairs it met.
"""

from __future__ import annotations

import difflib
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Words that mark a bracket as an edition or a genre and not as part of the title.
EDITION_WORDS = "edition|unabridged|abridged|dramati[sz]ed|version|remaster(?:ed)?|deluxe|complete|movie tie-in|audiobook"
GENRE_WORDS = "non-?fiction|fiction"
TITLE_SHARE, AUTHOR_SHARE = 0.7, 0.3
# Fixed value: pairs of names whose ratios a worker keeps.
REMEMBERED = 100_000


def plain(text: str | None) -> str:
    return (text or "").strip().lower()


def token_share(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    return len(x & y) / len(x | y) if x and y else 0.0


def most(a: str, b: str) -> float:
    """Upper bound of the sequence ratio of two texts: twice the characters that both hold by the sum of their lengths."""
    return 2.0 * sum((Counter(a) & Counter(b)).values()) / (len(a) + len(b))


@lru_cache(REMEMBERED)
def of_pair(a: str | None, b: str | None, least: float = 0.0) -> float:
    """Larger one of sequence ratio and Jaccard similarity of the words, without case and outer blanks; 0 with an empty side.

    Under ``least`` the value may be any that is below it, so that blocks are only looked for where the bound allows more.
    """
    a, b = plain(a), plain(b)
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    words = token_share(a, b)
    if most(a, b) < max(least, words):
        return words
    return max(difflib.SequenceMatcher(None, a, b).ratio(), words)


def best_author(a: list[str], b: list[str]) -> float:
    return max((of_pair(x, y) for x in a for y in b), default=0.0)


@F.arrow_udf(DoubleType())
def ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """``of_pair`` of two text columns."""
    return pa.array([of_pair(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


@F.arrow_udf(DoubleType())
def ratio_from(a: pa.Array, b: pa.Array, least: pa.Array) -> pa.Array:
    """``of_pair`` of two text columns, exact from ``least`` on."""
    return pa.array([of_pair(*x) for x in zip(a.to_pylist(), b.to_pylist(), least.to_pylist(), strict=True)], pa.float64())


@F.arrow_udf(DoubleType())
def _best_author(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([best_author(x or [], y or []) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


def length_bound(a: Column, b: Column) -> Column:
    """Upper bound of the sequence ratio by the lengths alone, in the JVM; null with a null side."""
    x, y = F.length(F.trim(a)), F.length(F.trim(b))
    return 2.0 * F.least(x, y) / F.greatest(x + y, F.lit(1))


def match_title(title: Column, strip_year: bool = True) -> Column:
    """Title without a year in front of a dash (if ``strip_year``), brackets that name an edition or a genre, and a last ``(un)abridged``.

    The title itself if nothing would be left; null gives the empty text.
    """
    out = F.regexp_replace(title, r"^\s*\(?\d{4}\)?\s*[-–—]\s*", "") if strip_year else title
    for words in (EDITION_WORDS, GENRE_WORDS):
        out = F.regexp_replace(out, rf"(?i)\s*[(\[][^)\]]*\b(?:{words})\b[^)\]]*[)\]]", "")
    out = F.regexp_replace(out, r"(?i)\s*[-–—:]?\s*\b(?:unabridged|abridged)\b\s*$", "")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    return F.coalesce(F.when(out != "", out).otherwise(title), F.lit(""))


def title_author_score(title_a: Column, authors_a: Column, title_b: Column, authors_b: Column) -> Column:
    """0.7 of the titles' ratio and 0.3 of the best ratio of two authors (arrays; none: 0)."""
    return F.lit(TITLE_SHARE) * ratio(title_a, title_b) + F.lit(AUTHOR_SHARE) * _best_author(authors_a, authors_b)
