"""Column functions that tell values which name nothing: placeholders, structural marks, junk in place of an author."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import names

# Words of structure, with and without a number behind them, and names of fields that a tagger left as values.
NUMBERED = "track|disc|cd|chapter|volume|vol|part"
MARKERS = "track|disc|disk|cd|chapter|chap|volume|vol|part|side"
FIELD_NAMES = r"artist|album|title|composer|album\s*artist"


def word_set(text: Column) -> Column:
    """Distinct words of a text in lower case, cut at all punctuation."""
    return F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(text, r"(?U)[\W_]+", " ")), " "), lambda w: w != ""))


def resembles(a: Column, b: Column) -> Column:
    """Whether one name's words are all among the other's; false with an empty or null side."""
    x, y = word_set(a), word_set(b)
    within = (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)
    return F.coalesce((F.size(x) > 0) & (F.size(y) > 0) & within, F.lit(False))


def placeholder_title(value: Column) -> Column:
    """``Track 3``, ``Unknown Album``, ``Untitled`` or a field's name; null and empty are none."""
    return F.coalesce(names.stripped(value).rlike(rf"(?Ui)^(?:(?:{NUMBERED})\s*\d+|unknown(?:\s.*)?|untitled|{FIELD_NAMES})$"), F.lit(False))


def index_title(value: Column) -> Column:
    """A number or ``01 of 15``."""
    return F.coalesce(names.stripped(value).rlike(r"(?Ui)^(?:\d{1,4}|\d{1,3}\s+of\s+\d{1,3})$"), F.lit(False))


def structural_marker(value: Column) -> Column:
    """What names no identity: blank, one character, a placeholder, a track or chapter mark in front, a number, a bare word of structure. Null is one, too."""
    v = F.coalesce(names.stripped(value), F.lit(""))
    marked = v.rlike(rf"(?Ui)^\s*(?:{MARKERS})\s*\d") | v.rlike(rf"(?Ui)^(?:{MARKERS})\s*\d*$")
    return (F.length(v) <= 1) | placeholder_title(v) | index_title(v) | marked


def author_junk(value: Column) -> Column:
    """How far a value is from an author's name, 0 to 1: structure, a book's number, a whole ``Author.-.Title`` and ``(5)`` are 1, a count in it 0.9."""
    v = F.coalesce(names.stripped(value), F.lit(""))
    numbered = v.rlike(r"(?Ui)\(\s*.+?#?\s*\d") | names.sequence_affix(v).isNotNull()
    shaped = numbered | v.rlike(r"(?U)\.\s*-\s*\.") | v.rlike(r"(?U)^\s*[(\[]\s*\d{1,3}\s*[)\]]\s*$") | v.rlike(r"(?Ui)[(\[]\s*series\b")
    counted = F.size(names.enumeration(F.replace(v, F.lit("_"), F.lit(" ")))["pairs"]) > 0
    return F.when(structural_marker(v) | shaped, 1.0).when(counted, 0.9).otherwise(0.0)
