"""Which books need a human: confidence bands, trust in where an identity comes from, missing fields, the facets that combine them.

Books hold state, confidence, identity_confidence, authors_prov, series_prov, series, narrators (arrays), cover, asin, isbn, year, findings and
acknowledged (arrays of codes), missing. Nulls are absent values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# States that need nobody, sources that only guess, sources on the spot, bounds of the bands, findings that block or don't count.
DONE = ("ready", "organized", "encoded", "skipped")
WEAK = ("directory", "filename", "graphing")
LOCAL = ("tag", "datafile", "directory", "filename", "graphing", "manual")
LOW, HIGH = 40.0, 75.0
FIELDS = ("series", "cover", "ident", "narrator", "year")


def effective_confidence() -> Column:
    """The confidence after matching if there is any, else that of the local identification."""
    return F.when(F.coalesce("confidence", F.lit(0.0)) > 0, F.col("confidence")).otherwise(F.coalesce("identity_confidence", F.lit(0.0)))


def confidence_bucket() -> Column:
    return F.when(effective_confidence() >= HIGH, "high").when(effective_confidence() >= LOW, "mid").otherwise("low")


def needs_human() -> Column:
    return ~F.coalesce(F.col("state").isin(*DONE), F.lit(False))


def _tier(source: str) -> Column:
    return F.when(F.col(source) != "", F.when(F.col(source).isin(*LOCAL), F.col(source)).otherwise("match"))


def identity_tiers() -> Column:
    """Distinct tiers of trust of author and series: a local source as it is, any other is ``match``."""
    return F.array_distinct(F.array_compact(F.array(_tier("authors_prov"), _tier("series_prov"))))


def weak_identity() -> Column:
    """(field, source) of the guess that an identity rests on, the author first; null where there is none."""
    guess = lambda field, source: F.when(F.col(source).isin(*WEAK), F.struct(F.lit(field).alias("field"), F.col(source).alias("source")))
    return F.coalesce(guess("author", "authors_prov"), guess("series", "series_prov"))


def missing_fields() -> Column:
    """Names of the fields that are absent; any code identifies a book."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    lost = {"series": none("series"), "cover": empty("cover"), "ident": empty("asin") & empty("isbn"), "narrator": none("narrators"), "year": F.col("year").isNull()}
    return F.array_compact(F.array(*(F.when(lost[f], f) for f in FIELDS)))


def open_findings(suppressed: tuple[str, ...] = ()) -> Column:
    """Whether a finding is neither acknowledged nor of a suppressed kind."""
    known = F.concat(F.coalesce("acknowledged", F.array().cast("array<string>")), F.array(*map(F.lit, suppressed)).cast("array<string>"))
    return F.coalesce(F.size(F.array_except("findings", known)) > 0, F.lit(False))


def blocked(blocking: tuple[str, ...]) -> Column:
    """Whether the files are gone or a finding makes writing impossible."""
    return F.coalesce(F.col("missing"), F.lit(False)) | F.coalesce(F.arrays_overlap("findings", F.array(*map(F.lit, blocking)).cast("array<string>")), F.lit(False))


def facets(chosen: dict, blocking: tuple[str, ...] = (), suppressed: tuple[str, ...] = ()) -> Column:
    """All facets that are set at once: state, confidence, id_trust and missing are lists of which one must hold; findings, errors and needs_work are switches. Empty ones ask for nothing."""
    some = lambda name, has: has(list(chosen[name])) if chosen.get(name) else F.lit(True)
    listed = lambda values: F.array(*map(F.lit, values))
    switch = lambda name, test: test if chosen.get(name) else F.lit(True)
    tests = [
        some("state", lambda v: F.coalesce(F.col("state").isin(*v), F.lit(False))), some("confidence", lambda v: confidence_bucket().isin(*v)), some("id_trust", lambda v: F.arrays_overlap(identity_tiers(), listed(v))),
        some("missing", lambda v: F.arrays_overlap(missing_fields(), listed(v))), switch("findings", open_findings(suppressed)), switch("errors", blocked(blocking)), switch("needs_work", needs_human()),
    ]
    return reduce(lambda a, b: a & b, tests)


def order(key: str) -> list[Column]:
    """Sort order of a list of books: ``conf_asc``, ``conf_desc`` or ``title``; ties of confidence by title."""
    title = F.lower(F.coalesce("title", F.lit("")))
    return {"conf_asc": [effective_confidence(), title], "conf_desc": [effective_confidence().desc(), title], "title": [title]}.get(key, [])
