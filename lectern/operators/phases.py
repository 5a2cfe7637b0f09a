"""The pipeline's phases of each book as rows (book, phase, state): what a change makes stale, the book's state, the funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phases in order, what alone makes a phase stale where that isn't all before it, thresholds of confidence.
PHASES = ("search", "categorize", "identify", "match", "tag", "organize", "encode")
ONLY_AFTER = {"encode": ("search",)}
READY, IDENTIFIED = 75.0, 60.0
STATES = ("pending", "fresh", "stale", "running", "failed")


def rank(phase: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, PHASES)), phase)


def makes_stale(changed: Column, target: Column) -> Column:
    """Whether a change of one phase makes another stale: any before it, but for those that name what they depend on."""
    plain = rank(changed) < rank(target)
    for phase, causes in ONLY_AFTER.items():
        plain = F.when(target == phase, changed.isin(*causes)).otherwise(plain)
    return plain


def invalidate(phases: DataFrame, changes: DataFrame) -> DataFrame:
    """``phases`` after ``changes`` (book, phase), with ``staled`` for rows that a change of another phase made stale.

    The changed phase itself becomes stale and gets a row if it has none; later ones only if they ran, so that what is pending
    stays so. Several changes of a book act together; repeated ones count once.
    """
    causes = changes.select("book", F.col("phase").alias("_cause")).distinct().groupBy("book").agg(F.collect_set("_cause").alias("_causes"))  # at most seven
    named = changes.select("book", "phase").distinct().join(phases.select("book", "phase"), ["book", "phase"], "left_anti").withColumn("state", F.lit("pending"))
    met = phases.select("book", "phase", "state").unionByName(named).join(causes, "book", "left")
    own = F.coalesce(F.array_contains("_causes", F.col("phase")), F.lit(False))
    ran = F.col("state") != "pending"
    below = F.coalesce(F.exists("_causes", lambda c: makes_stale(c, F.col("phase"))), F.lit(False)) & ran
    return met.select("book", "phase", F.when(own | below, "stale").otherwise(F.col("state")).alias("state"), (below & ~own).alias("staled"))


def states(books: DataFrame, phases: DataFrame, ready: float = READY, identified: float = IDENTIFIED) -> DataFrame:
    """(book, state) of every book: the first rung of the ladder that its phases and confidences reach.

    ``books`` hold skipped, confirmed, confidence, identity_confidence, has_identity; nulls are false and 0. A phase without a
    row is pending; of several rows of a phase any counts.
    """
    fresh = lambda *names: F.coalesce(F.bool_or((F.col("state") == "fresh") & F.col("phase").isin(*names)), F.lit(False))
    any_of = lambda state: F.coalesce(F.bool_or(F.col("state") == state), F.lit(False))
    facts = phases.groupBy("book").agg(any_of("failed").alias("failed"), any_of("running").alias("running"), fresh("organize").alias("organized"), fresh("encode").alias("encoded"), fresh("identify", "match").alias("known"))
    met = books.join(facts, "book", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    number = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    ladder = (
        F.when(yes("skipped"), "skipped").when(yes("failed"), "failed").when(yes("running"), "encoding").when(yes("organized"), "organized").when(yes("encoded"), "encoded")
        .when(~yes("known"), "detected").when(yes("confirmed") | ((number("confidence") >= ready) & yes("has_identity")), "ready").when(yes("has_identity") & (number("identity_confidence") >= identified), "identified").otherwise("needs_review")
    )
    return met.select("book", ladder.alias("state"))


def funnel(phases: DataFrame) -> DataFrame:
    """(phase, n) of all phases in order: books for which the phase is fresh, each counted under every such phase."""
    counts = phases.where("state = 'fresh'").groupBy("phase").agg(F.count_distinct("book").alias("n"))
    known = phases.sparkSession.createDataFrame([(p,) for p in PHASES], "phase string")
    return known.join(counts, "phase", "left").select("phase", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
