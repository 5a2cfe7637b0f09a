"""Snapshots of files: changes, gaps, findings, similarity of part sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import names
from lectern.operators import pairs


def changes(old: DataFrame, new: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """(key, change): added, removed, modified or same, by a null-safe comparison."""
    a = old.select(key, F.struct(*compared).alias("a"))
    b = new.select(key, F.struct(*compared).alias("b"))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("modified")
    return a.join(b, key, "full_outer").select(key, kind.alias("change"))


#: Fewest numbers that make a sequence, and the largest first number before which others are taken to be missing.
LEAST, LEADING = 3, 3


def holes(held: Column) -> Column:
    """Numbers that a part's sorted distinct numbers lack, null without a sure gap.

    Holes lie between the least and the largest number, and before the least one if that is 2 or 3. Parts of fewer than three
    numbers, or with more holes than numbers, have none; so no list grows beyond what the part holds.
    """
    low, high, n = F.array_min(held), F.array_max(held), F.size(held)
    first = F.when((low > 1) & (low <= LEADING), F.lit(1)).otherwise(low)
    missing = high - first + 1 - n
    return F.when((n >= LEAST) & (missing > 0) & (missing <= n), F.array_except(F.sequence(first, high), held))


def gaps(rows: DataFrame, part: str, number: str) -> DataFrame:
    """(part, n_missing, missing): numbers absent from the part's sequence; parts without a sure gap are left out. Nulls don't count."""
    held = rows.where(F.col(number).isNotNull()).groupBy(part).agg(F.array_sort(F.collect_set(F.col(number).cast("long"))).alias("held"))  # at most a part's numbers
    return held.select(part, holes(F.col("held")).alias("lost")).where("lost is not null").select(part, F.size("lost").alias("n_missing"), F.array_join("lost", ",").alias("missing"))


def missing_tracks(rows: DataFrame, part: str, name: str, track: str) -> DataFrame:
    """(part, by, n_missing, missing): files that a part lacks by the names and tracks of those it has; parts without a sure gap are left out.

    ``total``: every name has an ``N of M`` mark with one M, and their numbers, ranges included, cover 1..M at most once and
    nothing beyond; what isn't covered is missing, also at the end, unless that is more than what is there. That no number is
    covered twice shows in the sum of the ranges' lengths, which then is the size of their union. Otherwise ``track``: all tracks
    are known and distinct, or ``name``: all names have a number of their own in front (after a word like ``Chapter``, if it is
    the same for all), and these have ``holes``. A part's summary is combined before it moves; numbers of marks have three
    digits, which bounds its sets.
    """
    mark = F.get(F.filter(names.part_marks(F.col(name)), lambda m: m["total"].isNotNull()), F.lit(0))
    low, high = F.col("_m.index"), F.coalesce("_m.end", "_m.index")
    single = lambda n: F.when(F.size(names.track_index(n)["components"]) == 1, names.track_index(n)["components"][0]).cast("long")
    text = F.coalesce(F.col(name), F.lit(""))
    plain = rows.select(part, F.col(track).cast("long").alias("_t"), mark.alias("_m"), single(text).alias("_plain"), single(names.without_leading_word(text)).alias("_after"), F.when(names.stripped(text) != "", names.leading_word(text)).alias("_word"), (names.stripped(text) != "").alias("_some"))
    numbers = lambda c: F.array_sort(F.collect_set(c))
    sums = plain.groupBy(part).agg(
        F.count("*").alias("n"), F.count("_m").alias("marked"), F.min("_m.total").alias("total"), F.max("_m.total").alias("other_total"), F.sum(F.greatest(high - low + 1, F.lit(0))).alias("length"),
        F.collect_set(F.when(high >= low, F.struct(low.alias("low"), high.alias("high")))).alias("ranges"), numbers("_t").alias("tracks"), F.count("_t").alias("n_tracks"), numbers("_plain").alias("plain"), F.count("_plain").alias("n_plain"),
        numbers("_after").alias("after"), F.count("_after").alias("n_after"), F.count(F.when(F.col("_some"), 1)).alias("named"), F.count("_word").alias("worded"), F.min("_word").alias("word"), F.max("_word").alias("other_word"),
    )
    covered = F.array_distinct(F.flatten(F.transform("ranges", lambda r: F.sequence(r["low"], r["high"]))))
    sums = sums.withColumn("covered", covered)
    exact = (F.col("marked") == F.col("n")) & (F.col("total") == F.col("other_total")) & (F.col("length") == F.size("covered")) & (F.coalesce(F.array_max("covered"), F.lit(0)) <= F.col("total"))
    left = F.array_except(F.when(F.col("total") > 0, F.sequence(F.lit(1), "total")).otherwise(F.array().cast("array<int>")), "covered")
    shared = (F.col("named") > 0) & (F.col("worded") == F.col("named")) & (F.col("word") == F.col("other_word"))
    whole = lambda values, count: (F.col(count) == F.col("n")) & (F.size(values) == F.col("n"))
    by = F.when(exact, "total").when(whole("tracks", "n_tracks"), "track").when(F.when(shared, whole("after", "n_after")).otherwise(whole("plain", "n_plain")), "name")
    lost = F.when(F.col("by") == "total", F.when(F.size(left) <= F.size("covered"), F.transform(left, lambda x: x.cast("long"))))
    lost = lost.when(F.col("by") == "track", holes(F.col("tracks"))).when(F.col("by") == "name", holes(F.when(shared, F.col("after")).otherwise(F.col("plain"))))
    found = sums.withColumn("by", by).select(part, "by", F.array_sort(lost).alias("lost")).where(F.size("lost") > 0)
    return found.select(part, "by", F.size("lost").alias("n_missing"), F.array_join("lost", ",").alias("missing"))


def part_order(rows: DataFrame, part: str, name: str, track: str) -> DataFrame:
    """``rows`` with their ``place`` from 1 in the part and what it is ``by``; a part whose order isn't sure has null places and ``by`` blocked.

    ``track``: the tracks are exactly 1..n; ``total``: every name has an ``N of M`` mark with M = n and these are exactly 1..n;
    ``name``: else by the natural order of the names, which must all differ in it. A part of one row is ``single``. A null name
    counts as empty.
    """
    mark = F.get(F.filter(names.part_marks(F.col(name)), lambda m: m["total"].isNotNull()), F.lit(0))
    keyed = rows.where(F.col(part).isNotNull()).withColumns({"_mark": mark, "_key": names.natural_key(F.coalesce(F.col(name), F.lit("")))}).withColumn("_at", F.col("_mark.index"))
    # of 1..n at most n values that lie in 1..n: a permutation if none repeats; a part's rows are only sorted, one shuffle serves all sorts
    own = Window.partitionBy(part)
    again = lambda c: F.coalesce(F.col(c) == F.lag(c).over(own.orderBy(c)), F.lit(False))
    keyed = keyed.withColumns({"_key_again": again("_key"), "_track_again": again(track), "_at_again": again("_at")})
    sums = {
        "_n": F.count("*"), "_same": F.bool_or("_key_again"), "_repeats": F.bool_or("_track_again"), "_tracked": F.count(track), "_t_low": F.min(track), "_t_high": F.max(track), "_at_repeats": F.bool_or("_at_again"), "_marked": F.count("_at"),
        "_m_low": F.min("_at"), "_m_high": F.max("_at"), "_total": F.min("_mark.total"), "_other_total": F.max("_mark.total"),
    }
    n = F.col("_n")
    full = lambda repeats, count, low, high: ~F.col(repeats) & (F.col(count) == n) & (F.col(low) == 1) & (F.col(high) == n)
    by_total = full("_at_repeats", "_marked", "_m_low", "_m_high") & (F.col("_total") == n) & (F.col("_other_total") == n)
    by = F.when(n == 1, "single").when(full("_repeats", "_tracked", "_t_low", "_t_high"), "track").when(by_total, "total").when(~F.col("_same"), "name").otherwise("blocked")
    judged = keyed.withColumns({c: f.over(own) for c, f in sums.items()}).withColumn("by", by)
    order = F.when(F.col("by") == "track", F.col(track).cast("long")).when(F.col("by") == "total", F.col("_at").cast("long"))
    place = F.row_number().over(Window.partitionBy(part).orderBy(order, "_key"))
    return judged.withColumn("place", F.when(F.col("by") != "blocked", place)).select(*rows.columns, "place", "by")


def shared_parts(left: DataFrame, right: DataFrame, owner: str, part: str, least_percent: int) -> DataFrame:
    """Pairs of owners whose part sets have a Jaccard similarity of at least the percentage, by an equi-join on parts."""
    both = pairs.between_sets(left, right, [], owner, part)
    return both.where(F.col("shared") * 100 >= F.col("united") * least_percent).select("a", "b", "shared", "united")


# Upper bounds of bitrate tiers in kbit/s.
TIERS = (64, 96, 128, 192, 256)


def bitrate_tier(bitrate: Column) -> Column:
    """Tier of a bitrate in bit/s, to the nearest 8 kbit/s, so that what a variable rate reports stays in one."""
    kbps = F.bround(bitrate / 8000) * 8
    return F.size(F.filter(F.array(*map(F.lit, TIERS)), lambda t: t < kbps))


def mixed_quality(rows: DataFrame, part: str) -> DataFrame:
    """(part, detail): parts whose files of known bitrate differ in tier, codec, sample rate or channels. Bitrates of 0 and null aren't known."""
    known = rows.where(F.col("bitrate") > 0)
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    tier = bitrate_tier(F.col("bitrate"))
    uniform = F.min(tier) == F.max(tier)
    for c in ("codec", "sample_rate", "channels"):
        uniform = uniform & (F.min(plain(c)) == F.max(plain(c)))
    kbps = F.bround(F.col("bitrate") / 1000).cast("long").cast("string")
    sums = known.groupBy(part).agg(uniform.alias("uniform"), F.array_sort(F.collect_set(F.when(F.col("codec") != "", F.col("codec")))).alias("codecs"), F.min_by(kbps, "bitrate").alias("low"), F.max_by(kbps, "bitrate").alias("high"))
    mixed = F.concat(F.lit("files mix formats ("), F.array_join("codecs", " + "), F.lit(")"))
    return sums.where(~F.col("uniform")).select(part, F.when(F.size("codecs") > 1, mixed).otherwise(F.concat(F.lit("files span "), "low", F.lit("-"), "high", F.lit(" kbps"))).alias("detail"))


def chapters(rows: DataFrame, part: str, start: str, total: str, order: str, shift: int = 0) -> DataFrame:
    """``rows`` with ``place``, ``begin`` and ``end``: starts moved by ``shift`` and held within 0 and the part's total, in their order, each ending where the next one starts, the last at the total."""
    begin = F.least(F.greatest(F.col(start) + shift, F.lit(0)), F.col(total))
    own = Window.partitionBy(part).orderBy("begin", order)
    met = rows.withColumn("begin", begin)
    return met.withColumns({"place": F.row_number().over(own), "end": F.greatest(F.coalesce(F.lead("begin").over(own), F.col(total)), F.col("begin"))})
