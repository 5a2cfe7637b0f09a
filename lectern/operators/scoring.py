"""Identification of books by what catalogues return: candidates ranked, confidence with the signals it is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import quality, titles
from lectern.functions import similarity as sim
from lectern.functions import text as fx
from lectern.operators.steps import kept

# From what score on sources agree, and within how much of the best one authority decides.
AGREES, MARGIN = 0.85, 0.05
BOOK = ("title", "authors", "asin", "isbn", "duration_ms", "abridged")
RESULT = ("provider", "title", "authors", "runtime_ms", "asin", "isbn", "abridged")


def scored(books: DataFrame, results: DataFrame, book: str, order: str) -> DataFrame:
    """``results`` joined to their books (columns ``b_*``) with ``score``, ``rank_score`` and ``closeness``; a result without a book goes.

    The rank adds to the score of title and authors at most 0.10 for a runtime that is close to the book's and takes 0.15 at
    most for one that is far.
    """
    # a book's title is cleaned once, not for each of its results; cleaned titles are columns of their own, so that they cross to Python once
    own = books.select(book, *(F.col(c).alias(f"b_{c}") for c in BOOK), sim.match_title(F.col("title")).alias("_ours"))
    both = results.select(book, order, *RESULT).join(own, book).withColumn("_theirs", sim.match_title(F.col("title")))
    both = both.withColumns({"title_ratio": sim.ratio("_ours", "_theirs"), "score": sim.title_author_score(F.col("_ours"), F.col("b_authors"), F.col("_theirs"), F.col("authors"))})
    timed = (F.col("b_duration_ms") > 0) & (F.col("runtime_ms") != 0)
    off = F.abs(F.col("runtime_ms") - F.col("b_duration_ms"))
    bonus = F.when(timed, F.greatest(F.lit(-0.15), 0.10 - off / F.col("b_duration_ms"))).otherwise(0.0)
    return both.withColumns({"rank_score": F.col("score") + bonus, "closeness": F.when(timed, -off).otherwise(0)}).drop("_ours", "_theirs")


def ranking(found: DataFrame, book: str, order: str) -> DataFrame:
    """``scored`` results with their ``place`` from 1 within the book: best first, equal ones as they came."""
    by = Window.partitionBy(book).orderBy(F.desc("rank_score"), F.desc("closeness"), order)  # the results of one book
    return found.withColumn("place", F.row_number().over(by))


def identify(books: DataFrame, results: DataFrame, book: str, order: str, authority: dict[str, int] | None = None) -> DataFrame:
    """(book, confidence, signals, best, author_inferred): one row a book.

    Signals are (name, points, detail) in the order in which they are judged; their sum, held between 0 and 100, is the
    confidence. ``best`` is the ``order`` of the result that identifies the book, null without results. ``authority`` ranks
    providers from 0; it picks among results nearly as good as the best. Null titles are empty, null arrays have no authors.
    """
    found = ranking(scored(books, results, book, order), book, order)
    known = authority or {}
    last = len(known)
    trust = F.coalesce(F.create_map(*(F.lit(x) for p in known.items() for x in p))[F.col("provider")], F.lit(last)) if known else F.lit(0)
    found = found.withColumn("_trust", trust)
    per_book = Window.partitionBy(book)
    found = found.withColumn("_top", F.max("score").over(per_book))
    # sources that agree on the author of a book that names none
    first_author = F.lower(F.trim(F.get("authors", F.lit(0))))
    found = found.withColumn("_votes_for", F.when((F.size(F.coalesce("b_authors", F.array())) == 0) & (F.col("title_ratio") >= AGREES) & (first_author != ""), first_author))
    # written once: two aggregates read it, and each would score every result again
    used = ("score", "title_ratio", "provider", "runtime_ms", "abridged", "authors", "_trust", "_top", "_votes_for", "place", "asin", "b_asin", "isbn", "b_isbn")
    found = kept(found.select(book, order, *used))
    named = found.where("_votes_for is not null").groupBy(book, "_votes_for").agg(F.count_distinct("provider").alias("n"), F.min_by(F.struct(order, "score", "title_ratio", "provider", "runtime_ms", "abridged", F.get("authors", F.lit(0)).alias("author"), "_trust"), order).alias("inferred"))
    inferred = named.where("n >= 2").groupBy(book).agg(F.count("*").alias("n"), F.min("inferred").alias("inferred")).where("n = 1").select(book, "inferred")
    row = F.struct(order, "score", "title_ratio", "provider", "runtime_ms", "abridged", F.get("authors", F.lit(0)).alias("author"), "_trust")
    near = (F.col("score") >= AGREES) & (F.col("score") >= F.col("_top") - MARGIN)
    agrees = F.col("score") >= AGREES
    sums = found.groupBy(book).agg(
        F.min_by(row, "place").alias("leader"), F.min(F.when(near, F.struct(F.col("_trust").alias("t"), (-F.col("score")).alias("s"), order, row.alias("row")))).alias("trusted"),
        F.bool_or((F.col("asin") != "") & (F.col("asin") == F.col("b_asin"))).alias("asin_hit"), F.bool_or((F.col("b_isbn") != "") & fx.same_isbn(F.col("isbn"), F.col("b_isbn"))).alias("isbn_hit"),
        F.count_distinct(F.when(agrees, F.col("provider"))).alias("agreeing"), F.max(F.when(agrees, F.col("score"))).alias("quality"),
    )
    all_of = books.select(book, *BOOK).join(sums, book, "left").join(inferred, book, "left")
    picked = F.coalesce("inferred", *([F.col("trusted.row")] if known else []), "leader")
    return judged(all_of.withColumn("_best", picked), book, order, known)


def judged(rows: DataFrame, book: str, order: str, known: dict[str, int]) -> DataFrame:
    """The signals of ``identify`` from one row a book."""
    two = lambda c: F.format_string("%.2f", F.bround(c, 2))
    percent = lambda c: F.format_string("%d%%", F.bround(c * 100).cast("long"))
    some = F.col("leader").isNotNull()
    best, off = F.col("_best"), F.abs(F.col("_best.runtime_ms") - F.col("duration_ms")) / F.col("duration_ms")
    timed = some & (F.col("duration_ms") > 0) & (F.col("_best.runtime_ms") != 0)
    formats = some & F.col("abridged").isNotNull() & F.col("_best.abridged").isNotNull()

    def signal(name: str, when: Column, points: Column | int, detail: Column | str) -> Column:
        whole = (points if isinstance(points, Column) else F.lit(points)).cast("int")
        return F.when(when, F.struct(F.lit(name).alias("name"), whole.alias("points"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail")))

    rounded = lambda c: F.bround(c).cast("int")
    highest = max(known.values(), default=0)
    bonus = rounded(F.lit(10) * (1 - F.col("_best._trust") / F.lit(highest))) if highest > 0 else F.lit(10)
    signals = [
        signal("embedded_core", (F.col("title") != "") & (F.size("authors") > 0), 15, "title+author present"),
        signal("cross_source_author_consensus", F.col("inferred").isNotNull(), rounded(60 * F.col("inferred.title_ratio")), F.concat(F.lit("author '"), F.col("inferred.author"), F.lit("' inferred from agreeing sources"))),
        signal("asin_exact_match", F.col("asin_hit"), 60, F.concat(F.lit("ASIN "), F.col("asin"))),
        signal("isbn_exact_match", F.col("isbn_hit"), 60, F.concat(F.lit("ISBN "), F.col("isbn"))),
        signal("cross_source_agreement", F.col("agreeing") >= 2, rounded(60 * F.col("quality")), F.concat(F.col("agreeing").cast("string"), F.lit(" providers agree ("), two(F.col("quality")), F.lit(")"))),
        signal("single_source_match", F.col("agreeing") == 1, rounded(30 * F.col("quality")), F.concat(F.lit("1 provider agrees ("), two(F.col("quality")), F.lit(")"))),
        signal("disagreement_penalty", some & (F.col("_best.score") < 0.5), -25, F.concat(F.lit("best match "), two(F.col("_best.score")))),
        signal("runtime_match", timed & (off <= 0.05), 12, F.concat(F.lit("runtime within "), percent(off))),
        signal("runtime_mismatch", timed & (off >= 0.25), -15, F.concat(F.lit("runtime off by "), percent(off), F.lit(" (abridged or wrong edition?)"))),
        signal("format_match", formats & (F.col("abridged") == F.col("_best.abridged")), 5, "abridged flag agrees"),
        signal("format_mismatch", formats & (F.col("abridged") != F.col("_best.abridged")), -15, "abridged flag differs"),
        signal("source_authority", some & (F.col("_best.score") >= AGREES) & (bonus > 0) & F.lit(bool(known)), bonus, F.concat(F.col("_best.provider"), F.lit(" (authority #"), (F.col("_best._trust") + 1).cast("string"), F.lit(")"))),
    ]
    held = rows.withColumn("signals", F.array_compact(F.array(*signals)))
    total = F.aggregate("signals", F.lit(0), lambda acc, s: acc + s["points"])
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(100.0), total.cast("double")))
    return held.select(book, confidence.alias("confidence"), "signals", best[order].alias("best"), F.col("inferred").isNotNull().alias("author_inferred"))


def similar_pairs(rows: DataFrame, key: str, name: str, block: list[str], least: float) -> DataFrame:
    """(a, b, score): pairs a < b of distinct names of a block whose ratio is at least ``least``, each name by its smallest key.

    Names of a block are joined; the bound by lengths drops pairs in the JVM, that by characters before blocks are looked for,
    and neither drops a pair that reaches ``least``. Equal names are one row; null names, blocks and keys are left out.
    """
    known = F.concat(*(F.col(c).cast("string") for c in (key, name, *block))).isNotNull()
    kinds = rows.where(known & (F.trim(name) != "")).groupBy(*block, F.lower(F.trim(name)).alias("_name")).agg(F.min(key).alias("_key"))
    words = F.array_distinct(F.filter(F.split("_name", r"\s+"), lambda w: w != ""))
    # as many tasks as the session has partitions: the names are few, their pairs are not
    kinds = kinds.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *block)
    side = lambda s: kinds.select(*block, F.col("_key").alias(s), F.col("_name").alias(f"_{s}"), words.alias(f"_w{s}"))
    both = side("a").join(side("b"), block).where("a < b")
    shared = F.size(F.array_intersect("_wa", "_wb"))
    by_words = shared >= F.lit(least) * (F.size("_wa") + F.size("_wb") - shared)
    open_pairs = both.where((sim.length_bound(F.col("_a"), F.col("_b")) >= least) | by_words)
    return open_pairs.select("a", "b", sim.ratio_from("_a", "_b", F.lit(least)).alias("score")).where(F.col("score") >= least)


def identity_confidence(authors: Column, authors_from: Column, author_folder: Column, series: Column, series_from: Column, series_folder: Column, title: Column, verdict: Column) -> Column:
    """How sure a book's local identity is, 0 to 100: by its author or series, whichever is surer, a little more with both.

    A user or a match is sure, a tag nearly; what else a value comes from is as sure as the folder's kind. A junk author counts for
    less, a title that its surroundings contradict halves, none takes 30 %, and an author that is the title halves. Null arrays
    and texts are absent; without author and series it is 0.
    """
    sure = lambda source, folder: F.when(source.isin("manual", "match"), 1.0).when(source.isin("tag", "datafile"), 0.9).otherwise(F.coalesce(folder, F.lit(0.0)))
    authored, serial = F.coalesce(F.size(authors) > 0, F.lit(False)), F.coalesce(series != "", F.lit(False))
    junk = F.array_max(F.transform(authors, quality.author_junk))
    a = F.when(authored, sure(authors_from, author_folder) * (1.0 - junk)).otherwise(0.0)
    s = F.when(serial, sure(series_from, series_folder)).otherwise(0.0)
    base = F.least(F.lit(1.0), F.greatest(a, s) + F.when((a > 0) & (s > 0), 0.1).otherwise(0.0))
    told = F.when(F.coalesce(title, F.lit("")) == "", 0.7).when(verdict == "contradict", 0.5).otherwise(1.0)
    echo = F.when(F.coalesce((F.size(authors) == 1) & titles.echoes(F.get(authors, F.lit(0)), title), F.lit(False)), 0.5).otherwise(1.0)
    return F.bround(base * told * echo * 100).cast("long")
