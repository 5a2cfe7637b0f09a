"""Files of a folder seen together: what their names share, whether they are one book's parts or several books.

Each folder's files are reduced to summaries that merge (counts, least and greatest values by position), so that a folder of any
size is combined before its rows move; but for constant tokens and clusters, whose windows hold a folder in one task, which spills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import chunks, names, quality
from lectern.operators.steps import Steps, spread

# Weights of the election between one book and many, and its bounds.
WEIGHTS = {"prior": 6.0, "enumeration": 10.0, "pairs": 10.0, "index_titles": 10.0, "constant": 1.0, "key": 1.5, "author": 1.0, "series": 12.0, "album": 8.0}
CONSTANTS_MOST, WHOLE_BOOK_SECONDS, ALBUM_FILES = 3, 10_800, 8
#: Files that one task sorts, about; a larger folder stays whole and spills.
TASK_FILES = 500_000
#: Bytes of distinct stems, 32 more for each, whose readings are broadcast: some 40,000 stems.
STEM_BYTES = 1 << 21


def same(c: Column | str) -> Column:
    """Whether all values of a group are one, nulls aside."""
    return F.min(c) == F.max(c)


def constant_tokens(rows: DataFrame, part: str, name: str, order: str) -> DataFrame:
    """(part, token, place): tokens that every name of a part has, compared without case, as the first name by ``order`` writes them.

    Each row says by bits, 64 tokens a number, which tokens of the first name it has; what all rows have is left. Nothing but a
    part's rows is held, which are sorted together; only the first of them keeps its tokens past that. Parts of one name have none.
    """
    return shared_tokens(with_tokens(rows.select(part, order, name), name), part, order)


def with_tokens(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the tokens of a name and, to compare them, their keys."""
    return rows.withColumn("_tokens", chunks.cohort_tokens(F.col(name))).withColumn("_own", F.transform("_tokens", chunks.comparable))


def shared_tokens(cut: DataFrame, part: str, order: str) -> DataFrame:
    """``constant_tokens`` of rows that are cut already."""
    own = Window.partitionBy(part)
    led = cut.where(F.col(part).isNotNull()).select(part, order, "_tokens", "_own").withColumns({"_first": F.first("_own").over(own.orderBy(order)), "_k": F.row_number().over(own.orderBy(order)), "_n": F.count("*").over(own)}).where("_n >= 2")
    words = led.withColumn("_word", F.explode(F.when(F.size("_first") > 0, F.sequence(F.lit(0), F.floor((F.size("_first") - 1) / 64).cast("int")))))
    of_word = F.slice("_first", F.col("_word") * 64 + 1, F.lit(64))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)
    held = F.aggregate(F.transform(of_word, lambda t, k: F.when(F.array_contains("_own", t), bit(k)).otherwise(0)), F.lit(0).cast("long"), lambda bits, b: bits.bitwiseOR(b))
    lead = lambda c: F.when(F.col("_k") == 1, c)
    said = words.select(part, "_word", "_k", held.alias("_held"), lead(F.col("_tokens")).alias("_tokens"), lead(F.col("_own")).alias("_own"), lead(of_word).alias("_of_word"))
    every = said.withColumn("_all", F.bit_and("_held").over(Window.partitionBy(part, "_word"))).where("_k = 1 and _all <> 0")
    each = every.select(part, "_tokens", "_own", "_word", "_all", F.posexplode("_of_word").alias("_bit", "_key")).where(F.col("_all").bitwiseAND(bit(F.col("_bit"))) != 0)
    at = F.col("_word") * 64 + F.col("_bit")
    return each.where(F.array_position("_own", F.col("_key")) == at + 1).select(part, F.get("_tokens", at).alias("token"), at.alias("place"))


def varies_only_by_number(rows: DataFrame, part: str, name: str, order: str) -> DataFrame:
    """(part, only_numbers): whether the names of a part are alike once constant tokens and digits are gone; false for one name."""
    cut = with_tokens(rows, name)
    return beside_tokens(cut, shared_tokens(cut, part, order), part).groupBy(part).agg(only_numbers().alias("only_numbers"))


def beside_tokens(cut: DataFrame, constants: DataFrame, part: str) -> DataFrame:
    """Rows that are cut, with ``_residue``: what their names say besides their part's constant tokens and digits."""
    fixed = constants.groupBy(part).agg(F.collect_set(chunks.comparable(F.col("token"))).alias("_fixed"))  # at most a name's tokens
    rest = F.transform(F.filter(F.arrays_zip("_tokens", "_own"), lambda t: ~F.array_contains(F.coalesce("_fixed", F.array().cast("array<string>")), t["_own"])), lambda t: t["_tokens"])
    return cut.join(fixed, part, "left").withColumn("_residue", chunks.comparable(F.regexp_replace(F.array_join(rest, " "), "[0-9]+", " ")))


def only_numbers() -> Column:
    return (F.count("*") >= 2) & same("_residue")


def median_reaches(values: Column, bound: float) -> Column:
    """Whether the median of a group's values is at least the bound, by counts and the values next to the bound, so that no values are held; null without values."""
    below, above = values < bound, values >= bound
    n, low = F.count(values), F.count(F.when(below, 1))
    middle = F.max(F.when(below, values)) * 0.5 + F.min(F.when(above, values)) * 0.5  # of as many below as above
    return F.when(n > 0, F.when(low * 2 == n, middle >= bound).otherwise(low * 2 < n))


def number_pairs(rows: DataFrame, part: str, name: str, order: str) -> DataFrame:
    """(part, complete): whether every name has an ``N of n`` in the widest sense, n being the number of names, and these N are exactly 1..n."""
    pattern = rf"(?Ui)\b({names.SHORT})(?:\s*(?:of|out\s+of|within|[/-])\s*|\s+)({names.SHORT})\b"
    text = F.replace(name, F.lit("_"), F.lit(" "))
    number = lambda k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    n = rows.groupBy(part).agg(F.count("*").alias("n"))
    pairs = rows.select(part, order, F.explode(F.arrays_zip(number(1).alias("n"), number(2).alias("m"))).alias("x")).select(part, order, F.col("x.n").cast("int").alias("_at"), F.col("x.m").cast("int").alias("_total"))
    found = pairs.join(n, part).where("_total = n").groupBy(part).agg(F.count_distinct(order).alias("files"), F.count_distinct("_at").alias("places"), F.min("_at").alias("low"), F.max("_at").alias("high"))
    whole = (F.col("files") == F.col("n")) & (F.col("places") == F.col("n")) & (F.col("low") == 1) & (F.col("high") == F.col("n"))
    return n.join(found, part, "left").select(part, ((F.col("n") >= 2) & F.coalesce(whole, F.lit(False))).alias("complete"))


def grouping_votes(files: DataFrame, part: str, order: str) -> DataFrame:
    """(part, outcome, weight, reason): votes for ``one`` book or ``many`` of each folder, the prior for many among them.

    ``files`` hold name, title, album, asin, isbn, artist and seconds. A key or author is uniform where all files have it, alike
    without case and blanks, and it is no placeholder.
    """
    text = lambda c: chunks.comparable(F.col(c))
    some = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    key = F.when(some("asin"), F.concat(F.lit("asin:"), F.lower(names.stripped(F.col("asin"))))).when(some("isbn"), F.concat(F.lit("isbn:"), F.lower(names.stripped(F.col("isbn"))))).when(some("album") & ~quality.structural_marker(F.col("album")), F.concat(F.lit("album:"), text("album")))
    usable = lambda c: F.when(some(c) & ~quality.placeholder_title(F.col(c)), text(c))
    seconds = F.when(F.col("seconds") > 0, F.col("seconds"))
    # names are cut once; a folder's rows stay together, in more tasks the more files there are, and each step is written by itself:
    # what sorts and aggregates of one hold isn't added to the others'
    steps = Steps(files.sparkSession)
    cut = steps.keep(with_tokens(files, "name"))
    tasks = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-cut.count() // TASK_FILES))
    cut = cut.repartition(tasks, part)
    fixed = steps.keep(shared_tokens(cut, part, order))
    sums = beside_tokens(cut, fixed, part).groupBy(part).agg(
        only_numbers().alias("only_numbers"), F.count("*").alias("n"), median_reaches(seconds, WHOLE_BOOK_SECONDS).alias("reaches"), F.bool_and(some("title") & quality.structural_marker(F.col("title"))).alias("index_titles"), ((F.count(key) == F.count("*")) & same(key)).alias("keyed"),
        ((F.count(usable("artist")) == F.count("*")) & same(usable("artist")) & ~F.bool_or(quality.structural_marker(F.col("artist")))).alias("authored"),
        ((F.count(usable("album")) == F.count("*")) & same(usable("album")) & ~F.bool_or(quality.structural_marker(F.col("album")))).alias("albumed"),
    )
    counted = fixed.groupBy(part).agg(F.count("*").alias("constants"))
    known = steps.keep(sums).repartition(tasks, part).join(counted, part, "left").join(steps.keep(number_pairs(cut, part, "name", order)), part)
    long, short = F.coalesce("reaches", F.lit(False)), F.coalesce(~F.col("reaches"), F.lit(False))
    cast = [
        (F.lit(True), "many", WEIGHTS["prior"], "prior: default to split unless one-evidence exceeds it"), (F.col("only_numbers"), "one", WEIGHTS["enumeration"], "files differ only by number (numbered parts)"),
        (F.col("complete") & ~long, "one", WEIGHTS["pairs"], "complete numbered sequence"), (F.col("index_titles"), "one", WEIGHTS["index_titles"], "all per-file titles are structural markers"),
        (F.col("constants") > 0, "one", WEIGHTS["constant"] * F.least("constants", F.lit(CONSTANTS_MOST)), "constant filename tokens"), (F.col("keyed"), "one", WEIGHTS["key"], "shared work key"), (F.col("authored"), "one", WEIGHTS["author"], "uniform author"),
        (F.col("albumed") & short & (F.col("n") >= ALBUM_FILES), "one", WEIGHTS["album"], "uniform album over chapter-short files"), (long, "many", WEIGHTS["series"], "whole-book-sized files"),
    ]
    vote = lambda o, w, r: F.struct(F.lit(o).alias("outcome"), (w if isinstance(w, Column) else F.lit(w)).cast("double").alias("weight"), F.lit(r).alias("reason"))
    return known.select(part, F.explode(F.array_compact(F.array(*(F.when(where, vote(o, w, r)) for where, o, w, r in cast)))).alias("v")).select(part, "v.*")


def resolve_grouping(votes: DataFrame, part: str) -> DataFrame:
    """(part, outcome, one, many): one book only where its votes weigh more."""
    weight = lambda o: F.coalesce(F.sum(F.when(F.col("outcome") == o, F.col("weight"))), F.lit(0.0))
    sums = votes.groupBy(part).agg(weight("one").alias("one"), weight("many").alias("many"))
    return sums.select(part, F.when(F.col("one") > F.col("many"), "one").otherwise("many").alias("outcome"), "one", "many")


def cluster(files: DataFrame, part: str, stem: str, order: str) -> DataFrame:
    """``files`` with ``kind`` and ``points`` of their folder and ``work``, ``label``, ``series``, ``sequence`` of their work.

    The chunks of the stems are compared place by place: ``identical``, alike but for numbers, or of ``different`` text. One book
    (``single``, its files one work): a single file, a shared title with a chapter's mark in every stem, numbers glued to one
    text, names that differ by number only, or not at all. Several (``multi``, a work a file): different text, or the same title
    with more behind it and no numbers. ``unknown``: a stem without chunks, or numbers with text in chunks that not all have.
    A work is named by the first of its files by ``order``. Null stems are empty; files of no folder (null) are left out.

    A folder's files are sorted together once, all its sums are windows over them; a folder stays in one task and spills.
    """
    read, texts = stems_read(files.where(F.col(part).isNotNull()), F.coalesce(F.col(stem), F.lit("")), part)
    own = Window.partitionBy(part)
    # sorted by number first, so that the windows without an order need no sort of their own
    read = read.withColumn("_again", F.col("_number") == F.lag("_number").over(own.orderBy("_number")))
    over = lambda **sums: {f"_{name}": c.over(own) for name, c in sums.items()}
    known = read.withColumns(over(
        n=F.count("*"), least=F.min(F.size("_s")), most=F.max(F.size("_s")), last_text=F.max("_last"), chaptered=F.bool_and("_marked"), headed=F.bool_and("_head"), numbered=F.count("_number"), repeated=F.bool_or(F.coalesce("_again", F.lit(False))), low_rest=F.min("_rest"), high_rest=F.max("_rest"),
        low_words=F.min(F.get("_w", F.lit(0))), high_words=F.max(F.get("_w", F.lit(0))), first=F.min(F.struct(order)), first_glued=F.min(F.struct(order, "_glued")), first_part=F.min(F.struct(order, "_part")),
    ))
    # the chunks that all files have, as one value
    shared = lambda c: F.get(c, F.col("_least") - 1)
    known = known.withColumns(over(low_s=F.min(shared("_s")), high_s=F.max(shared("_s")), low_w=F.min(shared("_w")), high_w=F.max(shared("_w"))))
    known = known if texts is None else known.join(F.broadcast(texts), "_stem")
    uniform, titled = F.col("_least") == F.col("_most"), (F.col("_least") > 0) & (F.col("_low_words") == F.col("_high_words")) & F.col("_headed")
    glued = (F.col("_numbered") == F.col("_n")) & ~F.col("_repeated") & (F.col("_low_rest") == F.col("_high_rest"))
    case = (
        F.when(F.col("_n") == 1, "file").when(F.col("_least") == 0, "unparseable").when(titled & F.col("_chaptered"), "chapters").when(glued, "glued").when(F.col("_low_s") != F.col("_high_s"), "titles")
        .when(F.col("_low_w") != F.col("_high_w"), F.when(~uniform & (F.col("_last_text") >= F.col("_least")), "ragged").otherwise("numbers")).when(uniform, "identical").otherwise("editions")
    )
    kind = F.when(F.col("_case").isin("unparseable", "ragged"), "unknown").when(F.col("_case").isin("titles", "editions"), "multi").otherwise("single")
    extra = F.when(F.col("_case").isin("chapters", "glued", "titles", "numbers"), 2).when(F.col("_case") == "identical", 1).otherwise(0)
    points = F.when(F.col("_case") == "file", 3).when(F.col("_case") == "unparseable", 0).otherwise(F.greatest(F.lit(0), F.when(uniform, 2).otherwise(-1) + extra))
    several = ~F.col("_case").isin("chapters", "glued", "numbers", "identical")
    label = F.when(several, F.col("_alone")).when(F.col("_case") == "glued", F.col("_first_glued._glued")).otherwise(F.col("_first_part._part"))
    return known.withColumn("_case", case).select(
        *files.columns, kind.alias("kind"), points.alias("points"), F.coalesce(F.when(~several, F.col(f"_first.{order}")), F.col(order)).alias("work"), label.alias("label"),
        F.when(several, F.col("_ref.series")).alias("series"), F.when(several, F.col("_ref.sequence")).alias("sequence"),
    )


def stems_read(files: DataFrame, text: Column, part: str) -> tuple[DataFrame, DataFrame | None]:
    """``files``, a folder's in one task, with what their stems say by themselves; what only a work's text needs, by stem, if that is apart.

    Files of many folders are named alike (``Chapter 01``), so each distinct stem is read once and broadcast, and numbers stand for
    the texts that are compared; beyond ``STEM_BYTES`` of them, each file's stem is read where it is, with the same rows.
    """
    steps = Steps(files.sparkSession)
    named = steps.keep(files.withColumn("_stem", text))
    tasks = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-named.count() // TASK_FILES))
    stems = steps.keep(named.select("_stem").distinct().withColumn("_id", F.monotonically_increasing_id()))
    if (stems.agg(F.sum(F.octet_length("_stem") + 32)).first()[0] or 0) > STEM_BYTES:
        read = stem_readings(named, part, steps)
        steps.drop(named, stems)
        return read.repartition(tasks, part), None
    read = stem_readings(stems, "_stem", steps)
    steps.drop(stems)
    number = lambda c: F.min("_id").over(Window.partitionBy(c))
    of = lambda c: read.select("_id", F.posexplode(c).alias("_at", "_key")).withColumn("_key", number("_key")).groupBy("_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_key"))), lambda x: x["_key"]).alias(c))
    keys = read.select("_stem", "_id", "_last", "_marked", "_head", "_number", number("_rest").alias("_rest")).join(of("_s"), "_id", "left").join(of("_w"), "_id", "left")
    none = F.array().cast("array<bigint>")
    keys = steps.keep(keys.withColumns({"_s": F.coalesce("_s", none), "_w": F.coalesce("_w", none)}).drop("_id"))
    labels = read.select("_stem", "_glued", "_part")
    return named.repartition(tasks, part).join(F.broadcast(keys.join(labels, "_stem")), "_stem"), read.select("_stem", "_alone", "_ref")


def stem_readings(rows: DataFrame, key: str, steps: Steps) -> DataFrame:
    """``rows``, dealt by ``key``, with readings of ``_stem``: its first chunks' texts and words, for each number of chunks (``_s``, ``_w``), whether the first has text and which is the last that has, whether one is a chapter's mark, the only number in front, what is left without numbers, and what a work is called in each case."""
    text, c = F.col("_stem"), F.col("_c")
    # each step is written: what regular expressions find is read many times over
    cut = steps.keep(spread(rows, key).withColumn("_c", chunks.chunks(text)).withColumns({"_texts": F.transform("_c", chunks.signature), "_words": F.transform("_c", lambda x: F.array_join(chunks.words(x), " ")), "_t": chunks.title_chunks(text, c)}))
    place = F.filter(F.sequence(F.lit(0), F.size("_texts")), lambda k: F.get("_texts", k) != "")
    heads = lambda x: F.transform(x, lambda _, k: F.slice(x, F.lit(1), k + 1))
    index = names.track_index(text)
    lead, shown, residue = F.get("_t", F.lit(0)), chunks.spaced(text), names.stripped(F.regexp_replace(text, "[0-9]+", ""))
    filled = lambda x: F.when(x != "", x).otherwise(shown)
    out = cut.select(
        *rows.columns, heads("_texts").alias("_s"), heads("_words").alias("_w"), F.coalesce(F.get("_texts", F.lit(0)) != "", F.lit(False)).alias("_head"), F.coalesce(F.array_max(place), F.lit(-1)).alias("_last"), F.exists("_c", chunks.chapter_mark).alias("_marked"),
        F.when((residue != "") & (F.size(index["components"]) == 1), index["components"][0]).alias("_number"), F.lower(residue).alias("_rest"),
        filled(F.when(chunks.signature(lead) != "", chunks.spaced(lead)).otherwise(shown)).alias("_alone"), filled(chunks.spaced(residue)).alias("_glued"), filled(F.when(lead.isNotNull(), chunks.without_number(chunks.spaced(lead))).otherwise(shown)).alias("_part"),
        F.when(F.size("_t") > 1, chunks.series_of(F.slice("_t", F.lit(2), F.greatest(F.size("_t"), F.lit(1))))).alias("_ref"),
    )
    return steps.keep(out, cut)
