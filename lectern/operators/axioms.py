"""Kinds of folders by election: each axiom is a DataFrame of votes, the votes of a node are tallied, authors are handed down.

``nodes`` are those of ``trees.coarse_kinds``. ``books`` are (book, node, title, title_prov, authors, authors_prov, series, series_prov,
sequence, label, stem, n_files): the book's folder, its fields and where each comes from, the label that its file names suggest,
the name of its first file. Votes are (node, axiom, kind, weight, reason, hard, value). Nulls are fields that aren't there; of
several books the smallest id comes first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import names, quality
from lectern.functions import text as fx
from lectern.operators import trees
from lectern.operators.steps import Steps

# Weights of the votes, in the order of what beats what.
WEIGHTS = {
    "manual": 100.0, "match": 10.0, "title_leaf": 5.0, "franchise": 4.0, "leaf_series": 4.0, "series_ramp": 3.0, "consensus_most": 3.0, "memoir": 3.0, "structure_most": 3.0, "root": 2.5, "leaf_author": 2.5, "grouping": 2.0,
    "bucket_word": 2.0, "numeric": 1.5, "tag_match": 1.5, "mixed": 1.0, "numbered": 1.0, "numbered_ramp": 2.0, "numbered_tag": 1.0, "depth": 0.5, "bucket": 1.0, "bucket_child": 0.5,
}
# Order of kinds in a tie, names of staging folders and of an author's shelves, where values come from.
KINDS = ("title", "author", "series", "franchise", "container")
BUCKETS = ("incoming", "downloads", "download", "audiobooks", "audiobook", "books", "misc", "unsorted", "new", "temp", "tmp", "media", "library", "import", "imports")
SHELVES = ("non series", "standalone", "collection", "collections", "anthology", "anthologies", "omnibus", "miscellaneous", "misc", "short stories", "singles", "best of")
TAGGED = ("tag", "datafile")
MATCHED = ("audnexus", "audible", "hardcover", "openlibrary")
HARD = (*TAGGED, *MATCHED, "googlebooks", "manual")
ECHOES = ("directory", "graphing")
MEMOIRS = ("memoir", "autobiography", "my story", "the story of", "my life")
COVERAGE, JUNK = 0.6, 0.9


@dataclass
class Library:
    """What the axioms read: ``nodes`` with ``key`` (of the name) and ``shelf`` (franchise or collection name), books, and sums over subtrees."""

    nodes: DataFrame
    books: DataFrame
    franchises: DataFrame
    overrides: DataFrame
    author_depth: int | None = 1
    modal_author_depth: int | None = field(init=False)
    steps: Steps = field(init=False)
    sums: DataFrame = field(init=False)

    def __post_init__(self) -> None:
        modal = trees.modal_title_depth(self.nodes)
        self.modal_author_depth = None if modal is None else modal - 1
        known = self.franchises.groupBy(fx.entity_key(F.col("name")).alias("key")).agg(F.min("name").alias("franchise"))
        plain = F.trim(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", " "))
        self.steps = Steps(self.nodes.sparkSession)
        self.nodes = self.steps.keep(self.nodes.withColumn("key", fx.entity_key(F.col("name"))).join(known, "key", "left").withColumn("collection", plain.isin(*SHELVES)))
        self.books = self.steps.keep(self.books)
        self.all_series = fx.entity_key(F.col("series"))
        self.sums = self.gathered()

    def votes_of(self, rows: DataFrame, axiom: str, kind: Column | str, weight: Column | float, reason: Column | str, value: Column | None = None, hard: bool = False) -> DataFrame:
        as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
        value = F.lit(None) if value is None else value
        return rows.select("node", F.lit(axiom).alias("axiom"), as_column(kind).alias("kind"), as_column(weight).cast("double").alias("weight"), as_column(reason).cast("string").alias("reason"), F.lit(hard).alias("hard"), value.cast("string").alias("value"))

    def gathered(self) -> DataFrame:
        """(node, what, key, n, low, high, first): what the books of each subtree say, by key, from one pass up the tree.

        ``what`` is ``tag`` or ``match`` for authors of such a source, ``series`` for asserted series with their least and greatest
        numbers, ``book`` for books, ``tagged series`` for books with a series tag.
        """
        number, text = F.lit(None).cast("double"), F.lit("")
        fact = lambda rows, what, key, at, said, n=number: rows.select("node", F.lit(what).alias("what"), key.alias("key"), F.lit(1).cast("long").alias("n"), n.alias("low"), n.alias("high"), F.struct("book", at.cast("int").alias("at"), said.alias("said")).alias("first"))
        zero = F.lit(0)
        people = lambda what, sources: fact(self.books.where(F.col("authors_prov").isin(*sources)).select("node", "book", F.posexplode("authors").alias("at", "author")), what, fx.entity_key(F.col("author")), F.col("at"), F.col("author"))
        serial = self.books.where(F.col("series").isNotNull() & F.col("series_prov").isin(*HARD))
        facts = [
            people("tag", TAGGED), people("match", MATCHED), fact(serial, "series", self.all_series, zero, F.col("series"), F.col("sequence")), fact(self.books, "book", text, zero, text),
            fact(serial.where(F.col("series_prov").isin(*TAGGED)), "tagged series", text, zero, text),
        ]
        return self.steps.keep(trees.roll_up(self.nodes, reduce(DataFrame.unionByName, facts), ["what", "key"], {"n": F.sum, "low": F.min, "high": F.max, "first": F.min}))

    def of(self, what: str) -> DataFrame:
        return self.sums.where(F.col("what") == what).drop("what")


def manual_override(lib: Library) -> DataFrame:
    rows = lib.nodes.select("node").join(lib.overrides.select("node", F.col("kind").alias("k"), F.col("value").alias("v")), "node")
    return lib.votes_of(rows, "00 manual", F.col("k"), WEIGHTS["manual"], "you classified this folder", F.col("v"), hard=True)


def matched_identity(lib: Library) -> DataFrame:
    rows = lib.nodes.select("node", "key").join(lib.of("match"), ["node", "key"])
    return lib.votes_of(rows, "01 match", "author", WEIGHTS["match"], F.concat(F.lit("matched book(s) author '"), F.col("first.said"), F.lit("' == folder name")), F.col("first.said"), hard=True)


def tagged_authors(lib: Library) -> DataFrame:
    """An author on three quarters of a subtree's tags, and one whose name is the folder's; both may vote."""
    people = lib.of("tag")
    total = people.groupBy("node").agg(F.sum("n").alias("total"), F.max_by(F.struct("n", "first"), "n").alias("top")).where(F.col("top.n") * 4 >= F.col("total") * 3)
    n = F.col("top.n")
    name = F.col("top.first.said")
    consensus = lib.votes_of(total, "02 consensus", "author", F.least(F.lit(WEIGHTS["consensus_most"]), 0.5 + 0.5 * n), F.concat(n.cast("string"), F.lit(" book(s) tagged author '"), name, F.lit("'")), name)
    same = lib.nodes.select("node", "key").join(people, ["node", "key"])
    return consensus.unionByName(lib.votes_of(same, "03 tag", "author", WEIGHTS["tag_match"], F.concat(F.lit("a tagged author matches the folder name '"), F.col("first.said"), F.lit("'")), F.col("first.said")))


def leaf_title(lib: Library) -> DataFrame:
    """A leaf with one book: its title, its series, or, at the depth of authors and with a title of the file's own, its author."""
    one = lib.books.groupBy("node").agg(F.min_by(F.struct("title", "title_prov", "authors", "authors_prov", "series", "label", "n_files"), "book").alias("b"))
    rows = lib.nodes.where("kind = 'title'").join(one, "node")
    b = lambda c: F.col(f"b.{c}")
    real = F.when((b("title") != "") & b("title_prov").isin(*HARD), b("title"))
    label = F.coalesce(b("label"), F.when(real.isNull() & ~F.coalesce(b("title_prov").isin(*ECHOES), F.lit(False)), b("title")))
    words = F.size(F.filter(quality.word_set(label), lambda w: ~w.rlike(r"^\d+[a-z]?$"))) > 0
    rows = rows.withColumn("_own", F.coalesce(real, F.when(words & (F.coalesce(b("n_files"), F.lit(1)) <= 1), label)))
    authored = F.coalesce((F.size(b("authors")) > 0) & b("authors_prov").isin(*HARD), F.lit(False))
    at_depth = F.lit(False) if lib.author_depth is None else F.col("depth") == lib.author_depth
    titled = quality.resembles(F.col("name"), F.col("_own"))
    inside = (F.size(F.array_except(quality.word_set(F.col("name")), quality.word_set(F.col("_own")))) == 0) & (F.size(quality.word_set(F.col("name"))) < F.size(quality.word_set(F.col("_own"))))
    memoir = titled & at_depth & ~authored & inside & reduce(lambda x, m: x | F.lower("_own").contains(m), MEMOIRS, F.lit(False))
    serial = quality.resembles(F.col("name"), b("series"))
    low = F.lower(names.stripped(F.col("name")))
    silent = F.col("franchise").isNotNull() | low.isin(*BUCKETS) | F.replace(low, F.lit(" "), F.lit("")).rlike("^[0-9]+$")
    case = F.when(memoir, "memoir").when(titled, "title").when(serial, "series").when(silent, "none").when(~authored & at_depth & F.col("_own").isNotNull(), "author").otherwise("title")
    rows = rows.withColumn("_case", case).where("_case <> 'none'")
    kind = F.when(F.col("_case").isin("memoir", "author"), "author").otherwise(F.col("_case"))
    weight = F.when(F.col("_case") == "memoir", WEIGHTS["memoir"]).when(F.col("_case") == "series", WEIGHTS["leaf_series"]).when(F.col("_case") == "author", WEIGHTS["leaf_author"]).otherwise(WEIGHTS["title_leaf"])
    reason = F.when(F.col("_case") == "memoir", "memoir titled after its author").when(F.col("_case") == "series", "single-book leaf of a series").when(F.col("_case") == "author", "lone book at the author depth").otherwise("single-book leaf (a title folder)")
    return lib.votes_of(rows, "04 leaf", kind, weight, reason, F.when(kind == "author", F.col("name")).when(kind == "series", b("series")))


def folder_title_shape(lib: Library) -> DataFrame:
    """A leaf with one book whose name has a title's year, readers, or place in a series."""
    rows = lib.nodes.where("kind = 'title' and n_books = 1").withColumn("t", names.folder_title(F.col("name")))
    dated = F.col("t.year").isNotNull() | (F.size("t.narrators") > 0)
    placed = (F.col("t.series").isNotNull() | F.col("t.sequence").isNotNull()) & F.col("t.title").rlike(r"\p{L}")
    return lib.votes_of(rows.where(dated | placed), "05 shape", "title", WEIGHTS["title_leaf"], F.when(dated, "folder name is a year/narrator title shape").otherwise("folder names a book within a series"))


def author_structure(lib: Library) -> DataFrame:
    """Several books of its own that aren't the series that the folder is named after; and the depth at which authors stand."""
    plain = lib.nodes.where("franchise is null and not collection")
    sums = lib.books.groupBy("node").agg(F.count("*").alias("n"), F.count_distinct(lib.all_series).alias("n_series"), F.min_by("series", F.when(F.col("series").isNotNull(), F.col("book"))).alias("one")).where("n >= 2")
    rows = plain.join(sums, "node").where((F.col("n_series") != 1) | ~quality.resembles(F.col("name"), F.col("one")))
    weight = F.least(F.lit(WEIGHTS["structure_most"]), 1.0 + 0.5 * F.greatest(F.col("n_series"), F.lit(1)))
    out = lib.votes_of(rows, "06 structure", "author", weight, F.concat(F.col("n").cast("string"), F.lit(" loose books")))
    if lib.modal_author_depth is None:
        return out
    return out.unionByName(lib.votes_of(plain.where(F.col("depth") == lib.modal_author_depth), "07 depth", "author", WEIGHTS["depth"], "sits at the library's typical author depth"))


def author_from_grouping(lib: Library) -> DataFrame:
    return lib.votes_of(lib.nodes.where("kind = 'grouping' and franchise is null and not collection"), "08 grouping", "author", WEIGHTS["grouping"], "a folder of title subfolders (author/series grouping)")


def known_franchise(lib: Library) -> DataFrame:
    return lib.votes_of(lib.nodes.where("franchise is not null"), "09 franchise", "franchise", WEIGHTS["franchise"], F.concat(F.lit("declared franchise '"), F.col("franchise"), F.lit("'")), F.col("franchise"))


def numbered_siblings(lib: Library) -> DataFrame:
    """Children (folders with books below, or files of the folder's own books) whose names carry a book's number."""
    below, tagged = lib.of("book").select("node"), lib.of("tagged series").select("node", F.lit(True).alias("tagged"))
    dirs = lib.nodes.where("parent is not null").select("node", F.col("parent"), "name").join(below, "node").select(F.col("parent").alias("node"), "name")
    children = dirs.unionByName(lib.books.select("node", F.col("stem").alias("name"))).where("name is not null").distinct()
    affix, title = names.sequence_affix(F.col("name")), names.folder_title(F.col("name"))
    number = F.coalesce(affix["sequence"], title["sequence"])
    cleaned = F.lower(F.coalesce(affix["cleaned"], F.when(title["title"] != "", title["title"]), F.col("name")))
    read = children.select("node", number.alias("number"), cleaned.alias("cleaned"), F.coalesce(affix["strong"], F.lit(True)).alias("strong")).where("number is not null")
    # that numbers and titles differ shows in their least and greatest
    sums = read.groupBy("node").agg(F.count("*").alias("n"), F.min("number").alias("low"), F.max("number").alias("high"), F.min("cleaned").alias("first"), F.max("cleaned").alias("last"), F.bool_or("strong").alias("strong"))
    # written once: each vote reads other columns of it, so that Spark would cut the names for each of them anew
    rows = lib.steps.keep(sums.join(tagged, "node", "left").fillna(False, ["tagged"]).join(lib.nodes.select("node", "name"), "node"))
    vote = lambda where, axiom, weight, reason: lib.votes_of(rows.where(where), axiom, "series", WEIGHTS[weight], reason, F.col("name"))
    ramp = (F.col("n") >= 2) & (F.col("low") < F.col("high")) & (F.col("first") < F.col("last")) & (F.col("strong") | F.col("tagged"))
    return (
        vote(F.lit(True), "10 numbered", "numbered", F.concat(F.col("n").cast("string"), F.lit(" child name(s) carry a sequence number")))
        .unionByName(vote(ramp, "11 ramp", "numbered_ramp", "numbered title ramp, distinct titles"))
        .unionByName(vote("tagged", "12 numbered tag", "numbered_tag", "child books carry a series tag"))
    )


def series_ramp(lib: Library) -> DataFrame:
    """Most books of a subtree in one asserted series with at least two numbers, and the folder named after it."""
    books = lib.of("book").select("node", F.col("n").alias("books"))
    sums = lib.of("series").groupBy("node").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("first").alias("first")).join(books, "node")
    rows = sums.join(lib.nodes.select("node", "name"), "node").where((F.col("kinds") == 1) & (F.col("n") >= COVERAGE * F.col("books")) & (F.col("low") < F.col("high")) & quality.resembles(F.col("name"), F.col("first.said")))
    return lib.votes_of(rows, "13 series", "series", WEIGHTS["series_ramp"], F.concat(F.lit("all books in series '"), F.col("first.said"), F.lit("', folder matches")), F.col("first.said"))


def container_shape(lib: Library) -> DataFrame:
    many = lib.votes_of(lib.nodes.where("book_like >= 2"), "14 bucket", "container", WEIGHTS["bucket"] + WEIGHTS["bucket_child"] * F.col("book_like"), F.concat(F.col("book_like").cast("string"), F.lit(" book-like child folders (a bucket)")))
    mixed = lib.votes_of(lib.nodes.where("n_files > 0 and n_dirs > 0"), "15 mixed", "container", WEIGHTS["mixed"], F.concat(F.lit("loose audio beside "), F.col("n_dirs").cast("string"), F.lit(" subfolders")))
    return many.unionByName(mixed).unionByName(lib.votes_of(lib.nodes.where("depth = 0"), "16 root", "container", WEIGHTS["root"], "the scan root is usually a library bucket"))


def bucket_word(lib: Library) -> DataFrame:
    low = F.lower(names.stripped(F.col("name")))
    bucket, number = low.isin(*BUCKETS), F.replace(low, F.lit(" "), F.lit("")).rlike("^[0-9]+$")
    rows = lib.nodes.where(bucket | number)
    return lib.votes_of(rows, "17 word", "container", F.when(bucket, WEIGHTS["bucket_word"]).otherwise(WEIGHTS["numeric"]), F.when(bucket, "a bucket/staging folder name").otherwise("numeric, not a name"))


AXIOMS: tuple[Callable[[Library], DataFrame], ...] = (
    manual_override, matched_identity, tagged_authors, leaf_title, folder_title_shape, author_structure, author_from_grouping, known_franchise, numbered_siblings, series_ramp, container_shape, bucket_word,
)


def resolve(nodes: DataFrame, votes: DataFrame, overrides: DataFrame) -> DataFrame:
    """``nodes`` (node, name) with kind, value, confidence, source, settled, evidenced, reasons.

    A hard vote settles a node, one of the kind that the user chose before others, the heaviest of them. Else most weight wins,
    in a tie the first of ``KINDS``; the confidence is the winner's share. The value is that of the heaviest vote of the winning
    kind that has one, else for authors and series the folder's name; a junk author is none. A node without votes is a
    container. Votes are summed by kind before they move.
    """
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    weight, first = F.col("weight"), -F.substring("axiom", 1, 2).cast("int")
    valued = F.when(F.col("value") != "", F.struct(weight, first.alias("first"), "value"))
    sums = votes.groupBy("node", "kind").agg(F.sum("weight").alias("total"), F.max(F.when(F.col("hard"), F.struct(weight, first.alias("first"), "value"))).alias("hard"), F.max(valued).alias("valued"), F.collect_list(F.struct("axiom", "reason")).alias("said"))
    chosen = overrides.select("node", F.col("kind").alias("_chosen"))
    over = Window.partitionBy("node")  # five kinds at most
    held = sums.join(chosen, "node", "left").withColumns({"_all": F.sum("total").over(over), "reasons": F.array_sort(F.flatten(F.collect_list("said").over(over)))})
    manual = F.col("hard").isNotNull() & F.coalesce(F.col("kind") == F.col("_chosen"), F.lit(False))
    rank = F.row_number().over(over.orderBy(manual.desc(), F.col("hard").isNotNull().desc(), F.col("hard.weight").desc_nulls_last(), F.col("total").desc(), order))
    won = held.withColumn("manual", manual).withColumn("_rank", rank).where("_rank = 1").select("node", F.col("kind").alias("_kind"), "hard", "valued", "total", "_all", "reasons", "manual")
    out = nodes.join(won, "node", "left")
    kind, settled = F.coalesce("_kind", F.lit("container")), F.col("hard").isNotNull()
    value = F.coalesce(F.when(settled & (F.col("hard.value") != ""), F.col("hard.value")), F.col("valued.value"), F.when(kind.isin("author", "series"), F.col("name")))
    sane = F.when(settled & (F.col("hard.value") != ""), F.lit(True)).otherwise((kind != "author") | (quality.author_junk(value) < JUNK))
    share = F.when(settled, 1.0).when(F.col("_all") > 0, F.bround(F.col("total") / F.col("_all"), 2)).otherwise(0.0)
    return out.select(
        "node", kind.alias("kind"), F.when(sane, value).alias("value"), share.alias("confidence"), F.when(F.col("manual"), "manual").when(settled, "matched").otherwise("").alias("source"), settled.alias("settled"),
        (F.coalesce(F.col("hard.value") != "", F.lit(False)) | F.col("valued").isNotNull()).alias("evidenced"), F.coalesce(F.transform("reasons", lambda r: r["reason"]), F.array().cast("array<string>")).alias("reasons"),
    )


def classify(lib: Library) -> DataFrame:
    """Every node's kind by the votes of all axioms."""
    votes = lib.steps.keep(reduce(DataFrame.unionByName, (axiom(lib) for axiom in AXIOMS)))
    return resolve(lib.nodes.select("node", "name"), votes, lib.overrides)


AUTHOR = "struct<node:string,value:string,confidence:double,source:string>"
MESSAGE = f"struct<named:{AUTHOR},nearest:{AUTHOR},layout:struct<node:string,name:string,kind:string,source:string>,series:struct<node:string,value:string,confidence:double>>"


def inherited(nodes: DataFrame, kinds: DataFrame, author_depth: int | None = 1) -> DataFrame:
    """(node, author, layout, series): what a book in each folder inherits from it and the folders above.

    ``author`` is the nearest folder of kind author that evidence names, else the nearest that only its own name does; the root
    counts only if it is settled. ``layout`` is the folder at the depth of authors unless it is a franchise, series or container.
    ``series`` is the nearest folder of kind series. One message of these goes down a level at a time.
    """
    rows = nodes.select("node", "parent", "depth", "name").join(kinds.select("node", "kind", "value", "confidence", "source", "evidenced"), "node")
    own = F.struct("node", "value", "confidence", "source")
    author = (F.col("kind") == "author") & F.col("value").isNotNull() & ((F.col("depth") > 0) | (F.col("source") != ""))
    layout = F.lit(False) if author_depth is None else (F.col("depth") == author_depth) & ~F.col("kind").isin("franchise", "series", "container")

    def message(above: Column) -> Column:
        either = lambda mine, made, name: F.when(mine, made).otherwise(above[name]).alias(name)
        return F.struct(either(author & F.col("evidenced"), own, "named"), either(author, own, "nearest"), either(layout, F.struct("node", "name", "kind", "source"), "layout"), either(F.col("kind") == "series", F.struct("node", "value", "confidence"), "series"))

    down = trees.pass_down(rows, message, MESSAGE)
    return down.select("node", F.coalesce("message.named", "message.nearest").alias("author"), F.col("message.layout").alias("layout"), F.col("message.series").alias("series"), F.col("message.named").isNotNull().alias("author_evidenced"))


def fill_down(books: DataFrame, nodes: DataFrame, kinds: DataFrame, author_depth: int | None = 1) -> DataFrame:
    """(book, author, by, author_confidence, series, sequence): what books without an author or series of their own get from their folders.

    Authors and series with a hard source stay as they are (null here). ``by`` is ``manual`` (the folder was classified by hand),
    ``graphing`` (an author's folder above) or ``directory`` (only the layout says so; a title's folder gives its name only to a
    book without a title, and never if it was classified by hand). The series comes with the number in the folder's name or in
    that of the file; without a number there is none.
    """
    found = books.withColumnRenamed("series", "series_own").join(inherited(nodes, kinds, author_depth), "node", "left").join(nodes.select("node", F.col("name").alias("_folder")), "node", "left")
    own = F.coalesce((F.size("authors") > 0) & F.col("authors_prov").isin(*HARD), F.lit(False))
    untitled = (F.coalesce("title", F.lit("")) == "") & (F.col("layout.source") != "manual")
    laid = F.when((F.col("layout.kind") != "title") | untitled, F.col("layout.name"))
    author = F.when(~own, F.coalesce("author.value", laid))
    by = F.when(author.isNotNull(), F.when(F.col("author.source") == "manual", "manual").when(F.col("author").isNotNull(), "graphing").otherwise("directory"))
    number = F.coalesce(names.folder_title(F.col("_folder"))["sequence"], names.sequence_affix(F.when(F.col("series.node") == F.col("node"), F.col("stem")).otherwise(F.col("_folder")))["sequence"])
    free = F.col("series_own").isNull() | ~F.coalesce(F.col("series_prov").isin(*HARD), F.lit(False))
    serial = free & F.col("series").isNotNull() & number.isNotNull() & ~quality.structural_marker(F.col("series.value"))
    return found.select("book", author.alias("author"), by.alias("by"), F.when(author.isNotNull(), F.col("author.confidence")).alias("author_confidence"), F.when(serial, F.col("series.value")).alias("series"), F.when(serial, number).alias("sequence"))
