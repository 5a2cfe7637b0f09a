"""Authors, series and franchises as nodes of a library, their books, and the navigator's views as ordered rows.

``books`` are (book, title, authors, authors_prov, series, series_prov, confidence), series an array of (name, sequence);
``aliases`` are (kind, name, canonical) with names already followed to their ends. A view's rows stay rows: nested arrays would put
a hub's books into one value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as fx
from lectern.operators import ranks
from lectern.operators.steps import Steps, kept

# Fixed value: whose spelling of a name counts more.
AUTHORITY = {"manual": 5, "audnexus": 4, "audible": 4, "hardcover": 4, "openlibrary": 4, "googlebooks": 4, "tag": 3, "datafile": 3, "directory": 2, "filename": 2, "graphing": 1}


def memberships(books: DataFrame, aliases: DataFrame) -> DataFrame:
    """(book, kind, key, name, prov, sequence, at): each author and series of each book, under its canonical name; a blank name is none."""
    people = books.select("book", F.lit("author").alias("kind"), F.posexplode("authors").alias("at", "said"), F.col("authors_prov").alias("prov")).withColumn("sequence", F.lit(None).cast("double"))
    series = books.select("book", F.lit("series").alias("kind"), F.posexplode("series").alias("at", "s"), F.col("series_prov").alias("prov")).select("book", "kind", "at", F.col("s.name").alias("said"), "prov", F.col("s.sequence").alias("sequence"))
    known = aliases.groupBy("kind", fx.entity_key(F.col("name")).alias("said_key")).agg(F.min("canonical").alias("canonical"))
    rows = people.unionByName(series).withColumn("said_key", fx.entity_key(F.col("said"))).join(known, ["kind", "said_key"], "left")
    name = F.coalesce("canonical", "said")
    key = F.when(F.col("canonical").isNull(), F.col("said_key")).otherwise(fx.entity_key(F.col("canonical")))
    return rows.select("book", "kind", key.alias("key"), name.alias("name"), F.coalesce("prov", F.lit("")).alias("prov"), "sequence", "at").where("key <> ''")


def spellings(members: DataFrame, order: str = "book") -> DataFrame:
    """(kind, key, display): the spelling that the most authoritative sources use most; of several, the one that ceases first by ``order``."""
    authority = reduce(lambda c, p: c.when(F.col("prov") == p[0], p[1]), list(AUTHORITY.items())[1:], F.when(F.col("prov") == "manual", AUTHORITY["manual"])).otherwise(0)
    spelled = members.groupBy("kind", "key", authority.alias("authority"), "name").agg(F.count("*").alias("n"), F.max(F.struct(order, "at")).alias("last"))
    best = spelled.groupBy("kind", "key").agg(F.max("authority").alias("authority"))
    top = spelled.join(best, ["kind", "key", "authority"])
    rank = F.row_number().over(Window.partitionBy("kind", "key").orderBy(F.desc("n"), "last", "name"))  # spellings of one name
    return top.withColumn("r", rank).where("r = 1").select("kind", "key", F.col("name").alias("display"))


def displays(members: DataFrame, order: str = "book") -> DataFrame:
    """``spellings`` with ``n_books``."""
    return spellings(members, order).join(members.groupBy("kind", "key").agg(F.count_distinct("book").alias("n_books")), ["kind", "key"])


def tree(books: DataFrame, aliases: DataFrame, places: bool = True) -> DataFrame:
    """(view, author, series, place, book): the navigator's rows; ``places`` is false for them without ``place``, unranked.

    ``authors``: an author's series by number, then its books without a series by title (series null); a book with a series but
    no author stands under the name of its first series. ``series``: all books of a series by number. ``needs_id``: books with
    neither, the least sure first. A book stands in each series once, at the greatest of its numbers; no number is 0. Ties go
    by book.
    """
    # keys are slow to make and read by all that follows
    steps = Steps(books.sparkSession)
    members = steps.keep(memberships(books, aliases))
    names = steps.keep(spellings(members))
    # the name of an author is that of its members; a pseudo-author bears the series' name
    people = members.where("kind = 'author'").select("book", F.col("key").alias("author_key")).distinct()
    serial = steps.keep(members.where("kind = 'series'").groupBy("book", F.col("key").alias("series_key")).agg(F.max(F.coalesce("sequence", F.lit(0.0))).alias("sequence")))
    first = members.where("kind = 'series'").groupBy("book").agg(F.min_by(F.struct("key", "name"), "at").alias("f"))
    pseudo = first.join(people, "book", "left_anti").select("book", F.col("f.key").alias("author_key"), F.col("f.name").alias("pseudo"))
    of = lambda kind, key, shown: names.where(F.col("kind") == kind).select(F.col("key").alias(key), F.col("display").alias(shown))
    homes = people.withColumn("pseudo", F.lit(None).cast("string")).unionByName(pseudo)
    fallback = pseudo.groupBy("author_key").agg(F.min_by("pseudo", "book").alias("own"))
    homes = homes.drop("pseudo").join(of("author", "author_key", "author"), "author_key", "left").join(fallback, "author_key", "left")
    homes = homes.select("book", "author_key", F.coalesce("author", "own").alias("author"))
    rest = books.select("book", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    nested = homes.join(serial, "book", "left").join(of("series", "series_key", "series"), "series_key", "left").join(rest, "book")
    # a few authors and series hold most books: their rows are ranked by range, too
    placed = lambda rows, keys, *order: ranks.place(rows, [*order, "book"], within=keys).withColumn("place", F.col("place").cast("int")) if places else rows
    authors = placed(nested.withColumn("title", F.when(F.col("series_key").isNull(), F.col("title"))), ["author_key", "series_key"], "sequence", "title")
    series = placed(serial.join(of("series", "series_key", "series"), "series_key"), ["series_key"], "sequence")
    lost = rest.join(members.select("book").distinct(), "book", "left_anti")
    view = lambda rows, name: rows.select(F.lit(name).alias("view"), "author", "series", *(["place"] if places else []), "book")
    none = F.lit(None).cast("string")
    # the least sure first: one list of all books, ranked by range
    unsure = placed(lost, [], "confidence")
    return view(authors, "authors").unionByName(view(series.withColumn("author", none), "series")).unionByName(view(unsure.withColumns({"author": none, "series": none}), "needs_id"))


def narrowed(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The tree's rows of the ``wanted`` books, their places kept; authors and series without any are gone with their rows."""
    return rows.join(wanted.select("book").distinct(), "book", "left_semi").select(*rows.columns)


def branches(rows: DataFrame) -> DataFrame:
    """(view, author, series, n): the tree's nodes with their books, ancestors of every row included; an author's own row has no series and counts all of its books once."""
    rows = kept(rows)
    leaves = rows.groupBy("view", "author", "series").agg(F.count_distinct("book").alias("n")).where("series is not null")
    roots = rows.groupBy("view", "author").agg(F.count_distinct("book").alias("n")).where("author is not null or view = 'needs_id'").withColumn("series", F.lit(None).cast("string"))
    return leaves.unionByName(roots.select(*leaves.columns))


def pruned(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, dst, ...) of which both ends are among ``nodes`` (node)."""
    ends = nodes.select("node").distinct()
    return edges.join(ends, F.col("src") == ends["node"], "left_semi").join(ends, F.col("dst") == ends["node"], "left_semi")


def overlay(base: DataFrame, user: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both by key, the user's before the built-in ones."""
    return user.select(*base.columns).unionByName(base.join(user.select(*key), key, "left_anti").select(*base.columns))

