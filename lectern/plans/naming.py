"""Queries over names: files, folders, templates. The tables hold no file names, so they are made from keys of their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import names, templates
from lectern.operators import files
from lectern.plans.registry import query
from lectern.sources.tables import table

FILE = "[$PadNum - ]$Title[ ($PubYear)]"


def book(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, Column]]:
    """Parts as books: brand the author, type the series, size its number (none over 40), every third one of a franchise."""
    col = F.col
    fields = {
        "author": col("p_brand"), "title": col("p_name"), "series_name": F.when(col("p_size") % 4 > 0, col("p_type")), "sequence": F.when(col("p_size") <= 40, col("p_size").cast("double") / 2),
        "year": F.when(col("p_size") % 3 == 0, col("p_size") + 1950), "franchise": F.when(col("p_partkey") % 3 == 0, F.lit("Brand/Wide")), "abridged": col("p_size") % 2 == 0,
    }
    return table(spark, d, "part"), fields


@query(r"""WITH t AS (SELECT *, p_size / 2.0 AS half, p_size % 4 > 0 AS has, p_size <= 40 AS numbered FROM part),
n AS (SELECT *, CASE WHEN NOT (has AND numbered) THEN '' WHEN p_size % 2 = 0 THEN CAST(p_size // 2 AS VARCHAR) ELSE CAST(p_size // 2 AS VARCHAR) || '.5' END AS num FROM t),
s AS (SELECT *, CASE WHEN has THEN '(' || p_type || CASE WHEN num <> '' THEN ' Book #' || num ELSE '' END || ')' ELSE '' END AS series,
CASE WHEN num = '' THEN '' WHEN p_size % 2 = 0 AND length(num) < 2 THEN '0' || num ELSE num END AS pad FROM n)
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'BrandWide/' ELSE '' END || p_brand || '/' || CASE WHEN series <> '' THEN series || '/' ELSE '' END || CASE WHEN pad <> '' THEN pad || ' - ' ELSE '' END || p_name
|| CASE WHEN p_size % 3 = 0 THEN ' (' || (p_size + 1950) || ')' ELSE '' END || '.m4b' AS path FROM s""")
def template_path(spark, d):
    """Destination of every book: a folder and a file template with groups that go when a field is missing."""
    rows, fields = book(spark, d)
    return rows.select("p_partkey", templates.target_path("[$Franchise]/$SortAuthor/$Series", FILE, fields, ".m4b").alias("path"))


@query("""SELECT p_partkey, p_brand AS author, CAST(p_size AS VARCHAR) AS sequence, p_name AS title, CAST(p_size + 1950 AS VARCHAR) AS year FROM part""")
def template_parse(spark, d):
    """File names that one template built, taken apart by another."""
    rows, fields = book(spark, d)
    fields = fields | {"title": F.replace("p_name", F.lit(" "), F.lit("_")), "series_name": F.col("p_type"), "sequence": F.col("p_size"), "year": F.col("p_size") + 1950}
    name = F.concat(templates.render("$Author - $SerNum. $Title ($PubYear)", templates.token_values(fields)), F.lit(".mp3"))
    return rows.select("p_partkey", templates.parse_name("$Author - $SerNum. $Title ($PubYear)", name).alias("p")).select("p_partkey", "p.*")


def lines(spark: SparkSession, d: str) -> DataFrame:
    """(l_orderkey, l_linenumber, k, n): the distinct lines of orders as files, their place in the order and how many there are."""
    own = Window.partitionBy("l_orderkey")
    sorted_by = own.orderBy("l_linenumber")
    # lines are dealt and sorted once: of equal ones the first is left
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").withColumns({"k": F.dense_rank().over(sorted_by), "_at": F.row_number().over(sorted_by), "_first": F.rank().over(sorted_by)})
    return rows.where("_at = _first").drop("_at", "_first").withColumn("n", F.count("*").over(own))


LINES_SQL = "l AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))"


def file_names(spark: SparkSession, d: str) -> DataFrame:
    """(l_orderkey, l_linenumber, kind, n, name): files of a book, named in the style of the book's kind; n files a book."""
    rows = lines(spark, d).withColumn("kind", F.col("l_orderkey") % 5)
    k = F.col("l_linenumber").cast("string")
    total = (F.col("n") + F.col("l_orderkey") % 3).cast("string")
    name = F.when(F.col("kind") == 0, F.concat(F.lit("The Book "), k, F.lit(" of "), total)).when(F.col("kind") == 1, F.concat(F.lit("Disc 0"), k, F.lit("-0"), k, F.lit(" of "), total)).when(F.col("kind") == 2, F.concat(F.lit("Chapter "), k, F.lit(" The End")))
    return rows.withColumn("name", name.when(F.col("kind") == 3, F.concat(F.lit("CD"), k, F.lit("a"))).otherwise(F.concat(F.lit("1984 - Title"), k)))


@query(f"""WITH {LINES_SQL}, t AS (SELECT l_orderkey, l_linenumber, l_orderkey % 5 AS kind, n + l_orderkey % 3 AS total FROM l)
SELECT l_orderkey, l_linenumber, CASE WHEN kind < 4 AND kind <> 2 THEN 1 WHEN kind = 2 THEN 1 ELSE 0 END::INTEGER AS n_marks, CASE WHEN kind < 4 THEN l_linenumber END::INTEGER AS "index", CASE WHEN kind < 2 THEN total END::INTEGER AS total,
CASE WHEN kind = 1 THEN l_linenumber END::INTEGER AS "end", CASE WHEN kind = 3 THEN 'a' WHEN kind < 4 THEN '' END AS half,
CASE kind WHEN 0 THEN 'The Book' WHEN 1 THEN '' WHEN 2 THEN 'The End' WHEN 3 THEN '' ELSE '1984 - Title' || l_linenumber END AS rest FROM t""")
def part_marks(spark, d):
    """Part marks of every file name, and what the name is without them."""
    found = names.part_marks(F.col("name"))
    return file_names(spark, d).select("l_orderkey", "l_linenumber", F.size(found).alias("n_marks"), F.get(found, F.lit(0)).alias("m"), names.without_parts(F.col("name")).alias("rest")).select("l_orderkey", "l_linenumber", "n_marks", "m.*", "rest")


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_orderkey % 5 AS kind, count(*) OVER (PARTITION BY l_orderkey) AS n, count(*) OVER (PARTITION BY l_orderkey) + l_orderkey % 3 AS total FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <> 3)),
g AS (SELECT l_orderkey, any_value(kind) AS kind, any_value(n) AS n, any_value(total) AS total, list_sort(list(CAST(l_linenumber AS BIGINT))) AS held FROM t GROUP BY 1),
b AS (SELECT *, list_filter(range(1, total + 1), lambda i: NOT list_contains(held, i)) AS by_total, list_filter(range(CASE WHEN held[1] > 1 AND held[1] <= 3 THEN 1 ELSE held[1] END, held[-1] + 1), lambda i: NOT list_contains(held, i)) AS by_name FROM g),
c AS (SELECT l_orderkey, CASE WHEN kind < 2 AND held[-1] <= total THEN 'total' WHEN kind = 2 THEN 'name' END AS "by", CASE WHEN kind < 2 AND held[-1] <= total THEN CASE WHEN len(by_total) <= n THEN by_total END WHEN kind = 2 AND n >= 3 AND len(by_name) <= n THEN by_name END AS lost FROM b)
SELECT l_orderkey, "by", CAST(len(lost) AS INTEGER) AS n_missing, array_to_string(lost, ',') AS missing FROM c WHERE len(lost) > 0""")
def missing_files(spark, d):
    """What every book lacks once its third file is lost, by totals in names or by numbers in front of them."""
    rest = table(spark, d, "lineitem").where("l_linenumber <> 3").select("l_orderkey", "l_linenumber").distinct()
    counts = rest.withColumns({"n": F.count("*").over(Window.partitionBy("l_orderkey")), "kind": F.col("l_orderkey") % 5})
    k, total = F.col("l_linenumber").cast("string"), (F.col("n") + F.col("l_orderkey") % 3).cast("string")
    name = F.when(F.col("kind") == 0, F.concat(F.lit("The Book "), k, F.lit(" of "), total)).when(F.col("kind") == 1, F.concat(F.lit("Disc 0"), k, F.lit("-0"), k, F.lit(" of "), total)).when(F.col("kind") == 2, F.concat(F.lit("Chapter "), k, F.lit(" The End")))
    return files.missing_tracks(counts.select("l_orderkey", name.otherwise("x").alias("name"), F.lit(None).cast("int").alias("track")), "l_orderkey", "name", "track")


@query(f"""WITH {LINES_SQL}, t AS (SELECT *, l_orderkey % 4 AS kind FROM l)
SELECT l_orderkey, l_linenumber, CASE WHEN n = 1 THEN 'single' WHEN kind = 0 THEN 'track' WHEN kind = 1 THEN 'total' WHEN kind = 2 THEN 'name' ELSE 'blocked' END AS "by",
CAST(CASE WHEN n = 1 THEN 1 WHEN kind = 0 THEN n + 1 - k WHEN kind < 3 THEN k END AS INTEGER) AS place FROM t""")
def part_places(spark, d):
    """Place of every file in its book: by track (reversed), by totals, by the natural order of names; none where names are alike."""
    rows = lines(spark, d).withColumn("kind", F.col("l_orderkey") % 4)
    k, n = F.col("k"), F.col("n")
    made = rows.withColumns({
        "track": F.when(F.col("kind") == 0, n + 1 - k),
        "name": F.when(F.col("kind") == 1, F.concat((9 - k).cast("string"), F.lit(" x "), k.cast("string"), F.lit(" of "), n.cast("string"))).when(F.col("kind") == 2, F.concat(F.lit("v2 p"), (k * 7).cast("string"))).otherwise("same"),
    })
    return files.part_order(made, "l_orderkey", "name", "track").select("l_orderkey", "l_linenumber", "place", "by")


@query("""SELECT p_partkey, p_name AS title, CAST(CASE WHEN p_size % 2 = 0 THEN 1950 + p_size END AS INTEGER) AS year, CASE WHEN p_size % 3 = 0 THEN p_brand || '|' || p_type ELSE '' END AS narrators,
CASE WHEN p_size % 5 = 0 THEN p_type END AS series, CAST(CASE WHEN p_size % 5 = 0 THEN p_size WHEN p_size % 5 = 1 THEN p_size + 0.5 END AS DOUBLE) AS sequence FROM part""")
def folder_titles(spark, d):
    """Folder names with a book's number, year and readers, taken apart again."""
    col, empty = F.col, F.lit("")
    size = col("p_size")
    number = F.when(size % 5 == 0, F.concat(F.lit("("), "p_type", F.lit(", Book #"), size.cast("string"), F.lit(") "))).when(size % 5 == 1, F.concat(F.lit("#"), size.cast("string"), F.lit(".5 - "))).otherwise(empty)
    year = F.when(size % 2 == 0, F.concat((size + 1950).cast("string"), F.lit(" - "))).otherwise(empty)
    readers = F.when(size % 3 == 0, F.concat(F.when(size % 6 == 0, F.lit(" (read by ")).otherwise(F.lit(" - read by ")), "p_brand", F.lit(" & "), "p_type", F.when(size % 6 == 0, F.lit(")")).otherwise(empty))).otherwise(empty)
    found = table(spark, d, "part").select("p_partkey", names.folder_title(F.concat(number, year, "p_name", readers)).alias("t"))
    return found.select("p_partkey", "t.title", "t.year", F.array_join("t.narrators", "|").alias("narrators"), "t.series", "t.sequence")


@query("""SELECT p_partkey, CAST(CASE p_size % 6 WHEN 4 THEN NULL WHEN 3 THEN p_size + 0.5 ELSE p_size END AS DOUBLE) AS sequence, CASE WHEN p_size % 6 <> 4 THEN p_name END AS cleaned, CASE p_size % 6 WHEN 4 THEN NULL ELSE p_size % 6 NOT IN (2, 5) END AS strong FROM part""")
def sequence_affixes(spark, d):
    """Sequence numbers before and after titles, and whether they are sure to be ones."""
    size, name = F.col("p_size"), F.col("p_name")
    k = size.cast("string")
    forms = {0: (k, F.lit(" - "), name), 1: (name, F.lit(" ("), k, F.lit(")")), 2: (k, F.lit("-"), name), 3: (name, F.lit(" ["), k, F.lit(".5]")), 4: (name, F.lit(" "), k), 5: (name, F.lit("_"), k)}
    made = F.lit(None)
    for rest, parts in forms.items():
        made = F.when(size % 6 == rest, F.concat(*parts)).otherwise(made)
    return table(spark, d, "part").select("p_partkey", names.sequence_affix(made).alias("a")).select("p_partkey", "a.*")
