"""Registered queries over the driver's tables, each with the SQL that must give the same rows.

Roles: part is a book (brand its author, type its genre), orders a library entry, lineitem its files, region > nation > customer
the folder tree, events an edit history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import names, search
from lectern.functions import text as fx
from lectern.operators import edits, files, hierarchy, pairs, ranks, votes
from lectern.plans.registry import query
from lectern.sources.tables import table
from lectern.streaming import windows

def cents(c: str | Column) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) * 100).cast("long")


# --- catalogues, statistics, top-k


@query("SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 8")
def catalog_top_brands(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(8)


@query("SELECT p_type AS value, count(*) AS n, count(DISTINCT p_brand) AS n_brands FROM part GROUP BY 1")
def catalog_counts_by_type(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_type").alias("value")).agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("n_brands"))


STATES = ("F", "O", "P", "X")


@query("SELECT s.state, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) s(state) LEFT JOIN orders ON o_orderstatus = s.state GROUP BY 1")
def state_counts(spark, d):
    states = spark.createDataFrame([(s,) for s in STATES], "state string")
    counts = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("state")).agg(F.count("*").alias("n"))
    return states.join(counts, "state", "left").select("state", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("""SELECT count(DISTINCT l_orderkey) AS n_books, count(*) AS n_files, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS duration,
CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS bytes, CAST(max(l_linenumber) AS BIGINT) AS most FROM lineitem""")
def library_stats(spark, d):
    return table(spark, d, "lineitem").agg(F.count_distinct("l_orderkey").alias("n_books"), F.count("*").alias("n_files"), F.sum(F.col("l_quantity").cast("long")).alias("duration"), F.sum(cents("l_extendedprice")).alias("bytes"), F.max("l_linenumber").cast("long").alias("most"))


BUCKETS = ((100_000, "low"), (250_000, "medium"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 250000 THEN 'medium' ELSE 'high' END AS bucket
FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice >= 100000""")
def facet_filter(spark, d):
    bucket = F.when(F.col("o_totalprice") < BUCKETS[0][0], "low").when(F.col("o_totalprice") < BUCKETS[1][0], "medium").otherwise("high")
    rows = table(spark, d, "orders").where(F.col("o_orderstatus").isin("O", "P") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_totalprice") >= BUCKETS[0][0]))
    return rows.select("o_orderkey", bucket.alias("bucket"))


@query("""SELECT doc_id FROM documents WHERE (contains(lower(lang), 'en') OR contains(lower(lang), 'fr')) AND NOT contains(lower(source), 'src1')
AND (contains(lower(text), 'the') OR contains(lower(lang), 'the') OR contains(lower(source), 'the'))""")
def search_dsl_documents(spark, d):
    docs = table(spark, d, "documents")
    clauses = search.parse("lang:en,fr -source:src1 the", {"lang", "source", "text"})
    return docs.where(search.predicate(clauses, {"text": F.col("text"), "lang": F.col("lang"), "source": F.col("source")})).select("doc_id")


@query("""SELECT name, kind, CASE WHEN lower(name) = 'nation_1' THEN 0 WHEN starts_with(lower(name), 'nation_1') THEN 1 ELSE 2 END AS tier FROM
(SELECT n_name AS name, 'nation' AS kind FROM nation UNION ALL SELECT s_name, 'supplier' FROM supplier UNION ALL SELECT c_name, 'customer' FROM customer)
WHERE contains(lower(name), 'nation_1') ORDER BY tier, name, kind LIMIT 20""")
def search_rank_nodes(spark, d):
    side = lambda t, c: table(spark, d, t).select(F.col(c).alias("name"), F.lit(t).alias("kind"))
    all_of = side("nation", "n_name").unionByName(side("supplier", "s_name")).unionByName(side("customer", "c_name"))
    low = F.lower("name")
    tier = F.when(low == "nation_1", 0).when(low.startswith("nation_1"), 1).otherwise(2)
    return all_of.where(low.contains("nation_1")).withColumn("tier", tier).orderBy("tier", "name", "kind").limit(20)


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS place FROM customer")
def sort_confidence(spark, d):
    return ranks.place(table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"]).select("c_custkey", "place")


@query("SELECT l_orderkey, l_partkey, CAST(round(price * 100) AS BIGINT) AS cents FROM (SELECT l_orderkey, l_partkey, max(l_extendedprice) AS price, row_number() OVER (PARTITION BY l_orderkey ORDER BY max(l_extendedprice) DESC, l_partkey) AS k FROM lineitem GROUP BY 1, 2) WHERE k <= 2")
def top_files_per_book(spark, d):
    best = table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_extendedprice").alias("price"))
    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("price"), "l_partkey"))
    return best.withColumn("k", k).where("k <= 2").select("l_orderkey", "l_partkey", cents("price").alias("cents"))


# --- scalar functions


@query("""SELECT p_partkey AS id, trim(lower(regexp_replace(regexp_replace(p_name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'))) AS key FROM part
UNION ALL SELECT c_custkey, trim(lower(regexp_replace(regexp_replace(c_name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'))) FROM customer""")
def normalize_key_names(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), fx.entity_key(F.col("p_name")).alias("key")).unionByName(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), fx.entity_key(F.col("c_name")).alias("key")))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS title FROM part")
def titlecase_parts(spark, d):
    return table(spark, d, "part").select("p_partkey", fx.title_case(F.col("p_name")).alias("title"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?i)<(?:br|/p|/div)[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'),
'&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t]+', ' ', 'g'), '\n[ \t\r\n\f\x0b]*\n+', chr(10), 'g')) AS description FROM pages""")
def html_description(spark, d):
    return table(spark, d, "pages").select("page_id", fx.description(F.col("html")).alias("description"))


@query("SELECT r_regionkey, count(*) AS n, min(person) AS first FROM (SELECT r_regionkey, unnest(['A. ' || r_name, 'B. ' || r_name, r_name]) AS person FROM region) GROUP BY 1")
def split_people(spark, d):
    joined = F.concat(F.lit("A. "), F.col("r_name"), F.lit(" & B. "), F.col("r_name"), F.lit("; "), F.col("r_name"), F.lit(" ;"))
    rows = table(spark, d, "region").select("r_regionkey", F.explode(fx.people(joined)).alias("person"))
    return rows.groupBy("r_regionkey").agg(F.count("*").alias("n"), F.min("person").alias("first"))


@query("""SELECT p_partkey, t || CAST((10 - list_sum(list_transform(range(1, 13), lambda i: CAST(substr(t, i, 1) AS INTEGER) * (CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END))) % 10) % 10 AS VARCHAR) AS isbn
FROM (SELECT p_partkey, '978' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS t FROM part)""")
def isbn_check_digit(spark, d):
    return table(spark, d, "part").select("p_partkey", fx.isbn13(F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("isbn"))


@query("""SELECT event_id, s AS seconds, CAST(s // 3600 AS VARCHAR) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS code
FROM (SELECT event_id, CAST(floor(value * 60) AS BIGINT) AS s FROM events WHERE value >= 0)""")
def runtime_format_parse(spark, d):
    rows = table(spark, d, "events").where("value >= 0").select("event_id", fx.timecode(F.floor(F.col("value") * 60)).alias("code"))
    return rows.select("event_id", fx.seconds_of(F.col("code")).alias("seconds"), "code")


@query("SELECT c_custkey, substr(sha1('/' || r_name || '/' || n_name || '/' || c_name), 1, 16) AS id FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def path_ids(spark, d):
    tree = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, d, "customer").join(tree, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", fx.path_id(F.concat_ws("/", F.lit(""), "r_name", "n_name", "c_name")).alias("id"))


@query("SELECT p_brand || '/' || p_type || '/' || p_name AS path, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1 HAVING count(*) > 1")
def target_collisions(spark, d):
    path = F.concat_ws("/", "p_brand", "p_type", "p_name").alias("path")
    return table(spark, d, "part").groupBy(path).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first")).where("n > 1")


# --- hierarchy, entities, graph


@query("""SELECT r_name, n_name, count(DISTINCT c_custkey) AS n_customers, count(o_orderkey) AS n_orders FROM region JOIN nation ON n_regionkey = r_regionkey
JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ROLLUP (r_name, n_name)""")
def hierarchy_rollup(spark, d):
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("k"))
    rows = table(spark, d, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    tree = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.join(tree, F.col("c_nationkey") == F.col("n_nationkey")).rollup("r_name", "n_name").agg(F.count("*").alias("n_customers"), F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("n_orders"))


def tree_edges(spark: SparkSession, d: str) -> DataFrame:
    """(child, parent) of the folder tree: nations under regions, customers under nations."""
    up = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    return up.unionByName(table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("parent")))


@query("""WITH e AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
o AS (SELECT * FROM (VALUES ('r0', 'zero'), ('r2', 'two'), ('n3', 'three'), ('n12', 'twelve')) t(node, value)),
a AS (SELECT child AS node, child AS anc, 0 AS distance FROM e UNION ALL SELECT child, parent, 1 FROM e UNION ALL SELECT x.child, y.parent, 2 FROM e x JOIN e y ON x.parent = y.child)
SELECT a.node, arg_min(o.value, a.distance) AS value, CAST(min(a.distance) AS INTEGER) AS distance FROM a JOIN o ON a.anc = o.node WHERE a.node LIKE 'c%' GROUP BY 1""")
def nearest_override(spark, d):
    values = spark.createDataFrame([("r0", "zero"), ("r2", "two"), ("n3", "three"), ("n12", "twelve")], "ancestor string, value string")
    return hierarchy.nearest(hierarchy.closure(tree_edges(spark, d)), values).where(F.col("node").startswith("c"))


@query("""WITH RECURSIVE p AS (SELECT 'NATION_' || i AS name, 'NATION_' || (i - i % 4) AS target FROM range(0, 25) t(i) WHERE i % 4 = 1 UNION ALL SELECT 'NATION_' || i, 'NATION_' || (i - 1) FROM range(0, 25) t(i) WHERE i % 4 > 1),
w AS (SELECT name, target FROM p UNION ALL SELECT w.name, p.target FROM w JOIN p ON w.target = p.name)
SELECT w.name, w.target AS canonical FROM w ANTI JOIN p ON w.target = p.name""")
def alias_closure(spark, d):
    i = F.regexp_extract("n_name", r"(\d+)$", 1).cast("int")
    to = F.when(i % 4 == 1, i - i % 4).otherwise(i - 1)
    pairs = table(spark, d, "nation").where(i % 4 > 0).select(F.col("n_name").alias("name"), F.concat(F.lit("NATION_"), to).alias("target"))
    return hierarchy.aliases(pairs)


@query("SELECT n_name AS entity, count(DISTINCT c_custkey) AS n_members, count(*) AS n_books, min(o_orderkey) AS first FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def entity_membership(spark, d):
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("k"), F.min("o_orderkey").alias("f"))
    rows = per.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("n_name").alias("entity")).agg(F.count("*").alias("n_members"), F.sum("k").alias("n_books"), F.min("f").alias("first"))


@query("""WITH e AS (SELECT 'n' || n_nationkey AS a, 'r' || n_regionkey AS b FROM nation UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
h0 AS (SELECT 'r1' AS node, 0 AS hop), h1 AS (SELECT b AS node, 1 AS hop FROM u WHERE a = 'r1'), h2 AS (SELECT DISTINCT u.b AS node, 2 AS hop FROM u JOIN h1 ON u.a = h1.node WHERE u.b <> 'r1' AND u.b NOT IN (SELECT node FROM h1))
SELECT node, hop, greatest(0, count(*) OVER () - 60)::BIGINT AS omitted FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) ORDER BY hop, node LIMIT 60""")
def bfs_neighborhood(spark, d):
    edges = tree_edges(spark, d).select(F.col("child").alias("src"), F.col("parent").alias("dst"))
    return hierarchy.neighbourhood(edges, "r1", 2, 60)


@query("""SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n_customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n_suppliers FROM nation""")
def inspect_counts(spark, d):
    count = lambda t, k, n: table(spark, d, t).groupBy(F.col(k).alias("n_nationkey")).agg(F.count("*").alias(n))
    rows = table(spark, d, "nation").join(count("customer", "c_nationkey", "n_customers"), "n_nationkey", "left").join(count("supplier", "s_nationkey", "n_suppliers"), "n_nationkey", "left")
    return rows.select("n_name", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_customers", "n_suppliers")])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS INTEGER) AS place FROM lineitem GROUP BY 1, 2")
def series_order(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")))


# --- elections


@query("""SELECT user_id, event_type AS winner, w AS weight, CAST(t AS BIGINT) AS total, c AS candidates, CASE WHEN t = 0 THEN 0.0 ELSE round_even(w / t, 2) END AS share FROM (SELECT user_id, event_type, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS w,
row_number() OVER (PARTITION BY user_id ORDER BY sum(CAST(round(value * 100) AS BIGINT)) DESC, max(CAST(round(value * 100) AS BIGINT)) DESC, event_type) AS k, sum(sum(CAST(round(value * 100) AS BIGINT))) OVER (PARTITION BY user_id) AS t,
count(*) OVER (PARTITION BY user_id) AS c FROM events GROUP BY 1, 2) WHERE k = 1""")
def election(spark, d):
    return votes.elect(table(spark, d, "events"), "user_id", "event_type", cents("value"))


@query("""SELECT user_id, event_type AS winner, w AS weight, CAST(t AS BIGINT) AS total, c AS candidates FROM (SELECT user_id, event_type, CAST(sum(x) AS BIGINT) AS w, row_number() OVER (PARTITION BY user_id ORDER BY sum(x) DESC, min(event_id)) AS k,
sum(sum(x)) OVER (PARTITION BY user_id) AS t, count(*) OVER (PARTITION BY user_id) AS c FROM (SELECT *, CASE WHEN event_id % 97 = 0 THEN 100 ELSE 1 END AS x FROM events) GROUP BY 1, 2) WHERE k = 1""")
def election_ordered_ties(spark, d):
    weight = F.when(F.col("event_id") % 97 == 0, 100).otherwise(1)
    return votes.elect(table(spark, d, "events"), "user_id", "event_type", weight, tie=F.col("event_id")).drop("share")


@query("""SELECT o_custkey, o_orderstatus AS winner, n AS weight, CAST(t AS BIGINT) AS total, c AS candidates FROM (SELECT o_custkey, o_orderstatus, count(*) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderstatus) AS k,
sum(count(*)) OVER (PARTITION BY o_custkey) AS t, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders GROUP BY 1, 2) WHERE k = 1 AND n * 100 >= t * 75""")
def artist_consensus(spark, d):
    return votes.consensus(table(spark, d, "orders"), "o_custkey", "o_orderstatus", 75).drop("share")


@query("""WITH v AS (SELECT c_nationkey, c_mktsegment AS value, trim(regexp_replace(lower(c_mktsegment), '\\s+', ' ', 'g')) AS key, CAST(round(c_acctbal * 100) AS BIGINT) AS w,
c_acctbal > 9500 AS hard, c_name AS source, c_custkey FROM customer), ok AS (SELECT * FROM v WHERE key <> '' AND w > 0),
pool AS (SELECT * FROM ok WHERE hard OR c_nationkey NOT IN (SELECT c_nationkey FROM ok WHERE hard)),
k AS (SELECT c_nationkey, key, sum(w) AS n, max(w) AS most, arg_min(value, c_custkey) AS value, first(source ORDER BY w DESC, c_custkey) AS source FROM pool GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY c_nationkey) AS total, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, most DESC, key) AS place FROM k)
SELECT s.c_nationkey, r.value, CASE WHEN r.n IS NULL THEN 0.0::DOUBLE ELSE round_even(r.n / r.total, 2)::DOUBLE END AS share, r.source
FROM (SELECT DISTINCT c_nationkey FROM customer) s LEFT JOIN r ON s.c_nationkey = r.c_nationkey AND r.place = 1""")
def field_resolve(spark, d):
    rows = table(spark, d, "customer").select("c_nationkey", "c_mktsegment", cents("c_acctbal").alias("cents"), "c_name", (F.col("c_acctbal") > 9500).alias("hard"), "c_custkey")
    return votes.resolve_field(rows, "c_nationkey", "c_mktsegment", "cents", "c_name", "hard", "c_custkey")


@query("SELECT lang, count(*) AS n, count(DISTINCT source) AS n_sources FROM documents GROUP BY 1 HAVING count(DISTINCT source) >= 2")
def author_consensus_providers(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_sources")).where("n_sources >= 2")


# --- matching and ranking


def part_sets(spark: SparkSession, d: str) -> DataFrame:
    """(p_partkey, p_size, w, id): each part's sorted token set, named by the first part of its size band that has it."""
    tokens = F.array_sort(F.array_distinct(F.split(F.concat_ws(" ", "p_name", F.lower("p_brand"), F.lower("p_type")), " ")))
    rows = table(spark, d, "part").select("p_partkey", "p_size", tokens.alias("w"))
    return rows.join(rows.groupBy("p_size", "w").agg(F.min("p_partkey").alias("id")), ["p_size", "w"])


PART_SETS_SQL = """t AS (SELECT p_partkey, p_size, list_sort(list_distinct(string_split(p_name || ' ' || lower(p_brand) || ' ' || lower(p_type), ' '))) AS w FROM part),
s AS (SELECT p_size, w, min(p_partkey) AS id FROM t GROUP BY 1, 2)"""


@query(f"WITH {PART_SETS_SQL} SELECT p_partkey, id FROM t JOIN s ON t.p_size = s.p_size AND t.w = s.w")
def match_score_members(spark, d):
    return part_sets(spark, d).select("p_partkey", "id")


@query(f"""WITH {PART_SETS_SQL} SELECT a.id AS a, b.id AS b, CAST(len(list_intersect(a.w, b.w)) * 1000 // len(list_distinct(list_concat(a.w, b.w))) AS BIGINT) AS permille
FROM s a JOIN s b ON a.p_size = b.p_size AND a.id < b.id WHERE len(list_intersect(a.w, b.w)) > 0""")
def match_score(spark, d):
    """All pairs of distinct sets of a size band that share a token (others score 0); match_score_members names their parts."""
    sets = part_sets(spark, d).where("p_partkey = id").select("p_size", F.col("id").alias("set"), F.explode("w").alias("token"))
    return pairs.of_sets(sets, ["p_size"], "set", "token").select("a", "b", F.floor(F.col("shared") * 1000 / F.col("united")).cast("long").alias("permille"))


@query("SELECT l_partkey, l_suppkey, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY min(abs(l_extendedprice - 20000)), l_suppkey) AS INTEGER) AS k FROM lineitem GROUP BY 1, 2")
def rank_candidates(spark, d):
    best = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min(F.abs(F.col("l_extendedprice") - 20000)).alias("gap"))
    return best.withColumn("k", F.row_number().over(Window.partitionBy("l_partkey").orderBy("gap", "l_suppkey"))).drop("gap")


@query("SELECT *, row_number() OVER (ORDER BY gap, o_orderkey) AS place FROM (SELECT o_orderkey, CAST(round(abs(o_totalprice - 150000) * 100) AS BIGINT) AS gap FROM orders)")
def runtime_closeness(spark, d):
    return ranks.place(table(spark, d, "orders").select("o_orderkey", cents(F.abs(F.col("o_totalprice") - 150000)).alias("gap")), ["gap", "o_orderkey"])


@query("""SELECT c_custkey, 'v' || c_nationkey || ' ' || c_name AS name, row_number() OVER (ORDER BY c_nationkey, regexp_replace(c_name, '[0-9]+$', ''), CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT), c_custkey) AS place FROM customer""")
def natural_sort(spark, d):
    name = F.concat(F.lit("v"), F.col("c_nationkey").cast("string"), F.lit(" "), "c_name")
    rows = table(spark, d, "customer").select("c_custkey", name.alias("name"), names.natural_key(name).alias("key"))
    return ranks.place(rows, ["key", "c_custkey"]).select("c_custkey", "name", "place")


# --- windows over files and events


@query("""SELECT l_orderkey, l_linenumber, n, CAST(sum(n) OVER w AS BIGINT) AS "end", CAST(sum(n) OVER w - n AS BIGINT) AS "start" FROM (SELECT l_orderkey, l_linenumber, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2)
WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)""")
def chapters_running(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.col("l_quantity").cast("long")).alias("n"))
    return hierarchy.running(rows, "l_orderkey", ["l_linenumber"], "n")


@query("SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following, date_diff('second', ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 600 AS far FROM events")
def chapters_lead(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    span = F.unix_timestamp(F.lead("ts").over(w)) - F.unix_timestamp("ts")
    return table(spark, d, "events").select("event_id", F.lead("event_id").over(w).alias("following"), (span > 600).alias("far"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text")
def keep_first_dedup(spark, d):
    keyed = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    return keyed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).drop("key")


@query("""WITH x AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_linenumber % 7 <> 0), y AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_linenumber % 5 <> 0),
sx AS (SELECT o, count(*) AS n FROM x GROUP BY 1), sy AS (SELECT o, count(*) AS n FROM y GROUP BY 1)
SELECT x.o AS a, y.o AS b, count(*) AS shared, any_value(sx.n) + any_value(sy.n) - count(*) AS united FROM x JOIN y ON x.p = y.p JOIN sx ON sx.o = x.o JOIN sy ON sy.o = y.o GROUP BY 1, 2""")
def jaccard_reassociate(spark, d):
    """Every pair of an order of one snapshot and one of the other that shares a part, before the greedy one-to-one choice."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return files.shared_parts(rows.where("l_linenumber % 7 <> 0"), rows.where("l_linenumber % 5 <> 0"), "l_orderkey", "l_partkey", 0)


SNAPSHOT_SQL = """a AS (SELECT o_orderkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS size FROM orders WHERE o_orderkey % 11 <> 0),
b AS (SELECT o_orderkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS size FROM orders WHERE o_orderkey % 13 <> 0)"""


def snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", cents("o_totalprice").alias("size"))
    return rows.where("o_orderkey % 11 <> 0"), rows.where("o_orderkey % 13 <> 0").withColumn("size", F.col("size") + F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0))


@query(f"""WITH {SNAPSHOT_SQL} SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed'
WHEN a.size = b.size AND a.o_orderstatus = b.o_orderstatus THEN 'same' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""")
def change_detection(spark, d):
    return files.changes(*snapshots(spark, d), "o_orderkey", ["o_orderstatus", "size"])


@query(f"""WITH {SNAPSHOT_SQL} SELECT CASE WHEN a.size = b.size THEN 'warm' ELSE 'cold' END AS kind, count(*) AS n FROM b LEFT JOIN a ON a.o_orderkey = b.o_orderkey GROUP BY 1""")
def warm_cache_split(spark, d):
    old, new = snapshots(spark, d)
    both = new.join(old.select("o_orderkey", F.col("size").alias("known")), "o_orderkey", "left")
    return both.groupBy(F.when(F.col("known") == F.col("size"), "warm").otherwise("cold").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 13 <> 0)")
def stale_ids(spark, d):
    old = table(spark, d, "orders").select("o_orderkey")
    return old.join(old.where("o_orderkey % 13 <> 0"), "o_orderkey", "left_anti")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0)")
def prune_dangling(spark, d):
    nodes = table(spark, d, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(nodes, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("""WITH h AS (SELECT l_orderkey, list_distinct(list(l_linenumber)) AS s, min(l_linenumber) AS low, max(l_linenumber) AS high, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1),
g AS (SELECT l_orderkey, n, list_filter(range(CASE WHEN low > 1 AND low <= 3 THEN 1 ELSE low END, high + 1), lambda i: NOT list_contains(s, i)) AS lost FROM h WHERE n >= 3)
SELECT l_orderkey, CAST(len(lost) AS INTEGER) AS n_missing, array_to_string(lost, ',') AS missing FROM g WHERE len(lost) > 0 AND len(lost) <= n""")
def track_gaps(spark, d):
    return files.gaps(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("""WITH l AS (SELECT l_orderkey, CAST(l_quantity AS BIGINT) * 6000 AS bitrate, CASE WHEN l_orderkey % 5 = 0 AND l_returnflag = 'R' THEN 'FLAC' ELSE 'MP3' END AS codec FROM lineitem WHERE l_quantity > 2 AND l_orderkey % 2 = 0),
t AS (SELECT *, CASE WHEN k <= 64 THEN 0 WHEN k <= 96 THEN 1 WHEN k <= 128 THEN 2 WHEN k <= 192 THEN 3 WHEN k <= 256 THEN 4 ELSE 5 END AS tier FROM (SELECT *, round_even(bitrate / 8000, 0) * 8 AS k FROM l))
SELECT l_orderkey, CASE WHEN count(DISTINCT codec) > 1 THEN 'files mix formats (FLAC + MP3)' ELSE 'files span ' || min(bitrate) // 1000 || '-' || max(bitrate) // 1000 || ' kbps' END AS detail FROM t GROUP BY 1 HAVING count(DISTINCT tier) > 1 OR count(DISTINCT codec) > 1""")
def mixed_quality(spark, d):
    """Orders whose lines, as files, are of several qualities; a quantity up to 2 and odd orders are files of unknown quality."""
    known = (F.col("l_quantity") > 2) & (F.col("l_orderkey") % 2 == 0)
    codec = F.when((F.col("l_orderkey") % 5 == 0) & (F.col("l_returnflag") == "R"), "FLAC").otherwise("MP3")
    rows = table(spark, d, "lineitem").select("l_orderkey", F.when(known, F.col("l_quantity").cast("long") * 6000).otherwise(0).alias("bitrate"), codec.alias("codec"), F.lit(44100).alias("sample_rate"), F.lit(2).alias("channels"))
    return files.mixed_quality(rows, "l_orderkey")


@query("""WITH e AS (SELECT event_id, user_id, date_diff('second', min(ts) OVER (PARTITION BY user_id), ts) - 60 AS s, date_diff('second', min(ts) OVER (PARTITION BY user_id), max(ts) OVER (PARTITION BY user_id)) // 2 AS total FROM events),
c AS (SELECT *, least(greatest(s, 0), total) AS b FROM e)
SELECT event_id, b AS "begin", greatest(coalesce(lead(b) OVER w, total), b) AS "end", CAST(row_number() OVER w AS INTEGER) AS place FROM c WINDOW w AS (PARTITION BY user_id ORDER BY b, event_id)""")
def chapters_normalized(spark, d):
    """Events of a user as chapters that begin a minute early and end at half of the user's time."""
    own = Window.partitionBy("user_id")
    second = lambda c: F.unix_timestamp(c)
    rows = table(spark, d, "events").withColumns({"first": F.min("ts").over(own), "last": F.max("ts").over(own)})
    rows = rows.select("event_id", "user_id", (second("ts") - second("first")).alias("s"), F.floor((second("last") - second("first")) / 2).alias("total"))
    return files.chapters(rows, "user_id", "s", "total", "event_id", -60).select("event_id", "begin", "end", "place")


@query("SELECT l_orderkey, count(*) AS n_empty FROM lineitem WHERE l_discount = 0 AND l_extendedprice > 65536 GROUP BY 1")
def empty_audio_finding(spark, d):
    return table(spark, d, "lineitem").where("l_discount = 0 and l_extendedprice > 65536").groupBy("l_orderkey").agg(F.count("*").alias("n_empty"))


@query("SELECT p_partkey, concat_ws(',', CASE WHEN p_size <= 5 THEN 'size' END, CASE WHEN p_name LIKE 'small%' THEN 'name' END) AS missing FROM part WHERE p_size <= 5 OR p_name LIKE 'small%'")
def missing_fields(spark, d):
    lost = F.concat_ws(",", F.when(F.col("p_size") <= 5, "size"), F.when(F.col("p_name").startswith("small"), "name"))
    return table(spark, d, "part").select("p_partkey", lost.alias("missing")).where("missing <> ''")


# --- edits and states


@query("SELECT user_id, event_type, arg_min(CAST(round(value * 100) AS BIGINT), event_id) AS restored, count(*) AS n_changes FROM events GROUP BY 1, 2")
def undo_batches(spark, d):
    return edits.undo(table(spark, d, "events").withColumn("old", cents("value")), "user_id", "event_type", "event_id", "old")


@query("SELECT new AS p_type, count(*) AS n FROM (SELECT CASE p_type WHEN 'ECONOMY' THEN 'STANDARD' WHEN 'PROMO' THEN NULL ELSE p_type END AS new FROM part) WHERE new IS NOT NULL GROUP BY 1")
def bulk_remap(spark, d):
    return edits.remap(table(spark, d, "part"), "p_type", {"ECONOMY": "STANDARD", "PROMO": None}).groupBy("p_type").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, 'c_mktsegment' AS field, c_mktsegment AS old_value, 'BUILDING' AS new_value FROM customer WHERE c_nationkey < 5 AND c_mktsegment <> 'BUILDING'")
def bulk_edit_log(spark, d):
    return edits.set_field(table(spark, d, "customer"), "c_custkey", "c_mktsegment", F.lit("BUILDING"), F.col("c_nationkey") < 5)


@query("SELECT l_orderkey, arg_max(l_partkey, (l_extendedprice, -l_partkey)) AS primary_part, count(*) AS n_files, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS duration FROM lineitem GROUP BY 1")
def combine_primary(spark, d):
    best = F.max(F.struct("l_extendedprice", (-F.col("l_partkey")).alias("k"))).alias("m")
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(best, F.count("*").alias("n_files"), F.sum(F.col("l_quantity").cast("long")).alias("duration"))
    return rows.select("l_orderkey", (-F.col("m.k")).alias("primary_part"), "n_files", "duration")


@query("SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M:%S') AS starts, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    return windows.tumbling_counts(table(spark, d, "events"))
