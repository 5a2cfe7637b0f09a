"""Queries over a library as a whole: folder trees, kinds of nodes, the navigator, phases, cohorts of files, verdicts on titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import triage
from lectern.operators import axioms, cohorts, entities, phases, titles, trees
from lectern.plans.naming import LINES_SQL, lines
from lectern.plans.registry import query
from lectern.sources.tables import table


def nth(values: tuple[str, ...], k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))


def sql_nth(values: tuple[str, ...], k: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[{k} + 1]"


# --- phases: users of the events are books, each event sets a phase, the last one of a phase counts

PHASES_SQL = f"""p AS (SELECT user_id AS book, phase, arg_max(state, event_id) AS state FROM (SELECT user_id, event_id, {sql_nth(phases.PHASES, "event_id % 7")} AS phase, {sql_nth(phases.STATES[:3], "event_id // 7 % 3")} AS state FROM events) GROUP BY 1, 2)"""


def phase_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    rows = table(spark, d, "events").select(F.col("user_id").alias("book"), k, nth(phases.PHASES, k % 7).alias("phase"), nth(phases.STATES[:3], F.floor(k / 7) % 3).alias("state"))
    return rows.groupBy("book", "phase").agg(F.max_by("state", "event_id").alias("state"))


@query(f"WITH {PHASES_SQL} SELECT s.phase, count(p.book) AS n FROM (SELECT unnest({list(phases.PHASES)}) AS phase) s LEFT JOIN p ON p.phase = s.phase AND p.state = 'fresh' GROUP BY 1")
def phase_funnel(spark, d):
    return phases.funnel(phase_rows(spark, d))


@query(f"""WITH {PHASES_SQL}, b AS (SELECT user_id AS book, user_id % 11 = 0 AS skipped, user_id % 7 = 0 AS confirmed, max(value) AS confidence, min(value) AS identity, user_id % 3 > 0 AS named FROM events GROUP BY user_id),
f AS (SELECT b.*, coalesce(bool_or(p.phase = 'organize' AND p.state = 'fresh'), false) AS organized, coalesce(bool_or(p.phase = 'encode' AND p.state = 'fresh'), false) AS encoded,
coalesce(bool_or(p.phase IN ('identify', 'match') AND p.state = 'fresh'), false) AS known FROM b LEFT JOIN p ON p.book = b.book GROUP BY ALL)
SELECT book, CASE WHEN skipped THEN 'skipped' WHEN organized THEN 'organized' WHEN encoded THEN 'encoded' WHEN NOT known THEN 'detected' WHEN confirmed OR (confidence >= 300 AND named) THEN 'ready'
WHEN named AND identity >= 1 THEN 'identified' ELSE 'needs_review' END AS state FROM f""")
def state_machine(spark, d):
    """State of every book by its phases and confidences."""
    k = F.col("user_id")
    books = table(spark, d, "events").groupBy("user_id").agg(F.max("value").alias("confidence"), F.min("value").alias("identity_confidence"))
    books = books.select(k.alias("book"), (k % 11 == 0).alias("skipped"), (k % 7 == 0).alias("confirmed"), "confidence", "identity_confidence", (k % 3 > 0).alias("has_identity"))
    return phases.states(books, phase_rows(spark, d), ready=300, identified=1)


@query(f"""WITH {PHASES_SQL}, r AS (SELECT *, list_position({list(phases.PHASES)}, phase) AS at FROM p), c AS (SELECT DISTINCT user_id AS book, {sql_nth(phases.PHASES, "event_id // 3 % 7")} AS phase FROM events WHERE event_id % 3 = 0),
u AS (SELECT book, phase, state FROM p UNION ALL SELECT c.book, c.phase, 'pending' FROM c ANTI JOIN p ON c.book = p.book AND c.phase = p.phase),
m AS (SELECT u.*, list_position({list(phases.PHASES)}, u.phase) AS at, EXISTS (SELECT 1 FROM c WHERE c.book = u.book AND c.phase = u.phase) AS own, EXISTS (SELECT 1 FROM c WHERE c.book = u.book AND u.state <> 'pending'
AND CASE WHEN u.phase = 'encode' THEN c.phase = 'search' ELSE list_position({list(phases.PHASES)}, c.phase) < list_position({list(phases.PHASES)}, u.phase) END) AS below FROM u)
SELECT book, phase, CASE WHEN own OR below THEN 'stale' ELSE state END AS state, below AND NOT own AS staled FROM m""")
def phase_invalidation(spark, d):
    """Phases of every book after the changes that every third event makes."""
    k = F.col("event_id")
    changes = table(spark, d, "events").where(k % 3 == 0).select(F.col("user_id").alias("book"), nth(phases.PHASES, F.floor(k / 3) % 7).alias("phase"))
    return phases.invalidate(phase_rows(spark, d), changes)


# --- folder trees: regions, nations, customers


def customer_paths(spark: SparkSession, d: str) -> DataFrame:
    tree = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, d, "customer").join(tree, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", "n_name", F.concat_ws("/", F.lit(""), "r_name", "n_name", "c_name").alias("node"))


PATHS_SQL = "c AS (SELECT c_custkey, n_name, '/' || r_name AS region, '/' || r_name || '/' || n_name AS nation, '/' || r_name || '/' || n_name || '/' || c_name AS node FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@query(f"""WITH {PATHS_SQL}, o AS (SELECT c.*, o_orderstatus AS status, o_orderkey FROM orders JOIN c ON o_custkey = c_custkey)
SELECT x.node, status, count(*) AS n, min(o_orderkey) AS first FROM (SELECT '/' AS node, status, o_orderkey FROM o UNION ALL SELECT region, status, o_orderkey FROM o UNION ALL SELECT nation, status, o_orderkey FROM o UNION ALL SELECT node, status, o_orderkey FROM o) x GROUP BY 1, 2""")
def subtree_sums(spark, d):
    """Orders below every folder by status, and the first of them."""
    paths = customer_paths(spark, d)
    facts = table(spark, d, "orders").join(paths, F.col("o_custkey") == F.col("c_custkey")).groupBy("node", F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))
    return trees.roll_up(trees.folders(paths, "node"), facts, ["status"], {"n": F.sum, "first": F.min})


@query(f"""WITH {PATHS_SQL}, k AS (SELECT node, nation, region, CASE WHEN c_custkey % 4 = 0 THEN 'container' ELSE 'title' END AS kind, CASE WHEN c_custkey % 4 = 0 THEN 0.9 ELSE 1.0 END AS confidence FROM c),
n AS (SELECT nation, region, count(*) AS n, count(*) FILTER (kind = 'title') AS books, count(*) FILTER (kind = 'container') AS boxes FROM k GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN books * 2 > n THEN 'grouping' ELSE 'unknown' END AS kind FROM n), r AS (SELECT region, count(*) AS n, count(*) FILTER (kind = 'grouping') AS books FROM m GROUP BY 1), s AS (SELECT *, CASE WHEN books * 2 > n THEN 'grouping' ELSE 'unknown' END AS kind FROM r)
SELECT node, kind, confidence::DOUBLE AS confidence, 0 AS book_like FROM k
UNION ALL SELECT nation, kind, CASE WHEN kind = 'grouping' THEN round(least(1.0, round_even(books / n, 2) + 0.1), 2) ELSE 0 END, boxes FROM m
UNION ALL SELECT region, kind, CASE WHEN kind = 'grouping' THEN round_even(books / n, 2) ELSE 0 END, books FROM s
UNION ALL SELECT '/', CASE WHEN count(*) FILTER (kind = 'grouping') * 2 > count(*) THEN 'grouping' ELSE 'unknown' END, CASE WHEN count(*) FILTER (kind = 'grouping') * 2 > count(*) THEN round_even(count(*) FILTER (kind = 'grouping') / count(*), 2) ELSE 0 END, count(*) FILTER (kind = 'grouping') FROM s""")
def folder_kinds(spark, d):
    """Coarse kinds of all folders: each customer holds one book, every fourth two."""
    paths = customer_paths(spark, d)
    books = paths.select("node", F.explode(F.sequence(F.lit(1), F.when(F.col("c_custkey") % 4 == 0, 2).otherwise(1))).alias("k"), F.lit(1).cast("long").alias("n_files"))
    return trees.coarse_kinds(trees.folders(paths, "node"), books).select("node", "kind", F.col("kind_confidence").alias("confidence"), "book_like")


def node_library(spark: SparkSession, d: str) -> axioms.Library:
    """Customers as folders of one book each, tagged with their nation as author (every fifth with another's) or not, some in a series."""
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    # digits to letters: a name that ends in a number is no author's
    lettered = lambda c: F.translate(c, "_#0123456789", "  abcdefghij").alias(c)
    paths = customer_paths(spark, d).select("c_custkey", lettered("n_name"), lettered("node"))
    books = paths.select(
        k.alias("book"), "node", F.concat(F.lit("Book "), k.cast("string")).alias("title"), F.when(k % 3 == 0, "tag").otherwise("directory").alias("title_prov"), F.when(k % 5 == 0, F.array(F.lit("Guest Author"))).when(k % 2 == 0, F.array("n_name")).alias("authors"),
        F.when((k % 5 == 0) | (k % 2 == 0), F.when(k % 97 == 0, "audible").otherwise("tag")).alias("authors_prov"), F.when(k % 7 == 0, F.concat(F.lit("Saga of "), "n_name")).alias("series"), F.lit("tag").alias("series_prov"), (k % 9).cast("double").alias("sequence"),
        none.alias("label"), F.concat(F.lit("0"), (k % 9).cast("string"), F.lit(" - part")).alias("stem"), F.lit(1).cast("long").alias("n_files"),
    )
    nodes = trees.coarse_kinds(trees.folders(paths, "node"), books)
    franchises = table(spark, d, "region").where("r_regionkey = 1").select(F.col("r_name").alias("name"))
    overrides = paths.where(k % 50 == 1).select("node", F.lit("series").alias("kind"), "n_name").withColumnRenamed("n_name", "value")
    return axioms.Library(nodes, books, franchises, overrides, author_depth=2)


@query(None)
def node_kinds(spark, d):
    """Kind, value and confidence of every folder by the votes of all axioms."""
    return axioms.classify(node_library(spark, d)).drop("reasons")


@query(None)
def handed_down(spark, d):
    """Author and series that every book gets from its folders."""
    lib = node_library(spark, d)
    return axioms.fill_down(lib.books, lib.nodes, axioms.classify(lib), author_depth=2)


# --- the navigator: nations are authors, priorities series, orders books


@query("""WITH b AS (SELECT o_orderkey AS book, 'T' || o_orderkey % 100 AS title, CASE WHEN o_orderkey % 4 > 0 THEN n_name END AS author, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS series, CAST(o_custkey % 10 AS DOUBLE) AS sequence, round(o_totalprice * 100) AS confidence
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey), a AS (SELECT *, coalesce(author, series) AS home FROM b WHERE coalesce(author, series) IS NOT NULL)
SELECT 'authors' AS view, home AS author, series, CAST(row_number() OVER (PARTITION BY home, series ORDER BY CASE WHEN series IS NULL THEN NULL ELSE sequence END, CASE WHEN series IS NULL THEN title END, book) AS INTEGER) AS place, book FROM a
UNION ALL SELECT 'series', NULL, series, CAST(row_number() OVER (PARTITION BY series ORDER BY sequence, book) AS INTEGER), book FROM b WHERE series IS NOT NULL
UNION ALL SELECT 'needs_id', NULL, NULL, CAST(row_number() OVER (ORDER BY confidence, book) AS INTEGER), book FROM b WHERE author IS NULL AND series IS NULL""")
def library_tree(spark, d):
    return entities.tree(tree_books(spark, d), no_aliases(spark))


def tree_books(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    people = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    rows = table(spark, d, "orders").join(people, F.col("o_custkey") == F.col("c_custkey"))
    series = F.when(k % 3 > 0, F.array(F.struct(F.col("o_orderpriority").alias("name"), (F.col("o_custkey") % 10).cast("double").alias("sequence"))))
    return rows.select(k.alias("book"), F.concat(F.lit("T"), (k % 100).cast("string")).alias("title"), F.when(k % 4 > 0, F.array("n_name")).alias("authors"), F.lit("tag").alias("authors_prov"), series.alias("series"), F.lit("tag").alias("series_prov"), F.round(F.col("o_totalprice") * 100).alias("confidence"))


def no_aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "kind string, name string, canonical string")


@query("""WITH b AS (SELECT o_orderkey AS book, CASE WHEN o_orderkey % 4 > 0 THEN n_name END AS author, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS series FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F')
SELECT 'authors' AS view, coalesce(author, series) AS author, series, count(*) AS n FROM b WHERE series IS NOT NULL GROUP BY 2, 3 UNION ALL SELECT 'authors', coalesce(author, series), NULL, count(*) FROM b WHERE coalesce(author, series) IS NOT NULL GROUP BY 2
UNION ALL SELECT 'series', NULL, series, count(*) FROM b WHERE series IS NOT NULL GROUP BY 3 UNION ALL SELECT 'needs_id', NULL, NULL, count(*) FROM b WHERE author IS NULL AND series IS NULL HAVING count(*) > 0""")
def library_tree_filtered(spark, d):
    """Nodes of the tree that are left when only orders of one state are wanted."""
    wanted = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("book"))
    return entities.branches(entities.narrowed(entities.tree(tree_books(spark, d), no_aliases(spark), places=False), wanted))


@query("""WITH s AS (SELECT p_partkey, lower(p_type) AS key, CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN lower(p_type) ELSE upper(p_type[1]) || lower(p_type[2:]) END AS name, CASE p_size % 3 WHEN 0 THEN 5 WHEN 1 THEN 3 ELSE 2 END AS authority FROM part),
b AS (SELECT s.* FROM s JOIN (SELECT key, max(authority) AS authority FROM s GROUP BY 1) USING (key, authority)), r AS (SELECT key, name, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, max(p_partkey), name) AS k FROM b GROUP BY 1, 2)
SELECT 'author' AS kind, key, name AS display, n AS n_books FROM r JOIN (SELECT key, count(*) AS n FROM s GROUP BY 1) USING (key) WHERE k = 1""")
def canonical_display(spark, d):
    """Name of every type as its most authoritative sources spell it most often."""
    k, t = F.col("p_partkey"), F.col("p_type")
    name = F.when(k % 3 == 0, t).when(k % 3 == 1, F.lower(t)).otherwise(F.initcap(t))
    none = F.lit(None)
    books = table(spark, d, "part").select(k.alias("book"), F.array(name).alias("authors"), nth(("manual", "tag", "directory"), F.col("p_size") % 3).alias("authors_prov"), none.cast("array<struct<name:string,sequence:double>>").alias("series"), none.cast("string").alias("series_prov"))
    return entities.displays(entities.memberships(books, no_aliases(spark)))


# --- cohorts: lines of an order as the files of a folder


@query(f"""WITH {LINES_SQL} SELECT l_orderkey, unnest([CASE WHEN l_orderkey % 2 = 0 THEN 'Ann Lee' ELSE 'Bo Ray' END, '(Saga ' || l_orderkey % 5 || ')', 'Title']) AS token FROM (SELECT DISTINCT l_orderkey FROM l WHERE n >= 2)""")
def constant_tokens(spark, d):
    """Tokens that the names of all files of a folder share."""
    name = F.concat(F.when(F.col("l_orderkey") % 2 == 0, "Ann Lee").otherwise("Bo Ray"), F.when(F.col("k") % 2 == 0, " - ").otherwise(".-."), F.lit("(Saga "), (F.col("l_orderkey") % 5).cast("string"), F.lit(") Title - 0"), F.col("k").cast("string"), F.lit("-x"), F.col("k").cast("string"))
    return cohorts.constant_tokens(lines(spark, d).withColumn("name", name), "l_orderkey", "name", "k").select("l_orderkey", "token")


@query("""WITH w AS (SELECT doc_id, source, unnest(list_distinct(string_split(lower(text[:200]), ' '))) AS token FROM documents), n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1)
SELECT source, token FROM w JOIN n USING (source) GROUP BY source, token, n HAVING count(*) * 2 >= n AND token <> ''""")
def duplicate_text_groups(spark, d):
    """Words that half of a source's documents have among their first 200 characters (the names of the documents here)."""
    name = F.array_distinct(F.split(F.lower(F.substring("text", 1, 200)), " "))
    docs = table(spark, d, "documents").select("doc_id", "source", F.explode(name).alias("token"))
    n = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    held = docs.where("token <> ''").groupBy("source", "token").agg(F.count("*").alias("c"))
    return held.join(n, "source").where("c * 2 >= n").select("source", "token")


@query(f"""WITH {LINES_SQL} SELECT l_orderkey, l_linenumber, CASE WHEN n = 1 OR l_orderkey % 4 <> 1 THEN 'single' ELSE 'multi' END AS kind, CASE WHEN n = 1 OR l_orderkey % 4 = 1 THEN k ELSE 1 END::INTEGER AS work,
CASE WHEN l_orderkey % 4 = 1 THEN 'Saga' WHEN l_orderkey % 4 = 2 AND n = 1 THEN 'Chap' END AS series, CASE WHEN l_orderkey % 4 = 1 OR l_orderkey % 4 = 2 AND n = 1 THEN k END::DOUBLE AS sequence FROM l""")
def filename_clusters(spark, d):
    """Works that the names of every folder's files tell: parts, a series, chapters, numbers glued to a title."""
    k, n = F.col("k").cast("string"), F.col("n").cast("string")
    letter = F.char(F.col("k") + 96)
    forms = (F.concat(F.lit("Title "), k, F.lit(" of "), n), F.concat(F.lit("Title"), letter, F.lit(" (Saga "), k, F.lit(")")), F.concat(F.lit("Cujo - Chap 0"), k, F.lit(" - x"), letter), F.concat(F.lit("0"), k, F.lit("Cujo")))
    name = F.element_at(F.array(*forms), (F.col("l_orderkey") % 4 + 1).cast("int"))
    return cohorts.cluster(lines(spark, d).withColumn("stem", name), "l_orderkey", "stem", "k").select("l_orderkey", "l_linenumber", "kind", "work", "series", "sequence")


@query(f"""WITH {LINES_SQL}, g AS (SELECT l_orderkey, any_value(n) AS n FROM l GROUP BY 1),
w AS (SELECT l_orderkey, CASE WHEN n < 2 THEN 0.0 WHEN l_orderkey % 3 = 0 THEN 10.0 ELSE 0.0 END + CASE WHEN n >= 2 AND l_orderkey % 3 <> 2 THEN 1.0 ELSE 0.0 END + 1.5 + 1.0 AS one, CASE WHEN l_orderkey % 6 = 0 THEN 18.0 ELSE 6.0 END AS many FROM g)
SELECT l_orderkey, CASE WHEN one > many THEN 'one' ELSE 'many' END AS outcome, one::DOUBLE AS one, many::DOUBLE AS many FROM w""")
def file_grouping(spark, d):
    """Whether every folder is one book or many, by the votes of its files' names, tags and lengths."""
    order, k = F.col("l_orderkey"), F.col("k")
    name = F.when(order % 3 == 0, F.concat(F.lit("Book - 0"), k.cast("string"))).when(order % 3 == 1, F.concat(F.lit("Book - "), F.char(k + 96), F.char(k + 97))).otherwise(F.concat(F.char(k + 96), F.char(k + 98)))
    text = lambda x: F.lit(x).cast("string")
    files = lines(spark, d).select("l_orderkey", "k", name.alias("name"), text(None).alias("title"), text("The Album").alias("album"), text(None).alias("asin"), text(None).alias("isbn"), text("A B").alias("artist"), F.when(order % 6 == 0, 20_000.0).otherwise(900.0).alias("seconds"))
    return cohorts.resolve_grouping(cohorts.grouping_votes(files, "l_orderkey", "k"), "l_orderkey")


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'agree' WHEN 1 THEN 'contradict' ELSE 'abstain' END AS verdict, CASE WHEN p_size % 3 = 0 THEN 'folder' ELSE '' END AS sources,
CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN 'Zebra Yonder' END AS suggested FROM part""")
def title_verdict(spark, d):
    """Whether every book's title is borne out by its folder and files."""
    size = F.col("p_size")
    folder = F.when(size % 3 == 0, F.concat((size + 1950).cast("string"), F.lit(" - "), F.initcap("p_name"))).when(size % 3 == 1, "Zebra Yonder").otherwise(F.col("p_brand"))
    books = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"), folder.alias("folder"), F.array("p_brand").alias("authors"), F.col("p_type").alias("series"), F.lit(None).cast("string").alias("franchise"))
    files = table(spark, d, "part").select("p_partkey", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("at")).withColumn("stem", F.concat(F.lit("Chapter "), F.col("at").cast("string")))
    return titles.verdicts(books, files, "p_partkey", "at").select("p_partkey", "verdict", F.array_join("sources", ",").alias("sources"), "suggested")


@query("""WITH b AS (SELECT *, CASE WHEN o_custkey % 3 > 0 THEN o_totalprice / 5000 ELSE (o_orderkey % 100) * 1.0 END AS sure, ['tag', 'directory', 'audible'][o_orderkey % 3 + 1] AS source FROM orders)
SELECT o_orderkey AS book, CASE WHEN sure >= 75 THEN 'high' WHEN sure >= 40 THEN 'mid' ELSE 'low' END AS bucket, CASE source WHEN 'audible' THEN 'match' ELSE source END AS tiers,
concat_ws(',', CASE WHEN o_orderkey % 4 = 0 THEN 'series' END, CASE WHEN o_orderkey % 5 = 0 THEN 'cover' END, 'ident', CASE WHEN o_orderkey % 4 = 1 THEN 'narrator' END, CASE WHEN o_orderkey % 7 = 0 THEN 'year' END) AS missing
FROM b WHERE o_orderstatus IN ('O', 'P') AND sure < 75 AND source <> 'tag' AND (o_orderkey % 4 = 0 OR o_orderkey % 7 = 0)""")
def facet_books(spark, d):
    """Orders as books through four facets, with their bands, tiers and missing fields."""
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    text = lambda where, v: F.when(where, F.lit(v))
    books = table(spark, d, "orders").select(
        k.alias("book"), F.col("o_orderstatus").alias("state"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_totalprice") / 5000).otherwise(0.0).alias("confidence"), (k % 100).cast("double").alias("identity_confidence"), nth(("tag", "directory", "audible"), k % 3).alias("authors_prov"), none.alias("series_prov"),
        F.when(k % 4 > 0, F.array(F.lit("s"))).alias("series"), F.when(k % 4 != 1, F.array(F.lit("n"))).alias("narrators"), text(k % 5 > 0, "c").alias("cover"), none.alias("asin"), none.alias("isbn"), text(k % 7 > 0, 2000).alias("year"),
        F.array().cast("array<string>").alias("findings"), F.array().cast("array<string>").alias("acknowledged"), F.lit(False).alias("missing"),
    )
    wanted = triage.facets({"state": ["O", "P"], "confidence": ["low", "mid"], "id_trust": ["directory", "match"], "missing": ["series", "year"]})
    return books.where(wanted).select("book", triage.confidence_bucket().alias("bucket"), F.array_join(triage.identity_tiers(), ",").alias("tiers"), F.array_join(triage.missing_fields(), ",").alias("missing"))
