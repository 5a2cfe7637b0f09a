"""Names of a folder's files together: literal folders."""

from pyspark.sql import functions as F

from lectern.functions import chunks
from lectern.operators import cohorts
from lectern.plans import naming
from tests.measured import shuffled


def folder(spark, cases):
    return spark.createDataFrame([(p, k, n) for p, v in cases.items() for k, n in enumerate(v)], "p string, at int, name string")


def test_tokens(spark):
    cases = {
        "Worlds of Honor- David Weber - 27-60": ["Worlds of Honor", "David Weber", "27-60"], "A -B": ["A", "B"], "Author_-_Title": ["Author", "Title"], "Blow - #12 - X": ["Blow", "#12", "X"], "A.-.B--C": ["A", "B", "C"],
        "Clive Barker - Everville (HarperAud) - 6 of 8": ["Clive Barker", "(HarperAud)", "Everville", "6 of 8"], "X-Wing Catch-22 Jean-Étienne": ["X-Wing Catch-22 Jean-Étienne"], "Voyager -(Outlander 3)": ["Voyager", "(Outlander 3)"], "-a-": ["a"], "": [],
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, v string")
    assert [r["x"] for r in rows.select("i", chunks.cohort_tokens(F.col("v")).alias("x")).orderBy("i").collect()] == list(cases.values())


def test_constant_tokens(spark):
    cases = {
        "voyager": ["Diana Gabaldon - (Outlander 3) Voyager - D01.01-23", "Diana Gabaldon - (Outlander 3) Voyager - D01.02-23"], "flinx": ["Alan Dean Foster.-.Flinx Bk12 - 01-Trouble", "Alan Dean Foster.-.Flinx Bk12 - 02-More"],
        "case": ["Author - Title", "author - Other"], "none": ["01 - Title", "02 - Prologue"], "one": ["A - B"], "coyote": ["Coyote - Unb-001", "Coyote - Unb-002"], "null": ["A - B", None], "twice": ["A - A - 1", "a - 2"],
    }
    got = {}
    for r in cohorts.constant_tokens(folder(spark, cases), "p", "name", "at").collect():
        got.setdefault(r["p"], set()).add(r["token"])
    assert got == {"voyager": {"Diana Gabaldon", "(Outlander 3)", "Voyager"}, "flinx": {"Alan Dean Foster", "Flinx Bk12"}, "case": {"Author"}, "coyote": {"Coyote"}, "twice": {"A"}}
    only = {r["p"]: r["only_numbers"] for r in cohorts.varies_only_by_number(folder(spark, cases), "p", "name", "at").collect()}
    assert only == {"voyager": True, "flinx": False, "case": False, "none": False, "one": False, "coyote": True, "null": False, "twice": True}


FILES = "p string, at int, name string, title string, album string, asin string, isbn string, artist string, seconds double"


def test_one_book_or_many(spark):
    cases = {
        "voyager": [(f"Diana Gabaldon - Voyager - D01.0{k}-23", None, "Voyager", None, None, "Diana Gabaldon", 600.0) for k in (1, 2)], "long": [(f"Saga - Book {k}", None, None, None, None, None, 36_000.0) for k in (1, 2, 3)],
        "shelf": [(n, n, None, None, None, None, 600.0) for n in ("Dune", "Emma", "Ulysses")], "nothing": [(None,) * 7] * 2, "names": [(f"0{k}_4_{n}", None, None, None, None, None, 600.0) for k, n in enumerate(("The Coming", "On Love", "On Law", "End"), 1)],
        "other total": [(f"0{k}_9_{n}", None, None, None, None, None, 600.0) for k, n in enumerate(("The Coming", "On Love"), 1)], "album": [(n, f"{n} x", "The Book", None, None, "A B", 900.0) for n in "abcdefgh"], "album long": [(n, f"{n} x", "The Book", None, None, "A B", 20_000.0) for n in "abcdefgh"],
        "titles": [(n, f"Track {k}", None, None, None, None, None) for k, n in enumerate(("abc", "def"), 1)], "pairs long": [(f"{k} of 3 {n}", None, None, None, None, None, 30_000.0) for k, n in enumerate("xyz", 1)],
    }
    rows = spark.createDataFrame([(p, k, *f) for p, v in cases.items() for k, f in enumerate(v)], FILES)
    votes = cohorts.grouping_votes(rows, "p", "at").cache()
    got = {r["p"]: r["outcome"] for r in cohorts.resolve_grouping(votes, "p").collect()}
    assert got == {"voyager": "one", "long": "many", "shelf": "many", "nothing": "one", "names": "one", "other total": "many", "album": "one", "album long": "many", "titles": "one", "pairs long": "many"}
    said = {(r["p"], r["reason"]): r["weight"] for r in votes.collect()}
    assert said["voyager", "constant filename tokens"] == 2.0 and said["voyager", "shared work key"] == 1.5 and said["voyager", "uniform author"] == 1.0 and said["shelf", "prior: default to split unless one-evidence exceeds it"] == 6.0


CORPUS = {
    "one file": (["Tinker Dabble Doodle"], "single", 1), "camel parts": (["7thSigmaUnabridgedPart1_ep6", "7thSigmaUnabridgedPart2_ep6"], "single", 1), "kebab": (["girlblue-01-cd01-01", "girlblue-02-cd01-02", "girlblue-20-cd04-01"], "single", 1),
    "series": (["Alpha Wolf (Olento Research, 1)", "Bad Wolf (Olento Research 4)"], "multi", 2), "two": (["Pearl Harbor Christmas", "eleven Days in December"], "multi", 2), "ragged": (["Father of Lies (Darkly 1)", "Hidden Company", "Owlmen"], "multi", 3),
    "chapters": (["Cujo - Chap 01 - The Dog", "Cujo - Chap 02 - The Car", "Cujo - Epilogue"], "single", 1), "glued": (["01Cujo", "02Cujo", "03cujo"], "single", 1), "editions": (["Dune", "Dune (Deluxe)"], "multi", 2), "same": (["Dune", "Dune"], "single", 1),
    "numbers": (["Dune 1 of 2", "Dune 2 of 2"], "single", 1), "ragged numbers": (["Dune 1", "Dune 2 - The Messiah"], "unknown", 2), "empty": (["Dune", ""], "unknown", 2), "null": (["Dune", None], "unknown", 2), "orphan": (["Orphan Star-01 of 15", "Orphan Star-02 of 15"], "single", 1),
}


def test_clusters(spark):
    got = {}
    for r in cohorts.cluster(folder(spark, {p: v for p, (v, *_) in CORPUS.items()}), "p", "name", "at").orderBy("p", "at").collect():
        got.setdefault(r["p"], []).append(r)
    assert {p: (g[0]["kind"], len({r["work"] for r in g})) for p, g in got.items()} == {p: (kind, n) for p, (_, kind, n) in CORPUS.items()}
    label = lambda p: [(r["label"], r["series"], r["sequence"]) for r in got[p]]
    assert label("series") == [("Alpha Wolf", "Olento Research", 1.0), ("Bad Wolf", "Olento Research", 4.0)] and label("camel parts") == [("7th Sigma Unabridged Part", None, None)] * 2
    assert label("glued") == [("Cujo", None, None)] * 3 and label("chapters")[0][0] == "Cujo" and label("orphan")[0][0] == "Orphan Star 01 of"
    assert {p: g[0]["points"] for p, g in got.items()} == {
        "one file": 3, "camel parts": 4, "kebab": 4, "series": 4, "two": 4, "ragged": 1, "chapters": 1, "glued": 4, "editions": 0, "same": 3, "numbers": 4, "ragged numbers": 0, "empty": 0, "null": 0, "orphan": 4,
    }


def test_constant_tokens_of_long_names(spark):
    name = lambda k: " ".join(f"(t{i}x) " if i % 3 else f"(v{i}x{k}) " for i in range(150)) + "(T1X)"
    rows = spark.createDataFrame([("p", k, name(k)) for k in (2, 1, 3)] + [("q", 1, name(1)), (None, 1, "a"), (None, 2, "a")], "p string, at int, name string")
    found = sorted((r["place"], r["token"]) for r in cohorts.constant_tokens(rows, "p", "name", "at").collect())
    assert found == [(i, f"(t{i}x)") for i in range(150) if i % 3]


def test_constant_tokens_do_not_shuffle_tokens(spark):
    rows = spark.createDataFrame([(p, k, f"(a) (b) (c) (d{k}) (e) (f)") for p in range(100) for k in range(4)], "p int, at int, name string")
    found = cohorts.constant_tokens(rows, "p", "name", "at")
    assert found.count() == 500 and shuffled(spark, found) <= 400


def test_stems_are_cut_once(spark):
    rows = folder(spark, {"a": ["Title 1 of 2", "Title 2 of 2"], "b": ["01Cujo", "02Cujo"]})
    found = cohorts.cluster(rows, "p", "name", "at")
    assert "regexp" not in found._jdf.queryExecution().toString()
    assert {(r["p"], r["kind"], r["work"]) for r in found.collect()} == {("a", "single", 0), ("b", "single", 0)}


def test_a_stem_of_many_files_is_read_once(spark):
    rows = spark.range(0, 3000, 1, 3).selectExpr("id div 2 as p", "id as at", "concat('Dune ', id % 2 + 1, if(id % 4 < 2, ' of 2', ' x')) as name")
    found = cohorts.cluster(rows, "p", "name", "at")
    assert found.where("kind = 'single' and work = p * 2 and label like 'Dune%'").count() == 3000
    read = {f.rsplit("/", 1)[0] for f in found.inputFiles()}
    tables = [spark.read.parquet(f) for f in read]
    assert all(t.count() == 4 for t in tables if any(c.startswith("_") and c != "_stem" for c in t.columns)) and len(tables) > 1


def test_clusters_of_stems_beyond_the_broadcast(spark, monkeypatch):
    named = [(p, k, v) for p, (names, *_) in CORPUS.items() for k, v in enumerate(names)] + [(None, 1, "Dune 1"), (None, 2, "Dune 2"), ("tie", 1, "Dune b 1"), ("tie", 1, "Dune a 1"), ("no order", None, "Dune 1"), ("no order", 2, "Dune 2"), ("wide", 1, "A - B - C 1"), ("wide", 2, "A - B - D 1"), ("twice", 1, "01Cujo"), ("twice", 2, "01cujo")]
    rows = spark.createDataFrame(named, "p string, at int, name string")
    run = lambda: sorted(map(repr, cohorts.cluster(rows, "p", "name", "at").collect()))
    few = run()
    assert len(few) == len(named) - 2 and sum("kind='multi'" in r and "p='wide'" in r for r in few) == 2 and sum("p='twice'" in r and "work=1" in r for r in few) == 2
    monkeypatch.setattr(cohorts, "STEM_BYTES", 0)
    assert run() == few


def test_medians_against_a_bound(spark):
    cases = {
        "odd below": [1.0, 2.0, 90.0], "odd above": [1.0, 50.0, 90.0], "even below": [1.0, 8.0, 11.0, 90.0], "even at": [1.0, 8.0, 12.0, 90.0], "even above": [10.0, 11.0], "few": [1.0, 2.0, 3.0, 40.0], "at": [10.0], "ties": [10.0, 10.0, 1.0, 1.0],
        "nulls": [None, 12.0, None, 1.0, 11.0], "none": [None, None],
    }
    rows = spark.createDataFrame([(p, v) for p, values in cases.items() for v in values], "p string, v double")
    found = rows.groupBy("p").agg(cohorts.median_reaches(F.col("v"), 10.0).alias("got"), (F.median("v") >= 10.0).alias("want")).collect()
    assert all(r["got"] == r["want"] for r in found) and {r["p"] for r in found if r["got"]} == {"odd above", "even at", "even above", "at", "nulls"}


def test_grouping_holds_one_step_at_a_time(spark):
    files = spark.range(0, 400, 1, 1).selectExpr("id div 4 as p", "id as at", "concat('Ann - Book 0', id % 4) as name", "cast(null as string) as title", "'The Album' as album", "cast(null as string) as asin", "cast(null as string) as isbn", "'Ann' as artist", "900.0D as seconds")
    found = cohorts.resolve_grouping(cohorts.grouping_votes(files, "p", "at"), "p")
    plan = found._jdf.queryExecution().toString()
    assert not any(step in plan for step in ("Window", "percentile", "median", "regexp")) and found.where("outcome = 'one'").count() == 100


def test_grouping_takes_more_tasks_for_more_files(spark, monkeypatch):
    files = spark.range(0, 300, 1, 3).selectExpr("case when id < 200 then id div 4 else 1000 end as p", "id as at", "concat('Ann - Book 0', id) as name", "cast(null as string) as title", "'The Album' as album", "cast(null as string) as asin", "cast(null as string) as isbn", "'Ann' as artist", "900.0D as seconds")
    run = lambda: cohorts.resolve_grouping(cohorts.grouping_votes(files, "p", "at"), "p")
    few = sorted(map(tuple, run().collect()))
    monkeypatch.setattr(cohorts, "TASK_FILES", 20)
    found = run()
    # sums of the folders come from 15 tasks of about 20 files, of which some meet no folder
    assert max(sum(f.split("/")[-2] == step for f in found.inputFiles()) for step in ("1", "2", "3")) > 4
    assert sorted(map(tuple, found.collect())) == few and len(few) == 51


def test_lines_of_orders_are_dealt_once(spark, tmp_path):
    rows = [(1, 2), (1, 1), (1, 2), (1, None), (1, None), (2, 5), (2, 5), (None, 1), (None, 1), (None, 3)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int").repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = naming.lines(spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == {(1, None, 1, 3), (1, 1, 2, 3), (1, 2, 3, 3), (2, 5, 1, 1), (None, 1, 1, 2), (None, 3, 2, 2)} and found.count() == 6
    assert found._jdf.queryExecution().sparkPlan().toString().count("HashAggregate") == 0 and shuffled(spark, found) == len(rows)
