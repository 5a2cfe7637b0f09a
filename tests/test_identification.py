"""Re-association, similarity and scores against brute force and literal cases."""

import difflib
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lectern.functions import similarity as sim
from lectern.functions import text as fx
from lectern.operators import assignment, scoring
from lectern.plans import identification

SF = "/root/testdata/sf0.001"


def one_to_one(new, known):
    """Greedy pass over all sorted pairs of {owner: set}."""
    pairs = [(-Fraction(len(a & b), len(a | b)), -len(a & b), x, y) for x, a in new.items() for y, b in known.items() if a & b]
    left, used, out = set(new), set(), {}
    for _, shared, x, y in sorted(pairs):
        if x in left and y not in used:
            left.discard(x)
            used.add(y)
            out[x] = (y, -shared, len(new[x] | known[y]))
    return {x: out.get(x, (None, None, None)) for x in new}


def as_rows(df):
    return {r[0]: tuple(r)[1:] for r in df.select("l_orderkey", "known", "shared", "united").collect()}


@pytest.mark.parametrize("seed", range(4))
def test_greedy_choice(spark, seed):
    rng = random.Random(seed)
    sides = [{k: {rng.randrange(12) for _ in range(rng.randrange(1, 6))} for k in rng.sample(range(60), 25)} for _ in range(2)]
    new, known = (spark.createDataFrame([(k, p) for k, v in side.items() for p in [*v, *v]] + [(None, 1)], "l_orderkey long, p long") for side in sides)
    assert as_rows(assignment.reassociate(new, known, "l_orderkey", ["p"])) == one_to_one(*sides)


def test_greedy_chain_and_nothing_shared(spark):
    edges = spark.createDataFrame([(-(k + 1), k, k + step) for k in range(20) for step in (0, 1)], "score int, a long, b long")
    got = {(r["a"], r["b"]) for r in assignment.greedy(edges, ["score"]).collect()}
    assert got == {(19 - k, 19 - k) for k in range(20)}
    assert assignment.greedy(edges.where("false"), ["score"]).collect() == []
    new, known = (spark.createDataFrame([(1, p)], "l_orderkey long, p string") for p in ("x", "y"))
    assert as_rows(assignment.reassociate(new, known, "l_orderkey", ["p"])) == {1: (None, None, None)}
    none = spark.createDataFrame([(1, None)], "l_orderkey long, p string")
    assert as_rows(assignment.reassociate(none, none, "l_orderkey", ["p"])) == {1: (1, 1, 1)}


def test_reassociation_of_the_table(spark):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", F.struct("l_partkey", "l_suppkey"), "l_linenumber").collect()
    new, known = {}, {}
    for o, p, n in rows:
        if n % 7:
            new.setdefault(o + 1_000_000_000 * (o % 3 == 0), set()).add(p)
        if n % 5:
            known.setdefault(o, set()).add(p)
    assert as_rows(identification.reassociate_greedy(spark, SF)) == one_to_one(new, known)


def test_ratio(spark):
    rng = random.Random(1)
    words = ["dune", "the", "king", "kings", "way", "of", "Ünder", "a"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(5))) for _ in range(40)] + [None, "", " ", "x" * 300, "x" * 150 + "y" * 150, "  DUNE "]
    pairs = [(a, b) for a in texts for b in rng.sample(texts, 12)]

    def want(a, b):
        a, b = (a or "").strip().lower(), (b or "").strip().lower()
        x, y = set(a.split()), set(b.split())
        return max(difflib.SequenceMatcher(None, a, b).ratio(), len(x & y) / len(x | y)) if a and b else 0.0

    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    exact, bounded = (r.orderBy("i").collect() for r in (rows.select("i", sim.ratio("a", "b").alias("x")), rows.select("i", sim.ratio_from("a", "b", F.lit(0.6)).alias("x"))))
    assert [r["x"] for r in exact] == [want(a, b) for a, b in pairs]
    assert [r["x"] if r["x"] >= 0.6 else 0 for r in bounded] == [w if (w := want(a, b)) >= 0.6 else 0 for a, b in pairs]


def test_bounds_never_drop_a_pair(spark):
    part = spark.read.parquet("/root/testdata/sf0.01/part.parquet").selectExpr("p_partkey k", "concat(p_size, p_brand) s", "p_name || ' ' || lower(p_type) n").collect()
    first = {}
    for k, s, n in sorted(part):
        first.setdefault((s, n.lower()), k)
    names = list(first.items())
    ratio = lambda a, b: sim.of_pair(a, b)
    want = {(min(i, j), max(i, j)): ratio(a, b) for x, ((s, a), i) in enumerate(names) for (t, b), j in names[x + 1 :] if s == t}
    want = {k: v for k, v in want.items() if v >= 0.85}
    got = {(r["a"], r["b"]): r["score"] for r in identification.similar_names(spark, "/root/testdata/sf0.01").collect()}
    assert got.keys() == want.keys() and want
    assert all(abs(got[k] - want[k]) < 0.02 for k in got)  # a sequence ratio isn't symmetric


def test_titles_of_matches(spark):
    cases = {
        "1982 - The Gunslinger": "The Gunslinger", "(2001) – Dune": "Dune", "2001: A Space Odyssey": "2001: A Space Odyssey", "Dune (Unabridged)": "Dune", "Dune [Deluxe Edition]": "Dune", "Dune (Dune #1)": "Dune (Dune #1)",
        "Sapiens (Nonfiction)": "Sapiens", "Dune: Unabridged": "Dune", "(Unabridged)": "(Unabridged)", "a   b": "a b", "": "", None: "", "The Complete Works": "The Complete Works",
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    assert [r["x"] for r in rows.select("i", sim.match_title(F.col("t")).alias("x")).orderBy("i").collect()] == list(cases.values())
    assert spark.range(1).select(sim.match_title(F.lit("1982 - The Gunslinger"), strip_year=False)).first()[0] == "1982 - The Gunslinger"


def test_isbn(spark):
    pairs = [("0306406152", "9780306406157", True), ("0-306-40615-2", "978 0306406157", True), ("080442957x", "080442957X", True), ("0306406152", "9780134685991", False), (None, "0306406152", False), ("123", "123", False), ("", "", False)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string, x boolean")
    assert [r["y"] for r in rows.select("i", fx.same_isbn(F.col("a"), F.col("b")).alias("y")).orderBy("i").collect()] == [p[2] for p in pairs]
    codes = {"0-306-40615-2": "9780306406157", " 9780306406157 ": "9780306406157", "--": None, "97803064061570": None, "03064061x2": None}
    rows = spark.createDataFrame(list(enumerate(codes)), "i int, a string")
    assert [r["y"] for r in rows.select("i", fx.canonical_isbn(F.col("a")).alias("y")).orderBy("i").collect()] == list(codes.values())


BOOKS = "book int, title string, authors array<string>, asin string, isbn string, duration_ms long, abridged boolean"
RESULTS = "book int, at int, provider string, title string, authors array<string>, runtime_ms long, asin string, isbn string, abridged boolean"


def identified(spark, cases, authority=None):
    books = [(i, b.get("title", "Dune"), b.get("authors", ["Frank Herbert"]), b.get("asin"), b.get("isbn"), b.get("ms", 0), b.get("abridged")) for i, (b, _) in enumerate(cases)]
    results = [(i, k, r[0], r[1], r[2], *(r[3].get(c) for c in ("ms", "asin", "isbn", "abridged"))) for i, (_, rs) in enumerate(cases) for k, r in enumerate((*r, {})[:4] for r in rs)]
    found = scoring.identify(spark.createDataFrame(books, BOOKS), spark.createDataFrame(results, RESULTS), "book", "at", authority)
    return [(r["confidence"], {s["name"]: s["points"] for s in r["signals"]}, r["best"], r["author_inferred"]) for r in found.orderBy("book").collect()]


def test_confidence(spark):
    herbert = ["Frank Herbert"]
    hit = lambda p, **x: (p, "Dune", herbert, x)
    agree = {"embedded_core": 15, "cross_source_agreement": 60}
    single = {"embedded_core": 15, "single_source_match": 30}
    cases = [
        (({"title": "Mystery", "authors": []}, []), (0.0, {}, None, False)),
        (({}, []), (15.0, {"embedded_core": 15}, None, False)),
        (({}, [hit("a"), hit("b")]), (75.0, agree, 0, False)),
        (({}, [hit("a"), hit("a")]), (45.0, single, 0, False)),
        (({"asin": "B0"}, [("a", "Completely Different", ["Nobody"], {"asin": "B0"})]), (50.0, {"embedded_core": 15, "asin_exact_match": 60, "disagreement_penalty": -25}, 0, False)),
        (({"isbn": "0306406152"}, [hit("a", isbn="9780306406157")]), (100.0, {**single, "isbn_exact_match": 60}, 0, False)),
        (({"ms": 8_000_000}, [hit("a", ms=8_100_000)]), (57.0, {**single, "runtime_match": 12}, 0, False)),
        (({"ms": 8_000_000}, [hit("a", ms=4_000_000)]), (30.0, {**single, "runtime_mismatch": -15}, 0, False)),
        (({"ms": 8_000_000}, [hit("a", ms=4_000_000), hit("b", ms=8_000_000)]), (87.0, {**agree, "runtime_match": 12}, 1, False)),
        (({"abridged": True}, [hit("a", abridged=True)]), (50.0, {**single, "format_match": 5}, 0, False)),
        (({"abridged": True}, [hit("a", abridged=False)]), (30.0, {**single, "format_mismatch": -15}, 0, False)),
        (({"authors": []}, [hit("a"), hit("b")]), (60.0, {"cross_source_author_consensus": 60}, 0, True)),
        (({"authors": []}, [hit("a"), ("b", "Dune", ["Someone Else"])]), (0.0, {}, 0, False)),
        (({"authors": None}, [hit("a"), hit("b"), ("c", "Dune", ["X Y"]), ("d", "Dune", ["x y "])]), (0.0, {}, 0, False)),
    ]
    got = identified(spark, [c for c, _ in cases])
    for (case, want), have in zip(cases, got, strict=True):
        assert have == want, case


def test_authority_decides_among_near_results(spark):
    hit = lambda p, title="Dune", **x: (p, title, ["Frank Herbert"], x)
    cases = [({}, [hit("b"), hit("a")]), ({}, [hit("b"), hit("a", "Dunes")]), ({}, [hit("z"), hit("y")]), ({"ms": 1000}, [hit("b", ms=1000), hit("a", ms=5000)])]
    got = identified(spark, cases, {"a": 0, "b": 1, "c": 2})
    assert [(g[1].get("source_authority"), g[2]) for g in got] == [(10, 1), (5, 0), (None, 0), (10, 1)]
    assert identified(spark, cases[:1], {"a": 0})[0][1]["source_authority"] == 10


def test_candidates_are_ranked_by_score_then_runtime(spark):
    books = spark.createDataFrame([(1, "Dune", ["Frank Herbert"], None, None, 1000, None)], BOOKS)
    rows = [("w", "Dune Encyclopedia", ["Other"], None), ("s", "Dune", ["Frank Herbert"], 5000), ("t", "Dune", ["Frank Herbert"], 1010), ("u", "Dune", ["Frank Herbert"], None), ("v", "Dune", ["Frank Herbert"], None)]
    results = spark.createDataFrame([(1, k, p, t, a, ms, None, None, None) for k, (p, t, a, ms) in enumerate(rows)], RESULTS)
    placed = scoring.ranking(scoring.scored(books, results, "book", "at"), "book", "at").orderBy("place").collect()
    assert [r["at"] for r in placed] == [2, 3, 4, 1, 0]


def test_queries_cover_their_tables(spark):
    n = spark.read.parquet(f"{SF}/part.parquet").count()
    found = identification.identify_confidence(spark, SF).collect()
    assert len(found) == n and len({r["signals"] for r in found}) > 10
    assert identification.rank_results(spark, SF).count() == spark.read.parquet(f"{SF}/lineitem.parquet").select("l_partkey", "l_suppkey").distinct().count()


def test_names_in_few_blocks_use_all_partitions(spark):
    rows = spark.createDataFrame([(1, 1, "ann lee"), (2, 1, "ann leo")], "k int, block int, name string")
    found = scoring.similar_pairs(rows, "k", "name", ["block"], 0.5)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().toString()
    assert [(r["a"], r["b"]) for r in found.collect()] == [(1, 2)]


def test_results_are_scored_once(spark):
    books = spark.createDataFrame([(1, "Dune", [], None, None, 1000, None)], BOOKS)
    results = spark.createDataFrame([(1, k, p, "Dune", ["Frank Herbert"], 1000, None, None, None) for k, p in enumerate("ab")], RESULTS)
    found = scoring.identify(books, results, "book", "at")
    assert "ArrowEvalPython" not in found._jdf.queryExecution().toString()
    assert found.first()["author_inferred"]


def test_ratios_of_repeated_names_are_kept():
    sim.of_pair.cache_clear()
    assert [sim.of_pair("red steel", "red steal") for _ in range(3)] == [sim.of_pair.__wrapped__("red steel", "red steal")] * 3
    assert sim.of_pair.cache_info().misses == 1
