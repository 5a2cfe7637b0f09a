"""Titles, phases, entities and tables that change: literal cases and brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import entities, merges, phases, titles


def test_title_verdicts(spark):
    cases = [
        ("Cujo", ["Cujo - Chapter 1", "Cujo - Chapter 2"], "1981 - Cujo", ["Stephen King"], None, None, "agree", ["folder", "filename"], "Cujo"), ("Cujo", ["Track 001"], "Stephen King", ["Stephen King"], None, None, "abstain", [], None),
        ("Misery", ["01", "02"], "1981 - Cujo", ["Stephen King"], None, None, "contradict", [], "Cujo"), ("Track 1", [], "Cujo", [], None, None, "abstain", [], None), ("Unabridged", [], "Cujo", [], None, None, "abstain", [], None),
        ("Stephen King", [], "Cujo", ["Stephen King"], None, None, "abstain", [], None), ("SB 01 - StarBridge", ["StarBridge"], "x", [], "SB", None, "agree", ["filename"], "SB 01 - StarBridge"), ("The Land: Founding", [], "The Land", [], None, None, "agree", ["folder"], "The Land: Founding"),
        ("Mort", ["Discworld 04 - Mort"], "Discworld", ["Terry Pratchett"], "Discworld", None, "agree", ["filename"], "Mort"), (None, None, None, None, None, None, "abstain", [], None), ("The Of", [], "The Of", [], None, None, "abstain", [], None),
    ]
    books = spark.createDataFrame([(i, c[0], *c[2:6]) for i, c in enumerate(cases)], "i int, title string, folder string, authors array<string>, series string, franchise string")
    files = spark.createDataFrame([(i, k, f) for i, c in enumerate(cases) for k, f in enumerate(c[1] or [])], "i int, at int, stem string")
    got = titles.verdicts(books, files, "i", "at").orderBy("i").collect()
    assert [(r["verdict"], r["sources"], r["suggested"]) for r in got] == [(v, s, t) for *_, v, s, t in cases]
    assert got[2]["evidence"] == 'metadata title "Misery" vs folder "Cujo"' and got[0]["evidence"] == 'tag "Cujo" ~ folder'


def test_phases(spark):
    rng = random.Random(5)
    state = {(b, p): rng.choice(phases.STATES) for b in range(40) for p in phases.PHASES if rng.random() < 0.7}
    changes = {(b, rng.choice(phases.PHASES)) for b in range(0, 40, 2) for _ in range(2)}
    table = spark.createDataFrame([(b, p, s) for (b, p), s in state.items()], "book int, phase string, state string")
    want = dict(state)
    at = phases.PHASES.index
    staled = set()
    for b, c in changes:
        want[b, c] = "stale"
    for (b, p), s in state.items():
        for x, c in changes:
            if x == b and s != "pending" and at(c) < at(p) and (p != "encode" or c == "search"):
                want[b, p] = "stale"
                staled |= {(b, p)} if (b, p) not in changes else set()
    got = phases.invalidate(table, spark.createDataFrame([*changes, *changes], "book int, phase string")).collect()
    assert {(r["book"], r["phase"]): r["state"] for r in got} == want and {(r["book"], r["phase"]) for r in got if r["staled"]} == staled and len(got) == len(want)
    n = {r["phase"]: r["n"] for r in phases.funnel(table).collect()}
    assert n == {p: sum(s == "fresh" for (_, q), s in state.items() if q == p) for p in phases.PHASES}


def test_states(spark):
    cases = [
        ({}, {}, "detected"), ({"search": "fresh"}, {}, "detected"), ({"identify": "fresh"}, {}, "needs_review"), ({"identify": "fresh"}, {"confidence": 75.0, "has_identity": True}, "ready"), ({"match": "fresh"}, {"confidence": 80.0}, "needs_review"),
        ({"identify": "fresh"}, {"identity_confidence": 60.0, "has_identity": True}, "identified"), ({"identify": "fresh"}, {"confirmed": True}, "ready"), ({"encode": "fresh"}, {}, "encoded"), ({"encode": "fresh", "organize": "fresh"}, {}, "organized"),
        ({"organize": "stale", "encode": "stale", "identify": "stale"}, {}, "detected"), ({"tag": "running", "organize": "fresh"}, {}, "encoding"), ({"tag": "failed", "match": "running"}, {}, "failed"), ({"tag": "failed"}, {"skipped": True}, "skipped"),
    ]
    columns = ["skipped boolean", "confirmed boolean", "confidence double", "identity_confidence double", "has_identity boolean"]
    books = spark.createDataFrame([(i, *(b.get(c.split()[0]) for c in columns)) for i, (_, b, _) in enumerate(cases)], "book int, " + ", ".join(columns))
    rows = spark.createDataFrame([(i, p, s) for i, (ps, *_) in enumerate(cases) for p, s in ps.items()], "book int, phase string, state string")
    assert [r["state"] for r in phases.states(books, rows).orderBy("book").collect()] == [s for *_, s in cases]


BOOKS = "book int, title string, authors array<string>, authors_prov string, series array<struct<name:string,sequence:double>>, series_prov string, confidence double"


def test_navigator(spark):
    rows = [
        (1, "B", ["Ann Lee"], "tag", [("Saga", 2.0)], "tag", 9.0), (2, "A", ["ann lee"], "directory", [("saga", 1.0), ("Saga", None)], "tag", 9.0), (3, "Z", ["Ann Lee", "Bo Ray"], "tag", [], None, 9.0), (4, "Y", ["Ann Lee"], "tag", None, None, 9.0),
        (5, "C", [], None, [("Lone", None)], "directory", 9.0), (6, "D", None, None, None, None, 5.0), (7, "E", [""], "tag", [], None, 2.0), (8, "F", ["A. Lee"], "tag", [("Other", 1.0)], "tag", 1.0),
    ]
    books = spark.createDataFrame(rows, BOOKS)
    aliases = spark.createDataFrame([("author", "A Lee", "Ann Lee")], "kind string, name string, canonical string")
    tree = entities.tree(books, aliases)
    got = sorted(map(tuple, tree.collect()), key=repr)
    want = [
        ("authors", "Ann Lee", "Other", 1, 8), ("authors", "Ann Lee", "Saga", 1, 2), ("authors", "Ann Lee", "Saga", 2, 1), ("authors", "Ann Lee", None, 1, 4), ("authors", "Ann Lee", None, 2, 3), ("authors", "Bo Ray", None, 1, 3), ("authors", "Lone", "Lone", 1, 5),
        ("series", None, "Lone", 1, 5), ("series", None, "Other", 1, 8), ("series", None, "Saga", 1, 2), ("series", None, "Saga", 2, 1), ("needs_id", None, None, 1, 7), ("needs_id", None, None, 2, 6),
    ]
    assert got == sorted(want, key=repr)
    few = entities.narrowed(tree, spark.createDataFrame([(3,), (1,)], "book int"))
    assert sorted(map(tuple, entities.branches(few).collect()), key=repr) == sorted([("authors", "Ann Lee", None, 2), ("authors", "Ann Lee", "Saga", 1), ("authors", "Bo Ray", None, 1), ("series", None, "Saga", 1)], key=repr)
    assert entities.tree(books.where("false"), aliases).collect() == []


def test_displays(spark):
    rows = [(k, "x", [n], p, [], None, 0.0) for k, (n, p) in enumerate([("ann lee", "directory"), ("ann lee", "directory"), ("ANN LEE", "tag"), ("Ann Lee", "tag"), ("Ann Lee", "tag"), ("ANN LEE", "tag")])]
    members = entities.memberships(spark.createDataFrame(rows, BOOKS), spark.createDataFrame([], "kind string, name string, canonical string"))
    assert [tuple(r) for r in entities.displays(members).collect()] == [("author", "ann lee", "Ann Lee", 6)]


def test_edges_and_overlays(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (None, 1)], "src int, dst int")
    assert [tuple(r) for r in entities.pruned(edges, spark.createDataFrame([(1,), (2,), (2,)], "node int")).collect()] == [(1, 2)]
    base, user = (spark.createDataFrame(v, "key string, shown string") for v in ([("a", "A"), ("b", "B")], [("b", "Bee"), ("c", "C")]))
    assert sorted(map(tuple, entities.overlay(base, user, ["key"]).collect())) == [("a", "A"), ("b", "Bee"), ("c", "C")]


SCHEMA = "id int, kind string, root string"


def test_changes_of_a_table_done_twice_are_done_once(spark, tmp_path):
    path = f"{tmp_path}/nodes"
    rows = [(i, "old", f"r{i % 3}") for i in range(9)]
    merges.create(spark.createDataFrame([(*r, k) for k, r in enumerate([*rows, (0, "later", "r0")])], f"{SCHEMA}, at int"), path, ["id"], "at")
    have = lambda: {r["id"]: (r["kind"], r["root"]) for r in merges.read(spark, path, SCHEMA).collect()}
    model = {i: (k, r) for i, k, r in rows}
    assert have() == model
    new = spark.createDataFrame([(1, "new", 0), (20, "new", 1), (20, "again", 2)], "id int, kind string, at int")
    for _ in range(2):
        merges.replace_root(merges.read(spark, path, SCHEMA), "r0", new, ["id"], "at", path)
        assert have() == {i: v for i, v in model.items() if v[1] != "r0" and i != 1} | {1: ("new", "r0"), 20: ("new", "r0")}
    model = have()
    untouched = {p: p.stat().st_mtime_ns for p in (tmp_path / "nodes" / "root=r2").iterdir()}
    ups = spark.createDataFrame([(4, "up", "r1", 1), (4, "last", "r1", 2), (30, "up", "r9", 1)], f"{SCHEMA}, at int")
    for _ in range(2):
        merges.apply_delta(merges.read(spark, path, SCHEMA), ups, spark.createDataFrame([(1,), (20,), (99,)], "id int"), ["id"], "at", path)
        assert have() == {i: v for i, v in model.items() if i not in (1, 4, 20)} | {4: ("last", "r1"), 30: ("up", "r9")}
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "nodes" / "root=r2").iterdir()} == untouched
    assert not (tmp_path / "nodes" / "root=r0").exists()


@pytest.mark.parametrize("pair", list(itertools.combinations(phases.PHASES, 2)))
def test_what_makes_stale(spark, pair):
    if pair[0] in ("search", "identify"):
        got = spark.range(1).select(phases.makes_stale(F.lit(pair[0]), F.lit(pair[1])), phases.makes_stale(F.lit(pair[1]), F.lit(pair[0]))).first()
        assert tuple(got) == (pair[1] != "encode" or pair[0] == "search", False)


def test_titles_are_cut_by_all_tasks(spark):
    books = spark.range(0, 200, 1, 1).selectExpr("id as i", "concat('Book ', id) as title", "concat('1981 - Book ', id) as folder", "array('Ann Lee') as authors", "'Saga' as series", "cast(null as string) as franchise")
    files = spark.range(0, 200, 1, 1).selectExpr("id as i", "1 as at", "concat('Saga - Book ', id, ' Words') as stem")
    read = titles.verdicts(books, files, "i", "at").inputFiles()
    written = [sum(f.split("/")[-2] == step for f in read) for step in ("0", "1")]
    assert written == [4, 4]  # what the stems and what titles and folders say


def test_keys_of_a_tree_are_made_once(spark):
    books = spark.createDataFrame([(i, f"T{i}", [f"Ann  {i % 2}"], "tag", [("Saga", float(i))], "tag", 1.0) for i in range(6)], "book int, title string, authors array<string>, authors_prov string, series array<struct<name:string,sequence:double>>, series_prov string, confidence double")
    rows = entities.tree(books, spark.createDataFrame([("author", "ann 1", "Eve")], "kind string, name string, canonical string"))
    assert not any(f in rows._jdf.queryExecution().toString() for f in ("regexp", "normalize", "lower("))
    assert {(r["view"], r["author"], r["series"], r["place"], r["book"]) for r in rows.collect()} == {
        *(("authors", "Eve" if i % 2 else "Ann  0", "Saga", i // 2 + 1, i) for i in range(6)), *(("series", None, "Saga", i + 1, i) for i in range(6)),
    }


def test_branches_need_no_places(spark):
    books = spark.createDataFrame([(i, f"T{i}", ["Ann"] if i % 2 else None, "tag", [("Saga", float(i))] if i % 3 else None, "tag", 1.0) for i in range(12)], "book int, title string, authors array<string>, authors_prov string, series array<struct<name:string,sequence:double>>, series_prov string, confidence double")
    none, few = spark.createDataFrame([], "kind string, name string, canonical string"), spark.createDataFrame([(i,) for i in (0, 1, 3, 4, 5)], "book int")
    ranked, plain = entities.tree(books, none), entities.tree(books, none, places=False)
    assert plain.columns == ["view", "author", "series", "book"] and "Window" not in plain._jdf.queryExecution().executedPlan().toString()
    both = [sorted(map(tuple, entities.branches(entities.narrowed(t, few)).collect()), key=repr) for t in (ranked, plain)]
    assert both[0] == both[1] and ("needs_id", None, None, 1) in both[0]
