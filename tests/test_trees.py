"""Passes over trees against brute force, and the kinds of folders in literal libraries."""

import functools
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import axioms, trees
from lectern.plans import library as queries

BOOKS = "book int, node string, title string, title_prov string, authors array<string>, authors_prov string, series string, series_prov string, sequence double, label string, stem string, n_files long"


def book(i, node, title=None, title_prov=None, authors=None, authors_prov=None, series=None, series_prov=None, sequence=None, label=None, stem=None, n_files=1):
    return (i, node, title, title_prov, authors, authors_prov, series, series_prov, sequence, label, stem or f"s{i}", n_files)


def library(spark, rows, overrides=(), franchises=(), author_depth=1):
    books = spark.createDataFrame(rows, BOOKS)
    nodes = trees.coarse_kinds(trees.folders(books, "node"), books)
    return axioms.Library(nodes, books, spark.createDataFrame([(f,) for f in franchises], "name string"), spark.createDataFrame(list(overrides), "node string, kind string, value string"), author_depth)


def kinds(spark, rows, **more):
    return {r["node"]: r for r in axioms.classify(library(spark, rows, **more)).collect()}


@pytest.mark.parametrize("seed", range(2))
def test_passes(spark, seed):
    rng = random.Random(seed)
    paths = ["/" + "/".join(rng.choice("abc") for _ in range(rng.randrange(5))) for _ in range(40)]
    facts = [(p, rng.choice("xy"), rng.randrange(9)) for p in paths]
    nodes = trees.folders(spark.createDataFrame([(p,) for p in [*paths, None]], "path string"))
    names = {r["node"]: (r["parent"], r["depth"], r["name"]) for r in nodes.collect()}
    whole = lambda p: p.rstrip("/") or "/"
    up = lambda p: whole(p.rsplit("/", 1)[0]) if p != "/" else None
    above = lambda p: [p, *above(up(p))] if up(p) else [p]
    assert names == {a: (up(a), len(above(a)) - 1, a.rsplit("/", 1)[1]) for p in map(whole, paths) for a in above(p)}
    sums = {}
    for p, k, n in facts:
        for a in above(whole(p)):
            total, least = sums.get((a, k), (0, 99))
            sums[a, k] = (total + n, min(least, n))
    rows = spark.createDataFrame([(whole(p), k, n, n) for p, k, n in facts] + [("/nowhere", "x", 1, 1)], "node string, k string, n long, least long")
    assert {(r["node"], r["k"]): (r["n"], r["least"]) for r in trees.roll_up(nodes, rows, ["k"], {"n": F.sum, "least": F.min}).collect()} == sums
    down = trees.pass_down(nodes, lambda m: F.concat(F.coalesce(m, F.lit("")), F.col("name")), "string")
    assert {r["node"]: r["message"] for r in down.collect()} == {a: a.replace("/", "") for a in names}


def test_coarse_kinds(spark):
    rows = [(p, 1) for p in ("/A/t1", "/A/t2", "/A/t3", "/B/u1", "/B/u2", "/C", "/C", "/D", "/D/v")]
    books = spark.createDataFrame(rows, "node string, n_files long")
    got = {r["node"]: (r["kind"], r["kind_confidence"], r["book_like"]) for r in trees.coarse_kinds(trees.folders(books, "node"), books).collect()}
    assert got["/A"] == ("grouping", 1.0, 0) and got["/A/t1"] == ("title", 1.0, 0) and got["/C"] == ("container", 0.9, 0) and got["/D"] == ("container", 0.7, 0)
    assert got["/"] == ("unknown", 0.0, 4)
    empty = spark.createDataFrame([], "node string, n_files long")
    assert [tuple(r) for r in trees.coarse_kinds(trees.folders(empty, "node"), empty).collect()] == []


def test_kinds_of_a_literal_library(spark):
    tags, match = {"authors_prov": "tag"}, {"authors_prov": "audible"}
    rows = [book(k, f"/Ann Lee/t{k}", "x", "tag", ["Ann Lee"], **tags) for k in range(3)] + [book(9, "/Ann Lee/u", "y", "tag", ["Guest"], **tags)]
    rows += [book(20 + k, f"/King/t{k}", "x", "tag", ["Stephen King"], **tags) for k in range(2)]
    # hard votes
    rows += [book(30 + k, f"/{name}/{k}x", "x", "tag", [name], **match) for name in ("Cy Dow", "Di Eco") for k in (1, 2)]
    # series, franchises, buckets
    rows += [book(40 + k, f"/Taltos/0{k} - {t}", t, "directory") for k, t in enumerate(("Jhereg", "Yendi", "Teckla"), 1)]
    rows += [book(50 + k, "/Liz Carlyle Novels", f"t{k}", "tag", series="Liz Carlyle", series_prov="tag", sequence=float(k)) for k in range(3)]
    rows += [book(60 + k, f"/Star Trek/Author {k}/x{k}", f"x{k}", "directory") for k in range(2)] + [book(63, "/2001", "Odyssey", "tag"), book(64, "/incoming/x", "x", "tag")]
    # leaves with one book
    rows += [
        book(71, "/Bo Ray", "01", None, label="The Book"), book(72, "/The Way of Kings", "The Way of Kings", "tag"), book(73, "/1981 - Cujo", "part one", "filename"), book(74, "/Sam Walton", "Sam Walton, made in America, my story", "tag"),
        book(75, "/Jhereg", "x", "directory", ["Steven Brust"], "tag"), book(76, "/Discworld", "Mort", "directory", series="Discworld", series_prov="tag"), book(77, "/Flo Gay", "Chapter", "filename", label="Chapter x", n_files=4),
    ]
    got = kinds(spark, rows, overrides=[("/Di Eco", "series", "My Series")], franchises=["star trek"])
    shown = {k: (r["kind"], r["value"]) for k, r in got.items()}
    assert shown["/Ann Lee"] == ("author", "Ann Lee") and got["/Ann Lee"]["evidenced"] and not got["/Ann Lee"]["settled"] and shown["/King"] == ("author", "Stephen King") and shown["/"][0] == "container"
    assert {"3 book(s) tagged author 'Ann Lee'", "a tagged author matches the folder name 'Ann Lee'"} <= set(got["/Ann Lee"]["reasons"])
    assert got["/Ann Lee/t0"]["kind"] == "title" and got["/Ann Lee/t0"]["confidence"] > 0.5
    assert (*shown["/Cy Dow"], got["/Cy Dow"]["confidence"], got["/Cy Dow"]["source"], got["/Cy Dow"]["settled"]) == ("author", "Cy Dow", 1.0, "matched", True)
    assert (*shown["/Di Eco"], got["/Di Eco"]["source"]) == ("series", "My Series", "manual")
    assert shown["/Taltos"] == ("series", "Taltos") and shown["/Liz Carlyle Novels"] == ("series", "Liz Carlyle") and shown["/Star Trek"] == ("franchise", "star trek")
    assert shown["/2001"][0] == "container" and shown["/incoming"][0] in ("author", "container")
    assert shown["/Bo Ray"] == ("author", "Bo Ray") and shown["/The Way of Kings"][0] == "title" and shown["/1981 - Cujo"][0] == "title" and shown["/Sam Walton"] == ("author", "Sam Walton")
    assert shown["/Discworld"] == ("series", "Discworld") and shown["/Flo Gay"][0] == "title" and shown["/Jhereg"] == ("title", None)


def test_authors_are_handed_down(spark):
    rows = [
        *(book(k, f"/Ann Lee/t{k}", f"t{k}", "directory", ["Ann Lee"], "tag") for k in range(4)), book(5, "/Ann Lee/Shelf/deep", "deep", "directory"), book(6, "/Ann Lee/Shelf/other", "other", "directory"),
        book(7, "/Lone", None, None), book(8, "/Title Only", "Title Only", "tag"), *(book(k, f"/Taltos/0{k - 8} - T{k}", f"T{k}", "directory") for k in range(9, 12)), book(20, "/Ann Lee/Own/deep", "deep", "directory"), book(21, "/Ann Lee/Own/other", "other", "directory"),
    ]
    lib = library(spark, rows, overrides=[("/Ann Lee/Own", "author", "Someone")])
    got = {r["book"]: (r["author"], r["by"], r["series"], r["sequence"]) for r in axioms.fill_down(lib.books, lib.nodes, axioms.classify(lib)).collect()}
    assert got[0] == (None, None, None, None)
    # the shelf between is an author by its own name only, the one above by its books
    assert got[5][:2] == ("Ann Lee", "graphing") and got[6][:2] == ("Ann Lee", "graphing") and got[20][:2] == ("Someone", "manual")
    assert got[7][:2] == ("Lone", "directory") and got[8][0] is None
    assert [got[k][2:] for k in (9, 10, 11)] == [("Taltos", 1.0), ("Taltos", 2.0), ("Taltos", 3.0)]


SF = "/root/testdata/sf0.001"


def test_queries_equal_an_election_and_a_walk_up(spark):
    lib = queries.node_library(spark, SF)
    cast = functools.reduce(lambda a, b: a.unionByName(b), (axiom(lib) for axiom in axioms.AXIOMS)).collect()
    nodes = {r["node"]: r for r in lib.nodes.collect()}
    chosen = {r["node"]: r["kind"] for r in lib.overrides.collect()}
    votes = {}
    for v in sorted(cast, key=lambda v: v["axiom"]):
        votes.setdefault(v["node"], []).append(v)
    kinds, want = {}, {}
    for node, row in nodes.items():
        own = votes.get(node, [])
        hard = [v for v in own if v["hard"]]
        total = {}
        for v in own:
            total[v["kind"]] = total.get(v["kind"], 0.0) + v["weight"]
        if hard:
            best = max([v for v in hard if v["kind"] == chosen.get(node)] or hard, key=lambda v: v["weight"])
            kind, value, share = best["kind"], best["value"], 1.0
        else:
            kind = max(axioms.KINDS, key=lambda k: total.get(k, 0.0)) if own else "container"
            valued = [v for v in own if v["kind"] == kind and v["value"]]
            value = max(valued, key=lambda v: v["weight"])["value"] if valued else row["name"] if kind in ("author", "series") else None
            share = round(total[kind] / sum(total.values()), 2) if own else 0.0
        evidenced = any(v["value"] for v in own if v["kind"] == kind)
        kinds[node] = (kind, value, evidenced, bool(hard), "manual" if hard and node in chosen else "matched" if hard else "")
        want[node] = (kind, value, share)
    got = {r["node"]: (r["kind"], r["value"], r["confidence"]) for r in queries.node_kinds(spark, SF).collect()}
    assert got == want and len({k for k, *_ in got.values()}) >= 4

    def above(node):
        while node is not None:
            yield node
            node = nodes[node]["parent"]

    filled = {r["book"]: r for r in queries.handed_down(spark, SF).collect()}
    for b in lib.books.collect():
        people = [n for n in above(b["node"]) if kinds[n][0] == "author" and kinds[n][1] and (nodes[n]["depth"] or kinds[n][3])]
        best = next((n for n in people if kinds[n][2]), people[0] if people else None)
        layout = next((nodes[n]["name"] for n in above(b["node"]) if nodes[n]["depth"] == 2 and kinds[n][0] not in ("franchise", "series", "container", "title")), None)
        author = None if b["authors"] else kinds[best][1] if best else layout
        assert filled[b["book"]]["author"] == author, b
    assert len({r["author"] for r in filled.values()}) > 5 and len(filled) == lib.books.count()


def test_names_of_siblings_are_cut_once(spark):
    lib = library(spark, [book(1, "/A/Saga/01 - One", title="One", stem="01 - One"), book(2, "/A/Saga/02 - Two", title="Two", stem="02 - Two")])
    votes = axioms.numbered_siblings(lib)
    assert "regexp" not in votes._jdf.queryExecution().toString()
    assert {(r["axiom"], r["weight"]) for r in votes.where("node = '/A/Saga'").collect()} == {("10 numbered", 1.0), ("11 ramp", 2.0)}
