"""File and folder names, path templates, order and gaps of files: literal cases and brute force."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import names, templates
from lectern.operators import files
from tests.measured import shuffled


def of(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_part_marks(spark):
    cases = {
        "Hot Mahogany 7of7": [(7, 7, None, "")], "The Skies Disc 08 of 11": [(8, 11, None, "")], "01-06 of 20": [(1, 20, 6, "")], "Disc 1-3": [(1, None, 3, "")], "x 13b": [(13, None, None, "b")], "CD02": [(2, None, None, "")],
        "Part.3 - Ch01": [(3, None, None, ""), (1, None, None, "")], "Fahrenheit 451": [], "1984": [], "Disc-05": [(5, None, None, "")], "2001 of 2010": [], "Discus 5": [], "a1of2": [], "": [], None: [], "Tape 2 of 3A": [(2, 3, None, "a")],
    }
    got = of(spark, names.part_marks, list(cases))
    assert [[tuple(m) for m in g] for g in got] == [[(i, t, e, h) for i, t, e, h in w] for w in cases.values()]
    whole = {"Disc 05": (5, None, None, ""), "1of9": (1, 9, None, ""), " 01 of 15 ": (1, 15, None, ""), "13b": (13, None, None, "b"), "13": None, "1-3": None, "x Disc 05": None, "Ch01": (1, None, None, ""), "": None, None: None}
    assert [None if g is None else tuple(g) for g in of(spark, names.part_of, list(whole))] == list(whole.values())
    assert of(spark, names.without_parts, ["Hot Mahogany 7of7", "Skies - Disc 08 of 11", "A Disc 1 B", None]) == ["Hot Mahogany", "Skies", "A B", None]


def test_track_index(spark):
    cases = {
        "01": ([1], ""), "83Cujo": ([83], ""), "051 - Stephen King": ([51], ""), "02-01": ([2, 1], ""), "06b": ([6], "b"), "12.5 x": ([12], "5"), "cd01": ([1], ""), "d2t01 x": ([2, 1], ""), "1984": None, "Title 5": None, "1_2_3": ([1, 2, 3], ""),
        "1-Title": ([1], ""), "": None, None: None, "06bc": ([6], ""), " 7B": ([7], "b"),
    }
    assert [None if g is None else (g[0], g[1]) for g in of(spark, names.track_index, list(cases))] == list(cases.values())


def test_sequence_affix(spark):
    cases = {
        "02 - Yendi": (2.0, "Yendi", True), "Yendi (2)": (2.0, "Yendi", True), "Yendi [3]": (3.0, "Yendi", True), "1) Jhereg": (1.0, "Jhereg", True), "30-Day Plan": (30.0, "Day Plan", False), "Catch-22": (22.0, "Catch", False), "Yendi - 2.5": (2.5, "Yendi", True),
        "1984 - x": None, "12 - 13": None, "Yendi": None, "": None, None: None, "Fahrenheit 451": None,
    }
    assert [None if g is None else tuple(g) for g in of(spark, names.sequence_affix, list(cases))] == list(cases.values())


def test_folder_titles(spark):
    cases = {
        "1981 - Cujo": ("Cujo", 1981, [], None, None), "2001_Dune": ("Dune", 2001, [], None, None), "3001 - Odyssey": ("3001 - Odyssey", None, [], None, None), "#12 - The End": ("The End", None, [], None, 12.0),
        "(Old Saga Book #6) The Title": ("The Title", None, [], "Old Saga", 6.0), "(The Expanse, #4) Burn": ("Burn", None, [], "The Expanse", 4.0), "1990 - It (Unabridged - read by Ann Lee and Bo Ray)": ("It (Unabridged)", 1990, ["Ann Lee", "Bo Ray"], None, None),
        "It - read by Ann Lee": ("It", None, ["Ann Lee"], None, None), "It (read by Ann Lee) II": ("It II", None, ["Ann Lee"], None, None), "  a   b ": ("a b", None, [], None, None), "": ("", None, [], None, None), None: None,
    }
    assert [None if g is None else tuple(g) for g in of(spark, names.folder_title, list(cases))] == list(cases.values())


def test_natural_order(spark):
    rng = random.Random(2)
    words = ["a", "B", "part ", " ", "-", "x"]
    values = [*{"".join(itertools.chain.from_iterable((rng.choice(words), str(rng.randrange(12)) * rng.randrange(2)) for _ in range(rng.randrange(1, 5)))) for _ in range(80)}, "v2 p10 c3", "v2 p9 c30", "v10 p1", "0" * 30 + "7"]

    def python(x):
        texts, numbers = re.split("[0-9]+", x.lower()), re.findall("[0-9]+", x)
        return [v for t, n in itertools.zip_longest(texts, map(int, numbers), fillvalue=None) for v in ([t] if n is None else [t, n])]

    rows = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r["v"] for r in rows.orderBy(names.natural_key(F.col("v")), "v").collect()]
    assert got == sorted(values, key=lambda v: (python(v), v))


def test_enumeration(spark):
    got = of(spark, names.enumeration, ["1 of 8 Diana", "x 3/4", "2001 of 9", "a", None])
    assert [None if g is None else (g[0], [tuple(p) for p in g[1]]) for g in got] == [("Diana", [(1, 8)]), ("x", [(3, 4)]), ("2001 of 9", []), ("a", []), None]


FIELDS = "author string, title string, narrator string, franchise string, language string, series_name string, sequence double, year int, abridged boolean, part int, total int"
KINGS = {"author": "Brandon Sanderson", "title": "The Way of Kings", "series_name": "Stormlight Archive", "sequence": 1.0, "year": 2010}


def filled(spark, cases, made):
    """``made(template, fields)`` of (template, book) cases."""
    out = []
    for template, book in cases:
        row = spark.createDataFrame([tuple(book.get(f.split()[0]) for f in FIELDS.split(", "))], FIELDS)
        out.append(row.select(made(template, {c: F.col(c) for c in row.columns})).first()[0])
    return out


def test_templates_are_rendered(spark):
    solo, named = {"title": "Solo", "author": "Ann Leckie"}, {**KINGS, "sequence": None}
    cases = {
        ("$Author/$SerName/$Title", 0): "Brandon Sanderson/Stormlight Archive/The Way of Kings", ("$PubYear - $Title", 0): "2010 - The Way of Kings", ("$SerName $PadNum|$SerNum", 0): "Stormlight Archive 01|1", ("$Bogus$Title", 0): "The Way of Kings",
        ("$$Author $SortAuthor; $SortTitle", 0): "$Author Sanderson, Brandon; Way of Kings", ("[$SerNum - ]$Title", 1): "Solo", ("[$SerNum - ]$Title", 0): "1 - The Way of Kings", ("[$Series read by $Narrator - ]$Title", 0): "The Way of Kings",
        ("[[$Title]]", 0): "[The Way of Kings]", ("[static]$Title", 0): "staticThe Way of Kings", ("$Series", 0): "(Stormlight Archive Book #1)", ("$FmtName|$FmtNum", 0): "Stormlight Archive|Book #1", ("$Series$FmtName$SerNum", 1): "",
        ("$Series", 2): "(Stormlight Archive)", ("$FmtNum", 2): "", ("$Title[ - Part $Part of $Total]", 3): "x - Part 007 of 100", ("$Part of $Total", 4): "03 of 09", ("$Abridged$Language", 4): "AbridgedEnglish", ("[$Franchise/]$Title", 4): "Cosmere/x", ("", 0): "",
        ("$PadNum", 5): "2.5", ("$SerNum", 6): "12", ("[[[$Title]]]", 0): "[The Way of Kings]",
    }
    books = [KINGS, solo, named, {"title": "x", "part": 7, "total": 100}, {"title": "x", "part": 3, "total": 9, "abridged": True, "language": "English", "franchise": "Cosmere"}, {"series_name": "s", "sequence": 2.5}, {"series_name": "s", "sequence": 12.0}]
    got = filled(spark, [(t, books[k]) for t, k in cases], lambda t, f: templates.render(t, templates.token_values(f)))
    assert got == list(cases.values())
    other = templates.SeriesFormat("$FmtName, $FmtNum", "$SerName", "Vol. $PadNum")
    assert filled(spark, [("$Series", KINGS)], lambda t, f: templates.render(t, templates.token_values(f, other))) == ["Stormlight Archive, Vol. 01"]


@pytest.mark.parametrize("template", ["[$SerNum - $Title", "$Title]", "[$Series[$SerNum] ]$Title"])
def test_brackets_must_match(template):
    with pytest.raises(templates.TemplateError, match="bracket"):
        templates.scan(template)


def test_target_paths(spark):
    path = lambda folder, name: lambda _, f: templates.target_path(folder, name, f, ".m4b")
    assert filled(spark, [("", KINGS)], path("$Author/$Title", "$Title")) == ["Brandon Sanderson/The Way of Kings/The Way of Kings.m4b"]
    assert filled(spark, [("", {**KINGS, "author": "AC/DC: \"x\"?"})], path("$Author", "")) == ["ACDC x/The Way of Kings.m4b"]
    assert filled(spark, [("", {"title": "Solo"}), ("", {"title": " .. "})], path("$Author/$Title", "[$SerNum - ]$Title")) == ["Solo/Solo.m4b", ".m4b"]
    part = lambda _, f: templates.part_path("$Author", "$Title", f, F.lit("mp3"))
    books = [{"author": "A", "title": "T", "part": p, "total": n} for p, n in ((1, 2), (1, 1), (10, 100))]
    assert filled(spark, [("", b) for b in books], part) == ["A/T (01 of 02).mp3", "A/T.mp3", "A/T (010 of 100).mp3"]
    assert templates.tokens("$Partition") == ["Partition"]


def test_names_are_parsed(spark):
    parse = lambda t: lambda c: templates.parse_name(t, c)
    rows = lambda t, values: [None if g is None else g.asDict() for g in of(spark, parse(t), values)]
    assert rows("$Author - $Title", ["Stephen_King - It.mp3", "a  -  b - c.m4b", "nothing.mp3", None, "a.b - c.d.mp3"]) == [{"author": "Stephen King", "title": "It"}, {"author": "a", "title": "b - c"}, None, None, {"author": "a.b", "title": "c.d"}]
    assert rows("$Series $SerNum ($PubYear) $Skip_$Title", ["Saga 2.5 (1999) junk_The_End.mp3", "Saga two (1999) x_y"]) == [{"series": "Saga", "sequence": "2.5", "year": "1999", "title": "The End"}, None]
    assert rows("$$ $Title", ["$ x.mp3", "x"]) == [{"title": "x"}, None]
    for bad in ("[$Title]", "$Title $Title", "$Bogus", "$PadNum"):
        with pytest.raises(templates.TemplateError):
            templates.compile_parser(bad)
    assert templates.migrated("%author% - %title% %x% %subtitle%") == "$Author - $Title %x% $Skip"


@pytest.mark.parametrize("template", ["$Author - $Title", "$SerNum. $Title ($PubYear)", "$Title ~ $PubYear", "$Narrator, $Author: $Title"])
def test_parse_after_render_gives_the_fields_back(spark, template):
    books = [("Ann Lee", "Dune", "Bo Ray", 1.0, 1965), ("X. Y", "The End", "C D", 12.0, 2001), ("É", "a b c", "q", 2.5, 1999)]
    rows = spark.createDataFrame(books, "author string, title string, narrator string, sequence double, year int").withColumn("series_name", F.lit("s"))
    fields = {c: F.col(c) for c in rows.columns}
    back = rows.select("*", templates.parse_name(template, F.concat(templates.render(template, templates.token_values(fields)), F.lit(".mp3"))).alias("p")).collect()
    for r in back:
        for f, v in r["p"].asDict().items():
            assert v == (str(r[f]).removesuffix(".0"))


def test_missing_tracks(spark):
    cases = {
        1: [(None, f"{k} of 5") for k in (1, 2, 4)], 2: [(None, f"0{k} of 11 x") for k in range(1, 9)], 3: [(None, "01-06 of 20"), (None, "07-15 of 20")], 4: [(None, "Disc 01 of 11"), (None, "Disc 01 of 11"), (None, "Disc 02 of 11")],
        5: [(None, "1 of 20")], 6: [(k, "x") for k in (1, 2, 4)], 7: [(None, f"0{k} - t") for k in (1, 3, 4)], 8: [(None, f"Chapter {k}") for k in (2, 3, 4)], 9: [(None, "Chapter 1"), (None, "Part 2"), (None, "Chapter 4")],
        10: [(1, "a"), (None, "b"), (4, "c")], 11: [(None, "1 of 3"), (None, "2 of 4"), (None, "3 of 3")], 12: [(None, None), (None, "")], 13: [(None, f"{k} of 3") for k in (1, 2, 3)], 14: [(1, "3 of 4"), (2, "1 of 4"), (3, "9")], 15: [(None, "5 of 3"), (None, "1 of 3")],
        16: [(None, f"{d}-{t}") for d in (1, 2) for t in (1, 3)], 17: [(k, f"{k} of 3") for k in (1, 3)],
    }
    rows = spark.createDataFrame([(p, t, n) for p, v in cases.items() for t, n in v], "p int, t int, n string")
    got = {r["p"]: (r["by"], r["missing"]) for r in files.missing_tracks(rows, "p", "n", "t").collect()}
    want = {1: ("total", "3,5"), 2: ("total", "9,10,11"), 3: ("total", "16,17,18,19,20"), 6: ("track", "3"), 7: ("name", "2"), 8: ("name", "1"), 17: ("total", "2")}
    assert got == want


def test_part_order(spark):
    cases = {
        1: ([(2, "a"), (1, "b"), (3, "c")], "track", "bac"), 2: ([(None, "b 1 of 2"), (None, "a 2 of 2")], "total", None), 3: ([(None, "Part 10"), (None, "Part 2")], "name", None), 4: ([(None, "x01"), (None, "X1")], "blocked", None),
        5: ([(None, "only")], "single", None), 6: ([(1, "b"), (1, "a")], "name", None), 7: ([(1, "b"), (None, "a")], "name", None), 8: ([(None, "b 1 of 3"), (None, "a 2 of 3")], "name", None), 9: ([(2, "b"), (3, "a")], "name", None),
    }
    rows = spark.createDataFrame([(p, t, n) for p, (v, *_) in cases.items() for t, n in v], "p int, t int, n string")
    got = {}
    for r in files.part_order(rows, "p", "n", "t").orderBy("p", "place").collect():
        got.setdefault(r["p"], []).append((r["by"], r["place"], r["n"]))
    order = {1: ["b", "a", "c"], 2: ["b 1 of 2", "a 2 of 2"], 3: ["Part 2", "Part 10"], 5: ["only"], 6: ["a", "b"], 7: ["a", "b"], 8: ["a 2 of 3", "b 1 of 3"], 9: ["a", "b"]}
    for p, (_, by, _) in cases.items():
        assert {g[0] for g in got[p]} == {by}, p
        if by == "blocked":
            assert all(g[1] is None for g in got[p])
        else:
            assert [g[1] for g in got[p]] == list(range(1, len(got[p]) + 1)) and [g[2] for g in got[p]] == order[p], p


def test_part_order_shuffles_rows_once(spark):
    rows = spark.createDataFrame([(p, f"v {k * p}", k if p % 2 else None) for p in range(100) for k in (1, 2, 3)] + [(None, "x", 1)], "p int, n string, t int")
    found = files.part_order(rows, "p", "n", "t")
    by = {(r["p"], r["by"]) for r in found.collect()}
    assert by == {(p, "track" if p % 2 else "name" if p else "blocked") for p in range(100)} and shuffled(spark, found) <= 300
