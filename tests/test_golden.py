"""Literal cases: what the operators must give, whatever the registered SQL says."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as fx
from lectern.operators import files, votes


def of(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_elections(spark):
    cases = {
        1: [("a", 1.0), ("a", 2.0), ("b", 1.0)], 2: [("a", 2.0), ("b", 1.0), ("b", 1.0)], 3: [("b", 2.0), ("a", 1.0), ("a", 1.0)], 4: [("a", 1.0), ("b", 1.0), ("c", 1.0)], 5: [("a", 0.0)],
        6: [(None, 9.0), ("a", 1.0), ("b", None)],
    }
    rows = spark.createDataFrame([(s, k, w) for s, v in cases.items() for k, w in v], "subject int, key string, w double")
    got = {r["subject"]: (r["winner"], r["share"]) for r in votes.elect(rows, "subject", "key", F.col("w")).collect()}
    assert got == {1: ("a", 0.75), 2: ("a", 0.5), 3: ("b", 0.5), 4: ("a", 0.33), 5: ("a", 0.0), 6: ("a", 1.0)}
    order = F.when(F.col("key") == "author", 0).otherwise(1)
    tied = spark.createDataFrame([(1, "series", 1.0), (1, "author", 1.0)], "subject int, key string, w double")
    assert [(r["winner"], r["share"]) for r in votes.elect(tied, "subject", "key", F.col("w"), tie=order).collect()] == [("author", 0.5)]


def test_field_values(spark):
    cases = {
        1: [("Dune", 1.0, "tag", False), ("  dune ", 2.0, "folder", False), ("Emma", 1.0, "file", None)], 2: [("a", 9.0, "tag", False), ("B", 1.0, "match", True)],
        3: [("", 5.0, "tag", True), (None, 5.0, "tag", True), ("x", 0.0, "tag", True), ("x", None, "tag", True)], 4: [("a", 1.0, "one", False), ("a", 1.0, "two", False), ("b", 2.0, "three", False)],
        5: [("", 5.0, "tag", True), ("c\u2003d", 1.0, "one", False), ("C D", 1.0, "two", False), ("e", -3.0, "three", False)],
    }
    rows = spark.createDataFrame([(s, *x, i) for s, v in cases.items() for i, x in enumerate(v)], "subject int, value string, weight double, source string, hard boolean, at int")
    got = {r["subject"]: (r["value"], r["share"], r["source"]) for r in votes.resolve_field(rows, "subject", "value", "weight", "source", "hard", "at").collect()}
    assert got == {1: ("Dune", 0.75, "folder"), 2: ("B", 1.0, "match"), 3: (None, 0.0, None), 4: ("b", 0.5, "three"), 5: ("c\u2003d", 1.0, "one")}
    assert votes.resolve_field(rows.where("at > 99"), "subject", "value", "weight", "source", "hard", "at").collect() == []


def test_consensus_takes_three_quarters(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "a"), (2, "b")], "subject int, key string")
    assert [(r["subject"], r["winner"], r["weight"]) for r in votes.consensus(rows, "subject", "key", 75).collect()] == [(1, "a", 3)]


def test_gaps(spark):
    cases = {1: [1, 2, 4, 5], 2: [3, 4, 5], 3: [5, 6, 7, 8], 4: [1, 2, 50], 5: [0], 6: [1, 1, 3], 7: [1, 2, 1_000_000_000], 8: [2, 3, 5, 5], 9: [51, 53, 54], 10: [None]}
    rows = spark.createDataFrame([(p, n) for p, v in cases.items() for n in v], "part int, n int")
    assert {r["part"]: (r["n_missing"], r["missing"]) for r in files.gaps(rows, "part", "n").collect()} == {1: (1, "3"), 2: (2, "1,2"), 8: (2, "1,4"), 9: (1, "52")}


def test_titles(spark):
    cases = {
        "mistborn: the final empire": "Mistborn: The Final Empire", "the_way_of_kings": "The Way of Kings", "dune - the beginning": "Dune - The Beginning", "well-known tales": "Well Known Tales",
        "a ,b": "A, B", "what it is for": "What It Is For", "": "", "x" * 1500: "X" + "x" * 1499,
    }
    assert of(spark, fx.title_case, list(cases)) == list(cases.values())


def test_keys(spark):
    cases = {
        "\u00c9lodie Dupont": "elodie dupont", "Le Guin, Ursula K.": "ursula k le guin", "SueEllen Page": "sue ellen page", "MacDonald": "macdonald", "J. R. R. Tolkien": "jrr tolkien", "JRR Tolkien": "jrr tolkien",
        "\u6751\u4e0a\u6625\u6a39": "\u6751\u4e0a\u6625\u6a39", "a_b-c": "abc", "": "",
    }
    assert of(spark, fx.entity_key, [*cases, None]) == [*cases.values(), None]


def test_people(spark):
    cases = {
        "Ann Lee & Bo Ray": ["Ann Lee", "Bo Ray"], "Ann Lee and Bo Ray; Cy Dow": ["Ann Lee", "Bo Ray", "Cy Dow"], "Ann Lee, Bo Ray": ["Ann Lee", "Bo Ray"], "Lee, Ann": ["Lee, Ann"],
        "Sandy Anderson": ["Sandy Anderson"], "John Smith, Jr.": ["John Smith, Jr."], " ; ": [],
    }
    assert of(spark, fx.people, list(cases)) == list(cases.values())


@pytest.mark.parametrize(("code", "seconds"), [("1:02:03", 3723), ("2:03", 123), ("7", 7), ("x:1", None), ("", None), ("1:2:3:4", None), (None, None)])
def test_durations(spark, code, seconds):
    assert of(spark, fx.seconds_of, [code]) == [seconds]
