"""Facets of books: literal cases and all combinations against a plain filter."""

import itertools

from lectern.functions import triage

SCHEMA = "i int, title string, state string, confidence double, identity_confidence double, authors_prov string, series_prov string, series array<string>, narrators array<string>, cover string, asin string, isbn string, year int, findings array<string>, acknowledged array<string>, missing boolean"
ROWS = [
    (0, "b", "ready", 90.0, 10.0, "tag", "audible", ["s"], ["n"], "c", "a", None, 2000, [], [], False), (1, "A", "detected", 0.0, 50.0, "directory", None, [], None, None, None, "i", None, ["gap", "old"], ["gap"], None),
    (2, None, "needs_review", 39.9, 99.0, None, "graphing", None, [], "", "", "", 1990, ["corrupt"], None, False), (3, "c", None, None, None, "", "manual", ["s"], ["n"], "c", "a", "i", 1, None, None, True), (4, "a", "skipped", 75.0, 0.0, "hardcover", "tag", ["s"], ["n"], "c", "a", "i", 1, ["gap"], ["gap"], False),
]


def test_values(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA).select("i", triage.confidence_bucket().alias("b"), triage.identity_tiers().alias("t"), triage.missing_fields().alias("m"), triage.weak_identity().alias("w"), triage.needs_human().alias("n"), triage.open_findings(("old",)).alias("o"), triage.blocked(("corrupt",)).alias("x"))
    assert [(r["b"], sorted(r["t"]), r["m"], r["w"] and tuple(r["w"]), r["n"], r["o"], r["x"]) for r in rows.orderBy("i").collect()] == [
        ("high", ["match", "tag"], [], None, False, False, False), ("mid", ["directory"], ["series", "cover", "narrator", "year"], ("author", "directory"), True, False, False),
        ("low", ["graphing"], ["series", "cover", "ident", "narrator"], ("series", "graphing"), True, True, True), ("low", ["manual"], [], None, True, False, True), ("high", ["match", "tag"], [], None, False, False, False),
    ]


def test_facets_and_order(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    own = {"state": {0: "ready", 1: "detected", 2: "needs_review", 4: "skipped"}, "confidence": {0: "high", 1: "mid", 2: "low", 3: "low", 4: "high"}}
    for state, band, work in itertools.product(([], ["ready", "detected"]), ([], ["low"], ["mid", "high"]), (False, True)):
        got = [r["i"] for r in rows.where(triage.facets({"state": state, "confidence": band, "needs_work": work})).collect()]
        assert got == [i for i in range(5) if (not state or own["state"].get(i) in state) and (not band or own["confidence"][i] in band) and (not work or i in (1, 2, 3))]
    one = lambda **f: [r["i"] for r in rows.where(triage.facets(f, ("corrupt",), ("old",))).collect()]
    assert one(id_trust=["match"]) == [0, 4] and one(missing=["ident", "year"]) == [1, 2] and one(findings=True) == [2] and one(errors=True) == [2, 3] and one() == [0, 1, 2, 3, 4]
    by = lambda key: [r["i"] for r in rows.orderBy(*triage.order(key), "i").collect()]
    assert by("conf_asc") == [3, 2, 1, 4, 0] and by("conf_desc") == [0, 4, 1, 2, 3] and by("title") == [2, 1, 4, 0, 3]
