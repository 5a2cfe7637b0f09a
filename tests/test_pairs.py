from collections import defaultdict
from itertools import product

import pytest

from lectern.operators import files, pairs
from lectern.plans import registry
from tests.measured import shuffled


def tables(spark):
    """Sets of 1 to 9 elements, a large one, repeated rows, null owners and elements; all hold element 0."""
    x = [(o, e) for o in range(40) for e in (0, *range(o % 9 * 3, o % 9 * 3 + o % 9))] + [(99, e) for e in range(30)] + [(1, 0), (None, 0), (2, None)]
    y = [(o * 3, e) for o, e in x if o is not None and o % 2 == 0 and e != 4]
    return x, y, *(spark.createDataFrame(r, "o long, e long") for r in (x, y))


def brute(x, y, own):
    sides = []
    for rows in (x, y):
        sets = defaultdict(set)
        for o, e in rows:
            if o is not None:
                sets[o].add(e)
        sides.append(sets)
    out = {}
    for (a, s), (b, t) in product(sides[0].items(), sides[1].items()):
        shared = len((s & t) - {None})
        if shared and (a < b or not own):
            out[a, b] = shared, len(s) + len(t) - shared
    return out


@pytest.mark.parametrize(("small", "slot"), [(64, 4096), (3, 7), (0, 1)])
def test_pairs_of_small_and_large_sets_in_slots(spark, monkeypatch, small, slot):
    monkeypatch.setattr(pairs, "SMALL", small)
    monkeypatch.setattr(pairs, "SLOT", slot)
    x, y, left, right = tables(spark)
    rows = pairs.between_sets(left, right, [], "o", "e").collect()
    assert {(r["a"], r["b"]): (r["shared"], r["united"]) for r in rows} == brute(x, y, False) and len(rows) == len(brute(x, y, False))
    rows = pairs.of_sets(left, [], "o", "e").collect()
    assert {(r["a"], r["b"]): (r["shared"], r["united"]) for r in rows} == brute(x, x, True) and len(rows) == len(brute(x, x, True))


def test_pairs_of_scored_sets_are_not_shuffled(spark, tmp_path):
    rows = [(k, f"w{k} steel", "Brand#1", "PROMO", 1) for k in range(400)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    df = registry.queries()["match_score"](spark, str(tmp_path))
    assert df.count() == 400 * 399 // 2 and shuffled(spark, df) < 20_000


def test_pairs_of_owners_are_not_shuffled(spark):
    rows = spark.createDataFrame([(o, 7) for o in range(300)], "o long, e long")
    df = files.shared_parts(rows, rows, "o", "e", 0)
    assert df.count() == 90_000 and shuffled(spark, df) < 5_000
