from itertools import combinations

from lectern.operators import votes
from lectern.plans import registry


def test_every_pair_of_a_size_band_is_scored(spark, tmp_path):
    rows = [(k, f"{w} steel", "Brand#1", t, size) for k, (w, t, size) in enumerate([("red", "PROMO", 1), ("red", "PROMO", 1), ("blue", "PROMO", 1), ("blue", "ECONOMY", 1), ("red", "PROMO", 2), ("green", "PROMO", 2)], 7)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    member = {r["p_partkey"]: r["id"] for r in registry.queries()["match_score_members"](spark, str(tmp_path)).collect()}
    score = {(r["a"], r["b"]): r["permille"] for r in registry.queries()["match_score"](spark, str(tmp_path)).collect()}
    words = {k: (frozenset(f"{n} {b} {t}".replace("B", "b").lower().split()), s) for k, n, b, t, s in rows}
    used = set()
    for a, b in combinations(words, 2):
        (x, p), (y, q) = words[a], words[b]
        if p == q:
            key = tuple(sorted((member[a], member[b])))
            used.add(key)
            assert (1000 if key[0] == key[1] else score[key]) == 1000 * len(x & y) // len(x | y)
    assert set(score) == {k for k in used if k[0] != k[1]}


def test_pairs_of_any_parity_that_share_a_part(spark, tmp_path):
    sets = {2: range(10), 4: range(9, 30), 6: range(40, 45), 7: range(44, 50)}
    rows = [(o, p, 1) for o, s in sets.items() for p in s]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r["a"], r["b"]): (r["shared"], r["united"]) for r in registry.queries()["jaccard_reassociate"](spark, str(tmp_path)).collect()}
    assert got == {(a, b): (len(set(x) & set(y)), len(set(x) | set(y))) for a, x in sets.items() for b, y in sets.items() if set(x) & set(y)}


def test_consensus_of_three_quarters(spark):
    rows = spark.createDataFrame([(1, "x")] * 3 + [(1, "y")] + [(2, "x")] * 2 + [(2, "y")], "subject int, key string")
    assert [(r["subject"], r["winner"], r["weight"]) for r in votes.consensus(rows, "subject", "key", 75).collect()] == [(1, "x", 3)]
