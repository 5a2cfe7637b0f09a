from pyspark.sql import functions as F

from lectern.operators import ranks
from lectern.plans import registry

SF = "/root/testdata/sf0.001"


def test_places_over_ranges(spark):
    rows = spark.range(0, 500, 1, 7).selectExpr("id", "(id * 37) % 101 as v")
    got = {r["id"]: r["place"] for r in ranks.place(rows, ["v", "id"]).collect()}
    assert got == {i: k + 1 for k, i in enumerate(sorted(range(500), key=lambda i: (i * 37 % 101, i)))}


def test_no_row_is_left_out(spark):
    for name, source in (("sort_confidence", "customer"), ("natural_sort", "customer"), ("runtime_closeness", "orders")):
        n = spark.read.parquet(f"{SF}/{source}.parquet").count()
        assert sorted(r["place"] for r in registry.queries()[name](spark, SF).select("place").collect()) == list(range(1, n + 1))
    pairs = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_partkey", "l_suppkey").distinct().count()
    assert registry.queries()["rank_candidates"](spark, SF).count() == pairs


def test_places_within_parts(spark):
    part = lambda i: None if i % 9 == 0 else "all" if i % 3 else f"p{i % 7}"
    rows = [(i, part(i), i * 37 % 11) for i in range(900)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranks.place(spark.createDataFrame(rows, "id int, p string, v int").repartition(7), ["v", "id"], within=["p"])
        # the largest part lies in several ranges, each ranked by a task of its own
        assert got.where("p = 'all'").select(F.spark_partition_id().alias("t")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for p in {r[1] for r in rows}:
        want |= {r[0]: k for k, r in enumerate(sorted((r for r in rows if r[1] == p), key=lambda r: (r[2], r[0])), 1)}
    assert got.columns == ["id", "p", "v", "place"] and {r["id"]: r["place"] for r in got.collect()} == want
