from lectern.operators import hierarchy


def test_aliases_of_any_length_and_cycles(spark):
    chain = [(f"a{i:02}", f"a{i + 1:02}") for i in range(40)]
    cycle = [("y", "z"), ("z", "x"), ("x", "y")]
    tail = [("t1", "t2"), ("t2", "z")]
    pairs = spark.createDataFrame([*chain, *cycle, *tail, ("s", "s")], "name string, target string")
    want = {name: "a40" for name, _ in chain} | dict.fromkeys(["x", "y", "z", "t1", "t2"], "x") | {"s": "s"}
    rows = hierarchy.aliases(pairs).collect()
    assert len(rows) == len(want) and {r["name"]: r["canonical"] for r in rows} == want


def test_aliases_of_nothing(spark):
    assert hierarchy.aliases(spark.createDataFrame([], "name string, target string")).count() == 0


def test_closure_of_a_deep_tree_and_a_cycle(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(36)] + [(100, 101), (101, 100)], "child int, parent int")
    closed = hierarchy.closure(edges)
    want = {(i, j, j - i) for i in range(37) for j in range(i, 37)} | {(100, 100, 0), (100, 101, 1), (101, 101, 0), (101, 100, 1)}
    rows = [tuple(r) for r in closed.collect()]
    assert len(rows) == len(want) and set(rows) == want
    values = spark.createDataFrame([(36, "top")], "ancestor int, value string")
    assert {tuple(r) for r in hierarchy.nearest(closed, values).collect()} == {(i, "top", 36 - i) for i in range(37)}
