import datetime
import math

import duckdb
import pytest

from lectern.functions import search
from lectern.plans import registry
from lectern.streaming.windows import tumbling_counts

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(rows):
    def one(v):
        return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v.isoformat() if isinstance(v, datetime.datetime) else v

    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(registry.oracles()))
def test_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    other = duck.execute(registry.ORACLES[name])
    assert sorted(x[0] for x in other.description) == columns
    at = [[x[0] for x in other.description].index(c) for c in columns]
    want = [tuple(r[k] for k in at) for r in other.fetchall()]
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert canonical(got) == canonical(want)
    assert got


def test_filter_language():
    fields = {"author", "title", "year"}
    parsed = search.parse('author:"Le Guin",Wolfe -title:dark -x "two words" other:thing - year:', fields)
    assert parsed == [
        search.Clause("author", ("le guin", "wolfe")), search.Clause("title", ("dark",), True), search.Clause(None, ("x",), True), search.Clause(None, ("two words",)),
        search.Clause(None, ("other:thing",)), search.Clause(None, ("-",)),
    ]
    assert search.parse(search.render(parsed), fields) == parsed


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    stream = tumbling_counts(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert canonical(map(tuple, spark.table("counts").collect())) == canonical(map(tuple, tumbling_counts(events).collect()))
