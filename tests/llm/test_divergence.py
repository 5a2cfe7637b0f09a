"""Source divergence against its SQL and against brute force on hard rows."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from lectern.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long"


def sql(folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}'")
    return sorted(con.execute(divergence.ORACLE_SQL).fetchall())


def brute(rows, least, top):
    rows = [(t or "", lang or "", s or "") for _, t, lang, s, *_ in rows]
    held, count = defaultdict(set), defaultdict(Counter)
    for i, (text, lang, source) in enumerate(rows):
        for term in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text):
            term = re.sub("[A-Z]", lambda m: m[0].lower(), term)
            held[lang, term].add(i)
            count[lang, source][term] += 1
    out = []
    for lang in {x[1] for x in rows}:
        kept = [t for (g, t), docs in held.items() if g == lang and len(docs) >= least]
        sources = {x[2] for x in rows if x[1] == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        p = {s: share(count[lang, s]) for s in sources}
        q = share(sum((count[lang, s] for s in sources), Counter()))
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pair = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            term = [(t, f(p[s][t], q[t])) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


def test_equals_sql(spark):
    got = sorted(map(tuple, divergence.op11_source_divergence(spark, "/root/testdata/sf0.001").collect()))
    assert got == sql("/root/testdata/sf0.001/documents.parquet")
    assert {x[2] for x in got} == {"pair", "term"}


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, tmp_path, seed):
    rng = random.Random(seed)
    words = ["the", "The", "naïve", "Ünder", "日本", "a_b", "x1y", *(f"w{chr(97 + k)}" for k in range(26)), "é" * 300]
    rows = [(rng.choice([None, 1, 2]), " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randrange(60))), rng.choice(["en", "en", "en", "fr", None, ""]), rng.choice(["s1", "s1", "s1", "s2", "s3", None]), "t", 5) for _ in range(120)]
    rows += [(9, None, "en", "silent", None, None), (10, "", "xx", "alone", None, None), (11, "--- 12", "yy", "a", None, None), (12, None, "yy", "b", None, None), (13, "the " * 40000, "en", "s2", None, None)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, divergence.op11_source_divergence(spark, str(tmp_path)).collect()))
    assert got == brute(rows, 10, 10)
    few = divergence.divergence(spark.read.parquet(f"{tmp_path}/documents.parquet"), least=2, top=1)
    assert sorted(map(tuple, few.collect())) == brute(rows, 2, 1)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert divergence.op11_source_divergence(spark, str(tmp_path)).count() == 0
