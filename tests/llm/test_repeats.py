import hashlib
import random
from collections import Counter

import pytest

from lectern.llm import repeats


def brute(texts):
    seen = Counter()
    for t in texts.values():
        b = (t or "").encode()
        seen.update(b[i : i + 400] for i in range(len(b) - 399))
    out = {}
    for d, t in texts.items():
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(left).hexdigest())
    return out


def corpus(seed):
    rnd = random.Random(seed)
    some = lambda n: "".join(rnd.choice("abcdeé ") for _ in range(n))
    passages = [some(n) for n in (330, 380, 400, 401, 420, 700, 1500)]
    out = {0: None, 1: "", 2: "x" * 399, 3: "x" * 400, 4: "ab" * 1000, 5: "y" * 401, 6: some(400)}
    for d in range(7, 60):
        text = some(rnd.choice([0, 50, 500, 2000]))
        for _ in range(rnd.randrange(4)):
            p = rnd.choice(passages)
            a = rnd.randrange(0, 60)
            at = rnd.randrange(len(text) + 1)
            text = text[:at] + p[a : len(p) - rnd.randrange(0, 60)] + text[at:]
        if rnd.random() < 0.2:
            text = out[rnd.randrange(d)] or ""
            if text and rnd.random() < 0.5:
                at = rnd.randrange(len(text))
                text = text[:at] + "#" + text[at + rnd.randrange(2) :]
        out[d] = text
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, tmp_path, seed):
    texts = corpus(seed)
    spark.createDataFrame([(d, t, d) for d, t in texts.items()], "doc_id long, text string, first long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(texts)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.op2_suffix_dedup(spark, str(tmp_path)).collect()}
    assert set(got) == set(want)
    for d in want:
        assert got[d] == want[d], (d, len(texts[d] or ""))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert repeats.op2_suffix_dedup(spark, str(tmp_path)).count() == 0


def test_shared_passages(spark):
    rnd = random.Random(8)
    vocab = [f"w{k}" for k in range(5000)]
    some = lambda n: [rnd.choice(vocab) for _ in range(n)]
    docs = {}
    for k in range(40):
        passage = some(rnd.choice([49, 50, 51, 52, 60, 130]))
        for j in range(rnd.choice([1, 2, 3])):
            docs[100 * k + j] = " ".join(some(rnd.randrange(90)) + passage + some(rnd.randrange(90)))
        docs[100 * k + 50] = " ".join(own := some(60)) + "\n" + " ".join(own)
    docs |= {9000: None, 9001: "", 9002: docs[50], 9003: docs[50].upper()}
    windows = {}
    for d, t in docs.items():
        w = (t or "").lower().split()
        for k in range(len(w) - 50):
            windows.setdefault(tuple(w[k : k + 51]), set()).add(d)
    want = {d for ids in windows.values() if len(ids) > 1 for d in ids}
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["shares_passage"] for r in repeats.remove(rows).collect()}
    assert {d for d, x in got.items() if x} == want and set(got) == set(docs)


def test_rows_with_equal_or_no_ids_are_documents_of_their_own(spark):
    rnd = random.Random(8)
    long, other = ("".join(rnd.choice("abcdef ") for _ in range(n)) for n in (900, 5000))
    rows = [(1, long), (1, "short"), (2, long), (3, other), (3, other[:100]), (None, long), (None, other[:450]), (None, None)]
    want = brute(dict(enumerate(t for _, t in rows)))
    got = repeats.remove(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=key) == sorted(((d, *want[i]) for i, (d, _) in enumerate(rows)), key=key)


def test_shown_windows_are_written_where_they_are_made(spark, monkeypatch):
    plans, keep = [], repeats.Scratch.keep

    def noted(self, df):
        plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return keep(self, df)

    monkeypatch.setattr(repeats.Scratch, "keep", noted)
    passage = " ".join(f"p{k}" for k in range(80))
    rows = [(1, passage + " a"), (2, "b " + passage + " " + passage), (3, " ".join(f"q{k}" for k in range(80)) * 2), (4, None)]
    got = repeats.remove(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"] for r in got if r["shares_passage"]} == {1, 2}
    shown = [plan for columns, plan in plans if columns == ["doc_id", "hash"]]
    assert len(shown) == 1 and not [x for x in shown[0].splitlines() if "Exchange" in x and "hashpartitioning" in x]
