import random
import re

from lectern.llm import decontaminate


def grams(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_recall_and_exactness_both_ways(spark):
    rnd = random.Random(2)
    vocab = [f"v{k}" for k in range(3000)]
    items = {i: " ".join(rnd.choice(vocab) for _ in range(rnd.choice([9, 15, 25, 40, 80]))) for i in range(60)}
    items |= {60: None, 61: "", 62: "only three words", 63: items[0]}
    docs = {0: None, 1: "", 2: "only three words", 3: "Only THREE words"}
    for i in range(4, 160):
        w = [rnd.choice(vocab) for _ in range(rnd.choice([20, 300, 5000]))]
        for _ in range(rnd.randrange(3)):
            own = items[rnd.randrange(60)].split()
            if rnd.random() < 0.5:
                own[rnd.randrange(len(own))] = "changed"
            at = rnd.randrange(len(w))
            w[at:at] = own
        docs[i] = " ".join(w)
    want = set()
    sets = {k: grams(v) for k, v in items.items()}
    for d, t in docs.items():
        own = grams(t)
        want |= {(d, k, len(s), len(s & own)) for k, s in sets.items() if s and 100 * len(s & own) >= 75 * len(s)}
    a = spark.createDataFrame([(d, t, 1) for d, t in docs.items()], "doc_id long, text string, item_id long")
    b = spark.createDataFrame([(k, t, 1) for k, t in items.items()], "item_id long, text string, doc_id long")
    got = [{(r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in decontaminate.contamination(a, b, most).collect()} for most in (10**6, 0)]
    assert got[0] == got[1]
    assert got[0] <= want and len(got[0]) >= 0.99 * len(want) > 50


def test_empty_tables(spark):
    a = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(a, b).count() == 0


def test_repeated_and_null_ids_give_the_same_both_ways(spark):
    text, item = " ".join(f"w{k}" for k in range(60)), " ".join(f"w{k}" for k in range(10, 30))
    docs = spark.createDataFrame([(1, text), (1, text), (1, "other words"), (None, text), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (7, item), (8, "w1 w2"), (None, item)], "item_id long, text string")
    got = [sorted(((r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in decontaminate.contamination(docs, bench, most).collect()), key=repr) for most in (10**6, 0)]
    assert got[0] == got[1] == sorted([(d, i, 16, 16) for d in (1, None) for i in (7, None)], key=repr)
