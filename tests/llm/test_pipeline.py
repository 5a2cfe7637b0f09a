import hashlib

import public_tokenizers as P
import pyarrow as pa
import tiktoken

import corpus_pipeline
from lectern.llm.bpe import load_ranks, read_vocabulary
from tests.llm.test_jaccard import brute as components
from tests.llm.test_lines import brute as line_dedup


def test_stages_against_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "", None, "s", 0), (10**6 + 2, "123 456\n!!", "en", "s", 10)], source.schema)
    docs = source.unionByName(extra).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    held = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    for d in (10**6, 10**6 + 1, 10**6 + 2):
        del held[d]
    held = {d: t for d, (t, gone) in line_dedup(held).items() if not (gone and not t.strip())}
    held = {d: t for d, t in held.items() if components(held)[d][1] == d} if len(held) < 5 else (lambda c: {d: t for d, t in held.items() if c[d][1] == d})(components(held))
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = lambda t: {tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(len(w) - 4)}
    sets = [grams(t) for t in items]
    held = {d: t for d, t in held.items() if not any(s and 100 * len(s & grams(t)) >= 75 * len(s) for s in sets)}
    assert set(got) == set(held)
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(read_vocabulary(P.path("byte_bpe_50k.tiktoken"))), special_tokens={})
    for d, t in held.items():
        ids = other.encode_ordinary(t)
        assert got[d]["n_tokens"] == len(ids)
        assert got[d]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_workers_do_not_keep_the_codec_of_a_stage(spark):
    def codecs(batches):
        from lectern.llm import bpe

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(bpe._codecs)] * batch.num_rows, pa.int64())], names=["n"])

    docs = spark.range(0, 3200, 1, 32).selectExpr("id as doc_id", "concat('word', id) as text")
    assert corpus_pipeline.token_stage(spark, docs, "").where("n_tokens > 0").count() == 3200
    assert spark.range(0, 32, 1, 32).mapInArrow(codecs, "n long").agg({"n": "max"}).first()[0] == 0


def test_lines_are_cut_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta gamma", 16), (2, "alpha beta gamma", 16), (3, "alpha beta gamma\nown", 20)], "doc_id long, text string, n_chars long")
    out = corpus_pipeline.line_stage(spark, docs, "")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("left_of(") == 1
    assert sorted(map(tuple, out.collect())) == [(1, "alpha beta gamma", 16), (3, "own", 3)]
