"""Audit of how the sources of a language differ: by source the terms that it uses more than its language, and all pairs of sources.

Terms are counted by group (language and source) and kept where at least ``LEAST`` documents of the language hold them. A
group's p of a term is a smoothed share of its count, in whole billionths; f(p, q) = floor((p - q)^2 / (p + q)) says how far two
of them are apart. All of it is whole-number arithmetic.

Terms of a group: those of one count have one p, so f falls as the language's q grows. A bucket is all terms of a group with one
count; its least q bounds its f from above. Buckets are evaluated best bound first, in waves that double the number of terms,
and a group is done once it has k terms and no bound of its unseen buckets reaches the k-th value.

Pairs of sources: a term that neither holds adds the same f each time, one that only one of them holds depends on its count alone and is
summed by buckets; only what both hold is met term by term, through the postings of the term.

Defined results: null text, language and source count as ''. Every group and pair that occurs has its rows, those without terms
too; a language without kept terms has pairs of value 0 and no terms. Equal values are ranked by the item's UTF-8 bytes. Rows
with equal or no doc_id are documents of their own. An empty table gives an empty table. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.storage import Scratch
from lectern.llm.text import U64, blocks, mix, tidy, words

#: Documents of a language that must hold a term, and how many terms of a group are returned.
LEAST, TOP = 10, 10
#: Bytes between terms: ASCII but its letters. Only A-Z are lower-cased, so terms are cut and named as bytes.
BREAKS = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b < 91 else b for b in range(256)], dtype=np.uint8)
COUNTS = "lang string, source string, term string, n long, docs long"


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and documents of the group that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], names=["lang", "source"]).to_pylist()
            number: dict[tuple[str, str], int] = {}
            group = np.array([number.setdefault((g["lang"], g["source"]), len(number)) for g in groups], dtype=np.int64)
            names = list(number)
            for first_row, _, data, rows in blocks(batch.column(2), 4 << 20):
                hashes, starts, ends, first = words(data, rows, lower=True, breaks=BREAKS)
                if not len(hashes):
                    continue
                row = np.repeat(np.arange(len(rows) - 1), np.diff(first))
                # a term of a document, then a document's terms by group
                own = mix(hashes + row.astype(np.uint64) * U64(0x9E3779B97F4A7C15))
                _, at, times = np.unique(own, return_index=True, return_counts=True)
                of = group[first_row + row[at]]
                order = np.lexsort((hashes[at], of))
                at, times, of = at[order], times[order], of[order]
                fresh = np.flatnonzero((np.diff(of, prepend=-1) != 0) | np.concatenate([[True], hashes[at[1:]] != hashes[at[:-1]]]))
                raw = LOWER[data].tobytes()
                terms = [raw[s:e] for s, e in zip(starts[at[fresh]].tolist(), ends[at[fresh]].tolist(), strict=True)]
                lang, source = (pa.array([x[k] for x in names], pa.string()).take(pa.array(of[fresh])) for k in range(2))
                yield pa.RecordBatch.from_arrays([lang, source, pa.array(terms, pa.binary()).cast(pa.string()), pa.array(np.add.reduceat(times, fresh)), pa.array(np.diff(fresh, append=len(at)))], names=["lang", "source", "term", "n", "docs"])

    known = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    return known.mapInArrow(tidy(run), COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column | str, total: Column | str, kept: Column | str) -> Column:
    """p of a count: 1 + floor(10^9 (count + 2) / (total + 2 kept)); decimals hold the product."""
    whole = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")
    product = F.lit(1_000_000_000).cast("decimal(10,0)") * (whole(count) + F.lit(2).cast("decimal(1,0)"))
    return 1 + F.call_function("div", product, whole(total) + F.lit(2).cast("decimal(1,0)") * whole(kept))


def apart(p: Column | str, q: Column | str) -> Column:
    """f(p, q); p and q are at most 10^9 + 1, so the square is a long."""
    p, q = (F.col(x) if isinstance(x, str) else x for x in (p, q))
    return F.call_function("div", (p - q) * (p - q), p + q)


class Audit:
    """Counts of one run: ``postings`` (lang, source, term, n, p, q), ``groups`` (lang, source, total, kept, p0), both written once."""

    def __init__(self, docs: DataFrame, least: int = LEAST) -> None:
        self.scratch = Scratch(docs.sparkSession)
        counts = self.scratch.keep(term_counts(docs))
        terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")
        terms = self.scratch.keep(terms)
        langs = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
        held = self.scratch.keep(counts.drop("docs").join(terms, ["lang", "term"]))
        self.scratch.drop(counts)
        totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        occurring = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
        zero = F.lit(0).cast("long")
        groups = occurring.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        groups = groups.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("total", "kept", "lang_total")))
        # a language without terms has no shares
        self.groups = self.scratch.keep(groups.withColumn("p0", F.when(F.col("kept") > 0, share(zero, "total", "kept"))))
        shares = share("n", "total", "kept").alias("p"), share("lang_n", "lang_total", "kept").alias("q")
        self.postings = self.scratch.keep(held.join(self.groups, ["lang", "source"]).select("lang", "source", "term", "n", *shares))
        self.buckets = self.scratch.keep(self.postings.groupBy("lang", "source", "n", "p").agg(F.min("q").alias("low"), F.count("*").alias("terms")))
        self.scratch.drop(held, terms)

    def top_terms(self, top: int = TOP) -> DataFrame:
        """(lang, source, item, value, rank) of the ``top`` terms of each group by f where the group's share is the larger one."""
        group = ["lang", "source"]
        order = Window.partitionBy(*group).orderBy(F.desc("bound"), "n")  # distinct counts of a group
        bounded = self.buckets.where("p > low").withColumn("bound", apart("p", "low"))
        before = F.coalesce(F.sum("terms").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        wave = F.when(before < top, 0).otherwise(F.floor(F.log2(before / top)) + 1).cast("int")
        queue = self.scratch.keep(bounded.select(*group, "n", "bound", wave.alias("wave")))
        ranked = Window.partitionBy(*group).orderBy(F.desc("value"), "item")
        best, number, open_groups = None, 0, queue.select(*group).distinct()
        while open_groups is not None:
            now = queue.where(F.col("wave") == number).join(open_groups, group, "left_semi")
            seen = self.postings.where("p > q").join(now, [*group, "n"], "left_semi").select(*group, F.col("term").alias("item"), apart("p", "q").alias("value"))
            seen = seen if best is None else best.select(*group, "item", "value").unionByName(seen)
            best, old = self.scratch.keep(seen.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)), best
            number += 1
            unseen = queue.where(F.col("wave") >= number).groupBy(*group).agg(F.max("bound").alias("bound"))
            least = best.where(F.col("rank") == top).select(*group, F.col("value").alias("least"))
            left = self.scratch.keep(unseen.join(least, group, "left").where("least is null or bound >= least").select(*group))
            self.scratch.drop(*(t for t in (old, open_groups) if t is not None))
            open_groups = left if left.limit(1).count() else None
        return best

    def pairs(self) -> DataFrame:
        """(lang, source, item, value): for each source each other one of its language and the sum of f over all kept terms."""
        a = self.groups.select("lang", F.col("source").alias("a"), "kept", F.col("p0").alias("a0"))
        b = self.groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("b0"))
        zero = F.lit(0).cast("long")
        # what a holds, as if b held nothing of it: by a's buckets. These are the pairs that are returned.
        ends = self.scratch.keep(a.join(b, "lang").where("a <> b"))
        own = self.buckets.select("lang", F.col("source").alias("a"), "p", "terms")
        alone = ends.where("kept > 0").join(own, ["lang", "a"]).groupBy("lang", "a", "b").agg(F.sum(F.col("terms") * (apart("p", "b0") - apart("a0", "b0"))).alias("alone"))
        # what both hold: once for a < b
        one = self.postings.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("p"))
        other = self.postings.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("o"))
        both = one.join(other, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b", "p", "o").agg(F.count("*").alias("terms"))
        both = both.join(ends.select("lang", "a", "b", "a0", "b0"), ["lang", "a", "b"])
        shared = F.sum(F.col("terms") * (apart("p", "o") - apart("p", "b0") - apart("a0", "o") + apart("a0", "b0")))
        both = self.scratch.keep(both.groupBy("lang", "a", "b").agg(shared.alias("shared")))
        both = both.unionByName(both.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "shared"))
        alone = self.scratch.keep(alone)
        back = alone.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.col("alone").alias("back"))
        whole = ends.join(alone, ["lang", "a", "b"], "left").join(back, ["lang", "a", "b"], "left").join(both, ["lang", "a", "b"], "left")
        value = F.coalesce(F.col("kept") * apart("a0", "b0"), zero) + F.coalesce("alone", zero) + F.coalesce("back", zero) + F.coalesce("shared", zero)
        return whole.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), value.alias("value"))


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` with all other sources of the language, part ``term`` with ``top`` terms."""
    audit = Audit(docs, least)
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = audit.pairs().withColumn("rank", F.row_number().over(ranked))
    both = [x.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, x in (("pair", pair), ("term", audit.top_terms(top)))]
    return both[0].unionByName(both[1])


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
said AS (SELECT row, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM said GROUP BY 1, 2 HAVING count(DISTINCT row) >= 10),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY 1),
counted AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM said JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
grp AS (SELECT DISTINCT lang, source FROM docs),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.n AS lang_n FROM grp g JOIN kept k USING (lang) LEFT JOIN counted c USING (lang, source, term)),
sums AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM dense GROUP BY 1, 2),
shares AS (SELECT d.lang, d.source, d.term, d.n, 1 + (1000000000 * (d.n + 2)) // (s.total + 2 * l.v) AS p, 1 + (1000000000 * (d.lang_n + 2)) // (l.total + 2 * l.v) AS q
  FROM dense d JOIN sums s USING (lang, source) JOIN langs l USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY 1, 2, 3),
terms AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL SELECT * FROM (SELECT lang, source, 'term', item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms) WHERE rank <= 10
"""
