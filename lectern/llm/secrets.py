"""Secret scan in DataFrame expressions only.

Base kinds are fixed patterns. The method adds kind ``entropy``: candidate runs of key-like characters are passed through a
sliding window whose Shannon entropy (over hexadecimal or mixed characters, by the run's class) is kept up to date from
character counts, one character in and one out per step; a run is a secret if any window reaches its class's threshold,
unless the allow list knows all its pieces or a base span already covers part of it. Pieces that the list knows (a UUID, a
placeholder in a path) are cut out and the rest is judged; the span is that of the whole run.

Positions count code points, end exclusive. Defined results: null text counts as empty; texts without a secret have counts
0 and the SHA-256 of the empty string; duplicate rows are scanned alike; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds in the order of the digest, with their patterns and the least length of what must be long enough.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")
LEAST_VALUE = 8

CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Window length and least entropy in bits a character, for hexadecimal and for mixed candidates.
WINDOWS = {"hex": (16, 3.0), "mixed": (20, 3.7)}
# What a piece of a candidate (between separators) may be without being a secret: UUIDs, alphabets and counting runs, placeholders,
# one character over and over, and words (also in camel case; longer than 15 letters of one case they are judged like the rest).
SEPARATOR = "[/=_+-]"
KNOWN = r"(?i:[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|(?:abcdefghijklmnopqrstuvwxyz|abcdefghijklm|0123456789|1234567890)++|example|placeholder|dummy|sample)"
HUMP = "[A-Z][a-z]{2,14}|A(?![a-z])|Of|To|In|Is|By|On|At|Id|Or|As|An|If|No"
WORD = rf"[A-Z]?[a-z]{{1,14}}(?:{HUMP})*+|[A-Z]{{1,15}}"
#: Candidates that hold nothing but such pieces, or no letter.
ALLOWED = rf"^{SEPARATOR}*+(?:(?:{KNOWN}|([A-Za-z0-9])\1*+|{WORD})(?:{SEPARATOR}++|$))*+$|^[^A-Za-z]*$"
#: Where a candidate is cut: what is left is judged for itself.
CUT = rf"(?<![A-Za-z0-9]){KNOWN}(?![A-Za-z0-9])"


def spans(text: Column, pattern: str, kind: str, keep: Column | None = None, group: int | None = None) -> Column:
    """Array of (start, kind order, end, kind, value) of a pattern's leftmost non-overlapping matches, in order.

    The text is cut at the matches; running sums of the lengths of gaps and matches give the positions.
    """
    p = F.lit(pattern)
    hits, gaps = F.regexp_extract_all(text, p, F.lit(0)), F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, p, F.lit(group)) if group else hits
    empty = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string,value:string>>)")
    rows = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), values.alias("value"))

    def step(acc: Column, row: Column) -> Column:
        start = acc["at"] + F.length(row["gap"])
        end = start + F.length(row["hit"])
        one = F.array(F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), row["value"].alias("value")))
        good = row["hit"].isNotNull()
        if group:
            good = good & (F.length(row["value"]) >= LEAST_VALUE)
        return F.struct(F.coalesce(end, start).alias("at"), F.when(good, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    named = F.transform(rows, lambda r: F.struct(r["gap"].alias("gap"), r["hit"].alias("hit"), r["value"].alias("value")))
    found = F.aggregate(named, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern) if keep is None else keep, found).otherwise(empty)


def window_entropy(value: Column, width: int) -> Column:
    """Most bits a character over all windows of ``width`` characters, from counts updated one step at a time."""
    term = F.array(*[F.lit(k * math.log2(k) if k else 0.0) for k in range(width + 2)])
    code = lambda i: F.ascii(F.substring(value, i, F.lit(1)))
    start = F.struct(F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def step(acc: Column, i: Column) -> Column:
        new, full = code(i), i > width
        old = F.when(full, code(F.greatest(i - width, F.lit(1)))).otherwise(F.lit(-1))
        count = lambda c: F.coalesce(F.get(acc["counts"], c), F.lit(0))
        change = F.when(new == old, F.lit(0.0)).otherwise(
            F.get(term, count(new) + 1) - F.get(term, count(new)) + F.when(full, F.get(term, count(old) - 1) - F.get(term, count(old))).otherwise(F.lit(0.0))
        )
        total = acc["sum"] + change
        counts = F.transform(acc["counts"], lambda c, k: c + (k == new).cast("int") - (k == old).cast("int"))
        best = F.when(i >= width, F.greatest(acc["best"], F.lit(math.log2(width)) - total / width)).otherwise(acc["best"])
        return F.struct(counts.alias("counts"), total.alias("sum"), best.alias("best"))

    return F.aggregate(F.sequence(F.lit(1), F.length(value)), start, step, lambda acc: acc["best"])


def is_secret(value: Column) -> Column:
    """Whether entropy reaches its class's threshold in what the allow list leaves of a candidate, or in a hexadecimal piece of it."""
    (hex_width, hex_bits), (width, bits) = WINDOWS["hex"], WINDOWS["mixed"]
    pieces = F.filter(F.split(value, SEPARATOR), lambda p: p.rlike("^[0-9A-Fa-f]{%d,}$" % hex_width))
    high = lambda p: F.when(p.rlike("^[0-9A-Fa-f]+$"), window_entropy(p, hex_width) >= hex_bits).otherwise(window_entropy(p, width) >= bits)
    parts = F.concat(F.split(value, CUT, -1), pieces)
    return ~value.rlike(ALLOWED) & F.exists(parts, lambda p: F.when((F.length(p) < hex_width) | p.rlike(ALLOWED), F.lit(False)).otherwise(high(p)))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: array of (start, rank, end, kind, value), by start and then kind, and ``base``: its base kinds."""
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.withColumns({
        "_assign": spans(body, ASSIGN, "assign", group=1),
        "_access": spans(body, ACCESS, "access", keep=body.contains("AKIA")),
        "_hex": spans(body, HEX, "hex"),
        "_candidates": spans(body, CANDIDATE, "entropy"),
    })
    base = base.withColumn("base", F.array_sort(F.concat("_assign", "_access", "_hex")))
    free = lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    extra = F.filter(F.filter("_candidates", free), lambda c: is_secret(c["value"]))
    return base.withColumn("secrets", F.array_sort(F.concat("base", extra))).drop("_assign", "_access", "_hex", "_candidates")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``scan`` plus ``redacted``: the text with every base secret replaced by ``[SECRET]``."""
    out = F.coalesce(F.col(text), F.lit(""))
    for pattern in (ACCESS, HEX):
        out = F.regexp_replace(out, pattern, "[SECRET]")
    return scan(docs, text).withColumn("redacted", F.regexp_replace(out, ASSIGN.replace("+)", "{8,})"), "[SECRET]"))


def digest(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("secrets")).alias("spans"))
