"""Bitmaps of hashes: their bits, and what making one takes of the driver."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import bitmaps


def test_holds_its_values_and_little_else(spark):
    rows = spark.range(5000).select(F.xxhash64("id").alias("v"))
    values = np.array([r["v"] for r in rows.collect()])
    bits = bitmaps.bitmap(rows.union(rows))
    assert len(bits) == 1 << 14 and bits.dtype == np.uint64
    assert np.bitwise_count(bits).sum() == len(np.unique(bitmaps._at(values, len(bits) << 6)))
    assert bitmaps.holds(bits, values).all()
    assert bitmaps.holds(bits, np.arange(100_000)).mean() < 0.02
    assert not bitmaps.bitmap(rows.limit(0)).any()


def test_the_driver_holds_pages_of_bits_only(spark):
    # a task of more values than it gathers at a time; 4 MB of bits
    rows = spark.range(0, bitmaps.HELD + 200_000, 1, 1).select(F.xxhash64("id").alias("v"))
    tracemalloc.start()
    try:
        bits = bitmaps.bitmap(rows)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert bits.nbytes == 1 << 22
    assert bitmaps.holds(bits, np.array([r["v"] for r in rows.limit(1000).collect()])).all()
    assert peak < 8 * bits.nbytes  # not so with an object a word
