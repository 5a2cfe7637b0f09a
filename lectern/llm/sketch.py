"""Count sketches of fixed size: one array of counts for all tokens or signatures of a corpus, added up from those of its tasks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counts beyond this are alike.
MOST = (1 << 16) - 1


def packed(counts: np.ndarray) -> bytes:
    """Counts as compressed 16-bit numbers."""
    return zlib.compress(np.minimum(counts, MOST).astype(np.uint16).tobytes(), 1)


def unpacked(sketch: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(sketch), np.uint16)


def rarity(rows: DataFrame, size: int) -> np.ndarray:
    """Sum of all tasks' sketches (rows whose ``sketch`` isn't null) of ``size`` counts, added up in two rounds."""

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int32)
        for part in parts:
            for x in part.column("sketch"):
                total = np.minimum(total + unpacked(x.as_py()), MOST)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([packed(total)], pa.binary())], names=["part", "sketch"])

    own = rows.where("sketch is not null").select((F.spark_partition_id() % 16).alias("part"), "sketch")
    total = np.zeros(size, dtype=np.int32)
    for r in own.groupBy("part").applyInArrow(add, "part int, sketch binary").collect():  # at most 16 rows of 2 bytes a count
        total = np.minimum(total + unpacked(r["sketch"]), MOST)
    return total.astype(np.uint16)
