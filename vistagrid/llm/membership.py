"""A bounded broadcast filter: rows that are surely not in a set stay out of a shuffle; an exact join has to follow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The filter has 2^26 bits (8 MB) at most, however many hashes it holds; a full filter merely lets all rows pass.
MOST_BITS = 26
LEAST_BITS = 16
BITS_PER_HASH = 16


def filter_bits(hashes: DataFrame, column: str = "h") -> tuple[Broadcast, int]:
    """Bit array over the low bits of the hashes, made by Spark as one 64-bit word per row, and its size as a power of two."""
    n = hashes.count()
    power = min(MOST_BITS, max(LEAST_BITS, int(max(1, n) * BITS_PER_HASH).bit_length()))
    low = F.col(column).bitwiseAND((1 << power) - 1)
    words = hashes.groupBy(F.shiftright(low, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63 as int))")).alias("bits"))
    found = words.toPandas()
    bits = np.zeros(1 << (power - 6), dtype=np.int64)
    bits[found["w"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return hashes.sparkSession.sparkContext.broadcast(bits), power


def passes(bits: np.ndarray, power: int, hashes: np.ndarray) -> np.ndarray:
    low = hashes.astype(np.int64) & ((1 << power) - 1)
    return (bits[low >> 6] >> (low & 63)) & 1 == 1


def member_filter(rows: DataFrame, column: str, hashes: DataFrame, inside: bool = True) -> DataFrame:
    """Rows whose hash may be among `hashes` (column h); with `inside=False` those that surely are not."""
    shared, power = filter_bits(hashes)
    names = [c for c in rows.columns if c != column]

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = passes(shared.value, power, batch.column(column).to_numpy(zero_copy_only=False))
            yield batch.filter(pa.array(hit if inside else ~hit)).select(names)

    return rows.mapInArrow(chosen, rows.select(*names).schema)
