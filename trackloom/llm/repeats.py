"""Two-pass Bloom filtering: which 64-bit hashes may occur more than once.

Pass one sets, for every hash, k bits in a filter "seen" and, where the bit was
set before, the same bit in a filter "seen again".  A hash that occurs twice
has all its bits in "seen again", so there are no false negatives; a hash that
occurs once passes only when others hit all of its bits.  Filters merge by
again = a.again | b.again | (a.seen & b.seen) and seen = a.seen | b.seen.

The filter has bits_per_row bits a row up to max_bytes, the stated bound of
what the driver gathers and broadcasts.  Beyond it the filter fills up and more
rows count as possibly repeated: work grows, the result stays the same.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trackloom.llm.memory import trimmed

CHUNK = 1 << 16
FAN_IN = 64


def filter_bytes(rows: int, bits_per_row: int, max_bytes: int) -> int:
    """A power of two of bytes, at least one chunk."""
    need = max(CHUNK, rows * bits_per_row // 8)
    return min(1 << (need - 1).bit_length(), max_bytes)


def positions(hashes: np.ndarray, bits: int, k: int) -> np.ndarray:
    """k bit positions of each hash, by double hashing; bits is a power of two."""
    h = hashes.astype(np.uint64)
    step = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(17) | np.uint64(1)
    at = h[:, None] + np.arange(k, dtype=np.uint64) * step[:, None]
    at ^= at >> np.uint64(31)
    return (at * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)) & np.uint64(bits - 1)


def _set(bitmap: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))


def _get(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1


def add(seen: np.ndarray, again: np.ndarray, hashes: np.ndarray, k: int) -> None:
    at, times = np.unique(positions(hashes, len(seen) * 8, k), return_counts=True)
    repeated = (times > 1) | (_get(seen, at) == 1)
    _set(again, at[repeated])
    _set(seen, at)


SCHEMA = "chunk int, part int, seen binary, again binary"
ARROW = pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("seen", pa.binary()), ("again", pa.binary())])


def _chunks(seen: np.ndarray, again: np.ndarray, part: int):
    for chunk in range(len(seen) // CHUNK):
        own = seen[chunk * CHUNK : (chunk + 1) * CHUNK]
        if own.any():
            yield {"chunk": chunk, "part": part, "seen": zlib.compress(own.tobytes(), 1), "again": zlib.compress(again[chunk * CHUNK : (chunk + 1) * CHUNK].tobytes(), 1)}


def _builder(size: int, k: int):
    def build(batches):
        from pyspark import TaskContext

        seen, again = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        for batch in batches:
            add(seen, again, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), k)
        for row in _chunks(seen, again, TaskContext.get().partitionId()):
            yield pa.RecordBatch.from_pylist([row], schema=ARROW)

    return build


def _merge(group: pa.Table) -> pa.Table:
    seen, again = np.zeros(CHUNK, np.uint8), np.zeros(CHUNK, np.uint8)
    for s, a in zip(group.column("seen"), group.column("again"), strict=True):
        own = np.frombuffer(zlib.decompress(s.as_py()), np.uint8)
        again |= np.frombuffer(zlib.decompress(a.as_py()), np.uint8) | (seen & own)
        seen |= own
    part = min(group.column("part").to_pylist()) // FAN_IN
    return pa.Table.from_pylist([{"chunk": group.column("chunk")[0].as_py(), "part": part, "seen": zlib.compress(seen.tobytes(), 1), "again": zlib.compress(again.tobytes(), 1)}], schema=ARROW)


def repeated_filter(hashes: DataFrame, rows: int, bits_per_row: int = 16, k: int = 4, max_bytes: int = 32 << 20) -> np.ndarray:
    """The filter "seen again" over the one long column of hashes; at most max_bytes reach the driver."""
    return _filter(hashes, rows, bits_per_row, k, max_bytes, "again")


def member_filter(hashes: DataFrame, rows: int, bits_per_row: int = 16, k: int = 4, max_bytes: int = 32 << 20) -> np.ndarray:
    """The filter "seen": which hashes may occur at all."""
    return _filter(hashes, rows, bits_per_row, k, max_bytes, "seen")


def _filter(hashes: DataFrame, rows: int, bits_per_row: int, k: int, max_bytes: int, which: str) -> np.ndarray:
    size = filter_bytes(rows, bits_per_row, max_bytes)
    parts = hashes.mapInArrow(trimmed(_builder(size, k)), SCHEMA)
    tasks = hashes.rdd.getNumPartitions()
    while True:  # a group holds at most FAN_IN parts, so none grows with the data
        parts = parts.groupBy("chunk", F.expr(f"part div {FAN_IN}")).applyInArrow(_merge, SCHEMA)
        if tasks <= FAN_IN:
            break
        tasks = -(-tasks // FAN_IN)
    found = np.zeros(size, np.uint8)
    for row in parts.select("chunk", F.col(which).alias("bits")).collect():
        found[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = np.frombuffer(zlib.decompress(bytes(row.bits)), np.uint8)
    return found


def tester(spark, again: np.ndarray, k: int = 4):
    """A pandas UDF over a long column: may this hash be repeated?"""
    shared = spark.sparkContext.broadcast(again.tobytes())
    size = len(again)

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        bitmap = np.frombuffer(shared.value, np.uint8, size)
        return pd.Series(_get(bitmap, positions(h.to_numpy().view(np.uint64), size * 8, k)).all(axis=1))

    return maybe
