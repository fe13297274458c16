"""Bloom filter over 64-bit hashes: made in slices on the executors, sent to all, bounded in size. It only saves rows; an
exact join decides what it lets through."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bits, at least and at most (16 MB); beyond it more passes by chance.
LEAST, MOST = 1 << 13, 1 << 27


def places(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash."""
    h = h.view(np.uint64)
    return (h & np.uint64(size - 1)).astype(np.int64), ((h >> np.uint64(31)) & np.uint64(size - 1)).astype(np.int64)


def build(hashes: DataFrame) -> np.ndarray:
    """The bits, packed, of the filter over the single bigint column of ``hashes`` (without nulls; read twice)."""
    size, count = LEAST, hashes.count()
    while size < MOST and size < 16 * count:
        size *= 2

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, dtype=bool)
        for b in batches:
            for at in places(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), size):
                bits[at] = True
        slices = bits.reshape(-1, LEAST)
        hit = np.flatnonzero(slices.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array([np.packbits(slices[i]).tobytes() for i in hit], pa.binary())], names=["slice", "bits"])

    def total(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = np.zeros(LEAST // 8, dtype=np.uint8)
        for b in batches:
            for v in b.column("bits"):
                some |= np.frombuffer(v.as_py(), dtype=np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([some.tobytes()], pa.binary())], names=["slice", "bits"])

    schema = "slice int, bits binary"
    out = np.zeros((size // LEAST, LEAST // 8), dtype=np.uint8)
    for r in hashes.mapInArrow(local, schema).groupBy("slice").applyInArrow(total, schema).collect():
        out[r["slice"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out.reshape(-1)


def maybe(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the filter."""
    a, b = places(h, 8 * len(bits))
    hit = lambda at: (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
    return (hit(a) & hit(b)).astype(bool)


def one(bits: bytes, h: int) -> bool:
    """Whether a single hash may be in the filter, given as bytes."""
    mask = 8 * len(bits) - 1
    a, b = h & mask, (h >> 31) & mask
    return bool(bits[a >> 3] >> (7 - (a & 7)) & 1 and bits[b >> 3] >> (7 - (b & 7)) & 1)
