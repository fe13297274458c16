"""Bit codec of messages: fields of given widths packed into bytes, most or least significant bit first.

Encoding and decoding are inverse for values that fit; values are clipped to their width, short buffers stop the
decoding at the first field that does not fit. Arrow batches, one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def encode(values: list, widths: list[int], msb: bool = True) -> bytes:
    """Values packed in order; null counts as 0."""
    bits, n = 0, 0
    for v, w in zip(values, widths):
        v = min(max(int(v or 0), 0), (1 << w) - 1)
        bits = (bits << w) | v if msb else bits | (v << n)
        n += w
    size = -(-n // 8)
    return (bits << (size * 8 - n)).to_bytes(size, "big") if msb else bits.to_bytes(size, "little")


def decode(data: bytes | None, widths: list[int], msb: bool = True) -> list:
    """Values in order; null from the first field the buffer is too short for."""
    out, at = [], 0
    data = data or b""
    total, bits = len(data) * 8, int.from_bytes(data, "big" if msb else "little")
    for w in widths:
        if at + w > total:
            return out + [None] * (len(widths) - len(out))
        out.append((bits >> (total - at - w)) & ((1 << w) - 1) if msb else (bits >> at) & ((1 << w) - 1))
        at += w
    return out


def encode_messages(df: DataFrame, key: str, fields: list[tuple[str, int]], msb: bool = True) -> DataFrame:
    """(key, buffer) of messages with one column per field."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widths = [w for _, w in fields]
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns[1:])) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encode(list(r), widths, msb) for r in rows], pa.binary())], names=[key, "buffer"])

    return df.select(key, *[n for n, _ in fields]).mapInArrow(run, f"{key} {kind}, buffer binary")


def decode_messages(df: DataFrame, key: str, fields: list[tuple[str, int]], msb: bool = True) -> DataFrame:
    """(key, one column per field) of (key, buffer)."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widths = [w for _, w in fields]
        for b in batches:
            rows = [decode(x, widths, msb) for x in b.column(1).to_pylist()]
            cols = list(zip(*rows)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols]], names=[key, *[n for n, _ in fields]])

    return df.select(key, "buffer").mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{n} bigint" for n, _ in fields))
