"""Bloom filters and repeat filters over a column of 64-bit hashes, built on the executors.

Tasks send the bit positions they have seen, by chunk of the filter; one group a chunk turns them into bits. Only the
finished filter, whose size is a parameter, reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._words import U, mix64

CHUNK = 1 << 16  # bits
#: Bits of the largest filter: 32 MB. Past about a 16th as many values it passes more and more; results stay exact.
MOST_BITS = 1 << 28
BITS_A_ROW = 16


def bits_for(values: int, most: int = MOST_BITS) -> int:
    return min(most, max(CHUNK, 1 << int(BITS_A_ROW * max(1, values) - 1).bit_length()))


def positions(hashes: np.ndarray, bits: int, probes: int) -> np.ndarray:
    """A row of bit positions for each hash."""
    h = mix64(hashes.astype(np.int64, copy=False).view(U) + U(0x5851F42D4C957F2D))
    a, b = h & U(0xFFFFFFFF), (h >> U(32)) | U(1)
    return ((a[:, None] + b[:, None] * np.arange(probes, dtype=U)[None, :]) & U(bits - 1)).astype(np.int64)


def build(df: DataFrame, column: str, bits: int, probes: int = 3, repeated: bool = False) -> np.ndarray:
    """The filter as bytes. repeated: a bit is set only if two rows at least hit it, so what passes may be repeated."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
            if not len(values):
                continue
            at, n = np.unique(positions(values, bits, probes), return_counts=True)
            at = at * 2 + (n > 1)
            chunk = at // (2 * CHUNK)
            for part in np.split(at, np.flatnonzero(np.diff(chunk)) + 1):
                c = int(part[0]) // (2 * CHUNK)
                yield pa.record_batch({"chunk": pa.array([c], pa.int32()), "at": pa.array([(part - 2 * c * CHUNK).astype(np.uint32).tobytes()], pa.binary())})

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = np.frombuffer(at, dtype=np.uint32)
                held = counts.setdefault(c, np.zeros(CHUNK, dtype=np.uint8))
                held[at // 2] = np.minimum(2, held[at // 2] + 1 + at % 2)
        for c, held in counts.items():
            yield pa.record_batch({"chunk": pa.array([c], pa.int32()), "bits": pa.array([np.packbits(held >= 1 + repeated).tobytes()], pa.binary())})

    parts = df.select(column).mapInArrow(seen, "chunk int, at binary").repartition("chunk").mapInArrow(joined, "chunk int, bits binary")
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in parts.toLocalIterator():
        out[row["chunk"] * (CHUNK // 8) : (row["chunk"] + 1) * (CHUNK // 8)] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def passes(bloom: np.ndarray, hashes: np.ndarray, probes: int = 3) -> np.ndarray:
    at = positions(hashes, len(bloom) * 8, probes)
    return ((bloom[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)
