"""A Bloom filter of fixed size at most, built in parts of a fixed number of bits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bits of a part, and parts at most: 16 MB in all. A fuller filter lets more through.
PART_BITS, MOST_PARTS = 20, 128
PROBES, BITS_A_ROW = 4, 16


def places(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """PROBES places of each 64-bit hash among a power of two of bits."""
    h = h.astype(np.int64, copy=False).view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield ((h + np.uint64(i) * step) & np.uint64(bits - 1)).astype(np.int64)


class Filter:
    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for at in places(h, len(self.words) * 8):
            out &= (self.words[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def _part_batches(bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash) -> (part, its bits) of each part that a task has touched."""
    held = np.zeros(bits >> 3, np.uint8)
    for batch in batches:
        for at in places(batch.column(0).to_numpy(), bits):
            np.bitwise_or.at(held, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    parts = held.reshape(-1, min(bits, 1 << PART_BITS) >> 3)
    some = np.flatnonzero(parts.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([parts[k].tobytes() for k in some], pa.binary())], names=["part", "bits"])


def _join_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in any order -> one row a part of the partition."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            b = np.frombuffer(b, np.uint8)
            held[k] = held[k] | b if k in held else b
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["part", "bits"])


def build(hashes: DataFrame) -> Filter:
    """A filter of the one column of ``hashes`` (long, not null): 16 bits a row, 128 parts of 2^20 bits at most."""
    rows = hashes.count()
    bits = 1 << min(PART_BITS + MOST_PARTS.bit_length() - 1, max(10, (rows * BITS_A_ROW - 1).bit_length()))
    found = hashes.mapInArrow(partial(_part_batches, bits), "part int, bits binary").repartition("part").mapInArrow(_join_batches, "part int, bits binary")
    size = min(bits, 1 << PART_BITS) >> 3
    words = np.zeros(bits >> 3, np.uint8)
    for r in found.collect():  # at most MOST_PARTS rows of fixed size
        words[r.part * size : (r.part + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return Filter(words)
