"""What the vector searches share: usable rows, blocks of vectors, and exact lists of the best."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dimension(vectors: DataFrame, vec_col: str) -> int:
    """The most frequent length of a vector (the larger one of equals); 0 without any."""
    size = vectors.select(F.size(F.col(vec_col)).alias("d")).where("d > 0").groupBy("d").count()
    row = size.orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return row[0].d if row else 0


def usable(vectors: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """``id`` (long) and ``v`` (array<double>) of rows with an id and ``dim`` finite components."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("id").isNotNull() & (F.size("v") == dim) & ~odd)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A batch's vectors as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def unpack(data: bytes, kind: str, dim: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(-1, dim)


def best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k entries of each row with the least (score, id), sorted by row, score, id."""
    order = np.lexsort((ids, scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    first = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
    keep = place < k
    return rows[keep], ids[keep], scores[keep]


def blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[pa.RecordBatch]]:
    """The batches of a partition, cut so that each list holds at most ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(rows - size, batch.num_rows - at)
            held.append(batch.slice(at, n))
            at, size = at + n, size + n
            if size == rows:
                yield held
                held, size = [], 0
    if held:
        yield held
