"""Approximate nearest neighbours by an inverted multi-index.

Each half of a vector is quantised by its own ``cells`` centroids; a pair of centroids
is a cell, and every row is an entry of one. A query walks the pairs in the order of
their summed squared distances, with a heap over the grid of both sorted lists, until
the cells it passed hold ``share`` of all entries (and 10 k at least). All entries of
those cells are reranked by exact Euclidean distance in double precision.

*Share.* Unless given, it is measured: ``PROBES`` rows of the fit's sample walk the cells of
that sample, and the share is the least with which they find ``RECALL`` of their k nearest rows in it. A
sample's neighbours lie further off than the whole table's, so this errs upwards.

*Fit.* k-means in numpy on the ``sample`` rows with the least hashes (default 8192; at
most that many vectors come to the driver). *Index.* Every row. The centroids and the
entries a cell are of fixed size (2 x cells centroids, cells^2 counts) and are
broadcast. *Route.* Entries lie in blocks of one first centroid; a query goes to a
first centroid once, with a bit for each second centroid, so a hot cell is just more
blocks. Blocks meet query blocks by a join that Spark may split, and each task keeps
the k best a query.

Data without clusters (random directions) need about half of the entries, since their
neighbours lie in far cells too; clustered data need far fewer, and get fewer.

Vectors of another length than ``dim`` (by default the table's most frequent one), null
vectors, null or non-finite components, zero vectors and null ids take no part. Every row
is a candidate, repeated ones too, but for those with the query's id; equal query rows are
one query. Ties go to the smaller id. Only the named columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.vectors import best, dimension, matrix, unpack, usable
from tessella.runtime import materialize

#: Centroids of a half (at most 64: a query's second centroids are the bits of a long).
CELLS = 64
ENTRIES, QUERIES = 1024, 512
#: Rows of the sample that measure the share, and the recall that they have to reach.
PROBES, RECALL = 256, 0.95


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)


def k_means(x: np.ndarray, k: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """Centroids of the rows of ``x``; no more than there are distinct rows."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        counts = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return c


def walk(one: np.ndarray, two: np.ndarray, counts: np.ndarray, want: int) -> list[tuple[int, int]]:
    """Cells by ascending one[i] + two[j] until they hold ``want`` entries; ``counts`` is a grid."""
    a, b = np.argsort(one, kind="stable").tolist(), np.argsort(two, kind="stable").tolist()
    x, y = one.tolist(), two.tolist()
    heap, seen, got, out = [(x[a[0]] + y[b[0]], 0, 0)], {(0, 0)}, 0, []
    while heap and got < want:
        _, i, j = heapq.heappop(heap)
        n = counts[a[i]][b[j]]
        if n:
            got += n
            out.append((a[i], b[j]))
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (x[a[p]] + y[b[q]], p, q))
    return out


def measured_share(x: np.ndarray, codes: tuple[np.ndarray, np.ndarray], k: int) -> float:
    """The least share of the entries to pass, in walking order, for RECALL of the k nearest rows of a sample; 1 for a sample of few rows."""
    if len(x) < 50 * k:
        return 1.0
    half = x.shape[1] // 2
    i, j = nearest(x[:, :half], codes[0]), nearest(x[:, half:], codes[1])
    needed = []
    for q in range(0, len(x), -(-len(x) // PROBES)):
        far = ((x - x[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        best_ = np.argpartition(far, k)[:k]
        cell = ((codes[0] - x[q, :half]) ** 2).sum(axis=1)[i] + ((codes[1] - x[q, half:]) ** 2).sum(axis=1)[j]
        needed.append((cell[None, :] <= cell[best_][:, None]).mean(axis=1))
    return float(np.quantile(np.concatenate(needed), RECALL))


def _entry_batches(dim: int, codes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one, two = codes.value
    half = dim // 2
    for batch in batches:
        v = matrix(batch.column(1), dim)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(nearest(v[:, :half], one), pa.int32()), pa.array(nearest(v[:, half:], two), pa.int32()), pa.array([r.tobytes() for r in v], pa.binary())],
            names=["id", "i", "j", "data"],
        )


def _route_batches(dim: int, codes, counts, want: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    (one, two), grid, half = codes.value, counts.value, dim // 2
    for batch in batches:
        rows: list[tuple] = []
        for qid, id_, data in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            v = np.frombuffer(data, np.float64)
            masks: dict[int, int] = {}
            for i, j in walk(((one - v[:half]) ** 2).sum(axis=1), ((two - v[half:]) ** 2).sum(axis=1), grid, want):
                masks[i] = masks.get(i, 0) | 1 << j
            rows += [(i, qid, id_, m - (1 << 64) if m >> 63 else m, data) for i, m in masks.items()]
        cols = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["i", "qid", "id", "mask", "data"])


def _rerank_batches(k: int, dim: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows: entries (ids, js, vectors) and queries (qids, ids, masks, vectors) of one first centroid."""
    for batch in batches:
        rows, ids, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for n in range(batch.num_rows):
            entry, asked = batch.column(0)[n].as_py(), batch.column(1)[n].as_py()
            j, v, vid = (np.array([e[c] for e in entry]) if c == "j" else unpack(b"".join(e["data"] for e in entry), "<f8", dim) if c == "data" else np.array([e["id"] for e in entry], np.int64) for c in ("j", "data", "id"))
            q, qid, own = unpack(b"".join(e["data"] for e in asked), "<f8", dim), np.array([e["qid"] for e in asked], np.int64), np.array([e["id"] for e in asked], np.int64)
            masks = np.array([e["mask"] for e in asked], np.int64).view(np.uint64)
            rough = (q * q).sum(axis=1)[:, None] + (v * v).sum(axis=1)[None, :] - 2 * q @ v.T
            inside = (masks[:, None] >> j[None, :].astype(np.uint64) & np.uint64(1)).astype(bool) & (own[:, None] != vid[None, :])
            rough[~inside] = np.inf
            scale = 1e-9 * ((q * q).sum(axis=1) + (v * v).sum(axis=1).max())
            least = np.partition(rough, k - 1, axis=1)[:, k - 1] + scale if rough.shape[1] > k else np.full(len(q), np.inf)
            r, c = np.nonzero(inside & (rough <= least[:, None]))
            exact = np.sqrt(((q[r] - v[c]) ** 2).sum(axis=1))
            r, i, s = best(qid[r], vid[c], exact, k)
            rows.append(r)
            ids.append(i)
            scores.append(s)
        r, i, s = best(np.concatenate(rows), np.concatenate(ids), np.concatenate(scores), k)
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], names=["qid", "id", "score"])


def nearest_rows(vectors: DataFrame, k: int = 10, query_mod: int = 100, share: float | None = None, sample: int = 8192, cells: int = CELLS, id_col: str = "vec_id", vec_col: str = "embedding", dim: int | None = None) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the k nearest candidates found for each query (ids divisible by ``query_mod``)."""
    if not 1 <= cells <= 64:
        raise ValueError("1 to 64 centroids a half")
    spark, dim = vectors.sparkSession, dimension(vectors, vec_col) if dim is None else dim
    rows = usable(vectors, id_col, vec_col, dim).where(F.exists("v", lambda x: x != 0))
    rows = materialize(rows, "vectors")
    some = rows.orderBy(F.xxhash64("id", "v")).limit(sample).collect()
    half = dim // 2
    x = np.array([r.v for r in some], np.float64).reshape(len(some), dim)
    made = tuple(k_means(x[:, a:b], cells) if len(x) else np.zeros((1, b - a)) for a, b in ((0, half), (half, dim)))
    share = measured_share(x, made, k) if share is None else share
    codes = spark.sparkContext.broadcast(made)
    entries = materialize(rows.mapInArrow(partial(_entry_batches, dim, codes), "id long, i int, j int, data binary").withColumn("uid", F.monotonically_increasing_id()), "entries")

    grid = np.zeros((64, 64), np.int64)
    for r in entries.groupBy("i", "j").count().collect():  # at most cells^2 rows
        grid[r.i, r.j] = r["count"]
    total = int(grid.sum())
    counts = spark.sparkContext.broadcast(grid.tolist())
    want = max(10 * k, int(np.ceil(share * total)))

    # Blocks of one first centroid: as many as its entries fill.
    width = {i: max(1, -(-int(n) // ENTRIES)) for i, n in enumerate(grid.sum(axis=1))}
    of = F.element_at(F.array(*[F.lit(width[i]) for i in range(64)]), F.col("i") + 1)
    blocks = entries.withColumn("block", F.pmod(F.xxhash64("uid"), of)).groupBy("i", "block").agg(F.collect_list(F.struct("id", "j", "data")).alias("entries"))
    asked = entries.where(F.col("id") % query_mod == 0).groupBy("id", "data").agg(F.min("uid").alias("qid")).select("qid", "id", "data")
    n_asked = asked.count()
    routed = asked.repartition(max(1, -(-n_asked // 64))).mapInArrow(partial(_route_batches, dim, codes, counts, want), "i int, qid long, id long, mask long, data binary")
    per = max(1, -(-n_asked // QUERIES))
    queries = routed.withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(per))).groupBy("i", "part").agg(F.collect_list(F.struct("qid", "id", "mask", "data")).alias("queries"))
    met = blocks.join(queries, "i").select("entries", "queries")
    lists = met.mapInArrow(partial(_rerank_batches, k, dim), "qid long, id long, score double")
    place = Window.partitionBy("qid").orderBy("score", "id")
    top = lists.withColumn("rank", F.row_number().over(place).cast("int")).where(F.col("rank") <= k)
    names = asked.select("qid", F.col("id").alias("query_id"))
    return top.join(names, "qid").select("query_id", "rank", F.col("id").alias(id_col), "score")
