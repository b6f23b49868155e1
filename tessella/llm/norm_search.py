"""Exact top-k by inner product with norm buckets.

Vectors (components scaled and floored to integers) are sorted by length, longest
first, and cut into buckets. For a query with k-th best score s so far, a bucket
whose longest vector has length l needs a cosine of at least s / (|q| l):

* above 1 the bucket, and with it every later one of its run, is skipped;
* a high local threshold prunes by coordinates: a vector of that cosine must lie, in
  each of the query's largest coordinates, in an interval around the query's own;
* a low one prunes by length: only the prefix of vectors with |v| >= s / |q| counts.

What is left is verified by its integer products. Scores are exact: products run in
floating point only where |q| |v| stays below the type's exact integers, else in
Python integers (a score beyond 64 bits is cut to their range).

Queries are dealt in blocks and slices of blocks, buckets in runs; a group of a task has one slice and
one run, each shipped once, so its memory is fixed. All slices first meet the run of the
longest vectors. What they find there decides on lengths alone which other runs a block
has to meet, before anything is shipped, and is where their pruning starts. The k best
of each query are then found from the runs' lists.

Vectors of another length than ``dim`` (by default the table's most frequent one), null
vectors, null or non-finite components and null ids take no part. Every row is a
candidate, repeated ones too, but for those with the query's id; equal query rows are one
query. Ties go to the smaller id. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.vectors import best, blocks, dimension, matrix, unpack, usable
from tessella.runtime import materialize

BUCKET, RUN, QUERIES, SLICE = 1024, 16, 512, 32
#: Local cosine thresholds from which coordinates prune, and how many coordinates are looked at.
COORDINATES_FROM, FOCUS = 0.8, 4
_BLOCK = "dim int, n int, longest double, ids binary, norms binary, data binary"


def integers(v: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * v), cut to 64-bit integers."""
    x = np.floor(v * scale)
    return np.where(x >= 2.0**63, np.int64(2**63 - 1), np.clip(x, -(2.0**63), 2.0**62).astype(np.int64)) if x.size and np.abs(x).max() >= 2.0**62 else x.astype(np.int64)


def _block_batches(dim: int, scale: float, rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for held in blocks(batches, rows):
        ids = np.concatenate([b.column(0).to_numpy() for b in held])
        v = integers(np.concatenate([matrix(b.column(1), dim) for b in held]), scale)
        norms = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
        order = np.lexsort((ids, -norms))
        ids, v, norms = ids[order], v[order], norms[order]
        cols = [[dim], [len(ids)], [float(norms[0])], [ids.tobytes()], [norms.tobytes()], [v.tobytes()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["dim", "n", "longest", "ids", "norms", "data"])


class Bucket:
    """Vectors, longest first."""

    def __init__(self, ids: bytes, norms: bytes, data: bytes, dim: int):
        self.ids, self.norms, self.v = np.frombuffer(ids, np.int64), np.frombuffer(norms, np.float64), unpack(data, "<i8", dim)
        self._unit = None
        self._as: dict = {}

    def as_type(self, kind) -> np.ndarray:
        if kind not in self._as:
            self._as[kind] = self.v.astype(kind)
        return self._as[kind]

    def unit(self) -> np.ndarray:
        if self._unit is None:
            self._unit = self.v / np.maximum(self.norms, 1e-300)[:, None]
        return self._unit


def products(q: np.ndarray, v: Bucket, which, bound: float) -> np.ndarray:
    """Integer products of query rows with the chosen vectors, as float64 where that is exact, else Python integers."""
    if bound < 2**24:
        return (q.astype(np.float32) @ v.as_type(np.float32)[which].T).astype(np.float64)
    if bound < 2**53:
        return q.astype(np.float64) @ v.as_type(np.float64)[which].T
    out = q.astype(object) @ v.as_type(object)[which].T
    return np.vectorize(lambda x: max(-(2**63), min(2**63 - 1, x)), otypes=[object])(out) if out.size else out


class Searcher:
    """The k best of a block of queries so far."""

    def __init__(self, ids: np.ndarray, norms: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.norms, self.q, self.k = ids, norms, q, k
        self.floor = floor  # scores that are certain to be reached k times
        self.rows, self.found, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object)
        self.skipped = self.by_length = self.by_coordinate = 0

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        rows, ids, negative = best(np.r_[self.rows, rows], np.r_[self.found, ids], -np.r_[self.scores, scores].astype(object if scores.dtype == object or self.scores.dtype == object and len(self.scores) else np.float64), self.k)
        self.rows, self.found, self.scores = rows, ids, -negative
        counts = np.bincount(rows, minlength=len(self.ids))
        last = np.cumsum(counts) - 1
        full = counts == self.k
        if full.any():
            at = self.scores[last[full]].astype(np.float64)
            self.floor[full] = np.maximum(self.floor[full], at)

    def visit(self, b: Bucket) -> None:
        longest = float(b.norms[0])
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = self.norms * longest
            local = np.where(reach > 0, self.floor / reach, np.where(self.floor > 0, np.inf, -np.inf))
        slack = 1e-9
        active = local <= 1 + slack
        self.skipped += int((~active).sum())
        high = active & (local >= COORDINATES_FROM)
        low = np.flatnonzero(active & ~high)
        for i in np.flatnonzero(high):
            self._by_coordinate(int(i), float(local[i]), b)
        if low.size:
            self._by_length(low, b)

    def _keep(self, rows: np.ndarray, which: np.ndarray, s: np.ndarray, b: Bucket) -> None:
        ids = b.ids[which]
        own = ids[None, :] == self.ids[rows][:, None]
        if s.dtype == object:
            take = ~own & (s.astype(np.float64) >= self.floor[rows][:, None] * (1 - 1e-9) - 1)
        else:
            s[own] = -np.inf
            least = self.floor[rows]
            if s.shape[1] > self.k:
                least = np.maximum(least, np.partition(s, -self.k, axis=1)[:, -self.k])
            take = (s >= least[:, None]) & ~own
        r, c = np.nonzero(take)
        self.add(rows[r], ids[c], s[r, c])

    def _by_length(self, rows: np.ndarray, b: Bucket) -> None:
        self.by_length += len(rows)
        norms = self.norms[rows]
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(norms > 0, self.floor[rows] / norms, -np.inf)
        n = int(np.searchsorted(-b.norms, -(need.min() * (1 - 1e-9) if need.min() > 0 else -1.0), side="right"))
        if n:
            which = np.arange(n)
            self._keep(rows, which, products(self.q[rows], b, slice(0, n), float(norms.max() * b.norms[0])), b)

    def _by_coordinate(self, i: int, t: float, b: Bucket) -> None:
        self.by_coordinate += 1
        q = self.q[i] / self.norms[i]
        t = min(t, 1.0)
        inside = np.ones(len(b.ids), bool)
        for f in np.argsort(-np.abs(q))[:FOCUS]:
            wide = np.sqrt(max(0.0, (1 - t * t) * (1 - q[f] * q[f])))
            low = -1.0 if q[f] < -t else q[f] * t - wide
            high = 1.0 if q[f] > t else q[f] * t + wide
            x = b.unit()[:, f]
            inside &= (x >= low - 1e-9) & (x <= high + 1e-9)
        which = np.flatnonzero(inside)
        if which.size:
            self._keep(np.array([i]), which, products(self.q[i : i + 1], b, which, float(self.norms[i] * b.norms[0])), b)


FOUND = "qid long, rows array<long>, found array<long>, scores array<long>, floor binary, need double"


def _search(k: int, runs: pa.Table, asked: pa.Table) -> pa.Table:
    """A run (structs of buckets) and a slice's query blocks -> what each block finds, its floors, and the length from which vectors can matter to it."""
    out: list[dict] = []
    rows = asked.to_pylist()
    found = [b for r in runs.to_pylist() for b in r["buckets"]]
    buckets = [Bucket(b["ids"], b["norms"], b["data"], rows[0]["dim"]) for b in sorted(found, key=lambda b: -b["longest"])] if rows else []
    for row in rows:
        ids = np.frombuffer(row["q_ids"], np.int64)
        floor = np.frombuffer(row["floor"], np.float64).copy() if row["floor"] else np.full(len(ids), -np.inf)
        s = Searcher(ids, np.frombuffer(row["q_norms"], np.float64), unpack(row["q_data"], "<i8", row["dim"]), k, floor)
        for b in buckets:
            s.visit(b)
        with np.errstate(divide="ignore", invalid="ignore"):
            need = float(np.where(s.norms > 0, s.floor / s.norms, -np.inf).min())
        out.append({"qid": row["qid"], "rows": s.rows.astype(np.int64).tolist(), "found": s.found.astype(np.int64).tolist(), "scores": [int(x) for x in s.scores], "floor": s.floor.tobytes(), "need": need})
    types = (pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary(), pa.float64())
    names = ("qid", "rows", "found", "scores", "floor", "need")
    return pa.table([pa.array([r[n] for r in out], t) for n, t in zip(names, types, strict=True)], names=list(names))


def _meet(queries: DataFrame, groups: DataFrame, slices: int, k: int) -> DataFrame:
    """Query blocks (with the ``run`` to meet and their ``floor``) against runs: a group a run and slice."""
    asked = queries.withColumn("slice", F.pmod(F.xxhash64("qid"), F.lit(slices)))
    wanted = asked.select(F.col("run").alias("of_run"), F.col("slice").alias("of_slice")).distinct()
    there = groups.join(wanted, F.col("run") == F.col("of_run")).select("of_run", "of_slice", "buckets")
    return there.groupBy("of_run", "of_slice").cogroup(asked.groupBy("run", "slice")).applyInArrow(lambda a, b: _search(k, a, b), FOUND)


def top_products(vectors: DataFrame, k: int = 20, query_mod: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding", dim: int | None = None) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the k best candidates of each query (ids divisible by ``query_mod``)."""
    dim = dimension(vectors, vec_col) if dim is None else dim
    rows = usable(vectors, id_col, vec_col, dim).withColumn("norm", F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x * scale), F.lit(2.0))))
    rows = materialize(rows, "vectors")
    parts = max(1, -(-rows.count() // (BUCKET * RUN)))
    long = rows.repartitionByRange(parts, F.desc("norm"), F.col("id")).sortWithinPartitions(F.desc("norm"), "id").select("id", "v")
    buckets = long.mapInArrow(partial(_block_batches, dim, scale, BUCKET), _BLOCK)
    buckets = materialize(buckets.withColumn("bid", F.monotonically_increasing_id()), "buckets")
    # Buckets rank by length; a run is RUN of them. A row a bucket: a thousandth of the vectors.
    order = Window.orderBy(F.desc("longest"), "bid")
    runs = materialize(buckets.select("bid", "longest").withColumn("run", F.floor((F.row_number().over(order) - 1) / RUN)), "runs")
    groups = buckets.drop("longest").join(runs, "bid").groupBy("run").agg(F.collect_list(F.struct("longest", "ids", "norms", "data")).alias("buckets"))
    groups = materialize(groups, "groups")

    asked = rows.where(F.col("id") % query_mod == 0).select("id", "v").dropDuplicates(["id", "v"])
    blocks_ = max(1, -(-asked.count() // QUERIES))
    slices = -(-blocks_ // SLICE)
    queries = asked.repartition(blocks_).mapInArrow(partial(_block_batches, dim, scale, QUERIES), _BLOCK)
    queries = materialize(queries.select(F.monotonically_increasing_id().alias("qid"), "dim", F.col("ids").alias("q_ids"), F.col("norms").alias("q_norms"), F.col("data").alias("q_data")), "queries")

    first = queries.withColumns({"run": F.lit(0).cast("long"), "floor": F.lit(None).cast("binary")})
    first = materialize(_meet(first, groups, slices, k), "first")
    # The longest length of each run, in order: eight bytes for sixteen thousand vectors.
    longest = [r.longest for r in runs.groupBy("run").agg(F.max("longest").alias("longest")).orderBy("run").collect()]
    lists = first.select("qid", "rows", "found", "scores")
    if len(longest) > 1:
        reach = queries.sparkSession.createDataFrame([(longest[1:],)], "longest array<double>")
        wanted = F.explode(F.slice(F.sequence(F.lit(1).cast("long"), F.lit(len(longest) - 1).cast("long")), F.lit(1), F.size(F.filter("longest", lambda x: x * (1 + 1e-9) >= F.col("need")))))
        others = queries.join(first.select("qid", "floor", "need"), "qid").crossJoin(F.broadcast(reach))  # one row
        others = others.withColumn("run", wanted).drop("longest", "need")
        lists = lists.unionByName(_meet(others, groups, slices, k).select("qid", "rows", "found", "scores"))
    each = lists.select("qid", F.explode(F.arrays_zip("rows", "found", "scores")).alias("x")).select("qid", "x.rows", "x.found", "x.scores")
    place = Window.partitionBy("qid", "rows").orderBy(F.desc("scores"), "found")
    top = each.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    names = queries.select("qid", "q_ids").mapInArrow(_name_batches, "qid long, rows long, query_id long")
    return top.join(names, ["qid", "rows"]).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("found").alias(id_col), F.col("scores").alias("score"))


def _name_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for qid, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = np.frombuffer(data, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), qid)), pa.array(np.arange(len(ids))), pa.array(ids)], names=["qid", "rows", "query_id"])


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) = 64),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 20 = 0) q JOIN v c ON q.vec_id != c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
