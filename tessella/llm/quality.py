"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector x: its distinct words, hashed to ``SLOTS`` slots and
weighted by 1 + log count over the vector's length; each structure statistic (shares
of letter classes, marks, digits, repeated words, line and word lengths) and each
metadata number, one slot for the bin it falls into. The score is

    sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum (v_if x_i)^2))

where the identity makes all pairwise interactions cost one pass over the slots.

*Fit.* On the driver in numpy, from a bounded sample: the ``sample`` labelled ids with
the least hashes (default 8000) are broadcast to the documents, and only the sample's
sparse vectors come back. *Score.* One pass over all whole texts; no shuffle.

Null texts count as empty and get a score like others. Ids whose labels contradict
each other, and labels other than 0 and 1, are not learned from. Without any usable
label every score is 0.5. Repeated rows are scored one by one. Only the named columns
are read; a named metadata column that is absent counts as null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of hashed words (a power of two), bins of a statistic, factors.
SLOTS, BINS, FACTORS = 1 << 16, 24, 8
CACHE_WORDS = 300_000
_CLASSES = (
    bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b"!", b"|", b"*%&#$@~^", b"_=<>{}[]\\/+`",
    b".,;:?", b"'\"()-", b" ", b"\n", b"\t\r", bytes(range(128, 256)),
)
N_STATS = len(_CLASSES) + 7
#: Column k counts the bytes of class k.
_OF_CLASS = np.array([[b in c for c in _CLASSES] for b in range(256)], np.int64)


class _Slots(dict):
    """Word -> slot."""

    def __missing__(self, w: bytes) -> int:
        s = self[w] = xxhash.xxh3_64_intdigest(w) & SLOTS - 1
        return s


_slots = _Slots()


def _bin(x: float) -> int:
    """Bins of a share, finer towards 0."""
    return min(BINS - 1, int(math.sqrt(max(x, 0.0)) * BINS))


def _log_bin(x: float) -> int:
    return min(BINS - 1, int(math.log2(1 + max(x, 0.0))))


def features(data: bytes, meta: list[float | None]) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a document."""
    words = data.split()
    if len(_slots) > CACHE_WORDS:
        _slots.clear()
    a = np.fromiter(map(_slots.__getitem__, words), np.int64, len(words))
    slots, counts = np.unique(a, return_counts=True)
    values = 1 + np.log(counts)
    values /= math.sqrt(float((values**2).sum()) or 1.0)
    n, m = len(data) or 1, len(words) or 1
    bins = [_bin(x / n) for x in (np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _OF_CLASS).tolist()]
    again = int((a[1:] == a[:-1]).sum()) / m if len(a) > 1 else 0.0
    bins += [_bin(again), _bin(len(slots) / m), _bin(float(counts.max()) / m if len(counts) else 0.0)]
    bins += [_log_bin(n * 4 / m), _log_bin(m), _log_bin(n * 2 / (data.count(b"\n") + 1)), _bin(len({data[i : i + 32] for i in range(0, len(data), 32)}) * 32 / (n + 32))]
    bins += [BINS - 1 if x is None or not math.isfinite(x) else min(BINS - 2, _log_bin(abs(x))) for x in meta]
    stats = SLOTS + np.arange(len(bins)) * BINS + np.array(bins)
    return np.concatenate([slots, stats]).astype(np.int32), np.concatenate([values, np.full(len(bins), 0.5)]).astype(np.float32)


class Machine:
    """A factorisation machine with logistic loss, fitted by AdaGrad on mini-batches."""

    def __init__(self, size: int, factors: int = FACTORS, seed: int = 7):
        self.rng = np.random.default_rng(seed)
        self.w0, self.w = 0.0, np.zeros(size, np.float32)
        self.v = self.rng.normal(0, 0.02, (size, factors)).astype(np.float32)

    def margins(self, slots: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid, and the sums of v x, of documents laid end to end (each has a slot at least)."""
        vx = self.v[slots] * values[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
        linear = np.add.reduceat(self.w[slots] * values, starts)
        return self.w0 + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = 750, batch: int = 128, rate: float = 0.3, decay: float = 1e-4) -> None:
        """As many steps for a small sample as for a large one; the sample is gone through in ever new orders."""
        share = float(np.clip(labels.mean(), 0.01, 0.99))
        self.w0 = math.log(share / (1 - share))
        g0, gw, gv = 1.0, np.full(self.w.shape, 1e-2, np.float32), np.full(self.v.shape, 1e-2, np.float32)
        order, at = self.rng.permutation(len(docs)), 0
        for _ in range(steps):
            if at >= len(order):
                order, at = self.rng.permutation(len(docs)), 0
            some, at = order[at : at + batch], at + batch
            lengths = np.array([len(docs[i][0]) for i in some])
            slots, values = (np.concatenate([docs[i][k] for i in some]) for k in (0, 1))
            starts = np.cumsum(lengths) - lengths
            y, sums = self.margins(slots, values, starts)
            err = (1 / (1 + np.exp(-y)) - labels[some]).astype(np.float32) / len(some)
            of = np.repeat(np.arange(len(some)), lengths)
            each = err[of] * values
            vx = self.v[slots] * values[:, None]
            dv = each[:, None] * (sums[of] - vx)
            sort = np.argsort(slots, kind="stable")
            used, first = np.unique(slots[sort], return_index=True)
            dw = np.add.reduceat(each[sort], first) + decay * self.w[used]
            dv = np.add.reduceat(dv[sort], first, axis=0) + decay * self.v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            self.w[used] -= rate * dw / np.sqrt(gw[used])
            self.v[used] -= rate * dv / np.sqrt(gv[used])
            d0 = float(err.sum())
            g0 += d0 * d0
            self.w0 -= rate * d0 / math.sqrt(g0)


def _feature_rows(batch: pa.RecordBatch, first: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of a batch with the text (binary) at ``first`` and metadata behind it."""
    meta = list(zip(*[batch.column(i).to_pylist() for i in range(first + 1, batch.num_columns)], strict=True)) or [()] * batch.num_rows
    for data, m in zip(batch.column(first).to_pylist(), meta, strict=True):
        yield features(data or b"", list(m))


def _sample_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(_feature_rows(batch, 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s, _ in rows], pa.binary()), pa.array([v.tobytes() for _, v in rows], pa.binary())], names=["label", "slots", "values"])


def _probabilities(machine: Machine, rows: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The scores of documents, a bounded number of slots at a time."""
    scores: list[np.ndarray] = []
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush():
        lengths = np.array([len(s) for s, _ in held])
        y, _ = machine.margins(np.concatenate([s for s, _ in held]), np.concatenate([v for _, v in held]), np.cumsum(lengths) - lengths)
        scores.append(1 / (1 + np.exp(-y.astype(np.float64))))

    for row in rows:
        held.append(row)
        size += len(row[0])
        if size > 100_000:
            flush()
            held, size = [], 0
    if held:
        flush()
    return np.concatenate(scores) if scores else np.zeros(0)


def _score_batches(model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_probabilities(model.value, _feature_rows(batch, 1)), pa.float64())], names=["own", "score"])


def _keep_batches(model, text: int, meta: list[int], threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = batch.column(text).cast(pa.binary()).to_pylist()
        numbers = [batch.column(i).to_pylist() if i >= 0 else [None] * len(data) for i in meta]
        rows = (features(d or b"", [None if col[k] is None else float(col[k]) for col in numbers]) for k, d in enumerate(data))
        yield batch.filter(pa.array(_probabilities(model.value, rows) >= threshold))


def _meta(docs: DataFrame, names: tuple[str, ...]) -> list[Column]:
    return [(F.col(f"`{c}`").cast("double") if c in docs.columns else F.lit(None).cast("double")).alias(f"meta_{i}") for i, c in enumerate(names)]


def learnable(id_col: str, held_mod: int = 5) -> Column:
    """Whether an id may be learned from: crc32 of the id as text is not divisible by ``held_mod``; a null id never is."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % held_mod != 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", meta_cols: tuple[str, ...] = ("n_chars",), sample: int = 8000, held_mod: int = 5) -> Machine | None:
    """A machine learned from at most ``sample`` labelled documents; None without any."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where(learnable("_id", held_mod) & F.col("_label").isin(0, 1))
    known = known.groupBy("_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_most")).where("_label = _most").drop("_most")
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    text = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("_text"), *_meta(docs, meta_cols))
    rows = text.join(F.broadcast(known), "_id").select("_label", "_text", *[f"meta_{i}" for i in range(len(meta_cols))])  # at most ``sample`` rows are broadcast
    rows = rows.mapInArrow(_sample_batches, "label int, slots binary, values binary").orderBy(F.xxhash64("slots", "values"), "label").limit(sample).collect()
    if not rows:
        return None
    machine = Machine(SLOTS + (N_STATS + len(meta_cols)) * BINS)
    machine.fit([(np.frombuffer(r.slots, np.int32), np.frombuffer(r.values, np.float32)) for r in rows], np.array([r.label for r in rows], np.float32))
    return machine


def score(docs: DataFrame, machine: Machine | None, text_col: str = "text", meta_cols: tuple[str, ...] = ("n_chars",), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``score`` of every row."""
    own = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("own")
    if machine is None:
        out = docs.select(own, F.lit(0.5).alias("score"))
    else:
        rows = docs.select(own, F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("_text"), *_meta(docs, meta_cols))
        model = docs.sparkSession.sparkContext.broadcast(machine)  # of fixed size: slots times factors
        out = rows.mapInArrow(partial(_score_batches, model), f"own {rows.schema['own'].dataType.simpleString()}, score double")
    return out.select("own.*", F.col("score").alias("_score")).withColumnRenamed("_score", "score")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, held_mod: int = 5, id_col: str = "doc_id", **fit_options) -> DataFrame:
    """``id_col``, ``held_out``, ``score`` and ``predicted`` of every row."""
    machine = fit(docs, labels, id_col=id_col, held_mod=held_mod, **fit_options)
    out = score(docs, machine, keep=(id_col,))
    return out.select(id_col, (F.crc32(F.col(id_col).cast("string").cast("binary")) % held_mod == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("n_chars",), **fit_options) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with their own columns; all rows if there is nothing to learn from."""
    machine = fit(docs, labels, id_col=id_col, text_col=text_col, meta_cols=meta_cols, **fit_options)
    if machine is None:
        return docs
    model = docs.sparkSession.sparkContext.broadcast(machine)  # of fixed size: slots times factors
    meta = [docs.columns.index(c) if c in docs.columns else -1 for c in meta_cols]
    return docs.mapInArrow(partial(_keep_batches, model, docs.columns.index(text_col), meta, threshold), docs.schema)
