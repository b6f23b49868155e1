"""Language-model scores of whole texts, with an add-one unigram base beside them.

*Corpus statistics.* Words (runs of other than ASCII white space, A-Z lower-cased) of
all training documents are counted: in each task first, then by one shuffle of
distinct words. The subword ids that all training texts are read as are counted likewise.
Both grow with the input; what the driver holds of them does not: totals, at
most ``HEAD`` frequent words of at most ``LONG`` bytes, and one number a vocabulary id.

*Model.* The causal self-attention model of ``attention``. Its output classes come from
the neighbours of every id in all training documents, and its shares of classes from all their counts.
Its weights are trained on all windows of all training documents: it starts on the driver, on
at most ``windows`` of them (the least by hash), for ``PASSES`` passes; then every window
(one in ``train_every`` by hash, if a caller asks for fewer) is dealt
to a shard of about ``SHARD`` ids and passed once: each shard trains from that start, and
the weights are averaged, those of the embeddings by how often a shard has the id.

*Scores.* Texts are read once: subword ids, and the base for frequent words; the ids
then give the model's log10 probability. Other words leave as 64-bit hashes in
packed rows a document and bucket, meet the counts of their bucket in the task that
holds it (buckets of about ``BUCKET`` words), and come back as a sum a document.

The model gives a probability to the sequence of subword ids that the vocabulary
makes of a text's words, and to the end id.

Null texts count as empty: their one token is the end. Ids that are null are scored
and not learned from (their remainder is null). Repeated rows are counted and scored one by one. Without training
documents every count is 0 and the model is the untrained one. Only the named columns
are read.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import attention
from tessella.llm.blas import one_thread
from tessella.llm.parity_join import _ODD, mix
from tessella.llm.tokens import MARKS, Vocabulary
from tessella.runtime import materialize

HEAD, LONG, BUCKET, FLUSH, OTHERS, PASSING = 200_000, 256, 1_000_000, 300_000, 500_000, 65_536
#: Ids of a shard, windows that a shard holds at once, parts in which tables by id are summed, and passes over the starting windows.
SHARD, HELD, PARTS, PASSES = 2_000_000, 250_000, 64, 4
_MARKS = MARKS.encode()
_readers: dict[int, "Reader"] = {}


def words(data: bytes | None) -> list[bytes]:
    return (data or b"").lower().split()  # of bytes: ASCII letters and white space only


def remainder(id_col: str, mod: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from collections import Counter

    held: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for data in batch.column(0).to_pylist():
            held.update(words(data))
            if len(held) > FLUSH:
                # Frequent words stay, so that each task sends them once.
                most = sorted(held.values(), reverse=True)[len(held) // 4]
                kept = Counter({w: n for w, n in held.items() if n > max(most, 1)})
                for w in kept:
                    del held[w]
                yield out()
                held = kept
    yield out()


def _id_batches(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _readers.clear()  # the reading is over: a reader's words are the most that a worker holds
    total = np.zeros(size, np.int64)
    for batch in batches:
        total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4"), minlength=size)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])


def _hasher() -> Callable[[bytes], int]:
    import xxhash

    return xxhash.xxh3_64_intdigest


class _Places(dict):
    """Word -> its place."""

    def __init__(self, place):
        self.place = place

    def __missing__(self, w: bytes) -> int:
        return self.place(w)


class Reader:
    """Per distinct word: its place in arrays of log10(count + 1) or nan, its hash, and its ids.

    Places below ``most`` are kept for good, in the order words came; later words get a
    place for one text only.
    """

    def __init__(self, vocabulary: Vocabulary, head: dict[bytes, int]):
        self.encoder, self.head = vocabulary.encoder(), head
        self.most = len(head) + OTHERS
        self.log = np.full(self.most + PASSING, np.nan)
        self.hash = np.zeros(self.most + PASSING, np.uint64)
        self.places = _Places(self.place)
        self.ids: list[bytes] = []
        self.merged, self.tail = self.encoder.merged, self.encoder.units.end
        self.hashed = _hasher()

    def place(self, w: bytes) -> int:
        k, n = len(self.ids), self.head.get(w)
        if n is None:
            self.hash[k] = self.hashed(w)
            self.log[k] = np.nan
        else:
            self.log[k] = math.log10(n + 1)
        self.ids.append(self.subwords(w))
        if k < self.most:
            self.places[w] = k
        return k

    def subwords(self, w: bytes) -> bytes:
        """The ids of a word. Letters of ASCII, which ``words`` made small, are one pre-token, and marks behind them others."""
        if w.isalpha():
            return self.merged(w.decode())
        core = w.rstrip(_MARKS)
        if core.isalpha():
            at = self.places.get(core)
            return (self.merged(core.decode()) if at is None else self.ids[at]) + self.tail(w[len(core) :].decode())
        text = w.decode("utf-8", "replace")
        return self.encoder.whole(text) if "<|" in text else self.encoder.units.once(text)

    def read(self, data: bytes | None) -> tuple[int, float, int, np.ndarray, bytes]:
        """Words; sum of log10(count + 1) and number of frequent ones; hashes of the others; ids."""
        seq = words(data)
        if len(seq) > PASSING:
            parts = [self.read(b" ".join(seq[i : i + PASSING])) for i in range(0, len(seq), PASSING)]
            return sum(p[0] for p in parts), sum(p[1] for p in parts), sum(p[2] for p in parts), np.concatenate([p[3] for p in parts]), b"".join(p[4] for p in parts)
        at, ids = list(map(self.places.__getitem__, seq)), self.ids
        a = np.array(at, np.int64)
        log = self.log[a]
        other = np.isnan(log)
        out = len(seq), float(log[~other].sum()), int((~other).sum()), self.hash[a[other]], b"".join(map(ids.__getitem__, at))
        del ids[self.most :]
        return out


def _read_batches(vocabulary: Vocabulary, shared, end: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    head = shared.value
    key = id(head)
    if key not in _readers:
        _readers.clear()
        _readers[key] = Reader(vocabulary, head)
    read, tail = _readers[key].read, array("I", [end]).tobytes()

    def out():
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays(own), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.binary())],
            names=["own", "n_tokens", "known", "log", "others", "ids"],
        )

    for batch in batches:
        own: list[pa.Array] = []
        cols: tuple[list, ...] = ([], [], [], [], [])
        size = first = 0
        for i, data in enumerate(batch.column(1).to_pylist()):
            n, total, known, others, ids = read(data)
            for c, x in zip(cols, (n + 1, known, total, others.tobytes(), ids + tail), strict=True):
                c.append(x)
            size += len(ids)
            if size > 1 << 24:
                own = [batch.column(0).slice(first, i + 1 - first)]
                yield out()
                cols, size, first = ([], [], [], [], []), 0, i + 1
        if cols[0]:
            own = [batch.column(0).slice(first)]
            yield out()


def _score_batches(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, ids) -> (uid, score)."""
    _readers.clear()
    model = shared.value
    made = model.prepared()
    for batch in batches:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        scores: list[float] = []

        def flush():
            counts = [len(x) for x, _ in held]
            s = model.log10(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]), made=made)
            scores.extend(np.add.reduceat(s, np.cumsum(counts) - counts).tolist())

        for ids in batch.column(1):
            held.append(attention.windows(_array(ids.as_py()), model.begin))
            size += len(held[-1][0])
            if size >= 4096:
                flush()
                held, size = [], 0
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["uid", "score"])


def _array(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u4").astype(np.int32)


def _near_batches(marks: np.ndarray, end: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ids) -> rows (part, places id * 256 + mark, counts), a part a task; a text's first id stands behind an end."""
    _readers.clear()
    near, one = np.zeros(len(marks) * 256, np.int32), np.int32(1)  # of one type: else each addition is a cast
    for batch in batches:
        for data in batch.column(0):
            ids = np.frombuffer(data.as_py(), "<u4").astype(np.int64)
            m = marks[ids]
            np.add.at(near, ids * 256 + np.append(marks[end], m[:-1]), one)
            np.add.at(near, ids[:-1] * 256 + 128 + m[1:], one)
    at = np.flatnonzero(near)
    part = (at >> 8) % PARTS
    for k in np.unique(part).tolist():
        some = at[part == k]
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([some.astype(np.int32).tobytes()]), pa.array([near[some].tobytes()])], names=["part", "at", "n"])


def _sum_near_batches(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of part -> (part, its ids' summed rows of 256)."""
    part, total = None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.astype(np.float32).tobytes()])], names=["part", "near"])

    for batch in batches:
        for k, at, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            if k != part:
                if total is not None:
                    yield out()
                part, total = k, np.zeros(len(range(k, size, PARTS)) * 256, np.int64)
            at = np.frombuffer(at.as_py(), np.int32).astype(np.int64)
            total[(at >> 8) // PARTS * 256 + (at & 255)] += np.frombuffer(n.as_py(), np.int32)
    if total is not None:
        yield out()


def _window_batches(begin: int, every: int, start: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, ids) -> (hash of the window, its SPAN + 1 ids, whether it is one in ``every``) of those windows, and of those whose hash is less than ``start``."""
    for batch in batches:
        hashes, rows, shares = [], [], []
        for h, ids in zip(batch.column(0).to_numpy().view(np.uint64), batch.column(1), strict=True):
            x, y = attention.windows(_array(ids.as_py()), begin)
            own = mix(h + np.arange(len(x), dtype=np.uint64) * _ODD) >> np.uint64(1)
            share = own % np.uint64(every) == 0
            some = np.flatnonzero(share | (own < np.uint64(start)))
            if some.size:
                shares.append(share[some])
                aims = y[some]  # a text's last id is a target only: its inputs don't have it
                rows.append(np.hstack([x[some, : attention.CONTEXT + 1], np.where(aims < 0, begin, aims)]).astype(_kind(begin)))
                hashes.append(own[some])
        if rows:
            h, r = np.concatenate(hashes).view(np.int64), np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array([x.tobytes() for x in r], pa.binary()), pa.array(np.concatenate(shares))], names=["h", "row", "share"])


def _kind(begin: int) -> type:
    """Of an id in a window's row; none is above ``begin``."""
    return np.uint16 if begin < 1 << 16 else np.int32


def _inputs(rows: list[bytes], begin: int) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(b"".join(rows), _kind(begin)).reshape(len(rows), -1).astype(np.int32)
    y = a[:, attention.CONTEXT + 1 :]
    return np.ascontiguousarray(a[:, :-1]), np.where(y == begin, -1, y)


def _shard_batches(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, h, row) in this order -> rows (part, shard, ids, weights, changes): embeddings by part, and all else in part -1."""
    _readers.clear()
    start = shared.value
    shard, held, model, seen, aims = None, [], None, None, 0

    def flush():
        nonlocal held, aims
        x, y = _inputs(held, start.begin)
        with one_thread():
            model.train(x, y, epochs=1)
        seen[:] += np.bincount(x.reshape(-1), minlength=len(seen))
        aims += int((y >= 0).sum())
        held = []

    def out():
        if held:
            flush()
        rest = np.concatenate([(model.w[k] - start.w[k]).reshape(-1) for k in sorted(model.w) if k != "e"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([shard], pa.int64()), pa.array([b""]), pa.array([np.array([aims], np.int64).tobytes()]), pa.array([rest.astype(np.float32).tobytes()])], names=["part", "shard", "ids", "n", "change"])
        used = np.flatnonzero(seen)
        for k in range(PARTS):
            some = used[used % PARTS == k]
            if len(some):
                change = (model.w["e"][some] - start.w["e"][some]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([shard], pa.int64()), pa.array([some.astype(np.int32).tobytes()]), pa.array([seen[some].tobytes()]), pa.array([change.tobytes()])], names=["part", "shard", "ids", "n", "change"])

    for batch in batches:
        for s, row in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if s != shard:
                if model is not None:
                    yield from out()
                shard, held, model, seen, aims = s, [], start.copy(), np.zeros(len(start.w["e"]), np.int64), 0
            held.append(row)
            if len(held) >= HELD:
                flush()
    if model is not None:
        yield from out()


def _sum_change_batches(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of part and shard -> (part, mean changes)."""
    part, total, weight = None, None, None

    def out():
        mean = total / np.maximum(weight, 1)[:, None]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([mean.astype(np.float32).tobytes()])], names=["part", "change"])

    for batch in batches:
        for k, ids, n, change in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), batch.column(4), strict=True):
            at = np.frombuffer(ids.as_py(), np.int32) // PARTS if k >= 0 else np.zeros(1, np.int32)
            n, change = np.frombuffer(n.as_py(), np.int64), np.frombuffer(change.as_py(), np.float32).reshape(len(at), -1)
            if k != part:
                if total is not None:
                    yield out()
                rows = len(range(k, size, PARTS)) if k >= 0 else 1
                part, total, weight = k, np.zeros((rows, change.shape[1])), np.zeros(rows, np.int64)
            total[at] += change * n[:, None].astype(np.float64)
            weight[at] += n
    if total is not None:
        yield out()


def _split_batches(buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, others) -> a row (bucket, 1, uid, hashes) a document and bucket."""
    for batch in batches:
        rows: list[tuple[int, int, bytes]] = []
        for uid, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            h = np.frombuffer(data, np.uint64)
            b = (h % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            h, b = h[order], b[order]
            cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1], True]) if len(b) else np.zeros(1, np.int64)
            rows += [(int(b[i]), uid, h[i:j].tobytes()) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        b, u, h = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(np.ones(len(b), np.int32)), pa.array(u, pa.int64()), pa.array(h, pa.binary()), pa.array([b""] * len(b), pa.binary())], names=["bucket", "kind", "uid", "hashes", "counts"])


def _pack_batches(buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) -> rows (bucket, 0, null, hashes, counts)."""
    for batch in batches:
        h = np.array(list(map(_hasher(), batch.column(0).to_pylist())), np.uint64)
        n, b = batch.column(1).to_numpy(), (h % np.uint64(buckets)).astype(np.int64)
        rows = [(int(x), h[b == x].tobytes(), n[b == x].astype(np.int64).tobytes()) for x in np.unique(b)]
        x, hs, ns = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(np.zeros(len(x), np.int32)), pa.array([None] * len(x), pa.int64()), pa.array(hs, pa.binary()), pa.array(ns, pa.binary())], names=["bucket", "kind", "uid", "hashes", "counts"])


def _look_up_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of bucket and kind: a bucket's counts, then its documents."""
    bucket, parts, table = None, [], None
    for batch in batches:
        uids, known, logs = [], [], []
        asked: list[np.ndarray] = []

        def flush():
            if asked:
                flat = np.concatenate(asked)
                at = np.minimum(np.searchsorted(table[0], flat), max(0, len(table[0]) - 1))
                hit = table[0][at] == flat if len(table[0]) else np.zeros(len(flat), bool)
                value = np.where(hit, table[1][at], 0.0) if len(table[0]) else np.zeros(len(flat))
                lengths = np.array([len(x) for x in asked])
                starts = np.cumsum(lengths) - lengths
                known.extend(np.add.reduceat(hit.astype(np.int64), starts).tolist())
                logs.extend(np.add.reduceat(value, starts).tolist())

        for b, kind, uid, h, n in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
            if b != bucket:
                flush()
                asked, bucket, parts, table = [], b, [], None
            if kind == 0:
                parts.append((np.frombuffer(h, np.uint64), np.frombuffer(n, np.int64)))
                continue
            if table is None:
                hashes = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
                counts = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
                order = np.argsort(hashes)
                table, parts = (hashes[order], np.log10(counts[order] + 1.0)), []
            uids.append(uid)
            asked.append(np.frombuffer(h, np.uint64))
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(known, pa.int64()), pa.array(logs, pa.float64())], names=["uid", "known", "log"])


def train(texts: DataFrame, vocabulary: Vocabulary, counts: np.ndarray, end: int, windows: int, train_every: int) -> attention.Model:
    """The attention model, from all training documents: ``texts`` has their ``_id`` and ``ids`` (subword ids, as bytes)."""
    spark, size = texts.sparkSession, len(counts)
    final = np.zeros(size, bool)
    for token, i in vocabulary.encoder().library.get_vocab().items():
        final[i] = token.endswith("</w>")
    near = np.zeros((size, 256), np.float32)
    found = texts.select("ids").mapInArrow(partial(_near_batches, attention.marks(counts, final), end), "part int, at binary, n binary")
    found = found.repartition("part").sortWithinPartitions("part").mapInArrow(partial(_sum_near_batches, size), "part int, near binary")
    for r in found.toLocalIterator():  # PARTS rows
        near[r.part :: PARTS] = np.frombuffer(r.near, np.float32).reshape(-1, 256)
    with one_thread():
        model = attention.Model(counts, attention.classes(near, counts, final))
    del near

    about = max(1, int(counts.sum()) // attention.STEP)
    below = (1 << 63) - 1 if about <= 1.5 * windows else int(1.5 * windows / about * 2**63)

    def made(every: int, start: int) -> DataFrame:
        return texts.select(F.xxhash64("_id", "ids").alias("h"), "ids").mapInArrow(partial(_window_batches, model.begin, every, start), "h long, row binary, share boolean")

    first = made(1 << 63, below).where(F.col("h") < below).orderBy("h", "row").limit(windows).select("row").toArrow()  # at most ``windows`` rows of SPAN + 1 ids
    if first.num_rows:
        x, y = _inputs(first["row"].to_pylist(), model.begin)
        del first
        with one_thread():
            model.train(x, y, epochs=PASSES)

    shards = max(1, -(-int(counts.sum()) // (SHARD * train_every)))
    # Windows are made once more rather than kept: their rows repeat the context.
    dealt = made(train_every, 0).select(F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard"), "h", "row")
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "h", "row")
    shared = spark.sparkContext.broadcast(model)
    changes = dealt.mapInArrow(partial(_shard_batches, shared), "part int, shard long, ids binary, n binary, change binary")
    changes = changes.repartition("part").sortWithinPartitions("part", "shard").mapInArrow(partial(_sum_change_batches, size + 1), "part int, change binary")
    for r in changes.collect():  # PARTS + 1 rows of the size of the model
        model.add(r.part, PARTS, np.frombuffer(r.change, np.float32))
    return model


def score_texts(docs: DataFrame, vocabulary_path: str, held_mod: int = 7, held: int = 2, end_id: int = 49407, id_col: str = "doc_id", text_col: str = "text", windows: int = 40_000, train_every: int = 1) -> DataFrame:
    """``id_col``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every row.

    Documents whose crc32(id as text) mod ``held_mod`` is ``held`` are held out.
    """
    spark = docs.sparkSession
    vocabulary = Vocabulary(spark, vocabulary_path)
    if vocabulary.byte_level:
        raise ValueError("the model works on a word vocabulary, whose ids don't depend on white space")
    size = vocabulary.encoder().library.get_vocab_size(with_added_tokens=True)
    learn = F.coalesce(remainder(id_col, held_mod) != held, F.lit(False))

    counts = docs.where(learn).select(F.col(text_col).cast("binary").alias("text")).mapInArrow(_count_batches, "word binary, n long")
    counts = materialize(counts.groupBy("word").agg(F.sum("n").alias("n")), "words")
    n_words, n_distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_docs = docs.where(learn).count()
    total, distinct = n_words + n_docs, n_distinct + (n_docs > 0)

    # The least count of a frequent word: powers of 2 ^ (1/8), so the histogram is of fixed size.
    level = F.when(F.octet_length("word") <= LONG, F.floor(F.log2("n") * 8)).otherwise(-1)
    least, got = None, 0
    for r in counts.where(level >= 0).groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        got += r["count"]
        if got > HEAD:
            break
        least = r.level
    head: dict[bytes, int] = {}
    if least is not None:
        most = counts.where(level >= least).select("word", "n").toArrow()  # columns, not a row object a word
        head = dict(zip(most["word"].to_pylist(), most["n"].to_pylist(), strict=True))
        del most

    spread = spark.sparkContext.broadcast(head)  # of fixed size: HEAD words
    rows = docs.select(F.struct(F.col(id_col).alias("id")).alias("own"), F.col(text_col).cast("binary").alias("text"))
    read = rows.mapInArrow(partial(_read_batches, vocabulary, spread, end_id), f"own {rows.schema['own'].dataType.simpleString()}, n_tokens long, known long, log double, others binary, ids binary")
    read = materialize(read.withColumn("uid", F.monotonically_increasing_id()), "read")
    texts = read.select(F.col("own.id").alias("_id"), "ids").where(F.coalesce(remainder("_id", held_mod) != held, F.lit(False)))
    ids = np.zeros(size, np.int64)
    for r in texts.select("ids").mapInArrow(partial(_id_batches, size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # one row an id
        ids[r.id] = r.n
    model = train(texts, vocabulary, ids, end_id, windows, train_every)

    shared = spark.sparkContext.broadcast(model)  # of fixed size: the vocabulary
    scored = read.select("uid", "ids").mapInArrow(partial(_score_batches, shared), "uid long, score double")
    scored = materialize(scored, "scores")

    buckets = max(1, -(-n_distinct // BUCKET))
    shape = "bucket long, kind int, uid long, hashes binary, counts binary"
    rest = counts.where(level < least) if least is not None else counts
    asked = read.select("uid", "others").mapInArrow(partial(_split_batches, buckets), shape)
    both = rest.mapInArrow(partial(_pack_batches, buckets), shape).unionByName(asked)
    met = both.repartition("bucket").sortWithinPartitions("bucket", "kind")
    found = met.mapInArrow(_look_up_batches, "uid long, known long, log double").groupBy("uid").agg(F.sum("known").alias("more"), F.sum("log").alias("more_log"))
    out = read.drop("others", "ids").join(found, "uid", "left").join(scored, "uid")
    ends = 1 if n_docs else 0
    return out.select(
        F.col("own.id").alias(id_col), F.coalesce(F.crc32(F.col("own.id").cast("string").cast("binary")) % held_mod == held, F.lit(False)).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0)) + ends).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("log") + F.coalesce("more_log", F.lit(0.0)) + math.log10(n_docs + 1) - F.col("n_tokens") * math.log10(total + distinct + 1)).alias("base_score"), "score",
    )
