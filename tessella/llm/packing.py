"""Best-fit packing of documents into fixed-length sequences, improved by local search.

Plan on lengths, place on keys. Documents are encoded once into pieces of at most
``capacity`` ids (only longer documents are cut). The pieces' lengths, not their
ids, are dealt by hash into blocks of about ``BLOCK`` pieces; each block is packed
by itself in one task of bounded size:

1. best fit, longest first, with a bit mask over the gaps of open bins;
2. local search between underfull bins: the emptiest bin hands pieces to fuller
   ones by moves, one-for-one, two-for-one and one-for-two exchanges, each the
   largest transfer that fits. Every step moves length from a bin to one at least
   as full, so the sum of squared fills increases, until bins are empty.

The emptiest bins of a block (at most ``RESIDUE``) are opened again and packed
with those of ``FAN`` - 1 other blocks, and so on up to one last block; so the
whole table ends with the loose ends of one block, whatever its size.

Null texts count as empty: such a document is its end id alone. Repeated rows and
ids are separate pieces. Columns other than the two named ones are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.tokens import Vocabulary, strings
from tessella.runtime import materialize

BLOCK, RESIDUE, FAN, PATIENCE = 4096, 8, 32, 4
#: Lengths of a bin that enter two-piece exchanges; single pieces all enter.
PAIRED = 48


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest item first, into the fullest bin that takes it."""
    bins: list[list[int]] = []
    at_gap: dict[int, list[int]] = {}
    mask = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            gap = n + (fits & -fits).bit_length() - 1
            b = at_gap[gap].pop()
            if not at_gap[gap]:
                mask ^= 1 << gap
            bins[b].append(i)
        else:
            gap, b = capacity, len(bins)
            bins.append([i])
        if gap := gap - n:
            stack = at_gap.setdefault(gap, [])
            if not stack:
                mask |= 1 << gap
            stack.append(b)
    return bins


def _transfers(mine: np.ndarray, theirs: np.ndarray, gap: int) -> tuple[list[int], list[int]] | None:
    """Positions to give and to take so that the net transfer is the largest that fits the gap, or None."""
    a, b = mine[:PAIRED], theirs[:PAIRED]
    i, j = np.triu_indices(len(a), 1)
    k, m = np.triu_indices(len(b), 1)
    best, found = 0, None
    one, two, none = mine[:, None], (a[i] + a[j])[:, None], np.zeros(1, mine.dtype)
    for give, take, kind in ((one, none, 0), (one, theirs, 1), (two, theirs, 2), (one, b[k] + b[m], 3), (two, none, 4)):
        if not give.size or not take.size:
            continue
        net = give - take[None, :]
        net = np.where(net <= gap, net, 0)
        at = int(net.argmax())
        x, y = divmod(at, net.shape[1])
        if net[x, y] > best:
            best = int(net[x, y])
            gives = [int(i[x]), int(j[x])] if kind in (2, 4) else [x]
            takes = [y] if kind in (1, 2) else [int(k[y]), int(m[y])] if kind == 3 else []
            found = (gives, takes)
            if best == gap:
                break
    return found


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Empty the emptiest bins into fuller ones; stops when PATIENCE bins in a row can't be emptied."""
    fill = [int(lengths[b].sum()) for b in bins]
    open_ = {b for b in range(len(bins)) if fill[b] < capacity}
    stuck = 0
    tried: set[int] = set()
    while stuck < PATIENCE:
        sources = [b for b in open_ if b not in tried]
        if not sources or len(open_) < 2 or sum(capacity - fill[b] for b in open_) < capacity:
            break  # less free room than one bin: no bin can be saved
        a = min(sources, key=lambda b: (fill[b], b))
        tried.add(a)
        for b in sorted(open_ - {a}, key=lambda b: (-fill[b], b)):
            while fill[b] < capacity and bins[a] and fill[b] >= fill[a]:
                x, y = (sorted(bins[z], key=lambda n: -lengths[n]) for z in (a, b))
                step = _transfers(lengths[x], lengths[y], capacity - fill[b])
                if not step:
                    break
                gives, takes = [x[n] for n in step[0]], [y[n] for n in step[1]]
                bins[a] = [n for n in bins[a] if n not in gives] + takes
                bins[b] = [n for n in bins[b] if n not in takes] + gives
                fill[a], fill[b] = int(lengths[bins[a]].sum()), int(lengths[bins[b]].sum())
            if fill[b] == capacity:
                open_.discard(b)
            if not bins[a]:
                break
        if bins[a]:
            stuck += 1
        else:
            open_.discard(a)
            stuck = 0
    return [b for b in bins if b]


def pack(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def _pack_block(capacity: int, level: int, last: bool, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "uid"], ascending=[False, True], kind="stable").reset_index(drop=True)
    lengths, group = pdf["length"].to_numpy(np.int64), int(pdf["group"].iloc[0])
    bins = pack(lengths, capacity)
    loose = set()
    if not last:
        fills = sorted((int(lengths[b].sum()), k) for k, b in enumerate(bins))
        loose = {k for fill, k in fills[:RESIDUE] if fill < capacity}
    seq, offset, done = (np.zeros(len(pdf), t) for t in (np.int64, np.int64, bool))
    for k, b in enumerate(bins):
        seq[b] = (level << 56) + (group << 24) + k
        offset[b] = np.cumsum(lengths[b]) - lengths[b]
        done[b] = k not in loose
    return pd.DataFrame({"uid": pdf["uid"], "length": pdf["length"], "group": group, "sequence_id": seq, "offset": offset, "done": done})


def _packer(capacity: int, level: int, last: bool):
    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        return _pack_block(capacity, level, last, pdf)

    return packed


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """``uid``, ``sequence_id`` and ``offset`` of every row of ``pieces`` (``uid`` unique, ``length`` from 1 to ``capacity``)."""
    groups = max(1, -(-pieces.count() // BLOCK))
    rows = pieces.select("uid", F.col("length").cast("long").alias("length"), F.pmod(F.xxhash64("uid"), F.lit(groups)).alias("group"))
    out, level = None, 0
    while True:
        packed = materialize(
            rows.groupBy("group").applyInPandas(_packer(capacity, level, groups == 1), "uid long, length long, group long, sequence_id long, offset long, done boolean"),
            f"packed-{level}",
        )
        placed = packed.where("done").select("uid", "sequence_id", "offset")
        out = placed if out is None else out.unionByName(placed)
        if groups == 1:
            return out
        groups, level = -(-groups // FAN), level + 1
        rows = packed.where("not done").select("uid", "length", F.pmod("group", F.lit(groups)).alias("group"))


def _piece_batches(vocabulary: Vocabulary, capacity: int, end: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode, width = vocabulary.encoder().ids, 4 * capacity
    for batch in batches:
        kind = batch.schema.field(0).type
        docs, piece, ids, size = [], [], [], 0

        def out():
            lengths = [len(x) // 4 for x in ids]
            return pa.RecordBatch.from_arrays(
                [pa.array(docs, kind), pa.array(piece, pa.int32()), pa.array([p * capacity for p in piece], pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())],
                names=["id", "piece", "start", "length", "ids"],
            )

        for x, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
            whole = encode(text or "") + end
            for k, at in enumerate(range(0, len(whole), width)):
                docs.append(x)
                piece.append(k)
                ids.append(whole[at : at + width])
            size += len(whole)
            if size >= 1 << 23:
                yield out()
                docs, piece, ids, size = [], [], [], 0
        if docs:
            yield out()


def pieces(docs: DataFrame, vocabulary_path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table of ``id``, ``piece``, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit) and a unique ``uid``."""
    vocabulary = Vocabulary(docs.sparkSession, vocabulary_path)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    cut = rows.mapInArrow(partial(_piece_batches, vocabulary, capacity, struct.pack("<I", end_id)), f"id {kind}, piece int, start long, length long, ids binary")
    return materialize(cut.withColumn("uid", F.monotonically_increasing_id()), "pieces")


def pack_documents(docs: DataFrame, vocabulary_path: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ("ids",)) -> DataFrame:
    """Every piece with its place: ``id_col``, ``piece``, ``start``, ``length``, ``sequence_id``, ``offset`` and the columns of ``keep``.

    ``keep`` holds names or expressions over the pieces' columns; by default the
    ids themselves. They are taken before the join, so an expression of a few
    bytes (a checksum, say) spares the shuffle of the ids.
    """
    cut = pieces(docs, vocabulary_path, end_id, capacity, id_col, text_col)
    placed = place(cut.select("uid", "length"), capacity)
    return cut.select(F.col("id").alias(id_col), "piece", "start", "length", "uid", *keep).join(placed, "uid").drop("uid")


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences, ``sequence_id``, ``length``, ``ids`` and ``spans``, from what ``pack_documents`` returns with ``ids``.

    A group is one sequence: at most ``capacity`` ids.
    """
    part = F.struct("offset", "length", F.hex("ids").alias("hex"))
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(part)).alias("parts"))
    return rows.select(
        "sequence_id", "length",
        F.unhex(F.array_join(F.transform("parts", lambda p: p["hex"]), "")).alias("ids"),
        F.transform("parts", lambda p: F.struct(p["offset"].alias("offset"), p["length"].alias("length"))).alias("spans"),
    )
