"""N-gram Jaccard self-join by parity sketches, and the groups its links make.

A document's set holds the 64-bit hashes of its distinct ``k``-word shingles. Two
sets of sizes a and c with a Jaccard similarity of at least num / den differ in at
most t = (a + c)(den - num) / (den + num) elements.

*Sketches.* Elements are dealt to chunks, and each flips one bit of its chunk. An element of
only one set flips one bit of one chunk, so the Hamming distance of two sketches is a
lower bound of the sets' difference, and at most t of the p chunks of a linked pair differ.
For the join a chunk has 2^58 bits and is known by the XOR of the numbers of those that
are set, so unlike sets agree in a chunk by what they share and not by chance; for distances
sketches have about as many bits as the set has elements.

*Bands.* Band g takes the sizes from R^g on and all sizes that can be linked to one
below R^(g+1), so every linked pair meets in the band of its smaller set.

*Pigeonhole join.* p = 2 t + 1 chunks, t that of the band's largest pair. In any one
order of all (chunk, value) words, linked sets share one of the first t + 1 words of
each, t that of a set with its largest partner: were none shared, more than t chunks
would differ. The order puts frequent words last (zeros at the very end), so passages
that many documents hold are no join keys unless they make up most of a document.
Frequencies come from all documents: every task counts its words, those that repeat
in it are summed by slot, and the table of levels by slot is of fixed size. Any
table gives whole results; it only decides which words are keys.

*Homes.* A key's documents meet at its *home*, the least class that has it. Cold keys
are grouped by parts of bounded size; keys that the table knows as hot are reduced to
their home by a map-side aggregate and handed out by a join that adaptive execution may split.

*First round.* Each document is compared with its least home only: Hamming distance
of plain sketches first, then whole sets, in blocks that hold the home and a
bounded number of others. Work grows with the documents, however large a group is.

*Second round.* Homes all of whose documents are connected by then are done. In
the others, documents of different components are compared in square blocks
of bounded size: sketches first, then the sets of those that sketches let meet. No home
is capped: a larger one just has more blocks.

Equal sets are one class from the start (known by 128 bits of their digest), so
thousands of copies cost one document. Sets are made anew from the texts where they are
needed, rather than kept for all documents; a Bloom filter of fixed size keeps
the other texts from being cut again.

Null or blank texts have an empty set and are linked with nothing. A text of fewer
than ``k`` words has its whole sequence as one shingle. Rows with a null id are
returned with a null component and linked with nothing. Rows that repeat an id
are one node if their sets agree; else each set carries that id. Columns other than
the two named ones are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import bloom
from tessella.llm.components import components
from tessella.runtime import materialize

RATIO = 1.4
#: Bits of a slot of the table of word frequencies, words that a task counts at once, and times from which it reports one.
SLOT_BITS, COUNTED, REPEATED = 21, 1 << 21, 3
#: Level (log2 of a frequency) from which a key is hot; that of zero chunks; rows of a part of cold keys.
HOT, ZERO, PART = 11, 127, 1 << 21
#: Documents and bytes of sets on each side of a block.
BLOCK_DOCS, BLOCK_BYTES = 1024, 1 << 24
#: Classes that a task remembers, bytes of texts cut at once, and bytes of a word from which its text is hashed.
SEEN, CUT_BYTES, LONG_WORD = 500_000, 1 << 18, 256
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _hashed(a: np.ndarray, k: int) -> np.ndarray:
    n = len(a) - k + 1
    acc = np.full(n, np.uint64(k), np.uint64)
    for i in range(k):
        acc *= _ODD
        acc += a[i : i + n]
        acc = mix(acc)
    return acc


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes are white space, a number for each byte (A-Z as a-z, 0 for white space), and the powers of a factor and of its inverse."""
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    number = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
    number[65:91] = number[97:123]
    number[space] = 0
    factor = 0xD6E8FEB86659FD93
    up, down = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(CUT_BYTES, x, np.uint64)])) for x in (factor, pow(factor, -1, 1 << 64)))
    return space, number, up, down


_SPACE, _NUMBER, _UP, _DOWN = _tables()


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of at most CUT_BYTES bytes, and where they start: polynomials of the numbers of their bytes, and for long words a hash of their text."""
    a = np.frombuffer(data, np.uint8)
    gap = _SPACE.take(a)
    first = ~gap
    first[1:] &= gap[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    x = _NUMBER.take(a)
    x *= _UP[: len(a)]
    h = np.add.reduceat(x, starts)
    h *= _DOWN.take(starts)
    for k in np.flatnonzero(np.diff(starts, append=len(a)) > LONG_WORD).tolist():
        word = data[starts[k] : starts[k + 1] if k + 1 < len(starts) else len(a)].split()[0]
        if len(word) > LONG_WORD:
            h[k] = xxhash.xxh3_64_intdigest(word.lower())
    return h, starts


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text's words, in runs of less than CUT_BYTES bytes; a word that is longer than that alone."""
    held, size = [], 0
    for w in text.split():
        if size + len(w) >= CUT_BYTES and held:
            yield b" ".join(held)
            held, size = [], 0
        held.append(w)
        size += len(w) + 1
    if held:
        yield b" ".join(held)


def _grouped_hashes(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, list[int]]]:
    """The word hashes of texts in runs of about CUT_BYTES bytes, and each text's number of words."""
    at = 0
    while at < len(texts):
        if len(texts[at] or b"") >= CUT_BYTES:
            parts = [word_hashes(p)[0] if len(p) < CUT_BYTES else np.array([xxhash.xxh3_64_intdigest(p.lower())], np.uint64) for p in _pieces(texts[at])]
            out = np.concatenate([np.zeros(0, np.uint64), *parts])
            yield out, [len(out)]
            at += 1
            continue
        held, size, ends = [], 0, []
        while at < len(texts) and size + len(texts[at] or b"") < CUT_BYTES:
            held.append(texts[at] or b"")
            size += len(held[-1]) + 1
            ends.append(size)
            at += 1
        h, starts = word_hashes(b" ".join(held))
        yield h, np.diff(np.searchsorted(starts, ends), prepend=0).tolist()


def sets_of(texts: list[bytes | None], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit hashes of the ``k``-word shingles of each text, A-Z lower-cased."""
    for a, counts in _grouped_hashes(texts):
        acc = _hashed(a, k) if len(a) >= k else a
        start = 0
        for n in counts:
            if n >= k:
                s = acc[start : start + n - k + 1].copy()
                s.sort()
                new = s[1:] != s[:-1]
                yield s if new.all() else s[np.flatnonzero(np.append(True, new))]
            else:
                yield _hashed(a[start : start + n], n) if n else np.zeros(0, np.uint64)
            start += n


class Bands:
    """Bands of set sizes for a similarity of num / den, with their numbers of differences and chunks."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("the similarity must lie in (0, 1]")
        self.num, self.den = num, den
        self._of: dict[int, list[tuple[int, int, int]]] = {}

    def differences(self, a, c):
        return (a + c) * (self.den - self.num) // (self.den + self.num)

    def low(self, g: int) -> int:
        return math.ceil(RATIO**g)

    def high(self, g: int) -> int:
        return (self.low(g + 1) - 1) * self.den // self.num

    def of(self, n: int) -> list[tuple[int, int, int]]:
        """(band, its chunks, keys to list) for the bands in which a set of this size can meet one that is linked to it but not equal."""
        if n in self._of:
            return self._of[n]
        g = max(0, int(math.log(max(n, 1), RATIO)) - 1)
        while self.low(g + 1) <= n:
            g += 1
        out = []
        while g >= 0 and n <= self.high(g):
            least = self.low(g + 1) - 1
            partner = min(n * self.den // self.num, self.high(g)) if n <= least else least
            t = int(self.differences(n, partner))
            if t and self.low(g) <= least:
                out.append((g, 2 * int(self.differences(least, self.high(g))) + 1, t + 1))
            g -= 1
        if len(self._of) < 1 << 16:
            self._of[n] = out
        return out


def sketch(s: np.ndarray, p: int) -> np.ndarray:
    """p 64-bit words: each element flips one bit of one word."""
    at = (s % np.uint64(p)) * np.uint64(64) + (s >> np.uint64(58))
    odd = (np.bincount(at.astype(np.int64), minlength=64 * p) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def words_of(sets: list[np.ndarray], bands: Bands) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
    """The names of the (band, chunk, value) words of sets, which chunks are zero, and (set, first place, chunks, keys to list) of each set and band.

    A chunk's value is the XOR of the numbers of the bits that it has set, of 2^58.
    """
    plan, at = [], 0
    for i, s in enumerate(sets):
        for g, p, n in bands.of(len(s)):
            plan.append((i, at, p, n, g))
            at += p
    if not plan:
        return np.zeros(0, np.uint64), np.zeros(0, bool), []
    lengths = np.array([len(sets[x[0]]) for x in plan])
    s = np.concatenate([sets[x[0]] for x in plan])
    place = s >> np.uint64(32)
    place *= np.repeat(np.array([x[2] for x in plan], np.uint64), lengths)
    place >>= np.uint64(32)
    place += np.repeat(np.array([x[1] for x in plan], np.uint64), lengths)
    value = np.zeros(at, np.uint64)
    np.bitwise_xor.at(value, place.view(np.int64), s)
    chunks = np.array([x[2] for x in plan])
    number = np.arange(1, at + 1, dtype=np.uint64) - np.repeat(np.array([x[1] for x in plan], np.uint64), chunks)
    number += np.repeat(np.array([x[4] << 40 for x in plan], np.uint64), chunks)
    return mix(value + _ODD * number), value == 0, [x[:4] for x in plan]


def keys(sets: list[np.ndarray], bands: Bands, levels: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    """The join keys of sets, band by band: the first words in the order of (level, name); and how many each set has."""
    name, zero, plan = words_of(sets, bands)
    level = levels.take((name >> np.uint64(64 - SLOT_BITS)).view(np.int64))
    level[zero] = ZERO
    key = (level.astype(np.uint64) << np.uint64(56)) | (name >> np.uint64(8))
    out, counts = [], [0] * len(sets)
    for i, at, p, n in plan:
        own = key[at : at + p]
        out.append(np.partition(own, n - 1)[:n] if n < p else own)
        counts[i] += len(out[-1])
    return out, counts


def plain(s: np.ndarray) -> np.ndarray:
    """One sketch of a power of two bits, at least as many as the set has elements; halves fold onto each other."""
    words = max(1, 1 << (max(len(s), 64) - 1).bit_length() - 6)
    odd = np.bincount((s & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.uint64)


def fold(words: np.ndarray, n: int) -> np.ndarray:
    while len(words) > n:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed numbers; the first alone routes it."""
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


class _Seen:
    """Names that a task has met, up to SEEN of them; a name that was dropped counts as new."""

    def __init__(self):
        self.held: set[int] = set()

    def new(self, x: int) -> bool:
        if x in self.held:
            return False
        if len(self.held) > SEEN:
            self.held.clear()
        self.held.add(x)
        return True


CLASS_ROWS = "th long, n long, node long, more long, bits binary, slot int, times long"


def _class_batches(k: int, bands: Bands, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a document, and rows (slot, times) of the words that repeat among a task's classes."""
    names = [x.split()[0] for x in CLASS_ROWS.split(", ")]
    seen, held, size, kind, new, elements = _Seen(), [], 0, None, [], 0

    def counted():
        nonlocal held, size, new, elements
        name, zero, _ = words_of(new, bands)
        name, n = np.unique(np.concatenate([*held, name[~zero]]), return_counts=True)
        some = n >= REPEATED
        slot, at = np.unique(name[some] >> np.uint64(64 - SLOT_BITS), return_inverse=True)
        times = np.bincount(at, n[some], minlength=len(slot)).astype(np.int64)
        held, size, new, elements = [], 0, [], 0
        nulls = [pa.nulls(len(slot), t) for t in (kind, *[pa.int64()] * 4, pa.binary())]
        return pa.RecordBatch.from_arrays([*nulls, pa.array(slot.astype(np.int32)), pa.array(times)], names=["id", *names])

    for batch in batches:
        kind = batch.schema.field(0).type
        sizes, nodes, more, bits = [], [], [], []
        for null, s in zip(batch.column(0).is_null().to_pylist(), sets_of(batch.column(2).to_pylist(), k), strict=True):
            some = len(s) and not null
            node, rest = digest(s) if some else (None, None)
            sizes.append(len(s))
            nodes.append(node)
            more.append(rest)
            bits.append(plain(s).tobytes() if some else None)
            if some and seen.new(node):
                new.append(s)
                elements += len(s)
                if elements > CUT_BYTES >> 2:
                    name, zero, _ = words_of(new, bands)
                    held.append(name[~zero])
                    size, new, elements = size + len(held[-1]), [], 0
                if size > COUNTED:
                    yield counted()
        rows = len(sizes)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(more, pa.int64()), pa.array(bits, pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int64())],
            names=["id", *names],
        )
    if held or new:
        yield counted()


def _key_batches(k: int, bands: Bands, shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node). A task lists the keys of equal sets once."""
    seen, levels = _Seen(), shared.value
    for batch in batches:
        sets, nodes, size = [], [], 0

        def out():
            lists, counts = keys(sets, bands, levels)
            key = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
            return _longs(["key", "node"], key.view(np.int64), np.repeat(np.array(nodes, np.int64), counts))

        for s in sets_of(batch.column(0).to_pylist(), k):
            if len(s) and bands.of(len(s)) and seen.new(node := digest(s)[0]):
                sets.append(s)
                nodes.append(node)
                size += len(s)
                if size > CUT_BYTES >> 2:
                    yield out()
                    sets, nodes, size = [], [], 0
        if nodes:
            yield out()


def _home_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows (key, node) of a part's keys -> distinct rows (home, node) of keys that two nodes have at least."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    key, node = (np.concatenate([h[i] for h in held]) if held else np.zeros(0, np.int64) for i in (0, 1))
    del held
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    first = np.append(True, key[1:] != key[:-1])[: len(key)]
    home = node[np.flatnonzero(first)][np.cumsum(first) - 1] if len(key) else node
    some = home != node
    pairs = np.stack([home[some], node[some]], axis=1)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    if len(pairs):
        pairs = pairs[np.append(True, (pairs[1:] != pairs[:-1]).any(axis=1))]
    yield _longs(["home", "node"], pairs[:, 0], pairs[:, 1])


def _longs(names: list[str], *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)


def _set_batches(k: int, shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, th, hash of both, text) -> (id, th, set) of the rows that the filter lets through, equal ones of a task once."""
    wanted, seen = shared.value, _Seen()
    for batch in batches:
        h = batch.column(2).to_numpy()
        at = np.array([i for i in np.flatnonzero(wanted.has(h)).tolist() if seen.new(int(h[i]))], np.int64)
        some = pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(at)) for i in (0, 1, 3)], names=["id", "th", "text"])
        sets, size, first = [], 0, 0
        for i, s in enumerate(sets_of(some.column(2).to_pylist(), k)):
            sets.append(s.tobytes())
            size += len(sets[-1])
            if size > 1 << 24 or i + 1 == len(at):
                own = some.slice(first, len(sets))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(sets, pa.binary())], names=["id", "th", "set"])
                sets, size, first = [], 0, i + 1


def near(bands: Bands, words: np.ndarray, sizes: np.ndarray, i: int, at: np.ndarray) -> np.ndarray:
    """Those of ``at`` whose size and Hamming distance allow a link with ``i``."""
    a, c = np.minimum(sizes[at], sizes[i]), np.maximum(sizes[at], sizes[i])
    at = at[bands.den * a >= bands.num * c]
    if at.size:
        far = np.bitwise_count(words[at] ^ words[i]).sum(axis=1, dtype=np.int64)
        at = at[far <= bands.differences(sizes[at], sizes[i])]
    return at


def alike(bands: Bands, a: np.ndarray, c: np.ndarray) -> bool:
    both = np.intersect1d(a, c, assume_unique=True).size
    return bands.den * both >= bands.num * (len(a) + len(c) - both)


def _near_pair_batches(bands: Bands, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(home, node, their sizes and plain sketches) -> the pairs that can be linked."""
    for batch in batches:
        out = []
        for home, node, hn, n, hbits, bits in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if bands.den * min(n, hn) >= bands.num * max(n, hn):
                a, c = np.frombuffer(hbits, np.uint64), np.frombuffer(bits, np.uint64)
                least = min(len(a), len(c))
                if int(np.bitwise_count(fold(a, least) ^ fold(c, least)).sum()) <= bands.differences(n, hn):
                    out.append((home, node))
        yield _longs(["home", "node"], *(zip(*out, strict=True) if out else ((), ())))


def candidates(bands: Bands, nodes: list[int], sizes: list[int], bits: list[np.ndarray], parts: list[int], side: list[int]) -> list[list[int]]:
    """Groups (of places) that possible links between different ``parts`` make; ``side`` tells the two sides of a block apart (one side: all pairs)."""
    least = min(map(len, bits))
    n, words, sides, part = np.array(sizes, np.int64), np.stack([fold(b, least) for b in bits]), np.array(side), np.array(parts)
    apart, label, touched = len(set(side)) > 1, np.arange(len(nodes)), np.zeros(len(nodes), bool)
    for i in range(len(nodes) - 1):
        at = np.arange(i + 1, len(nodes))
        rest = part[at] != part[i]
        if apart:
            rest &= sides[at] != sides[i]
        found = near(bands, words, n, i, at[rest])
        if found.size:
            touched[i] = touched[found] = True
            for one in np.unique(label[found]):
                label[label == one] = label[i]
    order = np.flatnonzero(touched)
    order = order[np.argsort(label[order], kind="stable")]
    return [g.tolist() for g in np.split(order, np.flatnonzero(np.diff(label[order])) + 1) if len(g) > 1]


def linked(bands: Bands, nodes: list[int], sets: list[np.ndarray], parts: list[int]) -> list[tuple[int, int]]:
    """Links between sets of different ``parts``: as many as it takes to connect those parts that any link connects."""
    sizes, label = np.array([len(s) for s in sets], np.int64), np.array(parts)
    words, out = np.stack([sketch(s, max(4, int(sizes.max()) // 8)) for s in sets]), []
    for i in range(len(nodes) - 1):
        at = np.arange(i + 1, len(nodes))
        for j in near(bands, words, sizes, i, at[label[at] != label[i]]).tolist():
            if label[i] != label[j] and alike(bands, sets[i], sets[j]):
                label[label == label[j]] = label[i]
                out.append((nodes[i], nodes[j]))
    return out


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[tuple]]:
    """The rows of sorted batches, a list for each run of equal first ``n_keys`` values."""
    at, held = None, []
    for batch in batches:
        for row in zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)], strict=True):
            if row[:n_keys] != at:
                if held:
                    yield held
                at, held = row[:n_keys], []
            held.append(row)
    if held:
        yield held


def _star_batches(bands: Bands, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (home, sub, node, set) in order of home and sub -> the nodes that are linked to their home."""
    out: list[tuple[int, int]] = []
    for run in _runs(batches, 2):
        rows = {r[2]: np.frombuffer(r[3], np.uint64) for r in run}
        if (own := rows.get(run[0][0])) is not None:
            out += [(node, run[0][0]) for node, s in rows.items() if node != run[0][0] and alike(bands, own, s)]
        if len(out) > 50_000:
            yield _longs(["u", "v"], *zip(*out, strict=True))
            out = []
    yield _longs(["u", "v"], *(zip(*out, strict=True) if out else ((), ())))


def _candidate_batches(bands: Bands, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (home, one, two, sub, node, component, n, bits) in order of the block -> (group, node, component)."""
    out: list[tuple[int, int, int]] = []
    for run in _runs(batches, 3):
        rows = list({r[4]: r for r in run}.values())
        if len(rows) > 1:
            nodes = [r[4] for r in rows]
            for group in candidates(bands, nodes, [r[6] for r in rows], [np.frombuffer(r[7], np.uint64) for r in rows], [r[5] for r in rows], [r[3] for r in rows]):
                group.sort(key=nodes.__getitem__)
                name = digest(np.array([nodes[x] for x in group], np.int64))[0]
                out += [(name, nodes[x], rows[x][5]) for x in group]
        if len(out) > 50_000:
            yield _longs(["group", "node", "part"], *zip(*out, strict=True))
            out = []
    yield _longs(["group", "node", "part"], *(zip(*out, strict=True) if out else ((), (), ())))


def _link_batches(bands: Bands, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, node, component, set) in order of the group -> links (as components)."""
    out: list[tuple[int, int]] = []
    for run in _runs(batches, 1):
        rows = {r[1]: r for r in run}
        if len(rows) > 1:
            own = {r[1]: r[2] for r in rows.values()}
            out += [(own[u], own[v]) for u, v in linked(bands, list(rows), [np.frombuffer(r[3], np.uint64) for r in rows.values()], list(own.values()))]
        if len(out) > 50_000:
            yield _longs(["u", "v"], *zip(*out, strict=True))
            out = []
    yield _longs(["u", "v"], *(zip(*out, strict=True) if out else ((), ())))


def _levels(counted: DataFrame) -> np.ndarray:
    """log2 of the frequency of every slot's repeated words; 0 for others. One row a slot at most comes to the driver."""
    out = np.zeros(1 << SLOT_BITS, np.uint8)
    rows = counted.groupBy("slot").agg(F.sum("times").alias("times")).toPandas()
    out[rows["slot"].to_numpy(np.int64)] = np.minimum(np.log2(rows["times"].to_numpy(np.float64)), ZERO - 1)
    return out


def _key_hash() -> Column:
    return F.xxhash64("id", "th")


def _with_sets(rows: DataFrame, members: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """``members`` (with a ``node``) beside the set of each node."""
    members = members.join(classes.select("node", "id", "th"), "node")
    wanted = bloom.build(members.select(_key_hash().alias("h")))
    shared = rows.sparkSession.sparkContext.broadcast(wanted)  # of fixed size at most
    texts = rows.where("id is not null").select("id", "th", _key_hash().alias("h"), "text")
    sets = texts.mapInArrow(partial(_set_batches, k, shared), f"id {rows.schema['id'].dataType.simpleString()}, th long, set binary")
    return members.join(sets, ["id", "th"]).drop("id", "th")


def _blocks(sized: DataFrame, per: str) -> DataFrame:
    """``per`` and ``subs``: the number of parts of bounded size that its rows (with their size ``n``) make."""
    width = F.least(F.lit(BLOCK_DOCS), F.greatest(F.lit(32), F.floor(F.lit(BLOCK_BYTES) / (F.col("widest") * 8))))
    return sized.groupBy(per).agg(F.count("*").alias("m"), F.max("n").alias("widest")).select(per, F.ceil(F.col("m") / width).alias("subs"))


def _first_round(rows: DataFrame, classes: DataFrame, routed: DataFrame, k: int, bands: Bands) -> DataFrame:
    """Links (u, v) of nodes with the least of their homes."""
    sized = classes.select("node", "n", "bits")
    pairs = routed.groupBy("node").agg(F.min("home").alias("home")).join(sized, "node").join(sized.toDF("home", "hn", "hbits"), "home")
    pairs = pairs.select("home", "node", "hn", "n", "hbits", "bits").mapInArrow(partial(_near_pair_batches, bands), "home long, node long")
    pairs = materialize(pairs, "first-pairs")
    subs = _blocks(pairs.join(classes.select("node", "n"), "node"), "home")
    at = pairs.join(subs, "home").select("home", F.pmod(F.xxhash64("node"), F.col("subs")).alias("sub"), "node")
    homes = subs.select("home", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1)).alias("sub"), F.col("home").alias("node"))
    members = materialize(at.unionByName(homes), "first-members")
    met = _with_sets(rows, members, classes, k).select("home", "sub", "node", "set")
    return met.repartition("home", "sub").sortWithinPartitions("home", "sub").mapInArrow(partial(_star_batches, bands), "u long, v long")


def _second_round(rows: DataFrame, classes: DataFrame, routed: DataFrame, roots: DataFrame, k: int, bands: Bands) -> DataFrame | None:
    """Links between components that share a home; None if no home holds two of them but in a pair that was compared."""
    of = roots.select(F.col("u").alias("node"), F.col("root").alias("part"))
    least = routed.groupBy("node").agg(F.min("home").alias("least"))
    all_of = routed.unionByName(routed.select("home", F.col("home").alias("node")).distinct())
    parted = all_of.join(of, "node", "left").select("home", "node", F.coalesce("part", "node").alias("part"))
    state = parted.groupBy("home").agg(F.min("part").alias("a"), F.max("part").alias("b"), F.count("*").alias("m"), F.max("node").alias("far"), F.min("node").alias("near"))
    # The pair of a home of two has been compared if the home is the other's least one.
    other = F.when(F.col("far") == F.col("home"), F.col("near")).otherwise(F.col("far"))
    mixed = state.where("a != b").select("home", "m", other.alias("node")).join(least, "node", "left").where("m > 2 or least != home").select("home")
    parted = materialize(parted.join(mixed, "home"), "mixed")
    if parted.isEmpty():
        return None
    sized = parted.join(classes.select("node", "n"), "node")
    sub = F.pmod(F.xxhash64("node"), F.col("subs"))
    blocks = sized.join(_blocks(sized, "home"), "home").withColumn("sub", sub).select("home", "node", "part", "sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1)).alias("other"))
    blocks = blocks.select("home", F.least("sub", "other").alias("one"), F.greatest("sub", "other").alias("two"), "sub", "node", "part")
    blocks = blocks.join(classes.select("node", "n", "bits"), "node").select("home", "one", "two", "sub", "node", "part", "n", "bits")
    blocks = blocks.repartition("home", "one", "two").sortWithinPartitions("home", "one", "two")
    groups = materialize(blocks.mapInArrow(partial(_candidate_batches, bands), "group long, node long, part long").distinct(), "candidates")
    if groups.isEmpty():
        return None
    met = _with_sets(rows, groups, classes, k).select("group", "node", "part", "set").repartition("group").sortWithinPartitions("group")
    return met.mapInArrow(partial(_link_batches, bands), "u long, v long")


def _routed(rows: DataFrame, classes: DataFrame, levels: np.ndarray, k: int, bands: Bands) -> DataFrame:
    """Distinct (home, node): the documents that share a key, but for the home itself."""
    shared = rows.sparkSession.sparkContext.broadcast(levels)  # of fixed size
    listed = rows.where("id is not null").select("text").mapInArrow(partial(_key_batches, k, bands, shared), "key long, node long")
    listed = materialize(listed, "keys")
    hot = F.col("key") >= F.lit(HOT << 56)
    cold = listed.where(~hot).repartition(max(1, -(-listed.count() // PART)), "key").mapInArrow(_home_batches, "home long, node long")
    heated = listed.where(hot)
    least = heated.groupBy("key").agg(F.min("node").alias("home"), F.max("node").alias("last")).where("home != last").select("key", "home")
    heated = heated.join(least, "key").where("home != node").select("home", "node")
    routed = cold.unionByName(heated).distinct()
    named = classes.select("route", "node")
    routed = routed.join(named.toDF("home", "h"), "home").join(named.toDF("node", "c"), "node")
    return materialize(routed.select(F.col("h").alias("home"), F.col("c").alias("node")), "homes")


def _grouped(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``th`` (hash of the text), ``n``, ``root`` (of its group; null without words or id) and ``component`` (the group's least id) of every row."""
    bands = Bands(num, den)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    made = materialize(rows.mapInArrow(partial(_class_batches, k, bands), f"id {kind}, {CLASS_ROWS}"), "classes-of-rows")
    a = made.where("slot is null").select("id", "th", "n", F.col("node").alias("route"), "more", "bits")
    # One row stands for each class: the least id, and of equal ids the least text hash.
    classes = a.where("route is not null").groupBy("route", "more").agg(F.min(F.struct("id", "th")).alias("of"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    classes = classes.select("route", "more", F.monotonically_increasing_id().alias("node"), F.col("of.id").alias("id"), F.col("of.th").alias("th"), "n", "bits")
    classes = materialize(classes, "classes")

    routed = _routed(rows, classes, _levels(made.where("slot is not null")), k, bands)
    roots = components(_first_round(rows, classes, routed, k, bands))
    more = _second_round(rows, classes, routed, roots, k, bands)
    if more is not None:
        second = components(more).toDF("root", "final")
        joined = roots.join(second, "root", "left").select("u", F.coalesce("final", "root").alias("root"))
        roots = materialize(joined.unionByName(second.toDF("u", "root")), "roots")

    named = classes.join(roots, classes["node"] == roots["u"], "left").select("route", "more", "id", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("id").alias("component"))
    named = named.join(least, "root").select("route", "more", "root", "component")
    return a.drop("bits").join(named, ["route", "more"], "left").drop("route", "more")


def jaccard_groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_shingles`` and ``component_id`` of every row: the least id that links (similarity num / den or more) reach from it."""
    out = _grouped(docs, k, num, den, id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` of each group: that of the least id, and of equal ids the least text hash; rows with a null id or without words stay.

    Rows that a Bloom filter of those to go doesn't let through stay where they are, so
    only texts of groups are shuffled.
    """
    spark = docs.sparkSession
    rows = _grouped(docs, k, num, den, id_col, text_col).where("root is not null").groupBy("root", "id", "th").agg(F.count("*").alias("times"))
    rows = materialize(rows, "rows-of-groups")
    least = rows.groupBy("root").agg(F.min(F.struct("id", "th")).alias("least"))
    rows = rows.join(least, "root").select(F.col("id").alias("__id"), F.col("th").alias("__th"), "times", (F.struct("id", "th") == F.col("least")).alias("stays"))
    odd = materialize(rows.where("not stays or times > 1"), "rows-to-go")
    shared = spark.sparkContext.broadcast(bloom.build(odd.select(F.xxhash64("__id", "__th").alias("h"))))  # of fixed size at most
    hit = F.pandas_udf(lambda h: pd.Series(shared.value.has(h.to_numpy())), "boolean")
    marked = docs.withColumn("__hash", F.xxhash64(text_col))
    marked = marked.withColumn("__hit", hit(F.xxhash64(id_col, "__hash")))
    row = (F.col(id_col) == F.col("__id")) & (F.col("__hash") == F.col("__th"))
    some = marked.where("__hit").join(odd.where("not stays").select("__id", "__th"), row, "left_anti")
    twice = odd.where("stays").select("__id", "__th")
    if not twice.isEmpty():
        one = some.join(twice, row, "left_semi").dropDuplicates([id_col, "__hash"])
        some = some.join(twice, row, "left_anti").unionByName(one)
    return marked.where("not __hit").unionByName(some).select(*[F.col(f"`{c}`") for c in docs.columns])


def sql(k: int = 3, num: int = 90, den: int = 100) -> str:
    """The groups of the table ``documents`` in DuckDB's SQL."""
    shingle = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {k - 2}), lambda i: {shingle})) END AS x FROM d),
c AS (SELECT doc_id, len(x)::BIGINT AS n, md5(array_to_string(list_sort(x), chr(10))) AS h, x FROM s),
u AS (SELECT h, min(doc_id) AS node, any_value(n) AS n, any_value(x) AS x FROM c WHERE n > 0 GROUP BY h),
e AS (SELECT node, n, unnest(x) AS t FROM u),
p AS (SELECT a.node AS a, b.node AS b FROM e a JOIN e b ON a.t = b.t AND a.node < b.node AND {den} * least(a.n, b.n) >= {num} * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING {den} * count(*) >= {num} * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT node, node AS root FROM u UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node)
SELECT c.doc_id, c.n AS n_shingles, coalesce(m.root, c.doc_id) AS component_id
FROM c LEFT JOIN u ON u.h = c.h LEFT JOIN (SELECT node, min(root) AS root FROM r GROUP BY node) m ON m.node = u.node"""
