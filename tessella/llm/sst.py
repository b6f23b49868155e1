"""Sorted-string-table shards of token ids.

A shard is one file, written in ascending key order:

    data block*    zstd of entries: varint shared, varint unshared, varint value size,
                   key suffix, value; every RESTART-th entry has its whole key
    Bloom filter   K bits a key, double hashing of xxhash64
    sparse index   last key, offset and size of each block
    footer         offsets and sizes of filter and index, number of keys, magic

A lookup reads the footer, filter and index, and at most one block for a key that
is there (more only if equal keys cross a block's end). Keys order as the ids do:
``00`` for null, else ``01`` and the id (big-endian with the sign bit flipped for
integers, UTF-8 for strings). A value is a varint count, a width byte (2 or 4)
and that many little-endian ids.

Writing sorts the documents by id across partitions (one range shuffle of the
texts), encodes each partition and streams it into files of the shared folder. A
file is named for its task attempt; only files named by the manifest, which holds
the rows of the tasks that succeeded, belong to the table, so a task that is run
again or lost leaves no trace in results.

Null texts count as empty, so a document always has its end id. Rows that repeat
an id are all kept, next to each other. Columns other than the two named ones are
not read.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.tokens import Vocabulary, strings

MAGIC = b"TSSLSST1"
BLOCK_BYTES, RESTART, BITS_A_KEY, PROBES, SHARD_BYTES = 1 << 16, 16, 10, 7, 1 << 28
_FOOTER = struct.Struct("<QQQQQ8s")
MANIFEST = "file string, keys long, tokens long, first_key binary, last_key binary, bytes long"


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def to_key(x: int | str | None) -> bytes:
    if x is None:
        return b"\0"
    return b"\1" + (x.encode() if isinstance(x, str) else struct.pack(">Q", x + (1 << 63)))


def from_key(key: bytes, text: bool) -> int | str | None:
    if key == b"\0":
        return None
    return key[1:].decode() if text else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def to_value(ids: bytes) -> bytes:
    a = np.frombuffer(ids, "<u4")
    narrow = not a.size or a.max() < 1 << 16
    return varint(a.size) + (b"\2" + a.astype("<u2").tobytes() if narrow else b"\4" + ids)


def from_value(value: bytes) -> bytes:
    n, at = read_varint(value, 0)
    return np.frombuffer(value, "<u2" if value[at] == 2 else "<u4", n, at + 1).astype("<u4").tobytes()


def _probes(key: bytes, bits: int) -> list[int]:
    import xxhash

    h = xxhash.xxh64_intdigest(key)
    step = (h >> 32) | 1
    return [(h + i * step) % bits for i in range(PROBES)]


class ShardWriter:
    def __init__(self, sink):
        import zstandard

        self.sink, self.pack = sink, zstandard.ZstdCompressor(level=1).compress
        self.at, self.block, self.in_block, self.last = 0, bytearray(), 0, b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []

    def add(self, key: bytes, value: bytes) -> None:
        if self.keys and key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.in_block % RESTART:
            for a, b in zip(key, self.last, strict=False):
                if a != b:
                    break
                shared += 1
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.in_block += 1
        self.last = key
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _write(self, data: bytes) -> tuple[int, int]:
        self.sink.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def _flush(self) -> None:
        if self.block:
            data = self.pack(bytes(self.block))
            self.index.append((self.last, *self._write(data + struct.pack("<I", zlib.crc32(data)))))
            self.block, self.in_block = bytearray(), 0

    def finish(self) -> int:
        self._flush()
        bits = max(64, len(self.keys) * BITS_A_KEY + 7 >> 3 << 3)
        bloom = bytearray(bits >> 3)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        at_bloom = self._write(bytes(bloom))
        at_index = self._write(b"".join(varint(len(k)) + k + varint(o) + varint(n) for k, o, n in self.index))
        self._write(_FOOTER.pack(*at_bloom, *at_index, len(self.keys), MAGIC))
        return self.at


class ShardReader:
    """Random and sequential access to a shard; ``source`` is a seekable binary file."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, 2)
        at_bloom, n_bloom, at_index, n_index, self.n_keys, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.bloom = self._read(at_bloom, n_bloom)
        data, at, self.index = self._read(at_index, n_index), 0, []
        while at < len(data):
            n, at = read_varint(data, at)
            key, at = data[at : at + n], at + n
            o, at = read_varint(data, at)
            n, at = read_varint(data, at)
            self.index.append((key, o, n))
        self.lasts = [k for k, _, _ in self.index]
        self.blocks_read = 0

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        import zstandard

        data = self._read(*self.index[i][1:])
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a block's checksum differs")
        data, at, key = zstandard.ZstdDecompressor().decompress(data[:-4]), 0, b""
        self.blocks_read += 1
        while at < len(data):
            shared, at = read_varint(data, at)
            own, at = read_varint(data, at)
            size, at = read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, data[at : at + size]
            at += size

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, len(self.bloom) * 8))

    def get(self, key: bytes) -> list[bytes]:
        """The values of a key: none, one, or more if the key was repeated."""
        found: list[bytes] = []
        if self.may_hold(key):
            for i in range(bisect.bisect_left(self.lasts, key), len(self.index)):
                for k, v in self.block(i):
                    if k == key:
                        found.append(v)
                    elif k > key:
                        return found
        return found

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.index)):
            yield from self.block(i)


def file_system(path: str):
    """The Arrow file system of a path or URI, and the path there."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)


def _write_shards(vocabulary: Vocabulary, root: str, end: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    encode, (fs, at) = vocabulary.encoder().ids, file_system(root)
    part, out, sink, writer = TaskContext.get().partitionId(), [], None, None
    tokens, first = 0, b""

    def close():
        sink_size = writer.finish()
        sink.close()
        out.append((name, len(writer.keys), tokens, first, writer.last, sink_size))

    try:
        for batch in batches:
            for x, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                ids, key = encode(text or "") + end, to_key(x)
                if writer is None:
                    fs.create_dir(at, recursive=True)
                    name, tokens, first = f"{part:06d}-{uuid.uuid4().hex}.sst", 0, key
                    sink = fs.open_output_stream(f"{at}/{name}")
                    writer = ShardWriter(sink)
                writer.add(key, to_value(ids))
                tokens += len(ids) // 4
                if writer.at >= SHARD_BYTES:
                    close()
                    writer = None
        if writer is not None:
            close()
            writer = None
    finally:
        if writer is not None:
            sink.close()
    cols = list(zip(*out, strict=True)) or [()] * 6
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["file", "keys", "tokens", "first_key", "last_key", "bytes"])


def write_shards(docs: DataFrame, root: str, vocabulary_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode ``docs`` into shards under ``root``; returns the manifest (a row a shard), kept at ``root``/manifest.

    ``id_col`` must be of an integer type or a string. Equal ids are spread by
    their text, so that one id can't hold up a whole partition.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.typeName()
    id_ = F.col(id_col) if kind == "string" else F.col(id_col).cast("long")
    rows = docs.select(id_.alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(F.col("id"), F.xxhash64("text")).sortWithinPartitions("id")
    vocabulary = Vocabulary(spark, vocabulary_path)
    rows.mapInArrow(partial(_write_shards, vocabulary, root, struct.pack("<I", end_id)), MANIFEST).write.parquet(f"{root}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def _read_shards(root: str, text: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fs, at = file_system(root)

    def out(rows):
        a, b, c, d = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.string() if text else pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.binary())], names=["id", "start", "n_tokens", "ids"])

    for batch in batches:
        for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows, size = [], 0
            with fs.open_input_file(f"{at}/{name}") as f:
                for key, value in ShardReader(f).scan():
                    ids = from_value(value)
                    rows.append((from_key(key, text), start, len(ids) // 4, ids))
                    start += len(ids) // 4
                    size += len(ids)
                    if size >= 1 << 23:
                        yield out(rows)
                        rows, size = [], 0
            if rows:
                yield out(rows)


def read_shards(spark: SparkSession, root: str, id_type: str = "long") -> DataFrame:
    """``id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids`` of every document, from the files.

    The offsets of the shards are a running sum over the manifest, a row a shard.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    before = Window.orderBy("first_key", "last_key", "file").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))
    tasks = max(1, manifest.count())
    return shards.repartition(tasks).mapInArrow(partial(_read_shards, root, id_type == "string"), f"id {id_type}, start long, n_tokens long, ids binary")


def lookup(spark: SparkSession, root: str, x: int | str) -> list[bytes]:
    """The ids of one document: the manifest names the shards whose key range covers it, each answers by Bloom filter and binary search."""
    key, (fs, at) = to_key(x), file_system(root)
    rows = spark.read.schema(MANIFEST).parquet(f"{root}/manifest").where((F.col("first_key") <= F.lit(key)) & (F.col("last_key") >= F.lit(key)))
    found = []
    for r in sorted(rows.collect(), key=lambda r: (bytes(r.first_key), bytes(r.last_key), r.file)):
        with fs.open_input_file(f"{at}/{r.file}") as f:
            found += map(from_value, ShardReader(f).get(key))
    return found
