import io
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tessella.llm import packing, sst
from tessella.llm.token_counts import token_counts, whole_tokens
from tessella.llm.tokens import Encoder

from .helpers import TEXTS, documents, none

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


def library(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_units_give_the_library_s_ids(path):
    rng = random.Random(5)
    parts = ["the", "Cat", "é", "'s", " ", "  ", "\n", "\t", "\r\n", ".", ",,", "!!", "12", "½", "日本", "\xa0", "\x1c", "\x85", "<|", "<|endoftext|>", "ÀÉ", "İ", "ΣΑΣ", "é", "don't"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(3000)] + [t or "" for t in TEXTS]
    texts += [" ".join(rng.choice(parts) for _ in range(8)) for _ in range(2000)]
    encoder = Encoder(open(path, encoding="utf-8").read(), path == BYTE)
    assert [t for t in texts if encoder.ids(t) != encoder.whole(t)] == []


def test_whole_tokens_are_proved():
    tk = Tokenizer.from_file(BYTE)
    proved = whole_tokens(tk)
    assert len(proved) > 30_000
    some = random.Random(1).sample(sorted(proved), 500)
    assert all(len(tk.encode(t, add_special_tokens=False).ids) == 1 for t in some)


def test_counts(spark):
    rows = {r.doc_id: r for r in token_counts(documents(spark), BYTE).collect()}
    for i, t in enumerate(TEXTS):
        n = len(library(BYTE, t))
        assert (rows[i].n_bytes, rows[i].n_tokens, rows[i].over_limit) == (len((t or "").encode()), n, n > 1024)
    assert token_counts(documents(spark, copies=3), BYTE).count() == 3 * len(TEXTS)
    assert token_counts(none(spark), BYTE).count() == 0
    with pytest.raises(ValueError):
        token_counts(documents(spark), WORD)


def test_shards_round_trip(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    docs = documents(spark).unionByName(documents(spark, ["null id"]).selectExpr("cast(null as long) AS doc_id", "text", "lang", "source", "n_chars", "score", "length", "ids"))
    sst.write_shards(docs.repartition(3), root, BYTE, 2)
    rows = sorted(sst.read_shards(spark, root).collect(), key=lambda r: r.start)
    assert [r.id for r in rows] == [None, *range(len(TEXTS))]  # a null key comes first
    at = 0
    for r in rows:
        ids = np.array([*library(BYTE, "null id" if r.id is None else TEXTS[r.id]), 2], "<u4")
        assert (r.start, r.n_tokens, bytes(r.ids)) == (at, len(ids), ids.tobytes())
        at += len(ids)
    assert sst.lookup(spark, root, 7) == [np.array([*library(BYTE, TEXTS[7]), 2], "<u4").tobytes()]
    assert sst.lookup(spark, root, 10**6) == []
    empty = f"file://{tmp_path}/e"
    sst.write_shards(none(spark), empty, BYTE, 2)
    assert sst.read_shards(spark, empty).count() == 0


def test_shards_keep_repeated_and_text_ids(spark, tmp_path):
    df = spark.createDataFrame([("b", "x"), ("a", "y"), ("b", "x"), ("b", None)], "doc_id string, text string")
    root = f"file://{tmp_path}/s"
    sst.write_shards(df, root, BYTE, 2)
    rows = sorted(sst.read_shards(spark, root, "string").collect(), key=lambda r: r.start)
    assert [r.id for r in rows] == ["a", "b", "b", "b"] and len(sst.lookup(spark, root, "b")) == 3


def test_sorted_table_in_memory():
    rng = random.Random(2)
    keys = sorted(sst.to_key(rng.randrange(-(2**40), 2**40)) for _ in range(5000))
    values = [bytes(rng.randrange(256) for _ in range(rng.randrange(40))) for _ in keys]
    sink = io.BytesIO()
    writer = sst.ShardWriter(sink)
    for k, v in zip(keys, values, strict=True):
        writer.add(k, v)
    writer.finish()
    reader = sst.ShardReader(sink)
    assert list(reader.scan()) == list(zip(keys, values, strict=True)) and len(reader.index) > 1
    held = set(keys)
    reader.blocks_read = 0
    for i in rng.sample(range(5000), 50):
        assert values[i] in reader.get(keys[i])
    assert reader.blocks_read <= 100  # a lookup reads one block, two at a block's end
    absent = [k for k in (sst.to_key(x) for x in range(3000)) if k not in held]
    assert sum(map(reader.may_hold, absent)) < 0.05 * len(absent)
    with pytest.raises(ValueError):
        sst.ShardWriter(io.BytesIO()).add(b"b", b"") or writer.add(b"\0", b"")
    broken = bytearray(sink.getvalue())
    broken[10] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        list(sst.ShardReader(io.BytesIO(bytes(broken))).scan())
    for x in (0, 5, 2**15, 2**20):
        ids = np.array([x, 1], "<u4").tobytes()
        assert sst.from_value(sst.to_value(ids)) == ids
    assert [sst.from_key(sst.to_key(x), isinstance(x, str)) for x in (-5, 0, 2**62, "é")] == [-5, 0, 2**62, "é"] and sst.from_key(b"\0", False) is None


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark):
    packed = packing.pack_documents(documents(spark), WORD, capacity=64)
    rows = packed.collect()
    n = check_places(rows, 64)
    for i, t in enumerate(TEXTS):
        want = np.array([*library(WORD, t), 1], "<u4")
        got = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.start for r in got] == list(range(0, len(want), 64)) and b"".join(bytes(r.ids) for r in got) == want.tobytes()
    assert n <= -(-sum(r.length for r in rows) // 64) + 1
    whole = packing.sequences(packed).collect()
    assert sum(r.length for r in whole) == sum(r.length for r in rows) and all(len(r.ids) == 4 * r.length for r in whole)
    assert packing.pack_documents(none(spark), WORD).count() == 0
    assert packing.pack_documents(documents(spark, copies=3), WORD, capacity=64).count() == 3 * len(rows)


def test_place_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 50)
    monkeypatch.setattr(packing, "FAN", 3)
    rng = random.Random(8)
    lengths = [min(100, int(rng.expovariate(1 / 30)) + 1) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(lengths)), "uid long, length long")
    rows = packing.place(df, 100).join(df, "uid").collect()
    assert len(rows) == 3000
    assert check_places(rows, 100) <= 1.02 * sum(lengths) / 100 + 1


def test_local_search_saves_bins():
    def bins(lengths, groups):
        return packing.local_search([list(g) for g in groups], np.array(lengths), 10)

    assert len(bins([6, 4, 6, 4], [[0], [1, 3], [2]])) == 2  # moves
    assert len(bins([5, 3, 2, 7, 3], [[0, 1], [3], [2, 4]])) == 2  # an exchange makes room
    rng = np.random.default_rng(0)
    for _ in range(30):
        lengths = rng.integers(1, 60, 80)
        start = packing.best_fit(lengths, 100)
        end = packing.local_search(start, lengths, 100)
        assert sorted(i for b in end for i in b) == list(range(80)) and len(end) <= len(start)
        assert all(lengths[b].sum() <= 100 for b in end)
        assert len(end) <= -(-lengths.sum() // 100) + 1


def test_checksums_are_of_the_ids(spark):
    from pyspark.sql import functions as F

    rows = packing.pack_documents(documents(spark, ["abc def"]), WORD, keep=(F.crc32("ids").alias("c"),)).collect()
    assert rows[0].c == zlib.crc32(np.array([*library(WORD, "abc def"), 1], "<u4").tobytes())
