import hashlib
import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as T

RAW = ["plain", "﻿  é\r\nline\r  ", "　日本語\u001c", "A  B", "a  B", " \x85x ", "", "ﬁ ª ʰ Ａ", "\r\n\ra"]


def identity(t):
    t = t[1:] if t.startswith("﻿") else t
    return unicodedata.normalize("NFC", t.replace("\r\n", "\n").replace("\r", "\n")).strip()


def test_identity_matches_python(spark):
    df = spark.createDataFrame(list(enumerate(RAW)), "i int, t string")
    got = {r.i: (r.x, r.h) for r in df.select("i", T.identity_text(F.col("t")).alias("x"), T.content_sha256(F.col("t")).alias("h")).collect()}
    for i, t in enumerate(RAW):
        assert got[i] == (identity(t), hashlib.sha256(identity(t).encode()).hexdigest())
    assert identity(RAW[1]) == "é\nline"


def test_ids_and_splits(spark):
    def digest(v):
        return hashlib.sha256(json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()

    sha = hashlib.sha256(b"x").hexdigest()
    df = spark.createDataFrame([(sha, "quellé", "7"), (sha, "s", None)], "sha string, s string, u string")
    rows = df.select("u", T.document_id_v1(F.col("s"), F.col("sha"), F.col("u")).alias("a"), T.document_id_v2(F.col("s"), F.col("sha"), F.col("u")).alias("b"), T.assign_split(F.col("sha"), "salt", "0.5").alias("x")).collect()
    by = {r.u: r for r in rows}
    assert by["7"].a == digest({"source_identity": "quellé", "upstream_id": "7"})
    assert by["7"].b == digest({"content_sha256": sha, "source_identity": "quellé", "upstream_id": "7"})
    assert by[None].a == by[None].b == digest({"content_sha256": sha, "source_identity": "s"})
    score = int.from_bytes(hashlib.sha256(f"salt\0{sha}".encode()).digest()[:8], "big")
    assert by["7"].x == ("validation" if score < 2**63 else "train")
    with pytest.raises(Exception, match="upstream_id"):
        spark.createDataFrame([("", sha)], "u string, sha string").select(T.document_id_v2(F.lit("s"), F.col("sha"), F.col("u"))).collect()


def test_thresholds():
    assert T.validation_threshold("0.2") == T.validation_threshold("0.20")
    assert T.validation_threshold("0.5") == "8" + "0" * 15
    for bad in ("0", "1", "nan", "x", 0.5):
        with pytest.raises(ValueError):
            T.validation_threshold(bad)


@pytest.mark.parametrize(
    ("text", "policy", "reason"),
    [
        (None, {}, "non_string"), ("　\u001c ", {}, "empty"), ("bad\x00text", {}, "control_character"), ("a\tb\nc", {}, None),
        (" 日本語です。 ", {"max_utf8_bytes": 7}, None), ("日", {"max_utf8_bytes": 2}, "empty_after_truncation"),
        ("english only", {"language": "ja", "reject_wrong_script": True}, "wrong_script"), ("日本", {"language": "en", "reject_wrong_script": True}, "wrong_script"),
        ("123", {"language": "en", "reject_wrong_script": True}, None), ("x\x07", {"reject_controls": False}, None),
    ],
)
def test_policy(spark, text, policy, reason):
    row = T.verdict(spark.createDataFrame([(text,)], "t string"), "t", T.DocumentPolicy(**policy)).first()
    assert row.reason == reason
    assert (row.clean is None) == (reason is not None)
    if policy.get("max_utf8_bytes") and reason is None:
        assert row.truncated and len(row.clean.encode()) <= 7


def test_policy_is_checked():
    for bad in ({"version": 2}, {"language": "de"}, {"max_utf8_bytes": 0}, {"max_utf8_bytes": True}, {"reject_controls": 1}):
        with pytest.raises(ValueError):
            T.DocumentPolicy(**bad)


def test_scripts(spark):
    def counts(t):
        ja = sum(any(a <= ord(c) <= b for a, b in ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF))) for c in t)
        is_ja = lambda c: any(a <= ord(c) <= b for a, b in ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)))
        la = sum("LATIN" in unicodedata.name(c, "") and not is_ja(c) for c in t)
        return la, ja, sum(unicodedata.category(c)[0] == "L" and not is_ja(c) and "LATIN" not in unicodedata.name(c, "") for c in t)

    texts = ["ª º ʰ Ａ ✝ ͣ", "abcÀß Привет 日本カナ 漢字", "١٢ عربي", "zß ǆ"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.script_counts(F.col("t")).alias("s")).collect()
    for r in rows:
        assert tuple(r.s) == counts(r.t)


def test_truncation(spark):
    for t in ("aé日😀b" * 3, "", "abc"):
        for n in range(1, 20):
            data = t.encode()[:n]
            while True:
                try:
                    want = data.decode()
                    break
                except UnicodeDecodeError:
                    data = data[:-1]
            assert spark.createDataFrame([(t,)], "t string").select(T.truncate_utf8(F.col("t"), n)).first()[0] == want


def test_fingerprints_do_not_depend_on_order(spark):
    rows = [(f"d{i}", f"c{i % 3}", "train" if i % 2 else "validation") for i in range(9)]
    want = None
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, "document_id string, content_sha256 string, split string")
        got = (T.dataset_fingerprint(df).first()[0], T.dataset_fingerprint(df, "train").first()[0])
        want = want or got
        assert got == want
    docs = sorted(({"content_sha256": c, "document_id": d, "split": s} for d, c, s in rows), key=lambda r: (r["document_id"], r["content_sha256"], r["split"]))
    assert want[0] == hashlib.sha256(T.canonical_json({"documents": docs})).hexdigest()
