import json

import pytest
from pyspark.sql import functions as F

from tessella.functions import measures as M
from tessella.sources import manifests, readers, sinks
from tessella.streaming.cursor import corpus_stream, drain, pack_stream


def test_memory(spark):
    rows = readers.memory(spark, ["x", {"text": "yy", "kind": "k", "n": 3}], max_chars=1).collect()
    assert [(r.text, dict(r.metadata)) for r in rows] == [("x", {"index": "0"}), ("y", {"index": "1", "kind": "k", "n": "3"})]
    assert readers.iterable(spark, lambda: iter(["z"])).count() == 1
    for bad, error in (({"a": 1}, KeyError), ({"text": 3}, TypeError), (4, TypeError)):
        with pytest.raises(error):
            readers.memory(spark, [bad])
    for kind in ("hf", "url_jsonl"):
        with pytest.raises(RuntimeError, match="no network"):
            readers.read(spark, kind)
    with pytest.raises(ValueError):
        readers.read(spark, "ftp")


def test_strict_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_bytes('﻿{"id":"1","text":"ok"}\n\n{"id":2,"text":"bad\\ud800"}\n{"id":"3","text":5}\n'.encode())
    rows = [(r.line, r.text, r.upstream_id, r.problem) for r in readers.strict_json_lines(spark, str(path)).orderBy("line").collect()]
    assert rows == [(0, "ok", "1", None), (2, None, "2", "invalid_unicode"), (3, None, "3", "non_string")]
    for line in ('{"text":"a","text":"b"}', '{"id":"","text":"a"}', "[1]", "{"):
        path.write_text(line + "\n")
        with pytest.raises(Exception, match="line 0"):
            readers.strict_json_lines(spark, str(path)).collect()


def test_parquet_provenance(spark, tmp_path):
    for i in range(2):
        spark.createDataFrame([(f"t{i}{k}", f"id{k}", "d") for k in range(3)], "text string, id string, domain string").coalesce(1).write.parquet(str(tmp_path / f"{i}"))
    df = readers.parquet_documents(spark, [str(tmp_path / "0"), str(tmp_path / "1")], "text", "id", ["domain"])
    assert [(r.artifact_index, r.row_index, r.text) for r in df.orderBy("artifact_index", "row_index").collect()] == [(i, k, f"t{i}{k}") for i in range(2) for k in range(3)]
    with pytest.raises(ValueError, match="no column"):
        readers.parquet_documents(spark, [str(tmp_path / "0")], "text", None, ["nope"])


def test_text_formats(spark):
    kv = spark.createDataFrame([("MemFree:   12 kB",), ("HugePages:  3",), ("noise",)], "value string")
    assert {r.key: r.bytes for r in readers.key_values(kv).collect()} == {"MemFree": 12288, "HugePages": 3}
    lines = ["procs ---", " r swpd free UTC", " 1 0 5 2024-01-01 00:00:00", " 2 0 6 2024-01-01 00:00:01", " x 0 6 2024-01-01 00:00:02", " 3 0 7 2024-01-01 00:00:03"]
    table = spark.createDataFrame(list(enumerate(x.replace(" UTC", "") for x in lines)), "i int, value string")
    assert [r["values"]["free"] for r in readers.vmstat(table, "i").orderBy("i").collect()] == [6.0, 7.0]
    gpu = spark.createDataFrame([("2024-01-01 00:00:00, 5, [N/A]",), ("bad, 1, 2",), ("1, 2",)], "value string")
    rows = readers.separated(gpu, ["at", "power", "clock"], ",", {"at": "yyyy-MM-dd HH:mm:ss"}, ("power", "clock")).collect()
    assert [(r.power, r.clock) for r in rows] == [(5.0, None)]
    sizes = spark.createDataFrame([("1.5GiB",), ("2kB",), ("7B",), ("x",)], "t string").select(M.size_in_bytes(F.col("t"))).collect()
    assert [r[0] for r in sizes] == [1.5 * 2**30, 2000.0, 7.0, None]


def test_sinks(spark, tmp_path):
    sinks.write_json({"b": 1, "a": "é"}, str(tmp_path / "x.json"))
    assert json.loads((tmp_path / "x.json").read_text()) == {"a": "é", "b": 1}
    with pytest.raises(ValueError):
        sinks.write_json({"a": float("nan")}, str(tmp_path / "y.json"))
    assert [p.name for p in tmp_path.iterdir()] == ["x.json"]
    assert "| a |" in sinks.markdown({"n": 1, "rows": [{"a": 1}], "m": {"k": 2}}, "t")
    df = spark.createDataFrame([("s", "ab", [10, 11, 7], 0)], "source string, text string, ids array<int>, start long")
    assert [sinks.as_form(df, f, 3, 1).count() for f in sinks.FORMS] == [1, 1, 1, 1]
    with pytest.raises(ValueError):
        sinks.as_form(df, "csv")


@pytest.fixture
def built(spark, tmp_path):
    data = tmp_path / "d.jsonl"
    data.write_text("".join(json.dumps({"id": f"i{k}", "text": f"text number {k}"}) + "\n" for k in range(20)))
    manifests.build(spark, str(data), str(tmp_path / "d.manifest.json"), "d", "pretraining", {"salt": "s", "validation_fraction": "0.4"}, {"license": "x", "terms_url": "y"})
    return tmp_path


def test_manifest_round_trip(spark, built):
    at = str(built / "d.manifest.json")
    found = manifests.verify(spark, at, "train")
    assert found.index.count() == 20 and not found.lazy
    other = manifests.verify(spark, at, "validation")
    manifests.disjoint([found], [other])
    with pytest.raises(manifests.ManifestError, match="shared"):
        manifests.disjoint([found, other], [other])
    rows = readers.read(spark, "manifest", at, "train").collect()
    assert len(rows) == found.documents.count() and all(r.metadata["assigned_split"] == "train" and r.text.startswith("text number") for r in rows)
    assert {r.metadata["document_id"] for r in rows} == {r.document_id for r in found.index.where("split = 'train'").collect()}
    with pytest.raises(manifests.ManifestError, match="names"):
        manifests.verify(spark, at, "train", expected="0" * 64)


@pytest.mark.parametrize(
    ("purpose", "selection", "access", "grant", "opens"),
    [
        ("pretraining", "train", "training", False, True), ("pretraining", "all", "training", False, False), ("memorization_smoke", "all", "training", False, True), ("memorization_smoke", "train", "training", False, False),
        ("benchmark_dev", "all", "training", True, False), ("benchmark_dev", "all", "evaluation", False, True), ("benchmark_reserved", "all", "evaluation", False, False), ("benchmark_reserved", "all", "evaluation", True, True),
        ("benchmark_reserved", "train", "evaluation", True, False), ("pretraining", "train", "other", False, False),
    ],
)
def test_guard(purpose, selection, access, grant, opens):
    if opens:
        manifests.guard({"purpose": purpose}, selection, access, grant)
    else:
        with pytest.raises(manifests.ManifestError):
            manifests.guard({"purpose": purpose}, selection, access, grant)


def lazy():
    from tessella.plans.checks import lazy_manifest

    return lazy_manifest()


def test_lazy_manifest_opens_and_scans(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    at, files = tmp_path / "m.json", []
    at.write_text(json.dumps(lazy()))
    for i in range(2):
        files.append(str(tmp_path / f"{i}.parquet"))
        pq.write_table(pa.table({"text": [f"english text {i} {k}" for k in range(30)] + [None, "", "日本"], "doc_id": pa.array([k for k in range(30)] + [None, None, None], pa.int64()), "lang": ["en"] * 33, "source": [None] * 33, "other": [1] * 33}), files[-1])
    m = lazy()
    m["source"]["data_files"].append({"path": "more.parquet", "sha256": "1" * 64, "size_bytes": 5})
    m["dataset_fingerprint"] = manifests.dataset_fingerprint_of(m)
    m["manifest_fingerprint"] = manifests.fingerprint(m)
    at.write_text(json.dumps(m))
    train, other = (manifests.verify(spark, str(at), s) for s in ("train", "validation"))
    assert train.lazy
    manifests.disjoint([train], [other])
    with pytest.raises(manifests.ManifestError, match="select"):
        manifests.disjoint([train], [train])
    sides = [readers.read(spark, "manifest", str(at), s, paths=files) for s in ("train", "validation")]
    assert sum(s.count() for s in sides) == 60
    row = sides[0].first()
    assert row.metadata["artifact_path"] in ("documents.parquet", "more.parquet") and row.metadata["fallback_id"] == "false" and row.metadata["source"] is None
    judged = manifests.scan(spark, train, files)
    from tessella.operators.accounting import event_counts

    counts = {r.event: r.n for r in event_counts(judged, "reason", ["text", "source"]).collect()}
    assert counts["rows"] == 66 and counts["non_string"] == counts["empty"] == counts["wrong_script"] == 2 and counts["null:text"] == 2 and counts["null:source"] == 66
    assert counts["accepted"] + counts["other_split_validation"] == 60
    spark.read.parquet(files[0]).drop("lang").write.parquet(str(tmp_path / "x.parquet"))
    with pytest.raises(ValueError, match="no column"):
        manifests.scan(spark, train, [files[0], str(tmp_path / "x.parquet")])


@pytest.mark.parametrize("change", ["dataset_fingerprint", "kind", "revision", "suffix", "size", "metadata", "policy", "method", "twice", "purpose", "empty"])
def test_lazy_manifest_mutations_fail(spark, tmp_path, change):
    m = lazy()
    file = m["source"]["data_files"][0]
    if change == "dataset_fingerprint":
        m["dataset_fingerprint"] = "2" * 64
    elif change == "kind":
        m["source"]["kind"] = "hf"
    elif change == "revision":
        m["source"]["revision"] = "main"
    elif change == "suffix":
        file["path"] = "documents.json"
    elif change == "size":
        file["size_bytes"] = -1
    elif change == "metadata":
        m["source"]["metadata_fields"] = ["text"]
    elif change == "policy":
        m["document_policy"]["language"] = "xx"
    elif change == "method":
        m["split"]["method"] = "other"
    elif change == "twice":
        m["source"]["data_files"].append(dict(file))
    elif change == "purpose":
        m["purpose"] = "benchmark_dev"
    elif change == "empty":
        m["source"]["data_files"] = []
    if change != "dataset_fingerprint":
        m["dataset_fingerprint"] = manifests.dataset_fingerprint_of(m)
    m["manifest_fingerprint"] = manifests.fingerprint(m)
    at = tmp_path / "m.json"
    at.write_text(json.dumps(m))
    with pytest.raises(manifests.ManifestError):
        manifests.verify(spark, str(at), "train" if change != "purpose" else "all", "training" if change != "purpose" else "evaluation")


def test_lazy_and_indexed_sets_are_not_proven(spark, built, tmp_path):
    at = tmp_path / "lazy.json"
    at.write_text(json.dumps(lazy()))
    with pytest.raises(manifests.ManifestError, match="proven"):
        manifests.disjoint([manifests.verify(spark, str(at), "train")], [manifests.verify(spark, str(built / "d.manifest.json"), "validation")])


@pytest.mark.parametrize("change", ["fingerprint", "data", "index", "field", "path", "duplicate"])
def test_manifest_mutations_fail(spark, built, change):
    at = built / "d.manifest.json"
    m = json.loads(at.read_text())
    if change == "fingerprint":
        m["name"] = "other"
    elif change == "data":
        (built / "d.jsonl").write_text('{"id":"1","text":"x"}\n')
    elif change == "index":
        (built / m["index_path"]).write_text("{}")
    elif change == "field":
        m["extra"] = 1
    elif change == "path":
        m["index_path"] = "../x"
        m["manifest_fingerprint"] = manifests.fingerprint(m)
    at.write_text(json.dumps(m) if change != "duplicate" else '{"name":1,"name":2}')
    with pytest.raises(manifests.ManifestError):
        manifests.verify(spark, str(at), "train")


def test_stream_resumes_where_it_stopped(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    files = []
    for i in range(2):
        files.append(str(tmp_path / f"{i}.parquet"))
        pq.write_table(pa.table({"text": [f"{i}-{k}" for k in range(10)]}), files[-1], row_group_size=3)
    folder = str(tmp_path / "s")
    first = drain(corpus_stream(spark, files[:1], ["text"], "f", rows=4), "append", folder)
    assert sorted(r.text for r in first.collect()) == sorted(f"0-{k}" for k in range(10))
    # The same checkpoint with one artifact more: only its rows are new.
    again = drain(corpus_stream(spark, files, ["text"], "f", rows=4), "append", folder)
    assert sorted((r.artifact, r.row) for r in again.collect()) == [(i, k) for i in range(2) for k in range(10)]


def test_stateful_packing_equals_the_batch(spark, tmp_path):
    rows = [("k", i, f"s{i % 3}", 2 + i % 7) for i in range(40)]
    for part in range(4):
        spark.createDataFrame(rows[part * 10 : part * 10 + 10], "stream string, position int, source string, n_tokens int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = "stream string, position int, source string, n_tokens int"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(pack_stream(stream, 9), "append", str(tmp_path / "s")).groupBy("window_id").agg(F.sum("source_targets").alias("t")).collect()
    total = sum(r[3] for r in rows)
    assert sorted(r.window_id for r in got) == list(range((total - 1) // 8)) and {r.t for r in got} == {8}
