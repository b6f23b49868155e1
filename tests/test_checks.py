import hashlib

import pytest
from pyspark.sql import functions as F

from tessella.functions import records
from tessella.functions.tokens import END, Bytes, with_end
from tessella.operators import checks as C
from tessella.operators import fixed_windows as W
from tessella.operators import probes, quotas, schedule


def test_layout_of_windows(spark):
    rows = lambda *a, **k: [tuple(r) for r in W.layout(spark, *a, **k).orderBy("window_id").collect()]
    assert rows(10, 4) == [(0, 4, 3), (1, 4, 3), (2, 4, 3)]
    assert rows(11, 4) == [(0, 4, 3), (1, 4, 3), (2, 4, 3)] and rows(11, 4, keep_tail=True)[-1] == (3, 2, 1)
    assert rows(11, 4, budget=5) == [(0, 4, 3), (1, 3, 2)] and rows(11, 4, budget=6) == [(0, 4, 3), (1, 4, 3)]
    assert rows(0, 4) == rows(1, 4, keep_tail=True) == []
    with pytest.raises(ValueError, match="1 targets"):
        W.layout(spark, 11, 4, budget=10)
    assert rows(11, 4, keep_tail=True, budget=10)[-1] == (3, 2, 1)


def test_cut_texts_match_their_ids(spark):
    df = spark.createDataFrame([("abcdef",), ("äöü",), ("ab",), ("",), (None,)], "t string").withColumn("ids", with_end(Bytes().encode(F.col("t"))))
    out = [tuple(r) for r in df.select(quotas.cut_ids(F.col("ids"), F.lit(4), END), quotas.cut_bytes(F.col("t"), F.lit(4))).collect()]
    assert out[0] == ([105, 106, 107, END], "abc") and out[1] == ([203, 172, 203, END], "ä") and out[2] == ([105, 106, END], "ab") and out[3] == ([END], "") and out[4] == (None, None)


def test_targets_that_cannot_be_met_are_an_error():
    mix = schedule.Mix({"a": 0.5, "b": 0.5}, targets={"a": 30, "b": 30}, width=5, by_debt=True)
    plan = schedule.replay({"a": [8] * 9, "b": [8] * 9}, mix)
    assert sum(r[4] for r in plan) >= 60
    with pytest.raises(ValueError, match="target quotas"):
        schedule.replay({"a": [8] * 9, "b": [8]}, mix)


def test_next_pass_goes_on_behind_the_last():
    lengths = {"a": [3] * 10, "b": [3] * 10}
    mix = schedule.Mix({"a": 0.5, "b": 0.5}, seed=3, quotas={"a": 9, "b": 12})
    first = schedule.replay(lengths, mix)
    start = schedule.next_pass(first, lengths, False)
    assert start == {"a": 3, "b": 4} and schedule.next_pass(first, lengths, True) is None
    second = schedule.replay(lengths, schedule.Mix({"a": 0.5, "b": 0.5}, seed=3, quotas={"a": 9, "b": 12}, first=start))
    assert not {r[1:3] for r in first} & {r[1:3] for r in second} and min(r[2] for r in second if r[1] == "a") == 3


def test_bounded_and_quality(spark):
    df = spark.createDataFrame([(i, "s", None if i % 2 else "empty", i == 2) for i in range(6)], "i int, s string, reason string, truncated boolean")
    assert {r.bounded for r in C.bounded(df, ["i"], 6).collect()} == {True} and {r.bounded for r in C.bounded(df, ["i"], 7).collect()} == {False}
    assert {r.event: r.n for r in C.quality_counts(df, "s", "reason", "truncated", F.col("i") == 5).collect()} == {"accepted": 2, "empty": 3, "truncated": 1, "duplicate": 1}


def test_frames_keep_parts_apart(spark):
    schema = "g int, o int, a string, b string"
    one = spark.createDataFrame([(1, 0, "ab", "c"), (1, 1, None, "")], schema)
    two = spark.createDataFrame([(1, 0, "a", "bc"), (1, 1, None, "")], schema)
    three = spark.createDataFrame([(1, 1, None, ""), (1, 0, "ab", "c")], schema).repartition(2)
    digests = [C.framed_digest(d, "g", ["o"], ["a", "b"]).first().digest for d in (one, two, three, one.where("o = 0"))]
    assert digests[0] == digests[2] and len(set(digests)) == 3


def test_strata_and_identities(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3)], "s string, k int")
    want = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1)], "s string, expected long")
    assert {r.s: r.holds for r in C.strata(df, "s", "k", want).collect()} == {"a": False, "b": True, "c": False, None: False}
    assert [r.identities for r in C.identity_conflicts(df.withColumn("x", F.when(F.col("k") == 2, None).otherwise(F.col("k"))), "s", F.col("x")).collect()] == []


def test_cadence_of_logs(spark):
    rows = [(1, s) for s in (10, 20, 30)] + [(2, s) for s in (10, 30)] + [(3, s) for s in (10, 20, 25)]
    df = spark.createDataFrame(rows, "run int, step int").withColumn("last", F.lit(35))
    assert {r.run: r.on_cadence for r in C.off_cadence(df, ["run"], "step", 10, "last").collect()} == {1: True, 2: False, 3: False}


def test_passes_and_processes(spark):
    out = probes.passes(lambda: spark.range(10), measured=2)
    assert out["rows"] == 10 and len(out["seconds"]) == 2 and out["least"] <= out["median"] <= out["greatest"]
    state = iter(range(100))
    with pytest.raises(RuntimeError, match="changed"):
        probes.passes(lambda: spark.range(next(state) + 1))
    assert probes.fresh_process("import json; print(json.dumps({'a': 1}))")["a"] == 1
    with pytest.raises(RuntimeError, match="boom"):
        probes.fresh_process("raise SystemExit('boom')")


def test_seeds_plans_and_signatures():
    assert [records.split_seed(7, s) for s in ("train", "validation")] == [7, 8]
    runs = [{"candidate_id": "c", "repetition": 1}, {"candidate_id": "c", "repetition": 2}]
    plan = {"runs": runs}
    plan["plan_id"] = records.fingerprint(plan)
    records.check_plan(plan, runs, ["c/1", "c/2"])
    for bad in (({**plan, "x": 1}, runs, ["c/1", "c/2"]), (plan, runs[:1], ["c/1"]), (plan, runs, ["c/1", "c/1"])):
        with pytest.raises(ValueError):
            records.check_plan(*bad)
    records.comparable([{"a": 1}, {"a": 1}])
    with pytest.raises(ValueError):
        records.comparable([{"a": 1}, {"a": 2}])
    assert records.numbers_in({"a": 1, "b": {"c": 2.5, "d": True, "e": float("nan")}, "f": [3]}) == {"a": 1.0, "b.c": 2.5, "f.0": 3.0}


def test_tokenizer_manifest():
    data = b"file"
    m = {"files": {"t": {"sha256": hashlib.sha256(data).hexdigest(), "size_bytes": 4}}, "vocabulary_size": 3, "special_tokens": {"<e>": 2}, "probes": [{"text": "ab", "ids": [0, 1]}]}
    vocab = {"a": 0, "b": 1, "<e>": 2}
    encode, decode = lambda t: [vocab[c] for c in t], lambda ids: "".join("ab"[i] for i in ids)
    records.check_tokenizer(m, {"t": data}, vocab, encode, decode)
    for change in ({"vocabulary_size": 4}, {"special_tokens": {"<e>": 1}}, {"probes": [{"text": "ab", "ids": [1]}]}, {"files": {"t": {"sha256": "0" * 64, "size_bytes": 4}}}):
        with pytest.raises(ValueError):
            records.check_tokenizer({**m, **change}, {"t": data}, vocab, encode, decode)


def test_run_manifests():
    m = records.run_manifest({"a": 1}, ["run"], {"x": b"1", "y": b"2"}, "c0", b"lock")
    assert records.run_differences(m, {"x": b"1", "y": b"2"}, "c0", b"lock") == []
    assert records.run_differences(m, {"x": b"3", "z": b""}, "c1", b"other") == ["input x", "input y", "input z", "git commit", "lock"]
    assert records.run_differences({**m, "config": {"a": 2}}, {"x": b"1", "y": b"2"}, "c0", b"lock") == ["configuration"]


def test_a_choice_has_to_be_unique(spark):
    from tessella.operators import selection

    assert selection.only(spark.range(1)).id == 0
    for n, message in ((0, "no choice"), (2, "unique")):
        with pytest.raises(ValueError, match=message):
            selection.only(spark.range(n))


def test_metrics_keep_named_nulls(spark, tmp_path):
    import json

    from tessella.sources import sinks

    df = spark.createDataFrame([(1, None, None), (2, 0.5, "x"), (None, None, None)], "step int, loss double, note string").coalesce(1)
    sinks.append_metrics(df, str(tmp_path / "m"), keep_null=("loss",))
    lines = [json.loads(x) for f in (tmp_path / "m").glob("part-*") for x in f.read_text().splitlines()]
    assert lines == [{"step": 1, "loss": None}, {"step": 2, "loss": 0.5, "note": "x"}, {"loss": None}]


def test_cursors_are_bound(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tessella.streaming.cursor import _Reader

    pq.write_table(pa.table({"text": ["a", "b", "c"]}), str(tmp_path / "0.parquet"))
    options = {"files": f'["{tmp_path}/0.parquet"]', "columns": '["text"]', "fingerprint": "f", "seed": "3", "names": '["a", "b"]', "rows": "2"}
    reader = _Reader(options)
    start, end = reader.initialOffset(), reader.latestOffset()
    assert not start["complete"] and end["complete"] and [(p.first, p.last) for p in reader.partitions(start, end)] == [(0, 2), (2, 3)]
    for key, value in (("fingerprint", "g"), ("seed", "4"), ("names", '["b", "a"]')):
        with pytest.raises(ValueError, match=key):
            _Reader({**options, key: value}).partitions(start, end)
    with pytest.raises(ValueError, match="version"):
        reader.partitions({**start, "version": 0}, end)
