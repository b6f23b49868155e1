import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessella.functions import records
from tessella.operators import runs as R


def test_records():
    config = {"model": {"n": 1}, "wandb": {"mode": "x"}, "artifacts": {"resume_path": "p", "dir": "d"}}
    other = {"model": {"n": 1}, "wandb": {"mode": "y"}, "artifacts": {"resume_path": None, "dir": "d"}, "measurement": 3}
    assert records.experiment_id(config) == records.experiment_id(other) and len(records.experiment_id(config)) == 24
    assert records.experiment_id(config) != records.experiment_id({**config, "model": {"n": 2}})
    assert config["wandb"] == {"mode": "x"}
    assert records.secret_keys({"a": {"hf_token": "x"}, "max_tokens": 5, "b": [{"password": "y"}], "api_key": ""}) == ["a.hf_token", "b.0.password"]
    assert records.types_in({"type": "B", "x": [{"type": "A"}, {"type": "B"}]}) == ["B", "A"]
    payload = records.reproduction({"a": 1}, ["run"])
    assert records.reproduction_holds(payload) and not records.reproduction_holds({**payload, "config": {"a": 2}})
    with pytest.raises(ValueError, match="secrets"):
        records.reproduction({"api_key": "k"}, [])
    assert records.effective_tokens(2, 3, 4) == 24


def test_source_guards():
    good = [{"name": "a", "ratio": 0.5, "type": "hf", "revision": "0" * 40}, {"name": "b", "ratio": 0.5, "type": "jsonl"}]
    records.check_sources(good)
    for change in ({"ratio": 0.6}, {"name": "b"}, {"revision": "main"}, {"ratio": True}, {"ratio": -0.5}):
        with pytest.raises(ValueError):
            records.check_sources([{**good[0], **change}, good[1]])
    with pytest.raises(ValueError, match="manifest"):
        records.check_sources(good, manifest_only=True)


def test_inventory(spark):
    df = spark.createDataFrame([("d/b.parquet", 2, "0" * 64), ("d/a.parquet", 2, "1" * 64), ("d/c.parquet", 1, "2" * 64), ("e/x.parquet", 1, "3" * 64), ("d/readme", 1, "4" * 64)], "path string, size_bytes long, sha256 string")
    assert [r.path for r in R.inventory(df, "d/").orderBy("artifact_index").collect()] == ["d/c.parquet", "d/a.parquet", "d/b.parquet"]
    with pytest.raises(Exception, match="without size or hash"):
        R.inventory(df.withColumn("sha256", F.lit("x")), "d/").collect()


def test_lineage(spark):
    s = spark.createDataFrame([(0, None, 0), (1, "b0", 10), (2, "b9", 20), (3, "b1", 7), (4, None, 3)], "segment int, parent string, start_step int")
    b = spark.createDataFrame([("b0", 0, 10), ("b1", 1, 20)], "boundary string, segment int, step int")
    rows = {r.segment: r.problem for r in R.lineage_breaks(s, b).collect()}
    assert rows == {2: "no such parent", 3: "does not start where its parent ends", 4: "does not start at 0"}


def test_resources(spark):
    schema = "k string, t double, reads long, swap long"
    a, b = spark.createDataFrame([("p", 0.0, 10, 8)], schema), spark.createDataFrame([("p", 2.0, 4, 2)], schema)
    r = R.resource_rates(a, b, "k", "t", ["reads", "swap"], ["swap"]).first()
    assert (r.reads_per_second, r.swap_per_second) == (0.0, -3.0)


def test_round_trips_and_determinism(spark):
    df = spark.createDataFrame([("s", i, "x", "x" if i % 2 else "y") for i in range(30)], "s string, i int, t string, d string")
    r = R.round_trips(df, ["s"], "t", "d", "i", F.lit(1), F.lit(0), examples=3).first()
    assert (r.texts, r.failures, r.unknown, r.examples) == (30, 15, 30, [0, 2, 4])
    outcomes = spark.createDataFrame([("a", True, "E"), ("a", True, "E"), ("b", False, None), ("b", False, "x")], "k string, rejected boolean, outcome string")
    assert {r.k: (r.rejected, r.deterministic) for r in R.deterministic(outcomes, "k").collect()} == {"a": (True, True), "b": (False, False)}


def test_small_rules(spark):
    now = dt.datetime(2024, 1, 1, 12)
    df = spark.createDataFrame([(now - dt.timedelta(seconds=s), now) for s in (-90, -30, 10, 100)], "a timestamp, b timestamp")
    assert [r[0] for r in df.select(R.fresh(F.col("a"), F.col("b"), 50)).collect()] == [False, True, True, False]
    shards = spark.createDataFrame([("a", 1, True), ("b", 2, False), ("c", 3, False)], "path string, used_at int, leased boolean")
    assert R.eviction_victim(shards).first().path == "b"
    edges = spark.createDataFrame([(1e9, 1.04e9), (1e9, 1.2e9)], "first_median double, last_median double")
    assert [r.stable for r in R.memory_stable(edges).collect()] == [True, False]
    assert spark.range(1).select(R.slowed(F.lit(10.0), F.lit(9.0), F.lit(10.0)), R.slowed(F.lit(10.0), F.lit(11.0), F.lit(10.0))).first()[:] == (9.0, 10.0)
    samples = spark.createDataFrame([("h", float(i), 0.5) for i in range(0, 30, 3)], "h string, t double, took double")
    assert R.expected_samples(samples, ["h"], "t", "took", 2.5).first().coverage == 1.0
    assert R.telemetry_stream(spark).isStreaming
