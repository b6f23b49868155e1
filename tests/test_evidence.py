import math

from pyspark.sql import functions as F

from tessella.functions import measures as M
from tessella.operators import accounting as A
from tessella.operators import evidence as E
from tessella.operators import selection as S


def test_losses(spark):
    df = spark.createDataFrame([("a", 10.0, 5), ("a", 2.0, 1), ("b", 8000.0, 10), ("c", 0.0, 0)], "c string, l double, n long")
    rows = {r.c: r for r in E.weighted_nll(df, "c", "l", "n").collect()}
    assert rows["a"].nll == 2.0 and abs(rows["a"].perplexity - math.exp(2)) < 1e-12
    assert rows["b"].overflow and rows["b"].perplexity is None
    assert rows["c"].nll is None and not rows["c"].overflow
    assert rows[None].targets == 16


def test_gates_and_finiteness(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "x double")
    assert not df.agg(E.all_finite(["x"])).first()[0]
    assert df.limit(2).agg(E.all_finite(["x"])).first()[0]
    v = spark.createDataFrame([(False, True)], "failed boolean, warned boolean")
    assert E.verdict(v, "failed", "warned").first()[0] == "PASS WITH NOTE"


def test_sequences_and_inventories(spark):
    df = spark.createDataFrame([(1,), (2,), (5,)], "step long")
    assert {(r.step, r.problem) for r in E.sequence_gaps(df, "step", 3).collect()} == {(3, "missing"), (5, "extra")}
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "path string, sha256 string")
    b = spark.createDataFrame([("x", "1"), ("y", "9"), ("w", "4")], "path string, sha256 string")
    assert {(r.path, r.problem) for r in E.inventory_problems(a, b).collect()} == {("y", "changed"), ("z", "missing"), ("w", "extra")}
    assert [r.column for r in E.disagreements(b, ["path"]).collect()] == ["path"]


def test_maps_and_histograms(spark):
    df = spark.sql("SELECT 1 AS r, 10.0D AS wall, map('a', 2.0D, 'b', 3.0D) AS p, array(1, 2) AS c, array(0.0D, 1.0D, 2.0D) AS bins")
    row = df.select(E.unexplained(F.col("wall"), F.col("p"), F.lit(1.0)), E.has_phases(F.col("p"), ["a"]), E.has_phases(F.col("p"), ["z"]), E.valid_histogram(F.col("c"), F.col("bins"))).first()
    assert tuple(row) == (4.0, True, False, True)
    assert {r.phase: r.seconds for r in E.phase_sums(df, ["r"], "p").collect()} == {"a": 2.0, "b": 3.0}


def test_lifecycle(spark):
    df = spark.createDataFrame([(1, "start", "ok"), (1, "stop", "ok"), (2, "start", "failed")], "run int, action string, outcome string")
    rows = {r.run: (r.complete, r.clean) for r in E.lifecycle(df, ["run"], [("start", "ok"), ("stop", "ok")], [("start", "failed")]).collect()}
    assert rows == {1: (True, True), 2: (False, False)}


def test_selection(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0, 5.0), ("b", 2.0, 2.0, 4.0), ("c", 1.0, 1.0, 5.0)], "id string, x double, y double, v double")
    assert {r.id for r in S.pareto(df, "id", ["x", "y"], ["v"]).collect()} == {"a", "c"}  # equal rows don't dominate each other
    own = spark.createDataFrame([("f", 1.0), ("c", 3.0)], "name string, value double")
    kept = spark.createDataFrame([("f", "floor", 2.0), ("c", "ceiling", 4.0), ("g", "floor", 1.0)], "name string, kind string, value double")
    assert {r["name"] for r in S.weaker_thresholds(own, kept).collect()} == {"f", "g"}
    assert spark.range(1).select(S.checkpoint_bytes(F.lit(10), F.lit(25), 10, F.lit(1))).first()[0] == 10 * 9 + 1


def test_schedule_of_rates(spark):
    rows = [r[0] for r in spark.range(5).select(M.warmup_cosine(F.col("id"), 0, 4, 0.0)).collect()]
    assert [round(x, 6) for x in rows] == [round(0.5 * (1 + math.cos(math.pi * k / 4)), 6) for k in range(5)]


def test_accounting(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "i int, k string")
    assert {r.i: r.duplicate for r in A.with_duplicates(df.where("k is not null"), "k", "i").collect()} == {1: False, 2: True}
    assert {r.reason: r.events for r in A.null_accounting(df, ["i", "k"]).collect()} == {"null:i": 0, "null:k": 1}
    assert A.latest(df, ["k"], "i", 1).count() == 2
    merged = A.merge_counters(df.select("i", F.lit(1).alias("x")).where("i < 3"), df.select("i", F.lit(2).alias("y")).where("i > 1"), "i", ["x"], ["y"])
    assert {r.i: (r.x, r.y) for r in merged.collect()} == {1: (1, 0), 2: (1, 2), 3: (0, 2)}


def test_rows_with_a_null_key_are_duplicates_of_their_first(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, None), (4, "a"), (5, "b")], "i long, k string")
    assert {r.i: r.duplicate for r in A.with_duplicates(df, "k", "i").collect()} == {1: False, 2: False, 3: True, 4: True, 5: False}
