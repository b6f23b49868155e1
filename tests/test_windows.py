import random

import pytest
from pyspark.sql import functions as F

from tessella.functions.tokens import Bytes, with_end
from tessella.operators import fixed_windows as W
from tessella.operators import quotas
from tessella.operators import schedule as S
from tessella.operators.totals import running_total


def naive(docs, width):
    """Windows of a stream as lists of (source, token) with a carried last token."""
    stream = [(s, t) for s, ids in docs for t in ids]
    out, at = [], 0
    while at + width <= len(stream):
        out.append(stream[at : at + width])
        at += width - 1
    return out


@pytest.mark.parametrize(("total", "width", "windows", "tail"), [(7, 4, 2, 0), (8, 4, 2, 1), (8193, 65, 128, 0), (1, 4, 0, 0), (0, 4, 0, 0)])
def test_closed_form(total, width, windows, tail):
    assert W.full_windows(total, width) == (windows, tail)


def test_windows_against_a_sequential_packer(spark):
    rng = random.Random(4)
    for width in (2, 3, 5, 9):
        docs = [(f"s{rng.randrange(3)}", [rng.randrange(100) for _ in range(rng.randrange(1, 12))]) for _ in range(30)]
        rows = [(i, s, ids) for i, (s, ids) in enumerate(docs)]
        df = spark.createDataFrame(rows, "i int, source string, ids array<int>").withColumn("n", F.size("ids").cast("long"))
        df = running_total(df, "n", ["i"], "start")
        full, _ = W.full_windows(sum(len(x) for _, x in docs), width)
        want = naive(docs, width)
        assert full == len(want)
        got = {r.window_id: list(r.input_ids) for r in W.window_ids(df, "start", "ids", width, full).collect()}
        assert got == {k: [t for _, t in w] for k, w in enumerate(want)}
        targets = {(r.window_id, r.source): r.t for r in W.touched(df, "start", "n", width).where(f"window_id < {full}").groupBy("window_id", "source").agg(F.sum("targets").alias("t")).collect()}
        expected = {}
        for k, w in enumerate(want):
            for s, _ in w[1:]:
                expected[k, s] = expected.get((k, s), 0) + 1
        assert targets == expected


def test_stride_one_and_shift(spark):
    df = spark.createDataFrame([([1, 2, 3, 4],), ([1],)], "ids array<int>")
    rows = [r[0] for r in df.select(W.stride_one(F.col("ids"), 2)).collect()]
    assert [(list(p.inputs), list(p.labels)) for p in rows[0]] == [([1, 2], [2, 3]), ([2, 3], [3, 4])] and rows[1] == []
    a, b = W.inputs_and_labels(F.col("ids"))
    assert [(list(r[0]), list(r[1])) for r in df.select(a, b).collect()] == [([1, 2, 3], [2, 3, 4]), ([], [])]


def test_target_sources(spark):
    spans = spark.sql("SELECT array(named_struct('source', 'a', 'start', 0, 'end', 3), named_struct('source', 'b', 'start', 3, 'end', 5)) AS s")
    assert spans.select(W.target_sources(F.col("s"))).first()[0] == ["a", "a", "b", "b"]


def test_quotas(spark):
    ratios = {"a": 0.25, "b": 0.25, "c": 0.5}
    df = spark.createDataFrame(list(ratios.items()), "name string, ratio double")
    for total in (0, 1, 2, 3, 10, 101):
        got = {r["name"]: r.quota for r in quotas.largest_remainder(df, total).collect()}
        assert got == quotas.largest_remainder_of(ratios, total) and sum(got.values()) == total
    assert quotas.largest_remainder_of({"a": 0.7, "b": 0.3}, 10) == {"a": 7, "b": 3}
    assert quotas.largest_remainder_of(ratios, 1)["c"] == 1  # the largest fraction
    assert quotas.largest_remainder_of({"a": 0.5, "b": 0.5}, 1) == {"a": 0, "b": 1}  # of equal ones the larger name


def test_cut_keeps_the_end(spark):
    df = spark.createDataFrame([([9, 8, 7],)], "ids array<int>")
    for keep, want in ((1, [5]), (2, [9, 5]), (3, [9, 8, 7])):
        assert df.select(quotas.cut_ids(F.col("ids"), F.lit(keep), 5)).first()[0] == want


def test_byte_tokens(spark):
    df = spark.createDataFrame([("é日a",), ("",)], "t string")
    rows = df.select(with_end(Bytes().encode(F.col("t"))), Bytes().decode(Bytes().encode(F.col("t"))), Bytes().count(F.col("t"))).collect()
    assert list(rows[0][0]) == [b + 8 for b in "é日a".encode()] + [7] and rows[0][1] == "é日a" and rows[0][2] == 6
    assert list(rows[1][0]) == [7] and rows[1][2] == 0


def test_debt_schedule_is_exact():
    mix = S.Mix({"ja": 0.5, "en": 0.5}, targets={"ja": 32, "en": 32}, width=9, by_debt=True, seed=1)
    plan = S.replay({"ja": [5] * 20, "en": [7] * 20}, mix)
    owner = [s for _, s, _, _, kept, _ in plan for _ in range(kept)]
    windows = (len(owner) - 1) // 8
    credited = owner[1 : windows * 8 + 1]
    assert windows == 8 and credited.count("ja") == credited.count("en") == 32


def test_weighted_schedule(spark):
    lengths = {"a": [4] * 50, "b": [3] * 50}
    mix = S.Mix({"a": 0.7, "b": 0.3}, seed=9, quotas={"a": 70, "b": 30}, buffer=4)
    one, two = S.replay(lengths, mix), S.replay(lengths, mix)
    assert one == two
    for s in "ab":
        assert sum(r[4] for r in one if r[1] == s) == mix.quotas[s]
        positions = [r[2] for r in one if r[1] == s]
        assert len(set(positions)) == len(positions) and positions != sorted(positions)
    rows = [(s, i, n) for s, ns in lengths.items() for i, n in enumerate(ns)]
    df = S.plan(spark.createDataFrame(rows, "source string, position long, n_tokens long"), mix)
    assert [tuple(r) for r in df.orderBy("emit_order").collect()] == one
    with pytest.raises(ValueError, match="ran out"):
        S.replay({"a": [1], "b": [1]}, mix)
    with pytest.raises(ValueError):
        S.Mix({"a": 0.5})


def test_repeat_reaches_the_quota():
    mix = S.Mix({"a": 1.0}, quotas={"a": 10}, repeat=True)
    plan = S.replay({"a": [3, 3]}, mix)
    assert [r[3] for r in plan] == [0, 0, 1, 1] and sum(r[4] for r in plan) == 10


def test_running_total(spark):
    rows = [(i, random.Random(i).randrange(9)) for i in range(500)]
    got = {r.i: r.before for r in running_total(spark.createDataFrame(rows, "i long, n long").repartition(7), "n", ["i"]).collect()}
    at = 0
    for i, n in rows:
        assert got[i] == at
        at += n


def test_a_schedule_reads_only_what_quotas_reach(spark):
    from tessella.operators import schedule

    rows = [("a", i, 3 + i % 5) for i in range(500)] + [("b", i, 2 + i % 3) for i in range(500)] + [("c", i, 9) for i in range(50)]
    df = spark.createDataFrame(rows, "source string, position long, n_tokens long")
    lengths = {n: [r[2] for r in rows if r[0] == n] for n in "ab"}
    for mix in (
        schedule.Mix({"a": 0.7, "b": 0.3}, seed=5, quotas={"a": 70, "b": 40}), schedule.Mix({"a": 0.7, "b": 0.3}, seed=5, quotas={"a": 70, "b": 40}, buffer=6),
        schedule.Mix({"a": 0.5, "b": 0.5}, seed=5, targets={"a": 60, "b": 60}, width=9, by_debt=True), schedule.Mix({"a": 0.5, "b": 0.5}, seed=5, quotas={"a": 70, "b": 70}, first={"a": 100, "b": 7}),
    ):
        assert schedule.needed(df, mix, "source", "position", "n_tokens").count() < 400
        assert [tuple(r) for r in schedule.plan(df, mix).orderBy("emit_order").collect()] == schedule.replay(lengths, mix)


def test_late_rows_are_left_out(spark, tmp_path):
    """A row behind the watermark of an earlier batch doesn't change a finished window."""
    import datetime as dt
    import time

    from tessella.streaming.cursor import drain, event_windows

    def batch(name, rows):
        spark.createDataFrame([(dt.datetime(2024, 1, d, h), k, 1.0) for d, h, k in rows], "ts timestamp, k string, v double").coalesce(1).write.parquet(str(tmp_path / "tmp"))
        [part] = list((tmp_path / "tmp").glob("*.parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        part.rename(tmp_path / "in" / name)
        import shutil

        shutil.rmtree(tmp_path / "tmp")
        time.sleep(1.1)  # files are taken in the order of their times

    batch("1.parquet", [(1, 1, "a"), (1, 2, "a"), (3, 0, "a")])
    batch("2.parquet", [(3, 1, "a")])
    batch("3.parquet", [(1, 3, "a")])  # rows are late against the mark of the batch before the last
    batch("4.parquet", [(9, 0, "a")])
    batch("5.parquet", [(9, 1, "a")])
    stream = spark.readStream.schema("ts timestamp, k string, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = drain(event_windows(stream, "ts", "k", "v", "1 day", "1 hour"), "append", str(tmp_path / "out")).collect()
    assert {r["window"].start.day: r.n for r in rows} == {1: 2, 3: 2}


def test_a_complete_result_stays_with_the_executors(spark, tmp_path):
    """It is a table of files, not rows of the driver; a later run replaces it, and no input gives none."""
    import datetime as dt

    from tessella.streaming.cursor import drain, session_windows

    (tmp_path / "in").mkdir()

    def run():
        stream = spark.readStream.schema("ts timestamp, k string, v double").parquet(str(tmp_path / "in"))
        return drain(session_windows(stream, "ts", "k", "v", "6 hours"), "complete", str(tmp_path / "out"))

    assert run().count() == 0
    for hours, want in (([0, 1, 9], [1, 2]), ([5], [4])):  # the second run joins both sessions
        spark.createDataFrame([(dt.datetime(2024, 1, 1, h), "a", 1.0) for h in hours], "ts timestamp, k string, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        rows = run()
        assert sorted(r.n for r in rows.collect()) == want
        assert rows.inputFiles() and all(str(tmp_path / "out") in f for f in rows.inputFiles())
