"""Registered queries of run summaries over ``events`` (a user is a run, an event a sample) and derived tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import runs as R
from tessella.plans.evidence import events
from tessella.runtime import table


def artifact_inventory(spark, d):
    files = table(spark, d, "part").select(F.concat_ws("", F.lit("data/"), F.col("p_partkey"), F.lit(".parquet")).alias("path"), F.col("p_size").cast("long").alias("size_bytes"), F.sha2("p_name", 256).alias("sha256"), "p_partkey")
    return R.inventory(files, "data/").select("path", "size_bytes", "artifact_index")


def artifact_totals(spark, d):
    return R.inventory_totals(table(spark, d, "part").select(F.col("p_size").cast("long").alias("size_bytes")))


def host_summary(spark, d):
    out = R.host_summary(events(spark, d).withColumn("at", F.struct("ts", "event_id")), ["user_id"], "at", ["value"], ["event_id"])
    return out.select("user_id", "samples", "min_value", "max_value", F.col("delta_event_id"))


def device_summary(spark, d):
    df = events(spark, d).withColumn("power", F.when(F.col("event_type") != "click", F.col("value")))
    out = R.device_summary(df, ["user_id"], ["power"])
    return out.select("user_id", *[F.round(c, 6).alias(c) for c in ("min_power", "median_power", "max_power", "coverage_power")])


def pause_breakdown(spark, d):
    out = R.pauses(events(spark, d), ["user_id"], "event_type", "value", ["click", "view"])
    return out.select("user_id", *[F.round(c, 4).alias(c) for c in ("click_seconds", "view_seconds")])


def decomposition(spark, d):
    out = R.decomposition(events(spark, d), "event_type", "value", 10.0)
    return out.select("event_type", "runs", *[F.round(c, 6).alias(c) for c in ("least", "median", "greatest", "spread", "ratio")], "repeatable")


def candidate_summary(spark, d):
    df = events(spark, d).withColumn("passed", F.col("value") < 50)
    out = R.candidate_summary(df, "user_id", "value", "passed", ["event_id"], 5.0)
    return out.select("user_id", "runs", *[F.round(c, 6).alias(c) for c in ("conservative", "median", "greatest", "spread")], "all_passed", "worst_event_id", "repeatable")


def budget_stop(spark, d):
    df = events(spark, d).withColumn("amount", F.floor("value").cast("long"))
    return R.until_budget(df, ["user_id"], ["ts", "event_id"], "amount", 200).select("user_id", "event_id", "used")


def step_loss(spark, d):
    df = events(spark, d).withColumn("tokens", F.col("event_id") % 7)
    return R.accumulated(df, ["user_id"], "value", "tokens").select("user_id", F.round("loss", 6).alias("loss"), "tokens")


def average_throughput(spark, d):
    df = events(spark, d).withColumns({"tokens": F.col("event_id") % 7, "elapsed": F.col("seconds") - 1704067200.0})
    return R.average_so_far(df, ["user_id"], ["ts", "event_id"], "tokens", "elapsed").select("event_id", F.round("average", 9).alias("average"))


def storage_by_device(spark, d):
    df = table(spark, d, "supplier").select(F.col("s_nationkey").alias("device"), F.col("s_suppkey").alias("need"), (F.col("s_nationkey") * 10).cast("long").alias("free"))
    return R.storage_by_device(df, "device", "need", "free", 5)


def cache_telemetry(spark, d):
    df = events(spark, d).select("user_id", F.struct("ts", "event_id").alias("at"), (F.col("event_type") == "click").cast("int").alias("hits"), F.col("value").alias("size_bytes"), F.col("event_id").alias("free_bytes"))
    return R.cache_telemetry(df, ["user_id"], "at", ["hits"])


def newest_valid(spark, d):
    df = events(spark, d).select("user_id", "event_id", F.lit("click").alias("recorded"), F.col("event_type").alias("actual"))
    return R.newest_valid(df, ["user_id"], "event_id", "recorded", "actual").select("user_id", "event_id")


def top_k_probabilities(spark, d):
    out = R.top_k_probabilities(events(spark, d), ["user_id"], "event_id", "value", 4, 20.0)
    return out.select("user_id", "event_id", F.round("probability", 9).alias("probability"))


def fixed_work(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit(5).alias("tokens"))
    return R.fixed_work(df, ["l_orderkey"], "l_linenumber", "tokens", 4, 5)


def tail_note(spark, d):
    out = R.tail_note(events(spark, d), ["event_type"], "value")
    return out.select("event_type", F.round("p95", 6).alias("p95"), F.round("median", 6).alias("median"), "heavy_tail")


QUERIES = {
    f.__name__: f
    for f in (
        artifact_inventory, artifact_totals, host_summary, device_summary, pause_breakdown, decomposition, candidate_summary, budget_stop, step_loss,
        average_throughput, storage_by_device, cache_telemetry, newest_valid, top_k_probabilities, fixed_work, tail_note,
    )
}

SQL = {
    "artifact_inventory": "SELECT path, size_bytes, (row_number() OVER (ORDER BY size_bytes, path) - 1)::INT AS artifact_index FROM (SELECT 'data/' || p_partkey || '.parquet' AS path, p_size::BIGINT AS size_bytes FROM part)",
    "artifact_totals": "SELECT count(*) AS files, sum(p_size)::BIGINT AS bytes, max(p_size)::BIGINT AS largest FROM part",
    "host_summary": "SELECT user_id, count(*) AS samples, min(value) AS min_value, max(value) AS max_value, arg_max(event_id, (ts, event_id)) - arg_min(event_id, (ts, event_id)) AS delta_event_id FROM events GROUP BY user_id",
    "device_summary": "SELECT user_id, round(min(p), 6) AS min_power, round(median(p), 6) AS median_power, round(max(p), 6) AS max_power, round(count(p) / count(*), 6) AS coverage_power FROM (SELECT user_id, CASE WHEN event_type != 'click' THEN value END AS p FROM events) GROUP BY user_id",
    "pause_breakdown": "SELECT user_id, round(coalesce(sum(value) FILTER (event_type = 'click'), 0), 4) AS click_seconds, round(coalesce(sum(value) FILTER (event_type = 'view'), 0), 4) AS view_seconds FROM events GROUP BY user_id",
    "decomposition": "SELECT event_type, count(*) AS runs, round(min(value), 6) AS least, round(median(value), 6) AS median, round(max(value), 6) AS greatest, round((max(value) - min(value)) / median(value), 6) AS spread, round(min(value) / 10.0::DOUBLE, 6) AS ratio, count(*) = 3 AND (max(value) - min(value)) / median(value) <= 0.05 AS repeatable FROM events GROUP BY event_type",
    "candidate_summary": "SELECT user_id, count(*) AS runs, round(min(value), 6) AS conservative, round(median(value), 6) AS median, round(max(value), 6) AS greatest, round((max(value) - min(value)) / median(value), 6) AS spread, bool_and(value < 50) AS all_passed, max(event_id) AS worst_event_id, (max(value) - min(value)) / median(value) <= 5.0 AS repeatable FROM events GROUP BY user_id",
    "budget_stop": "SELECT user_id, event_id, used::BIGINT AS used FROM (SELECT user_id, event_id, least(a, 200 - (sum(a) OVER (PARTITION BY user_id ORDER BY ts, event_id) - a)) AS used FROM (SELECT *, floor(value)::BIGINT AS a FROM events)) WHERE used > 0",
    "step_loss": "SELECT user_id, round(sum(value) / nullif(sum(event_id % 7), 0), 6) AS loss, sum(event_id % 7)::BIGINT AS tokens FROM events GROUP BY user_id",
    "average_throughput": "SELECT event_id, round(CASE WHEN e > 0 THEN t / e ELSE 0 END, 9) AS average FROM (SELECT event_id, epoch_us(ts) / 1e6 - 1704067200.0::DOUBLE AS e, sum(event_id % 7) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events)",
    "storage_by_device": "SELECT s_nationkey AS device, sum(s_suppkey)::BIGINT AS needed, min(s_nationkey * 10)::BIGINT AS free, count(*) AS roots, min(s_nationkey * 10) - sum(s_suppkey) >= 5 AS enough FROM supplier GROUP BY s_nationkey",
    "cache_telemetry": "SELECT user_id, count(*) FILTER (event_type = 'click') AS hits, max(value) AS size_bytes, arg_max(event_id, (ts, event_id)) AS free_bytes FROM events GROUP BY user_id",
    "newest_valid": "SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY user_id",
    "top_k_probabilities": "SELECT user_id, event_id, round(e / sum(e) OVER (PARTITION BY user_id), 9) AS probability FROM (SELECT user_id, event_id, exp((value - max(value) OVER (PARTITION BY user_id)) / 20.0::DOUBLE) AS e, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 4",
    "fixed_work": "SELECT l_orderkey, count(*) = 4 AND count(DISTINCT l_linenumber) = 4 AND min(l_linenumber) = 1 AND max(l_linenumber) = 4 AS complete, true AS constant, count(*) = 4 AS total FROM lineitem GROUP BY l_orderkey",
    "tail_note": "SELECT event_type, round(quantile_disc(value, 0.95), 6) AS p95, round(median(value), 6) AS median, quantile_disc(value, 0.95) / median(value) > 1.5 AS heavy_tail FROM events GROUP BY event_type",
}
