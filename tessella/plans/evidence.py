"""Registered evidence queries: telemetry and metrics analytics over ``events`` and derived tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import measures as M
from tessella.operators import evidence as E
from tessella.operators import selection as S
from tessella.runtime import scratch, table
from tessella.streaming.cursor import drain, event_windows, pack_stream, session_windows

#: Microseconds since 1970 of a wall-clock time, whatever the session's zone.
MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))"


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("seconds", F.expr(MICROS) / 1e6)


def gap_analysis(spark, d):
    out = E.gaps(events(spark, d), ["user_id"], F.col("seconds"))
    return out.select("user_id", "samples", F.round("max_gap", 3).alias("max_gap"), "increasing")


def coverage(spark, d):
    df = events(spark, d).withColumn("day", F.floor(F.col("seconds") / 86400) * 86400.0)
    out = E.coverage(df, ["event_type", "day"], F.col("seconds"), F.col("day"), F.col("day") + 86400.0, 600.0)
    return out.select("event_type", "day", "samples", "expected", *[F.round(c, 4).alias(c) for c in ("coverage", "start_delay", "end_gap")])


def longest_run(spark, d):
    return E.longest_run(events(spark, d), ["user_id"], ["ts", "event_id"], F.col("value") > 10)


def counter_delta(spark, d):
    out = E.counter_delta(events(spark, d), ["event_type"], F.struct("ts", "event_id"), "value")
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("least", "greatest", "delta")])


def counter_falls(spark, d):
    return E.falls(events(spark, d), ["user_id"], ["ts", "event_id"], "value").select("event_id", "value", "previous")


def cadence_events(spark, d):
    df = events(spark, d).withColumn("amount", F.floor(F.col("value") * 10).cast("long"))
    return E.cadence(df, ["user_id"], ["ts", "event_id"], "amount", 1000).select("user_id", "event_id", "total")


def best_so_far(spark, d):
    return E.best_so_far(events(spark, d), ["user_id"], ["ts", "event_id"], "value").select("user_id", "event_id", "value")


def repeat_summary(spark, d):
    daily = events(spark, d).groupBy(F.floor(F.col("seconds") / 86400).alias("run"), F.col("event_type").alias("metric")).agg(F.round(F.sum("value"), 4).alias("v"))
    return E.repeat_summary(daily, "run", "metric", "v").select("metric", *[F.round(c, 4).alias(c) for c in ("median", "least", "greatest", "spread")])


def window_edges(spark, d):
    out = E.window_edges(events(spark, d), ["user_id"], ["ts", "event_id"], "value", 5)
    return out.select("user_id", *[F.round(c, 6).alias(c) for c in ("first_median", "last_median", "growth")])


def running_peak(spark, d):
    return E.running_peak(events(spark, d), ["user_id"], ["ts", "event_id"], "value").select("event_id", "peak")


def compression_by_stratum(spark, d):
    out = E.compression(table(spark, d, "documents"), "lang", "text", F.octet_length("text") + 1)
    return out.select(F.coalesce("lang", F.lit("all")).alias("lang"), "documents", "tokens", "codepoints", "bytes", *[F.round(c, 6).alias(c) for c in ("tokens_per_byte", "tokens_per_codepoint", "tokens_p50", "tokens_p95", "tokens_p99")])


def nll_by_corpus(spark, d):
    df = table(spark, d, "documents").withColumns({"targets": F.octet_length("text").cast("long"), "loss": F.octet_length("text") * (1.0 + F.col("doc_id") % 7)})
    out = E.weighted_nll(df, "source", "loss", "targets")
    return out.select(F.coalesce("source", F.lit("all")).alias("source"), "targets", F.round("nll", 6).alias("nll"), F.round("perplexity", 4).alias("perplexity"), "overflow")


def step_summary(spark, d):
    df = events(spark, d).select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.floor(F.col("value")).cast("long").alias("targets"), F.col("value").alias("wall"), (F.col("value") / 10).alias("wait"), "event_type")
    logs = df.where("event_type = 'click'").select("run", "step", F.lit(0.25).alias("pause"))
    out = E.step_summary(df.drop("event_type"), logs, warmup=100)
    return out.select("run", "targets", *[F.round(c, 6).alias(c) for c in ("targets_per_second", "step_median", "step_p95", "step_max", "wait_fraction")])


def candidates(spark, d) -> DataFrame:
    """A candidate a source: costs, speeds and shapes from its documents."""
    df = table(spark, d, "documents").groupBy(F.col("source").alias("id")).agg(
        F.round(F.avg("n_chars"), 4).alias("cost_a"), F.round(F.avg(F.octet_length("text")) / F.avg("n_chars"), 6).alias("cost_b"),
        F.count("*").alias("size"), F.max("n_chars").cast("double").alias("speed"), F.min("n_chars").cast("double").alias("least_speed"),
    )
    return df.withColumns({"depth": F.col("size") % 3, "context": F.pmod(F.col("speed").cast("long"), F.lit(1000))})


def pareto_frontier(spark, d):
    return S.pareto(candidates(spark, d), "id", ["cost_a", "cost_b", "size"], ["speed"]).select("id")


def select_winner(spark, d):
    return S.winner(candidates(spark, d), "id", "size", ["cost_a", "cost_b"], "speed", "least_speed", each=0.001, one=0.01).select("id", "promoted")


def constrained_choice(spark, d):
    return S.constrained_choice(candidates(spark, d), F.col("size") > 10, "speed", "depth", "context", 0.5, 0.8).select("id")


PAUSES = {"validation": (50_000, 3.0), "recovery": (200_000, 11.0), "milestone": (1_000_000, 20.0)}


def token_budget(spark, d):
    return S.token_budget(candidates(spark, d), "id", "speed", 600.0, 512, PAUSES, 10, 0.05, 30.0)


def supply_ratio(spark, d):
    df = candidates(spark, d)
    return df.select("id", S.supply(F.col("cost_b") * 1.2, F.col("speed") / 10_000).alias("ceiling"))


def gate_vector(spark, d):
    df = candidates(spark, d).withColumns({"a": F.col("size") > 40, "b": F.col("speed") > 8000, "c": F.when(F.col("depth") > 0, True)})
    return df.select("id", S.gates(["a", "b", "c"]).alias("passed"))


def upload_admission(spark, d):
    df = table(spark, d, "documents").select("doc_id", F.md5("text").alias("sha"), F.octet_length("text").cast("long").alias("size"))
    return S.admitted(df, ["doc_id"], "sha", "size", 500_000).select("doc_id", "projected", "admitted")


def lr_schedule(spark, d):
    return spark.range(0, 200).select(F.col("id").alias("step"), F.round(M.warmup_cosine(F.col("id"), 20, 180, 0.1), 9).alias("factor"))


def vocabulary_cost(spark, d):
    cost = M.vocabulary_cost(F.col("size"), 64, 8192)
    return candidates(spark, d).select("id", *[v.cast("long").alias(k) for k, v in cost.items()])


def plan_vs_observed(spark, d):
    nations, suppliers = table(spark, d, "nation"), table(spark, d, "supplier")
    return E.missing_and_extra(nations.select(F.col("n_nationkey").alias("key")), suppliers.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("key")), ["key"])


def preset_matrix(spark, d):
    return S.matrix(spark, ["m0", "m1", "m2"], [1024, 2048, 4096], 3)


def size_literals(spark, d):
    df = table(spark, d, "part").select("p_partkey", F.concat(F.col("p_size"), F.element_at(F.array(*map(F.lit, ["B", "kB", "KiB", "MiB", "GB", "?"])), (F.col("p_partkey") % 6 + 1).cast("int"))).alias("literal"))
    return df.select("p_partkey", M.size_in_bytes(F.col("literal")).alias("bytes"))


def bounded_events(spark, d):
    bounds = events(spark, d).agg(F.expr("percentile_disc(0.25) WITHIN GROUP (ORDER BY event_id)").alias("low"), F.expr("percentile_disc(0.75) WITHIN GROUP (ORDER BY event_id)").alias("high"))
    return E.between_bounds(events(spark, d), "event_id", bounds, "low", "high").groupBy("event_type").agg(F.count("*").alias("n"))


def multiset_difference(spark, d):
    from tessella.operators.accounting import multiset_difference as difference

    df, half = events(spark, d), F.col("ts") < F.expr("timestamp_ntz'2024-01-16 00:00:00'")
    return difference(df.where(half).select("user_id", "event_type"), df.where(~half).select("user_id", "event_type")).groupBy("side", "event_type").agg(F.count("*").alias("n"))


def event_time_windows(spark, d):
    """Tumbling windows over a file stream with a watermark, run to the end."""
    out = drain(event_windows(_event_stream(spark, d), "ts", "event_type", "value"), "complete", scratch(spark, "stream"))
    return out.select(F.unix_seconds("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def _stream(spark, d, name):
    """A table as a stream, be it one file or a folder of them: streams take a file by a pattern only, and a pattern takes both."""
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def _event_stream(spark, d):
    return _stream(spark, d, "events").withColumn("ts", F.expr(f"timestamp_micros({MICROS})"))


def sliding_windows(spark, d):
    """Windows of a day that start every six hours."""
    out = drain(event_windows(_event_stream(spark, d), "ts", "event_type", "value", "1 day", slide="6 hours"), "complete", scratch(spark, "stream"))
    return out.select(F.unix_seconds("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def session_stream(spark, d):
    """Sessions of a user as a stream: events less than six hours apart."""
    out = drain(session_windows(_event_stream(spark, d), "ts", "user_id", "value", "6 hours"), "complete", scratch(spark, "stream"))
    return out.select(F.unix_micros("session_window.start").alias("start"), "user_id", "n", F.round("total", 4).alias("total"))


def stream_pack(spark, d):
    """Windows packed by a stateful stream of documents, a stream a source."""
    rows = _stream(spark, d, "documents").select(F.col("source").alias("stream"), F.col("doc_id").alias("position"), F.col("lang").alias("source"), (F.octet_length("text") + 1).alias("n_tokens"))
    packed = drain(pack_stream(rows, 1025), "append", scratch(spark, "stream"))
    return packed.groupBy("stream").agg(F.countDistinct("window_id").alias("windows"), F.sum("source_targets").alias("targets"))


QUERIES = {
    f.__name__: f
    for f in (
        gap_analysis, coverage, longest_run, counter_delta, counter_falls, cadence_events, best_so_far, repeat_summary, window_edges, running_peak,
        compression_by_stratum, nll_by_corpus, step_summary, pareto_frontier, select_winner, constrained_choice, token_budget, supply_ratio, gate_vector,
        upload_admission, lr_schedule, vocabulary_cost, plan_vs_observed, preset_matrix, size_literals, bounded_events, multiset_difference,
        event_time_windows, sliding_windows, session_stream, stream_pack,
    )
}

_SEC = "epoch_us(ts) / 1e6"
_CAND = """SELECT source AS id, round(avg(n_chars), 4) AS cost_a, round(avg(strlen(text)) / avg(n_chars), 6) AS cost_b, count(*) AS size, max(n_chars)::DOUBLE AS speed, min(n_chars)::DOUBLE AS least_speed,
  count(*) % 3 AS depth, max(n_chars) % 1000 AS context FROM documents GROUP BY source"""
_ELAPSED = "m * 512 / speed + floor(m / 10) * 0.05 + floor(m * 512 / 50000) * 3.0 + floor(m * 512 / 200000) * 11.0 + floor(m * 512 / 1000000) * 20.0 + 30.0"

SQL = {
    "gap_analysis": f"SELECT user_id, count(*) AS samples, round(max(g), 3) AS max_gap, coalesce(bool_and(g > 0), true) AS increasing FROM (SELECT user_id, {_SEC} - lag({_SEC}) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM events) GROUP BY user_id",
    "coverage": f"""SELECT event_type, day, n AS samples, 144::BIGINT AS expected, round(n / 144.0::DOUBLE, 4) AS coverage, round(a - day, 4) AS start_delay, round(day + 86400.0 - z, 4) AS end_gap FROM (
      SELECT event_type, epoch(date_trunc('day', ts))::DOUBLE AS day, count(*) AS n, min({_SEC}) AS a, max({_SEC}) AS z FROM events GROUP BY 1, 2)""",
    "longest_run": """SELECT user_id, max(n)::BIGINT AS longest FROM (SELECT user_id, b, count(*) FILTER (h) AS n FROM (SELECT user_id, h, sum(CASE WHEN h THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b
      FROM (SELECT *, coalesce(value > 10, false) AS h FROM events)) GROUP BY user_id, b) GROUP BY user_id""",
    "counter_delta": "SELECT event_type, round(min(value), 6) AS least, round(max(value), 6) AS greatest, round(arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)), 6) AS delta FROM events GROUP BY event_type",
    "counter_falls": "SELECT event_id, value, previous FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) WHERE value < previous",
    "cadence_events": "SELECT user_id, event_id, total::BIGINT AS total FROM (SELECT user_id, event_id, a, sum(a) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS total FROM (SELECT *, floor(value * 10)::BIGINT AS a FROM events)) WHERE floor(total / 1000) > floor((total - a) / 1000)",
    "best_so_far": "SELECT user_id, event_id, value FROM (SELECT *, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events) WHERE b IS NULL OR value < b",
    "repeat_summary": """WITH r AS (SELECT ts::DATE AS run, event_type AS metric, round(sum(value), 4) AS v FROM events GROUP BY 1, 2)
      SELECT metric, round(median(v), 4) AS median, round(min(v), 4) AS least, round(max(v), 4) AS greatest, round((max(v) - min(v)) / median(v), 4) AS spread FROM r GROUP BY metric HAVING count(DISTINCT run) = (SELECT count(DISTINCT run) FROM r)""",
    "window_edges": """SELECT user_id, round(median(value) FILTER (u <= s), 6) AS first_median, round(median(value) FILTER (u > n - s), 6) AS last_median, round(greatest(0, min(value) FILTER (u > n - s) - min(value) FILTER (u <= s)), 6) AS growth FROM (
      SELECT *, least(5, greatest(1, n // 2)) AS s FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS u, count(*) OVER (PARTITION BY user_id) AS n FROM events)) GROUP BY user_id""",
    "running_peak": "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS peak FROM events",
    "compression_by_stratum": """SELECT coalesce(lang, 'all') AS lang, documents, tokens, codepoints, bytes, round(tokens / bytes, 6) AS tokens_per_byte, round(tokens / codepoints, 6) AS tokens_per_codepoint, round(p50, 6) AS tokens_p50, round(p95, 6) AS tokens_p95, round(p99, 6) AS tokens_p99 FROM (
      SELECT lang, quantile_cont(strlen(text) + 1, 0.5)::DOUBLE AS p50, quantile_cont(strlen(text) + 1, 0.95)::DOUBLE AS p95, quantile_cont(strlen(text) + 1, 0.99)::DOUBLE AS p99, count(*) AS documents, sum(strlen(text) + 1)::BIGINT AS tokens, sum(length(text))::BIGINT AS codepoints, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY GROUPING SETS ((lang), ()))""",
    "nll_by_corpus": """SELECT coalesce(source, 'all') AS source, targets, round(l / targets, 6) AS nll, round(exp(l / targets), 4) AS perplexity, false AS overflow FROM (
      SELECT source, sum(strlen(text))::BIGINT AS targets, sum(strlen(text) * (1.0 + doc_id % 7)::DOUBLE) AS l FROM documents GROUP BY GROUPING SETS ((source), ()))""",
    "step_summary": """SELECT user_id AS run, sum(floor(value)::BIGINT)::BIGINT AS targets, round(sum(floor(value)::BIGINT) / (sum(value) + 0.25 * count(*) FILTER (event_type = 'click')), 6) AS targets_per_second,
      round(median(value), 6) AS step_median, round(quantile_disc(value, 0.95), 6) AS step_p95, round(max(value), 6) AS step_max, round(sum(value / 10) / sum(value), 6) AS wait_fraction FROM events WHERE event_id > 100 GROUP BY user_id""",
    "pareto_frontier": f"WITH c AS ({_CAND}) SELECT id FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.id != a.id AND b.cost_a <= a.cost_a AND b.cost_b <= a.cost_b AND b.size <= a.size AND b.speed >= a.speed AND NOT (b.cost_a = a.cost_a AND b.cost_b = a.cost_b AND b.size = a.size AND b.speed = a.speed))",
    "select_winner": f"""WITH c AS ({_CAND}), b AS (SELECT * FROM c ORDER BY size, id LIMIT 1), g AS (SELECT c.*, 1 - c.cost_a / b.cost_a AS ga, 1 - c.cost_b / b.cost_b AS gb, c.id = b.id AS base, b.least_speed AS bl FROM c, b),
      p AS (SELECT *, NOT base AND ga >= 0.001 AND gb >= 0.001 AND greatest(ga, gb) >= 0.01 AND speed >= bl AS promoted FROM g)
      SELECT id, promoted FROM p WHERE promoted OR base ORDER BY promoted DESC, CASE WHEN promoted THEN ga + gb END DESC, size, id LIMIT 1""",
    "constrained_choice": f"""WITH a AS (SELECT * FROM ({_CAND}) WHERE size > 10), b AS (SELECT * FROM a WHERE speed >= (SELECT max(speed) FROM a) * 0.5), c AS (SELECT * FROM b WHERE depth = (SELECT max(depth) FROM b)),
      e AS (SELECT * FROM c WHERE speed >= (SELECT max(speed) FROM c) * 0.8) SELECT id FROM e WHERE context = (SELECT max(context) FROM e)""",
    "token_budget": f"SELECT id, max(m) * 512 AS token_budget FROM (SELECT id, speed, unnest(range(0, (speed * 600 / 512)::BIGINT + 2)) AS m FROM ({_CAND})) WHERE m = 0 OR {_ELAPSED} <= 600.0 GROUP BY id",
    "supply_ratio": f"SELECT id, CASE WHEN cost_b * 1.2::DOUBLE < 1.2::DOUBLE THEN 'loader headroom too small' WHEN cost_b * 1.2::DOUBLE <= speed / 10000 THEN 'loader' ELSE 'model' END AS ceiling FROM ({_CAND})",
    "gate_vector": f"SELECT id, size > 40 AND speed > 8000 AND depth > 0 AS passed FROM ({_CAND})",
    "upload_admission": "SELECT doc_id, (sum(size) OVER (ORDER BY doc_id))::BIGINT AS projected, sum(size) OVER (ORDER BY doc_id) <= 500000 AS admitted FROM (SELECT doc_id, strlen(text) AS size, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k FROM documents) WHERE k = 1",
    "lr_schedule": "SELECT s AS step, round(CASE WHEN s < 20 THEN (s + 1) / 20.0::DOUBLE ELSE 0.1::DOUBLE + 0.9::DOUBLE * 0.5::DOUBLE * (1 + cos(pi() * least(1.0::DOUBLE, (s - 20) / 160.0::DOUBLE))) END, 9) AS factor FROM (SELECT unnest(range(0, 200)) AS s)",
    "vocabulary_cost": f"SELECT id, size * 64 AS embedding_parameters, size * 65 AS head_parameters, size * 129 AS vocabulary_parameters, size * 516 AS model_bytes, size * 2064 AS training_state_bytes, size * 8192 AS logit_elements, size * 64 * 8192 AS multiply_accumulates FROM ({_CAND})",
    "plan_vs_observed": "SELECT n_nationkey AS key, 'missing' AS problem FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION ALL SELECT DISTINCT s_nationkey, 'extra' FROM supplier WHERE s_acctbal > 5000 AND s_nationkey NOT IN (SELECT n_nationkey FROM nation)",
    "preset_matrix": "SELECT arm, 'm' || arm // 3 AS model, ([1024, 2048, 4096][arm % 3 + 1])::INT AS context, r AS repetition, (((arm - (r - 1) * 3) % 9 + 9) % 9)::INT AS place FROM (SELECT unnest(range(0, 9))::INT AS arm), (SELECT unnest([1, 2, 3])::INT AS r)",
    "size_literals": "SELECT p_partkey, p_size * [1.0, 1000.0, 1024.0, 1048576.0, 1000000000.0, NULL][(p_partkey % 6 + 1)::INT]::DOUBLE AS bytes FROM part",
    "bounded_events": "WITH b AS (SELECT quantile_disc(event_id, 0.25) AS low, quantile_disc(event_id, 0.75) AS high FROM events) SELECT event_type, count(*) AS n FROM events, b WHERE event_id BETWEEN low AND high GROUP BY event_type",
    "multiset_difference": """WITH a AS (SELECT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-16'), b AS (SELECT user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-16')
      SELECT side, event_type, count(*) AS n FROM (SELECT 'left' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'right', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) GROUP BY side, event_type""",
    "event_time_windows": "SELECT epoch(date_trunc('day', ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "sliding_windows": "SELECT w * 21600 AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, epoch_us(ts) // 21600000000 - unnest([0, 1, 2, 3]) AS w FROM events) GROUP BY 1, 2",
    "session_stream": """SELECT min(epoch_us(ts))::BIGINT AS start, user_id, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (
      SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""",
    "stream_pack": "SELECT source AS stream, (sum(strlen(text) + 1)::BIGINT - 1) // 1024 AS windows, (sum(strlen(text) + 1)::BIGINT - 1) // 1024 * 1024 AS targets FROM documents GROUP BY source HAVING (sum(strlen(text) + 1)::BIGINT - 1) // 1024 > 0",
}
