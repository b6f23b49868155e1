"""Checks and summaries over whole corpora and runs: quality counts, bounded audits, digests, strata, arms, run rows and pilot gates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quality_counts(judged: DataFrame, by: str, reason: str, truncated: str, duplicate: Column) -> DataFrame:
    """Rows (``by``, ``event``, ``n``): each document's reason, or ``duplicate``, or ``accepted``, and beside it ``truncated``; a refused document can be truncated too."""
    event = F.coalesce(F.col(reason), F.when(duplicate, F.lit("duplicate")), F.lit("accepted"))
    events = F.array_compact(F.array(event, F.when(F.col(truncated), F.lit("truncated"))))
    return judged.select(by, F.explode(events).alias("event")).groupBy(by, "event").agg(F.count("*").alias("n"))


def bounded(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of an order, with ``bounded``: whether the bound was reached. The limit is the feature; it is taken as a top-k, so no task sorts the whole."""
    some = df.orderBy(*order).limit(most)
    reached = some.agg((F.count("*") >= most).alias("bounded"))
    return some.crossJoin(F.broadcast(reached))  # one row


def framed_digest(df: DataFrame, by: str, order: list[str], parts: list[str]) -> DataFrame:
    """A digest a group, over its rows in ``order``: each row's texts are framed by their lengths and hashed, then the hashes in order.

    Frames keep ("ab", "c") apart from ("a", "bc"); batches and partitions don't matter.
    """
    framed = F.concat_ws("", *[x for c in parts for x in (F.coalesce(F.octet_length(c), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(F.col(c), F.lit("")))])
    rows = df.select(by, F.struct(*order, F.sha2(framed, 256).alias("_h")).alias("_r"))
    return rows.groupBy(by).agg(F.count("*").alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("_r")), lambda r: r["_h"]), ""), 256).alias("digest"))


def identity_conflicts(df: DataFrame, key: str, identity: Column) -> DataFrame:
    """Keys that don't have one identity, with how many they have; null counts as one."""
    found = df.groupBy(key).agg((F.count_distinct(identity) + F.max(identity.isNull().cast("int"))).alias("identities"))
    return found.where("identities != 1")


def strata(df: DataFrame, stratum: str, key: str, expected: DataFrame) -> DataFrame:
    """Each stratum's rows and distinct keys beside the ``expected`` count, and whether all agree; strata of either side only are there too."""
    own = df.groupBy(stratum).agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys"))
    out = own.alias("a").join(expected.alias("b"), F.col(f"a.{stratum}").eqNullSafe(F.col(f"b.{stratum}")), "full")
    n, k, e = (F.coalesce(F.col(c), F.lit(0)) for c in ("a.rows", "a.keys", "b.expected"))
    return out.select(F.coalesce(f"a.{stratum}", f"b.{stratum}").alias(stratum), n.alias("rows"), k.alias("keys"), e.alias("expected"), ((n == e) & (k == n)).alias("holds"))


def arms(df: DataFrame, repetition: str, arm: str, value: str, base: str, other: str) -> DataFrame:
    """Two arms side by side for each repetition, and the other's change against the base in per cent; null where an arm is missing."""
    out = df.groupBy(repetition).agg(*[F.avg(F.when(F.col(arm) == a, F.col(value))).alias(n) for a, n in ((base, "base"), (other, "other"))])
    return out.withColumn("change_percent", F.lit(100.0) * (F.col("other") - F.col("base")) / F.nullif(F.col("base"), F.lit(0.0)))


def first_and_steady(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Each group's first value apart from the others' count, mean and greatest."""
    least = F.min(F.struct(*order))
    w = Window.partitionBy(*by)
    df = df.withColumn("_first", F.struct(*order) == least.over(w))
    steady = F.when(~F.col("_first"), F.col(value))
    return df.groupBy(*by).agg(F.min(F.when(F.col("_first"), F.col(value))).alias("first"), F.count(steady).alias("steady"), F.avg(steady).alias("steady_mean"), F.max(steady).alias("steady_max"))


def record_counts(df: DataFrame, kind: str, series: str, step: str) -> DataFrame:
    """Records, distinct series and last step of each type of record."""
    return df.groupBy(kind).agg(F.count("*").alias("records"), F.count_distinct(series).alias("series"), F.max(step).alias("last_step"))


def cache_identity(files: DataFrame) -> DataFrame:
    """Shards, bytes and the fingerprint of the list of (path, size) in order of path. One row a file: a cache holds few."""
    entries = F.array_sort(F.collect_list(F.struct("path", "size_bytes")))
    text = F.concat(F.lit("["), F.array_join(F.transform(entries, lambda e: F.to_json(e)), ","), F.lit("]"))
    return files.agg(F.count("*").alias("shards"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.sha2(text, 256).alias("fingerprint"))


def ordered_fingerprint(rows: DataFrame, order: list[str], value: str) -> DataFrame:
    """The fingerprint of a list of fingerprints, in order; a list of data sets is short."""
    entries = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return rows.agg(F.count("*").alias("parts"), F.sha2(F.array_join(F.transform(entries, lambda e: e["_v"]), ","), 256).alias("fingerprint"))


def token_stream(df: DataFrame, by: list[str], order: list[str], ids: Column, end: int) -> DataFrame:
    """The ids of a group's documents in order, an end behind each: what a memorisation check trains on. A group is a package of few documents."""
    rows = df.select(*by, F.struct(*order, F.array_append(ids, F.lit(end)).alias("_ids")).alias("_r"))
    return rows.groupBy(*by).agg(F.flatten(F.transform(F.array_sort(F.collect_list("_r")), lambda r: r["_ids"])).alias("ids"))


def run_summary(steps: DataFrame, run: str, step: str, wall: str, tokens: str, loss: str, pause: str, warmup: int, expected_steps: int | None = None) -> DataFrame:
    """One row a run: its steps and tokens behind the warm-up, tokens over step time and pauses, quantiles of step time, first and last loss, whether all is finite, and the gates of fixed work."""
    warm = F.col(step) > warmup
    of = lambda c: F.when(warm, F.col(c))
    finite = F.bool_and(F.coalesce(~F.isnan(F.col(loss)) & (F.abs(F.col(loss)) < float("inf")), F.lit(False)))
    out = steps.withColumn("_wall", of(wall)).groupBy(run).agg(
        F.count("*").alias("steps"), F.sum(of(tokens)).alias("tokens"), F.sum("_wall").alias("_w"), F.coalesce(F.sum(of(pause)), F.lit(0.0)).alias("pause_seconds"), F.median("_wall").alias("step_median"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY _wall)").alias("step_p95"), F.max("_wall").alias("step_max"), F.min_by(loss, step).alias("first_loss"), F.max_by(loss, step).alias("last_loss"),
        finite.alias("finite"), ((F.min(step) == 1) & (F.max(step) == F.count("*")) & (F.count_distinct(step) == F.count("*"))).alias("complete"),
    )
    rate = F.col("tokens") / F.nullif(F.col("_w") + F.col("pause_seconds"), F.lit(0.0))
    out = out.withColumns({"tokens_per_second": rate, "passed": F.col("finite") & F.col("complete") & (F.lit(True) if expected_steps is None else F.col("steps") == expected_steps)})
    return out.drop("_w")


def pilot_gates(run: DataFrame, key: str, named: Mapping[str, Column]) -> DataFrame:
    """A row a pilot and named gate (null is no pass), and the verdict over all: the gates are conditions over its summary row."""
    gates = F.array(*[F.struct(F.lit(n).alias("gate"), F.coalesce(c, F.lit(False)).alias("holds")) for n, c in named.items()])
    verdict = F.when(F.forall(gates, lambda g: g["holds"]), "PASS").otherwise("FAIL")
    return run.select(key, verdict.alias("verdict"), F.explode(gates).alias("g")).select(key, "g.gate", "g.holds", "verdict")


def plan_problems(planned: DataFrame, regenerated: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of a plan that the matrix doesn't make, that it makes and the plan lacks, or that the plan has twice."""
    a = planned.groupBy(*keys).agg(F.count("*").alias("_n"))
    out = a.join(regenerated.select(*keys).distinct().withColumn("_made", F.lit(True)), keys, "full")
    problem = F.when(F.col("_n").isNull(), "missing").when(F.col("_made").isNull(), "extra").when(F.col("_n") > 1, "twice")
    return out.select(*keys, problem.alias("problem")).where("problem is not null")


def off_cadence(logs: DataFrame, by: list[str], step: str, every: int, last: str) -> DataFrame:
    """Per run: whether its log steps are exactly every, 2 every, ... up to its last step, each once."""
    wanted = F.floor(F.max(last) / every)
    right = (F.count("*") == wanted) & (F.count_distinct(step) == wanted) & F.bool_and((F.col(step) % every == 0) & (F.col(step) > 0) & (F.col(step) <= F.col(last)))
    return logs.groupBy(*by).agg(F.count("*").alias("logs"), wanted.alias("expected"), right.alias("on_cadence"))
