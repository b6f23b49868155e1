"""Summaries of measured runs: telemetry, pauses, decomposition, candidates, resources, lineage and checks of inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.measures import nearest_rank, relative_range


def inventory(files: DataFrame, prefix: str, suffix: str = ".parquet") -> DataFrame:
    """The files below a prefix (``path``, ``size_bytes``, ``sha256``) in artifact order; one without a size or hash is an error."""
    from tessella.sources.readers import artifact_order

    some = files.where(F.col("path").startswith(prefix) & F.col("path").endswith(suffix))
    bad = F.col("size_bytes").isNull() | (F.col("size_bytes") <= 0) | ~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("file without size or hash: "), F.col("path"))).cast("string")).otherwise(F.col("path"))
    return artifact_order(some.withColumn("path", checked))


def inventory_totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.max("size_bytes").alias("largest"))


def host_summary(samples: DataFrame, by: list[str], at: str, gauges: list[str], counters: list[str]) -> DataFrame:
    """Least and greatest of gauges, last minus first of counters."""
    cols = [f(c).alias(f"{n}_{c}") for c in gauges for n, f in (("min", F.min), ("max", F.max))]
    cols += [(F.max_by(c, at) - F.min_by(c, at)).alias(f"delta_{c}") for c in counters]
    return samples.groupBy(*by).agg(F.count("*").alias("samples"), *cols)


def device_summary(samples: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Least, median and greatest over the values there are, and the share of samples that have one."""
    cols = [x for c in columns for x in (F.min(c).alias(f"min_{c}"), F.median(c).alias(f"median_{c}"), F.max(c).alias(f"max_{c}"), (F.count(c) / F.count("*")).alias(f"coverage_{c}"))]
    return samples.groupBy(*by).agg(*cols)


def expected_samples(samples: DataFrame, by: list[str], at: str, took: str, interval: float) -> DataFrame:
    """Samples over those that a sampler makes which waits ``interval`` after each collection."""
    out = samples.groupBy(*by).agg(F.count("*").alias("samples"), (F.max(at) - F.min(at)).alias("_span"), F.avg(took).alias("_took"))
    expected = F.floor(F.col("_span") / (F.lit(interval) + F.col("_took"))) + 1
    return out.select(*by, "samples", expected.alias("expected"), (F.col("samples") / expected).alias("coverage"))


def pauses(events: DataFrame, by: list[str], kind: str, seconds: str, kinds: list[str]) -> DataFrame:
    """Seconds of each kind of scheduled pause in columns; 0 where a run has none."""
    return events.groupBy(*by).agg(*[F.coalesce(F.sum(F.when(F.col(kind) == k, F.col(seconds))), F.lit(0.0)).alias(f"{k}_seconds") for k in kinds])


def decomposition(runs: DataFrame, role: str, rate: str, end_to_end: float, repetitions: int = 3, most_spread: float = 0.05) -> DataFrame:
    """Per role: least, median, greatest and relative range of its rates, its least rate over the whole's, and whether it repeats."""
    out = runs.groupBy(role).agg(F.count("*").alias("runs"), F.min(rate).alias("least"), F.median(rate).alias("median"), F.max(rate).alias("greatest"), relative_range(rate).alias("spread"))
    return out.withColumns({"ratio": F.col("least") / F.lit(end_to_end), "repeatable": (F.col("runs") == repetitions) & (F.col("spread") <= most_spread)})


def candidate_summary(runs: DataFrame, candidate: str, rate: str, passed: str, pauses_: list[str], most_spread: float = 0.05) -> DataFrame:
    """Per candidate: its conservative (least) rate, the middle and spread, the worst of each pause, and whether all its runs passed."""
    return runs.groupBy(candidate).agg(
        F.count("*").alias("runs"), F.min(rate).alias("conservative"), F.median(rate).alias("median"), F.max(rate).alias("greatest"), relative_range(rate).alias("spread"),
        F.coalesce(F.bool_and(passed), F.lit(False)).alias("all_passed"), *[F.max(p).alias(f"worst_{p}") for p in pauses_],
    ).withColumn("repeatable", F.col("spread") <= most_spread)


def slowed(speed: Column, pilot: Column, matrix: Column) -> Column:
    """A speed scaled by a pilot's slow-down against its measurement, never up."""
    return speed * F.least(F.lit(1.0), pilot / matrix)


def until_budget(df: DataFrame, by: list[str], order: list[str], amount: str, budget: int) -> DataFrame:
    """Rows up to the one that fills the budget, with ``used``: what of their amount still counts."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(amount).over(w), F.lit(0))
    return df.withColumn("used", F.least(F.col(amount), F.lit(budget) - before)).where("used > 0")


def accumulated(df: DataFrame, by: list[str], loss_sum: str, tokens: str) -> DataFrame:
    """Token-weighted loss of each group of micro-batches."""
    return df.groupBy(*by).agg((F.sum(loss_sum) / F.nullif(F.sum(tokens), F.lit(0))).alias("loss"), F.sum(tokens).alias("tokens"))


def average_so_far(df: DataFrame, by: list[str], order: list[str], tokens: str, elapsed: str) -> DataFrame:
    """Cumulative tokens over elapsed time; 0 before any time has passed."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("average", F.when(F.col(elapsed) > 0, F.sum(tokens).over(w) / F.col(elapsed)).otherwise(0.0))


def resource_rates(before: DataFrame, after: DataFrame, key: str, seconds: str, counters: list[str], may_fall: list[str]) -> DataFrame:
    """Rates of counters between two snapshots; only those in ``may_fall`` can be negative."""
    a, b = before.alias("a"), after.alias("b")
    time = F.nullif(F.col(f"b.{seconds}") - F.col(f"a.{seconds}"), F.lit(0.0))

    def change(c: str) -> Column:
        d = F.col(f"b.{c}") - F.col(f"a.{c}")
        return d if c in may_fall else F.greatest(d, F.lit(0))

    return a.join(b, key).select(key, *[(change(c) / time).alias(f"{c}_per_second") for c in counters])


def storage_by_device(roots: DataFrame, device: str, need: str, free: str, reserve: int) -> DataFrame:
    """What the roots on each file system need together, against its free space."""
    out = roots.groupBy(device).agg(F.sum(need).alias("needed"), F.min(free).alias("free"), F.count("*").alias("roots"))
    return out.withColumn("enough", F.col("free") - F.col("needed") >= reserve)


def cache_telemetry(rows: DataFrame, by: list[str], at: str, sums: list[str]) -> DataFrame:
    """Sums of counters, the largest size, and the last free space."""
    return rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums], F.max("size_bytes").alias("size_bytes"), F.max_by("free_bytes", at).alias("free_bytes"))


def eviction_victim(shards: DataFrame, leased: str = "leased", used: str = "used_at") -> DataFrame:
    """The shard that was used longest ago among those without a lease."""
    return shards.where(~F.col(leased)).orderBy(used, "path").limit(1)


def lineage_breaks(segments: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Segments whose parent boundary is missing, not before them, or not where they start."""
    s, b = segments.alias("s"), boundaries.alias("b")
    first = F.col("s.parent").isNull()
    problem = (
        F.when(~first & F.col("b.boundary").isNull(), "no such parent").when(~first & (F.col("b.segment") >= F.col("s.segment")), "parent is not earlier")
        .when(~first & (F.col("b.step") != F.col("s.start_step")), "does not start where its parent ends").when(first & (F.col("s.start_step") != 0), "does not start at 0")
    )
    return s.join(b, F.col("s.parent") == F.col("b.boundary"), "left").select("s.segment", problem.alias("problem")).where("problem is not null")


def newest_valid(files: DataFrame, by: list[str], step: str, recorded: str, actual: str) -> DataFrame:
    """The newest file of each group whose content is what was recorded; corrupt newer ones are passed over."""
    w = Window.partitionBy(*by).orderBy(F.desc(step))
    return files.where(F.col(recorded) == F.col(actual)).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def fresh(recorded: Column, now: Column, most_seconds: float, ahead: float = 60.0) -> Column:
    """A snapshot is usable if it isn't too old, nor further ahead than clocks differ."""
    age = F.unix_timestamp(now) - F.unix_timestamp(recorded)
    return (age >= -ahead) & (age <= most_seconds)


def top_k_probabilities(logits: DataFrame, by: list[str], token: str, logit: str, k: int, temperature: float) -> DataFrame:
    """Sampling probabilities: softmax at a temperature over each group's k largest logits."""
    w = Window.partitionBy(*by)
    top = logits.withColumn("_n", F.row_number().over(w.orderBy(F.desc(logit), token))).where(F.col("_n") <= k)
    top = top.withColumn("_e", F.exp((F.col(logit) - F.max(logit).over(w)) / F.lit(temperature)))
    return top.select(*by, token, (F.col("_e") / F.sum("_e").over(w)).alias("probability"))


def round_trips(df: DataFrame, by: list[str], text: str, decoded: str, key: str, unknown: Column, fallbacks: Column, examples: int = 10) -> DataFrame:
    """Texts that don't come back from their tokens, with the first keys, and counts of unknown and byte pieces."""
    w = Window.partitionBy(*by).orderBy(F.when(F.col("_bad"), 0).otherwise(1), key)
    df = df.withColumns({"_bad": ~F.col(text).eqNullSafe(F.col(decoded)), "_u": unknown, "_f": fallbacks})
    df = df.withColumn("_n", F.row_number().over(w))
    first = F.array_sort(F.collect_list(F.when(F.col("_bad") & (F.col("_n") <= examples), F.col(key))))  # at most ``examples`` a group
    return df.groupBy(*by).agg(F.count("*").alias("texts"), F.count_if("_bad").alias("failures"), F.sum("_u").alias("unknown"), F.sum("_f").alias("fallbacks"), first.alias("examples"))


def deterministic(outcomes: DataFrame, key: str) -> DataFrame:
    """Inputs that were tried repeatedly: whether they were rejected, and always in the same way."""
    return outcomes.groupBy(key).agg(F.bool_and("rejected").alias("rejected"), (F.countDistinct(F.coalesce("outcome", F.lit(""))) == 1).alias("deterministic"))


def fixed_work(steps: DataFrame, by: list[str], step: str, tokens: str, n: int, per_step: int) -> DataFrame:
    """Whether each run has exactly the steps 1 to n with equal tokens, and their sum."""
    return steps.groupBy(*by).agg(
        ((F.count("*") == n) & (F.countDistinct(step) == n) & (F.min(step) == 1) & (F.max(step) == n)).alias("complete"),
        F.bool_and(F.col(tokens) == per_step).alias("constant"), (F.sum(tokens) == n * per_step).alias("total"),
    )


def memory_stable(edges: DataFrame, first: str = "first_median", last: str = "last_median", slack: int = 128 << 20, share: float = 0.05) -> DataFrame:
    """The last median may exceed the first by a fixed slack or a share of it, whichever is more."""
    return edges.withColumn("stable", F.col(last) <= F.col(first) + F.greatest(F.lit(slack), F.col(first) * share))


def tail_note(df: DataFrame, by: list[str], value: str, most: float = 1.5) -> DataFrame:
    out = df.groupBy(*by).agg(nearest_rank(value, 0.95).alias("p95"), F.median(value).alias("median"))
    return out.withColumn("heavy_tail", F.col("p95") / F.col("median") > most)


def telemetry_stream(spark: SparkSession, rows_per_second: int = 1) -> DataFrame:
    """A stream of time-stamped rows in the place of a live sampler, for tests of plans over one."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select(F.unix_micros("timestamp").alias("wall_time_us"), (F.col("value") / rows_per_second).alias("monotonic_seconds"))
