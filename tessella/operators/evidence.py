"""Analytics over telemetry, metrics and run evidence: gaps, coverage, runs, deltas, cadences, summaries and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


def gaps(df: DataFrame, by: list[str], at: Column) -> DataFrame:
    """Per group: samples, the largest gap between neighbours, and whether times strictly increase. ``at`` in seconds; ordered by itself."""
    w = Window.partitionBy(*by).orderBy("_at")
    df = df.withColumn("_at", at).withColumn("_gap", F.col("_at") - F.lag("_at").over(w))
    return df.groupBy(*by).agg(F.count("*").alias("samples"), F.max("_gap").alias("max_gap"), F.coalesce(F.bool_and(F.col("_gap") > 0), F.lit(True)).alias("increasing"))


def coverage(df: DataFrame, by: list[str], at: Column, start: Column, end: Column, interval: float) -> DataFrame:
    """Per group: samples over those expected, the delay of the first and the gap behind the last."""
    df = df.withColumns({"_at": at, "_s": start, "_e": end})
    out = df.groupBy(*by).agg(F.count("*").alias("samples"), F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.first("_s").alias("_s"), F.first("_e").alias("_e"))
    expected = F.ceil((F.col("_e") - F.col("_s")) / F.lit(interval))
    return out.select(*by, "samples", expected.alias("expected"), (F.col("samples") / F.nullif(expected, F.lit(0))).alias("coverage"), (F.col("_first") - F.col("_s")).alias("start_delay"), (F.col("_e") - F.col("_last")).alias("end_gap"))


def longest_run(df: DataFrame, by: list[str], order: list[str], holds: Column) -> DataFrame:
    """Per group: the most consecutive rows for which ``holds`` is true."""
    w = Window.partitionBy(*by).orderBy(*order)
    df = df.withColumn("_h", F.coalesce(holds, F.lit(False))).withColumn("_breaks", F.sum(F.when(F.col("_h"), 0).otherwise(1)).over(w))
    runs = df.groupBy(*by, "_breaks").agg(F.count_if("_h").alias("_n"))
    return runs.groupBy(*by).agg(F.max("_n").alias("longest"))


def counter_delta(df: DataFrame, by: list[str], order: Column, value: str) -> DataFrame:
    """Per group: least, greatest and last minus first value of a counter."""
    return df.withColumn("_o", order).groupBy(*by).agg(F.min(value).alias("least"), F.max(value).alias("greatest"), (F.max_by(value, "_o") - F.min_by(value, "_o")).alias("delta"))


def falls(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows where a counter that must not fall does."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("previous", F.lag(value).over(w)).where(F.col(value) < F.col("previous"))


def cadence(df: DataFrame, by: list[str], order: list[str], amount: str, every: int) -> DataFrame:
    """Rows at which the running total passes a multiple of ``every``; one event however many multiples it passes."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("total", F.sum(amount).over(w))
    return df.where(F.floor(F.col("total") / every) > F.floor((F.col("total") - F.col(amount)) / every))


def best_so_far(df: DataFrame, by: list[str], order: list[str], loss: str) -> DataFrame:
    """Rows with a strictly lower loss than every earlier one."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_before", F.min(loss).over(w)).where(F.col("_before").isNull() | (F.col(loss) < F.col("_before"))).drop("_before")


def repeat_summary(df: DataFrame, run: str, metric: str, value: str) -> DataFrame:
    """Median, least, greatest and spread of each metric that every run has."""
    runs = df.select(run).distinct().agg(F.count("*").alias("_runs"))
    out = df.groupBy(metric).agg(F.countDistinct(run).alias("_n"), F.median(value).alias("median"), F.min(value).alias("least"), F.max(value).alias("greatest"))
    out = out.withColumn("spread", (F.col("greatest") - F.col("least")) / F.nullif(F.col("median"), F.lit(0.0)))
    return out.crossJoin(F.broadcast(runs)).where("_n = _runs").drop("_n", "_runs")  # one row is broadcast


def window_edges(df: DataFrame, by: list[str], order: list[str], value: str, n: int) -> DataFrame:
    """Medians and minima of the first and the last rows of each group: ``n`` of them, or half of a short group."""
    up, whole = Window.partitionBy(*by).orderBy(*order), Window.partitionBy(*by)
    df = df.withColumns({"_up": F.row_number().over(up), "_all": F.count("*").over(whole)})
    size = F.least(F.lit(n), F.greatest(F.lit(1), F.floor(F.col("_all") / 2)))
    first, last = F.when(F.col("_up") <= size, F.col(value)), F.when(F.col("_up") > F.col("_all") - size, F.col(value))
    out = df.select(*by, first.alias("_f"), last.alias("_l")).groupBy(*by).agg(F.median("_f").alias("first_median"), F.median("_l").alias("last_median"), F.min("_f").alias("_fm"), F.min("_l").alias("_lm"))
    return out.withColumn("growth", F.greatest(F.lit(0), F.col("_lm") - F.col("_fm"))).drop("_fm", "_lm")


def weighted_nll(df: DataFrame, corpus: str, loss_sum: str, targets: str) -> DataFrame:
    """Token-weighted loss and perplexity by corpus and over all (a null corpus)."""
    from tessella.functions.measures import perplexity

    out = df.groupingSets([[F.col(corpus)], []], F.col(corpus)).agg(F.sum(loss_sum).alias("loss"), F.sum(targets).alias("targets"))
    nll, ppl, over = perplexity(F.col("loss"), F.col("targets"))
    return out.select(corpus, "targets", nll.alias("nll"), ppl.alias("perplexity"), over.alias("overflow"))


def compression(df: DataFrame, stratum: str, text: str, tokens: Column) -> DataFrame:
    """Tokens, code points and bytes with their ratios, and quantiles of a document's tokens, by stratum and over all (a null stratum)."""
    df = df.withColumns({"_t": tokens, "_c": F.length(text), "_b": F.octet_length(text)})
    out = df.groupingSets([[F.col(stratum)], []], F.col(stratum)).agg(F.count("*").alias("documents"), F.sum("_t").alias("tokens"), F.sum("_c").alias("codepoints"), F.sum("_b").alias("bytes"), *[F.expr(f"percentile(_t, {q})").alias(f"tokens_p{int(q * 100)}") for q in (0.5, 0.95, 0.99)])
    return out.withColumns({"tokens_per_byte": F.col("tokens") / F.col("bytes"), "tokens_per_codepoint": F.col("tokens") / F.col("codepoints")})


def step_summary(steps: DataFrame, logs: DataFrame, run: str = "run", step: str = "step", targets: str = "targets", wall: str = "wall", wait: str = "wait", pause: str = "pause", warmup: int = 0) -> DataFrame:
    """Post-warm-up steps of each run: targets over step time and the pauses logged at those steps, quantiles of step time, share of waiting."""
    own = steps.where(F.col(step) > warmup)
    paused = logs.join(own.select(run, step), [run, step], "left_semi").groupBy(run).agg(F.sum(pause).alias("_p"))
    out = own.groupBy(run).agg(F.sum(targets).alias("targets"), F.sum(wall).alias("_w"), F.median(wall).alias("step_median"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {wall})").alias("step_p95"), F.max(wall).alias("step_max"), F.sum(wait).alias("_d"))
    out = out.join(paused, run, "left")
    return out.select(run, "targets", (F.col("targets") / (F.col("_w") + F.coalesce("_p", F.lit(0.0)))).alias("targets_per_second"), "step_median", "step_p95", "step_max", (F.col("_d") / F.col("_w")).alias("wait_fraction"))


def phase_sums(df: DataFrame, by: list[str], phases: str) -> DataFrame:
    """Sums over a map column, a row a phase."""
    return df.select(*by, F.explode(phases).alias("phase", "seconds")).groupBy(*by, "phase").agg(F.sum("seconds").alias("seconds"))


def unexplained(wall: Column, phases: Column, sync: Column) -> Column:
    """A step's wall time that neither its phases nor synchronisation account for."""
    return wall - F.aggregate(F.map_values(phases), F.lit(0.0), lambda s, x: s + x) - sync


def has_phases(phases: Column, required: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, required)), F.map_keys(phases))) == 0


def all_finite(columns: list[str]) -> Column:
    """Aggregate: every value is a finite number or null."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.coalesce(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.lit(True))
    return F.bool_and(ok)


def between_bounds(df: DataFrame, at: str, bounds: DataFrame, low: str, high: str) -> DataFrame:
    """Rows inside the interval of a one-row table of bounds."""
    return df.join(F.broadcast(bounds.limit(1)), F.col(at).between(F.col(low), F.col(high))).drop(low, high)  # one row


def missing_and_extra(planned: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Planned keys that weren't observed, and observed ones that weren't planned."""
    a = planned.join(observed, keys, "left_anti").select(*keys).withColumn("problem", F.lit("missing"))
    b = observed.join(planned, keys, "left_anti").select(*keys).withColumn("problem", F.lit("extra"))
    return a.unionByName(b.distinct())


def sequence_gaps(df: DataFrame, step: str, n: int) -> DataFrame:
    """Steps that a run of 1 to ``n`` should have and hasn't, or has and shouldn't."""
    return missing_and_extra(df.sparkSession.range(1, n + 1).select(F.col("id").alias(step)), df.select(step), [step])


def disagreements(df: DataFrame, columns: list[str]) -> DataFrame:
    """Identity columns that don't have one value over all rows."""
    one = df.agg(*[F.countDistinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("values")) for c in columns])).alias("x")).select("x.*").where("values > 1")


def verdict(df: DataFrame, failed: str, warned: str) -> DataFrame:
    """FAIL if anything failed, PASS WITH NOTE if anything warned, else PASS."""
    v = F.when(F.bool_or(failed), "FAIL").when(F.bool_or(warned), "PASS WITH NOTE").otherwise("PASS")
    return df.agg(v.alias("verdict"))


def valid_histogram(counts: Column, bins: Column) -> Column:
    """Counts are not negative and not all 0; there is one bin edge more, and edges don't fall."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.forall(counts, lambda x: x >= 0) & (total > 0) & (F.size(bins) == F.size(counts) + 1) & (F.array_sort(bins) == bins)


def running_peak(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("peak", F.max(value).over(w))


def lifecycle(df: DataFrame, by: list[str], required: list[tuple[str, str]], forbidden: list[tuple[str, str]]) -> DataFrame:
    """Per group: whether all required (action, outcome) pairs occurred and no forbidden one did."""
    seen = df.groupBy(*by).agg(F.collect_set(F.concat_ws("/", "action", "outcome")).alias("_s"))  # a set of pairs of a fixed vocabulary
    pairs = lambda xs: F.array(*[F.lit(f"{a}/{o}") for a, o in xs]).cast("array<string>")
    return seen.select(*by, (F.size(F.array_except(pairs(required), "_s")) == 0).alias("complete"), (~F.arrays_overlap(pairs(forbidden), F.col("_s"))).alias("clean"))


def inventory_problems(listed: DataFrame, actual: DataFrame) -> DataFrame:
    """Files (``path``, ``sha256``) that are missing, extra or changed."""
    a, b = listed.alias("a"), actual.alias("b")
    problem = F.when(F.col("b.sha256").isNull(), "missing").when(F.col("a.sha256").isNull(), "extra").when(F.col("a.sha256") != F.col("b.sha256"), "changed")
    return a.join(b, "path", "full").select("path", problem.alias("problem")).where("problem is not null")


def file_hashes(spark, path: str) -> DataFrame:
    """``path``, ``size_bytes`` and ``sha256`` of the files under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
