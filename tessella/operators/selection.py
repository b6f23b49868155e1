"""Choosing among candidates: dominance, winners, constrained choice, projections, gates.

Candidates are few (configurations, not documents); their inequality joins are between
rows of a table that a run of measurements makes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.totals import running_total


def pareto(df: DataFrame, key: str, low: list[str], high: list[str]) -> DataFrame:
    """Candidates that no other one equals or beats in every measure while differing in one."""
    a, b = df.alias("a"), df.alias("b")
    no_worse, same = F.lit(True), F.lit(True)
    for c in low:
        no_worse = no_worse & (F.col(f"b.{c}") <= F.col(f"a.{c}"))
    for c in high:
        no_worse = no_worse & (F.col(f"b.{c}") >= F.col(f"a.{c}"))
    for c in low + high:
        same = same & (F.col(f"b.{c}") == F.col(f"a.{c}"))
    return a.join(b, (F.col(f"a.{key}") != F.col(f"b.{key}")) & no_worse & ~same, "left_anti")


def winner(df: DataFrame, key: str, size: str, costs: list[str], speed: str, least_speed: str, each: float = 0.05, one: float = 0.10) -> DataFrame:
    """The smallest candidate, unless others gain at least ``each`` in every cost and ``one`` in some, at no less than its least speed: then the largest gain.

    Of equal gains the smaller candidate stays.
    """
    base = df.orderBy(size, key).limit(1).select(*[F.col(c).alias(f"_b_{c}") for c in (*costs, least_speed, key)])
    gains = [F.lit(1) - F.col(c) / F.col(f"_b_{c}") for c in costs]
    total = sum(gains[1:], gains[0])
    ok = F.col(speed) >= F.col(f"_b_{least_speed}")
    for g in gains:
        ok = ok & (g >= each)
    ok = ok & (F.greatest(*gains) >= one) if len(gains) > 1 else ok & (gains[0] >= one)
    rows = df.crossJoin(F.broadcast(base))  # one row
    rows = rows.withColumns({"promoted": ok & (F.col(key) != F.col(f"_b_{key}")), "gain": total}).where(F.col("promoted") | (F.col(key) == F.col(f"_b_{key}")))
    return rows.orderBy(F.desc("promoted"), F.when(F.col("promoted"), F.col("gain")).desc(), size, key).limit(1).select(*df.columns, "promoted")


def constrained_choice(df: DataFrame, eligible: Column, speed: str, depth: str, context: str, slowdown: float, floor: float) -> DataFrame:
    """Gates, then within ``slowdown`` of the fastest, then the deepest, then at least ``floor`` of that depth's fastest, then the longest context.

    More or less than one row is left to the caller to refuse.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def most(c: str) -> Column:
        return F.max(c).over(everything)

    df = df.where(eligible)
    for keep in (F.col(speed) >= most(speed) * F.lit(1.0 - slowdown), F.col(depth) == most(depth), F.col(speed) >= most(speed) * F.lit(floor), F.col(context) == most(context)):
        df = df.withColumn("_keep", keep).where("_keep").drop("_keep")
    return df


def only(df: DataFrame, what: str = "choice"):
    """The one row of a choice that has to be unique; none or more is an error."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"the {what} isn't unique" if rows else f"there is no {what}")
    return rows[0]


def elapsed(steps: Column, per_step: int, speed: Column, pauses: dict[str, tuple[int, float]], log_every: int, log_seconds: float, final_seconds: float) -> Column:
    """Seconds of a run of ``steps``: computing, log pauses by steps, other pauses by targets, and the end."""
    targets = steps * per_step
    out = targets / speed + F.floor(steps / log_every) * log_seconds + final_seconds
    for every, seconds in pauses.values():
        out = out + F.floor(targets / every) * seconds
    return out


def token_budget(df: DataFrame, key: str, speed: str, duration: float, per_step: int, pauses: dict[str, tuple[int, float]], log_every: int, log_seconds: float, final_seconds: float) -> DataFrame:
    """The most targets a run can train within ``duration``.

    Elapsed time rises with the steps, so the answer is found by halving: 60 rounds of
    an expression over the candidates, whatever the number of steps.
    """
    most = F.greatest(F.lit(0), F.floor(F.col(speed) * duration / per_step))
    bounds = F.struct(F.lit(0).cast("long").alias("low"), most.cast("long").alias("high"))

    def halve(b: Column, _: Column) -> Column:
        middle = F.floor((b["low"] + b["high"] + 1) / 2)
        fits = elapsed(middle, per_step, F.col(speed), pauses, log_every, log_seconds, final_seconds) <= duration
        return F.when(b["low"] >= b["high"], b).otherwise(F.struct(F.when(fits, middle).otherwise(b["low"]).alias("low"), F.when(fits, b["high"]).otherwise(middle - 1).alias("high")))

    return df.select(key, (F.aggregate(F.sequence(F.lit(1), F.lit(60)), bounds, halve)["low"] * per_step).alias("token_budget"))


def supply(loader: Column, model: Column, least: float = 1.2) -> Column:
    """Which of loader and model is the nearer ceiling, or that the loader's headroom is too small."""
    return F.when(loader < least, "loader headroom too small").when(loader <= model, "loader").otherwise("model")


def gates(names: list[str]) -> Column:
    """All named booleans hold; a null is no pass."""
    out = F.lit(True)
    for n in names:
        out = out & F.coalesce(F.col(n), F.lit(False))
    return out


def headroom(free: Column, managed: Column, cap: Column, largest: Column, reserve: Column) -> Column:
    """Bytes left of free space when the managed files grow to their cap and one more largest file comes, over the reserve."""
    return free + managed - cap - largest - reserve


def checkpoint_bytes(size: Column, tokens: Column, milestone: int, evidence: Column, recoveries: int = 3) -> Column:
    """Storage of a run: recovery copies, one best, one final, one being written, and a copy a milestone, beside its evidence."""
    return size * (F.lit(recoveries + 3) + F.ceil(tokens / milestone)) + evidence


def admitted(df: DataFrame, order: list[str], key: str, size: str, limit: int) -> DataFrame:
    """Uploads in order, each content once, as long as their bytes stay within a limit."""
    first = df.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), F.struct(*order)).alias("_row"))
    first = first.select(*[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in df.columns])
    out = running_total(first, size, order, "_used")
    return out.withColumn("projected", F.col("_used") + F.col(size)).withColumn("admitted", F.col("projected") <= limit).drop("_used")


def weaker_thresholds(own: DataFrame, committed: DataFrame, name: str = "name") -> DataFrame:
    """Thresholds that are weaker than the committed ones: a floor that fell, a ceiling that rose, or one that is gone."""
    a, b = own.alias("a"), committed.alias("b")
    weaker = F.col("a.value").isNull() | ((F.col("b.kind") == "floor") & (F.col("a.value") < F.col("b.value"))) | ((F.col("b.kind") == "ceiling") & (F.col("a.value") > F.col("b.value")))
    return b.join(a, name, "left").where(weaker).select(name, F.col("b.value").alias("committed"), F.col("a.value").alias("own"))


def matrix(spark, models: list[str], contexts: list[int], repetitions: int, shift: int = 3) -> DataFrame:
    """A row a run: all pairs of models and contexts in each repetition, each time in an order that starts ``shift`` places later."""
    arms = [(i, m, c) for i, (m, c) in enumerate((m, c) for m in models for c in contexts)]
    df = spark.createDataFrame(arms, "arm int, model string, context int").crossJoin(spark.range(1, repetitions + 1).select(F.col("id").cast("int").alias("repetition")))
    place = F.pmod(F.col("arm") - (F.col("repetition") - 1) * shift, F.lit(len(arms)))
    return df.withColumn("place", place.cast("int"))
