"""Exact token quotas by largest remainder, and cutting sources to them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.totals import running_total_by


def largest_remainder(ratios: DataFrame, total: int, name: str = "name", ratio: str = "ratio") -> DataFrame:
    """Adds ``quota``: floor(total * ratio), and one more for the largest fractions; of equal fractions the larger name wins.

    One row a source; products are doubles as in configuration files.
    """
    raw = F.lit(float(total)) * F.col(ratio).cast("double")
    df = ratios.withColumn("_floor", F.floor(raw)).withColumn("_rest", raw - F.floor(raw))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spare = F.lit(total) - F.sum("_floor").over(everything)
    place = F.row_number().over(Window.orderBy(F.desc("_rest"), F.desc(name)))
    df = df.withColumn("_spare", spare).withColumn("_place", place)
    return df.withColumn("quota", (F.col("_floor") + F.when(F.col("_place") <= F.col("_spare"), 1).otherwise(0)).cast("long")).drop("_floor", "_rest", "_spare", "_place")


def largest_remainder_of(ratios: dict[str, float], total: int) -> dict[str, int]:
    """The same for a configuration held by the driver."""
    out = {k: math.floor(total * float(r)) for k, r in ratios.items()}
    rest = sorted(ratios, key=lambda k: (total * float(ratios[k]) - math.floor(total * float(ratios[k])), k), reverse=True)
    for k in rest[: total - sum(out.values())]:
        out[k] += 1
    return out


def keep_within(length: Column, before: Column, quota: Column) -> Column:
    """How many of a document's tokens a quota leaves, given those before it; a document of unknown length has none."""
    return F.greatest(F.lit(0), F.least(F.coalesce(length, F.lit(0)), quota - before))


def cut_to_quota(df: DataFrame, source: str, order: str, length: str, quota: str) -> DataFrame:
    """Adds ``kept`` tokens of each document, taken in ``order`` (of equal places the shorter first) until its source's quota is full; drops documents without any.

    A source with most of the rows is spread over many tasks: the running sum has two levels.
    """
    df = running_total_by(df.withColumn(length, F.coalesce(F.col(length), F.lit(0))), source, length, [order, length], "_used")
    return df.withColumn("kept", keep_within(F.col(length), F.col("_used"), F.col(quota))).where("kept > 0").drop("_used")


def cut_ids(ids: Column, keep: Column, end: int) -> Column:
    """Ids cut to ``keep``, the last of them the end id if any were cut off."""
    cut = F.concat(F.slice(ids, F.lit(1), F.greatest(keep - 1, F.lit(0))), F.array(F.lit(end)))
    return F.when(F.size(ids) <= keep, ids).otherwise(cut)


def cut_bytes(text: Column, keep: Column) -> Column:
    """The text that byte ids cut to ``keep`` (the last of them an end) decode to; whole where all fit, and a character that was cut in two is left out."""
    data = F.encode(text, "UTF-8")
    most = F.greatest(keep - 1, F.lit(0)).cast("int")
    cut = F.coalesce(*[F.when(F.is_valid_utf8(part), part) for part in (F.substring(data, F.lit(1), F.greatest(most - k, F.lit(0))).cast("string") for k in range(4))])
    return F.when(F.octet_length(text) + 1 <= keep, text).otherwise(cut)


def truncation_counts(df: DataFrame, by: str, length: str, kept: str) -> DataFrame:
    """Documents that a target quota cut, and the tokens that it removed, by source."""
    cut = F.col(kept) < F.col(length)
    return df.groupBy(by).agg(F.count_if(cut).alias("fragments"), F.coalesce(F.sum(F.when(cut, F.col(length) - F.col(kept))), F.lit(0)).alias("removed_tokens"))


def ratio_report(counts: DataFrame, expected: DataFrame, name: str, amount: str, tolerance: float) -> DataFrame:
    """Realised share of each source beside the expected one, and whether they differ by no more than ``tolerance``."""
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = counts.join(expected, name).withColumn("realized", F.col(amount) / F.sum(amount).over(everything))
    return df.withColumn("deviation", F.abs(F.col("realized") - F.col("ratio"))).withColumn("within", F.col("deviation") <= tolerance)
