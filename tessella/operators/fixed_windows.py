"""Fixed windows over a token stream in closed form: no token is moved to count, attribute or place.

Documents laid end to end hold positions [start, end). Window k has the positions
[k s, k s + W) with stride s = W - 1, so its last token opens the next one. Every
position but the stream's first is a target of one window: a document's targets are
[max(start, 1), end), and it touches windows (max(start, 1) - 1) div s to (end - 2) div s.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def full_windows(total: int, width: int) -> tuple[int, int]:
    """Full windows of a stream, and targets of its tail."""
    return max(0, total - 1) // (width - 1), max(0, total - 1) % (width - 1)


def layout(spark: SparkSession, total: int, width: int, keep_tail: bool = False, budget: int | None = None) -> DataFrame:
    """The windows of a stream of ``total`` tokens: ``window_id``, ``window_tokens`` and ``targets``.

    With ``keep_tail`` the rest is a short last window if it has a target. A target
    ``budget`` ends the stream: the window that reaches it is cut, later ones are left out;
    a stream that has too few targets for it is an error.
    """
    full, tail = full_windows(total, width)
    rows = full + (1 if keep_tail and tail else 0)
    there = full * (width - 1) + (tail if keep_tail else 0)
    if budget is not None and there < budget:
        raise ValueError(f"the stream ends {budget - there} targets before its budget")
    if budget is not None:
        rows = min(rows, -(-budget // (width - 1)))
    left = F.lit(total - 1 if budget is None else min(budget, total - 1)) - F.col("id") * (width - 1)
    targets = F.least(F.lit(width - 1), left)
    return spark.range(rows).select(F.col("id").alias("window_id"), (targets + 1).alias("window_tokens"), targets.alias("targets"))


def touched(df: DataFrame, start: str, length: str, width: int) -> DataFrame:
    """A row for each window that has targets of a document, with ``window_id`` and ``targets``."""
    s, e = F.greatest(F.col(start), F.lit(1)), F.col(start) + F.col(length)
    stride = F.lit(width - 1)
    first, last = F.floor((s - 1) / stride), F.floor((e - 2) / stride)
    df = df.where(e > s).withColumn("window_id", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    k = F.col("window_id") * stride
    return df.withColumn("targets", F.least(e, k + stride + 1) - F.greatest(s, k + 1))


def spans(df: DataFrame, start: str, length: str, width: int, full: int) -> DataFrame:
    """A row for each full window and document with tokens in it: its clipped ``span_start`` and ``span_end`` there."""
    stride, e = F.lit(width - 1), F.col(start) + F.col(length)
    first = F.greatest(F.lit(0), F.ceil((F.col(start) - F.lit(width - 1)) / stride))
    last = F.least(F.floor((e - 1) / stride), F.lit(full - 1))
    df = df.where((F.col(length) > 0) & (last >= first)).withColumn("window_id", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    k = F.col("window_id") * stride
    df = df.withColumns({"span_start": F.greatest(F.col(start) - k, F.lit(0)), "span_end": F.least(e - k, F.lit(width))})
    return df.where("span_end > span_start")


def window_ids(df: DataFrame, start: str, ids: str, width: int, full: int) -> DataFrame:
    """The windows themselves: ``window_id`` and ``input_ids``. Pieces of documents are cut out and put together by window."""
    df = spans(df.withColumn("_n", F.size(ids).cast("long")), start, "_n", width, full)
    at = F.greatest(F.col("window_id") * (width - 1) - F.col(start), F.lit(0))
    piece = F.slice(F.col(ids), (at + 1).cast("int"), (F.col("span_end") - F.col("span_start")).cast("int"))
    parts = df.select("window_id", F.struct(F.col("span_start").alias("at"), piece.alias("piece")).alias("part"))
    parts = parts.groupBy("window_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return parts.select("window_id", F.flatten(F.transform("parts", lambda p: p["piece"])).alias("input_ids"))


def inputs_and_labels(ids: Column) -> tuple[Column, Column]:
    """Model inputs and labels: the same ids, one apart."""
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    return F.slice(ids, F.lit(1), n), F.slice(ids, F.lit(2), n)


def target_sources(spans_: Column) -> Column:
    """The source of each target of a window from its spans (structs of source, start, end)."""
    return F.flatten(F.transform(spans_, lambda s: F.array_repeat(s["source"], (s["end"] - F.greatest(s["start"], F.lit(1))).cast("int"))))


def stride_one(ids: Column, length: int) -> Column:
    """All overlapping pairs of ``length`` inputs and labels, one position apart."""
    starts = F.when(F.size(ids) > length, F.sequence(F.lit(0), F.size(ids) - length - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(F.slice(ids, i + 1, length).alias("inputs"), F.slice(ids, i + 2, length).alias("labels")))
