"""Corpus accounting: per-source audits, duplicates, nulls, disjointness and index checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_duplicates(df: DataFrame, key: str, order: str) -> DataFrame:
    """Adds ``duplicate``: not the first row, in ``order``, with its ``key``.

    The first row of each key is a minimum that is combined on the map side, so a key
    with very many copies is no hot task. Null is a key like others.
    """
    first = df.groupBy(F.col(key).alias("_key")).agg(F.min(order).alias("_first"))
    return df.join(first, F.col(key).eqNullSafe(F.col("_key"))).drop("_key").withColumn("duplicate", F.col(order) != F.col("_first")).drop("_first")


def summed(df: DataFrame, key: str, by: str, order: str, sums: dict[str, Column]) -> DataFrame:
    """One row a ``by``: ``documents``, ``sums`` (of values a row), and ``duplicates``: rows that aren't the first with their ``key``, by (order, by).

    Rows are reduced to one a (key, by) first, in one pass over them; that table gives
    the sums and the owner of each key's first row. Null is a key and a ``by`` like others.
    """
    small = df.groupBy(F.col(key).alias("_key"), F.col(by).alias("_by")).agg(F.count("*").alias("_rows"), F.min(F.struct(F.col(order).alias("o"))).alias("_first"), *[F.sum(c).alias(n) for n, c in sums.items()])
    owner = small.groupBy("_key").agg(F.min(F.struct("_first", "_by")).alias("_own")).groupBy(F.col("_own._by").alias("_owner")).agg(F.count("*").alias("_firsts"))
    total = small.groupBy("_by").agg(F.sum("_rows").alias("documents"), *[F.sum(n).alias(n) for n in sums])
    out = total.join(owner, F.col("_by").eqNullSafe(F.col("_owner")), "left")
    return out.select(F.col("_by").alias(by), "documents", *sums, (F.col("documents") - F.coalesce("_firsts", F.lit(0))).alias("duplicates"))


def audit(df: DataFrame, by: str, text: str, key: str, order: str, tokens: Column, truncated: Column | None = None) -> DataFrame:
    """One row a source: documents, bytes, tokens, end tokens, script sums, languages, duplicates and truncated ones. ``df`` has ``scripts`` and ``language``; texts are reduced to lengths before any shuffle."""
    language = {f"lang_{n}": F.when(F.col("language") == n, 1).otherwise(0).cast("long") for n in ("en", "ja", "mixed", "other")}
    scripts = {n: F.col(f"scripts.{n}") for n in ("latin", "japanese", "other")}
    cut = F.coalesce(truncated if truncated is not None else F.lit(False), F.lit(False)).cast("int").cast("long")
    values = {"text_bytes": F.octet_length(text), "tokens": tokens, **scripts, **language, "truncated": cut}
    narrow = df.select(key, by, order, *[c.alias(n) for n, c in values.items()])
    out = summed(narrow, key, by, order, {n: F.col(n) for n in values})
    return out.withColumn("end_tokens", F.col("documents"))


def null_accounting(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row (``reason`` null:<column>, ``events``) a column: one pass, then turned to rows."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f"null:{c}").alias("reason"), F.col(c).alias("events")) for c in columns])).alias("x")).select("x.reason", "x.events")


def event_counts(judged: DataFrame, reason: str, nulls: list[str]) -> DataFrame:
    """Rows (``event``, ``n``) of a judged scan: raw rows, accepted ones, reasons, and null cells by column; one pass."""
    one = F.explode(F.array_compact(F.array(F.lit("rows"), F.coalesce(F.col(reason), F.lit("accepted")), *[F.when(F.col(c).isNull(), F.lit(f"null:{c}")) for c in nulls])))
    return judged.select(one.alias("event")).groupBy("event").agg(F.count("*").alias("n"))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of ``a`` that ``b`` has too; it must be empty for disjoint sets."""
    return a.select(key).where(F.col(key).isNotNull()).distinct().join(b.select(key), key, "left_semi")


def repeated(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def differences(source: DataFrame, index: DataFrame, at: str, columns: list[str]) -> DataFrame:
    """Positions at which an index doesn't agree with its source: missing on a side, or any column differs."""
    a, b = (d.select(at, *columns).withColumn("_here", F.lit(True)) for d in (source, index))
    a, b = a.alias("a"), b.alias("b")
    unequal = F.col("a._here").isNull() | F.col("b._here").isNull()
    for c in columns:
        unequal = unequal | ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, at, "full").where(unequal).select(at, F.col("a._here").isNotNull().alias("in_source"), F.col("b._here").isNotNull().alias("in_index"))


def merge_counters(a: DataFrame, b: DataFrame, key: str, columns_a: list[str], columns_b: list[str]) -> DataFrame:
    """Counters of two origins side by side, 0 where one has no row."""
    return a.join(b, key, "full").select(key, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in [*columns_a, *columns_b]])


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with their ``side``."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def latest(df: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """The newest ``n`` rows of each group."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
