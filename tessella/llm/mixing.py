"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

1. *Targets.* Sources share a total by weight; a target stops at ``max_copies``
   times its source's size and the excess is shared again by weight. That is a
   water level, found in one pass over the sources ordered by cap / weight.
2. *Whole copies.* A document's expected copies e (its source's target over its
   size, shared by the optional document weights and again stopped at
   ``max_copies``) give floor(e) certain copies.
3. *Pareto order.* The remaining inclusion probability p = e - floor(e) ranks the
   documents of a source by q = (u / (1 - u)) / (p / (1 - p)), u uniform from a hash
   of seed, id and text. The sample is the prefix in that order whose words come
   nearest to what whole copies leave of the target: a document is in if the
   middle of its words lies within.

The prefix's end is found without sorting a source: sums over ``BINS`` equal bins
of q / (1 + q), then over as many bins of the bin that holds the end, then over the
rows of that last bin (about a millionth of a source). All sums are combined on
the map side, so a source with a third of all rows costs no task more than others.

One row a source (and distinct document weight) is held as a small written table;
its size, not the documents', decides whether Spark broadcasts it.

Null texts have size 0 and are never taken. A null source is a source of its own,
last in order. Rows that agree in id and text share their rank and are taken
together. Sources of size 0 get target 0. Columns of ``docs`` are only read by the
given names, so extra columns never clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.runtime import materialize

BINS = 1024
WORDS = r"[^\x20\x09-\x0D]+"
#: 13 hexadecimal digits of a hash are 52 bits.
UNIT = float(1 << 52)


def word_count(text: str) -> Column:
    """The number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def uniform(seed: int, id_col: str, text_col: str) -> Column:
    """A number strictly between 0 and 1 from a hash of seed, id and text."""
    part = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit("")))
    return (F.conv(F.substring(F.md5(part), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(UNIT)


def water_fill(rows: DataFrame, cap: Column, weight: Column, total: Column, by: list[Column], order: list[Column]) -> DataFrame:
    """Adds ``filled``: least(cap, level * weight), with the level at which these sum to ``total`` (all caps, if they don't reach it)."""
    ratio = F.when(weight > 0, cap / weight).otherwise(F.lit(float("inf")))
    rows = rows.withColumns({"_cap": cap.cast("double"), "_w": weight.cast("double"), "_total": total.cast("double"), "_ratio": ratio})
    w = Window.partitionBy(*by).orderBy("_ratio", *order)
    before = F.coalesce(F.sum("_cap").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("_level", F.when(rest > 0, (F.col("_total") - before) / rest)).withColumn("_level", F.when(F.col("_level") <= F.col("_ratio"), F.col("_level")))
    first = F.first("_level", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("filled", F.when(first.isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), first * F.col("_w"))))
    return rows.drop("_cap", "_w", "_total", "_ratio", "_level")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_copies: int) -> DataFrame:
    """``source``, ``source_size`` and ``target`` from a row (``source``, ``source_size``) a source: weights repeat over the sources in code-point order, null last."""
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.withColumns({"_n": F.row_number().over(everything), "_all": F.sum("source_size").over(whole)})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_n") - 1, F.lit(len(weights))) + 1).cast("int"))
    out = water_fill(ranked, F.col("source_size") * max_copies, weight, F.col("_all") * F.lit(share), [], [F.col("_n")])
    return out.select("source", "source_size", F.col("filled").alias("target"))


@dataclass
class Mix:
    """A planned mix: ``sized`` has ``id, source, size, weight, u`` a row of the documents; ``shares`` a row a source and weight."""

    sized: DataFrame
    shares: DataFrame
    seed: int
    cols: tuple[str, str, str]
    weight: Column

    @staticmethod
    def copies(u: Column) -> Column:
        """Copies of a document: the whole ones, and one more if its rank is not behind the cut."""
        return (F.col("whole") + F.when((F.col("part") > 0) & (rank(u, F.col("part")) <= F.col("cut")), 1).otherwise(0)).cast("long")

    def decisions(self) -> DataFrame:
        """``id``, ``source``, ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (words), a row of the documents."""
        a, b = self.sized.alias("a"), self.shares.alias("b")
        on = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.weight") == F.col("b.weight"))
        out = a.join(b, on).select("a.id", "a.source", "a.size", "b.source_size", "b.target", self.copies(F.col("a.u")).alias("copies"))
        return out.withColumn("taken", F.col("copies") * F.col("size"))

    def repeat(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs``, each as often as it is taken (documents without words: never), with its own columns."""
        id_col, text_col, source_col = self.cols
        own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        rows = docs.select(own.alias("own"), F.col(source_col).alias("source"), self.weight.cast("double").alias("weight"), uniform(self.seed, id_col, text_col).alias("u"), (word_count(text_col) > 0).alias("some"))
        a, b = rows.alias("a"), self.shares.alias("b")
        on = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.weight") == F.col("b.weight"))
        n = F.when(F.col("a.some"), self.copies(F.col("a.u"))).otherwise(0).cast("int")
        return a.join(b, on).select("a.own", F.explode(F.array_repeat(F.lit(0), n)).alias("_")).select("own.*")


def rank(u: Column, p: Column) -> Column:
    """The Pareto rank of a document."""
    return (u / (F.lit(1.0) - u)) / (p / (F.lit(1.0) - p))


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_copies: int = 2, seed: int = 1, weight: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """Plan a mix of ``share`` times all words of ``docs``.

    ``weight`` (positive, few distinct values: they are grouped by) prefers some
    documents of a source to others.
    """
    weight = F.lit(1.0) if weight is None else weight
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), weight.cast("double").alias("weight"), uniform(seed, id_col, text_col).alias("u"))
    sized = materialize(sized, "sized")
    groups = materialize(sized.groupBy("source", "weight").agg(F.sum("size").alias("group_size")), "groups")
    aim = targets(groups.groupBy("source").agg(F.sum("group_size").alias("source_size")), weights, share, max_copies)
    g, t = groups.alias("g"), aim.alias("t")
    shares = g.join(t, F.col("g.source").eqNullSafe(F.col("t.source"))).select("g.*", "t.source_size", "t.target")
    shares = water_fill(shares, F.col("group_size") * max_copies, F.col("weight") * F.col("group_size"), F.col("target"), [F.col("source")], [F.col("weight")])
    e = F.when(F.col("group_size") > 0, F.col("filled") / F.col("group_size")).otherwise(0.0)
    shares = shares.withColumn("e", e).withColumn("whole", F.floor("e")).withColumn("part", F.col("e") - F.col("whole")).drop("e", "filled")
    left = F.col("target") - F.sum(F.col("whole") * F.col("group_size")).over(Window.partitionBy("source"))
    shares = materialize(shares.withColumn("left", left), "shares")

    a, b = sized.alias("a"), shares.alias("b")
    on = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.weight") == F.col("b.weight"))
    ranked = a.join(b, on).where((F.col("part") > 0) & (F.col("size") > 0)).select("a.source", "a.size", "b.left", rank(F.col("a.u"), F.col("b.part")).alias("q"))
    ranked = ranked.withColumn("at", F.col("q") / (F.col("q") + 1.0))

    scale, low, done = 1.0, None, None  # done: words in bins before the one that holds the end
    for _ in range(2):
        scale *= BINS
        binned = ranked.withColumn("bin", F.floor(F.col("at") * F.lit(scale)))
        if low is not None:
            binned = binned.alias("a").join(low.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.floor(F.col("a.bin") / BINS) == F.col("b.bin"))).select("a.source", "a.left", "a.bin", "a.size", "b.done")
        else:
            binned = binned.withColumn("done", F.lit(0).cast("long"))
        sums = binned.groupBy("source", "left", "bin", "done").agg(F.sum("size").alias("words"))
        w = Window.partitionBy("source").orderBy("bin")
        sums = sums.withColumn("end", F.col("done") + F.sum("words").over(w))
        # The bin that holds the end, or the last one: rows behind it are out.
        low = sums.withColumn("next", F.lead("bin").over(w)).where(((F.col("end") - F.col("words") <= F.col("left")) & (F.col("end") > F.col("left"))) | (F.col("next").isNull() & (F.col("end") <= F.col("left"))))
        low = materialize(low.select("source", "bin", (F.col("end") - F.col("words")).alias("done")), "ends")
    a, b = ranked.withColumn("bin", F.floor(F.col("at") * F.lit(scale))).alias("a"), low.alias("b")
    last = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.bin") == F.col("b.bin"))).groupBy("a.source", "a.left", "a.q", "b.done").agg(F.sum("a.size").alias("words"))
    w = Window.partitionBy("source").orderBy("q")
    middle = F.col("done") + F.sum("words").over(w) - F.col("words") / 2
    last = last.withColumn("in", middle <= F.col("left")).groupBy("source").agg(F.max(F.when(F.col("in"), F.col("q"))).alias("of_in"), F.min("q").alias("least"))
    # With no row of the last bin in, the cut lies just before that bin's first row.
    cuts = last.select("source", F.coalesce("of_in", F.col("least") * F.lit(1 - 1e-12)).alias("cut"))
    s, c = shares.alias("s"), cuts.alias("c")
    shares = s.join(c, F.col("s.source").eqNullSafe(F.col("c.source")), "left").select("s.*", F.coalesce("c.cut", F.lit(-1.0)).alias("cut"))
    return Mix(sized, materialize(shares, "cuts"), seed, (id_col, text_col, source_col), weight)


def sql(seed: int = 1) -> str:
    """The mix of the table ``documents`` in DuckDB's SQL, for weights 3, 1, 2, share 1.5 and at most 2 copies."""
    return rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ((('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 13))::UBIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS n, (sum(source_size) OVER ())::DOUBLE * 1.5 AS total
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
v AS (SELECT *, (source_size * 2)::DOUBLE AS cap, [3.0, 1.0, 2.0][((n - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s),
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM v),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, (cap / w, n)) FROM l WHERE level <= cap / w) * w, cap)) AS target FROM l),
e AS (SELECT *, floor(x)::BIGINT AS whole, x - floor(x) AS part FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS x FROM t)),
r AS (
  SELECT d.doc_id, d.source, d.size, e.source_size, e.target, e.whole, e.part, target - whole * source_size AS leftover,
    CASE WHEN part > 0 AND size > 0 THEN (u / (1 - u)) / (part / (1 - part)) END AS q
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS till,
    sum(size) OVER (PARTITION BY source, q) AS same
  FROM r WHERE q IS NOT NULL
  UNION ALL SELECT *, NULL, NULL FROM r WHERE q IS NULL)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN q IS NOT NULL AND till - same / 2 <= leftover THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c"""
