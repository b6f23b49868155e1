"""Queries beyond the reference's own operators: star-schema joins, as-of joins, rollups, sessions and sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.plans.evidence import events
from tessella.runtime import table


def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    """Revenue of orders of one year by the customers' nation: filters reach the scans, small sides are broadcast by size."""
    orders = table(spark, d, "orders").where("o_orderdate >= timestamp_ntz'1995-01-01' AND o_orderdate < timestamp_ntz'1996-01-01'").select("o_orderkey", "o_custkey")
    items = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    rows = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum("revenue"), 2).alias("revenue"), F.count("*").alias("items"))


def priority_rollup(spark, d):
    rows = table(spark, d, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return rows.select(F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), F.coalesce("o_orderstatus", F.lit("all")).alias("status"), "orders", "total")


def top_parts_by_brand(spark, d):
    w = Window.partitionBy("p_brand").orderBy(F.desc("quantity"), "p_partkey")
    sums = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("quantity"))
    rows = sums.join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    by = Window.partitionBy("p_brand").orderBy(F.desc("quantity"))
    rows = rows.withColumns({"rank": F.row_number().over(w), "place": F.rank().over(by), "dense_place": F.dense_rank().over(by), "quarter": F.ntile(4).over(w)})
    return rows.where("rank <= 3").select("p_brand", "p_partkey", "quantity", "rank", "place", "dense_place", "quarter")


def last_click_before_purchase(spark, d):
    """As-of join without one: the last click at or before each purchase is a running maximum over both kinds of row."""
    w = Window.partitionBy("user_id").orderBy("ts", F.col("kind"), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = events(spark, d).where("event_type in ('click', 'purchase')").withColumn("kind", F.when(F.col("event_type") == "click", 0).otherwise(1))
    rows = rows.withColumn("click_id", F.last(F.when(F.col("kind") == 0, F.col("event_id")), ignorenulls=True).over(w))
    return rows.where("kind = 1").select("event_id", F.coalesce("click_id", F.lit(-1)).alias("click_id"))


def sessions(spark, d):
    """Sessions of a user: events less than six hours apart."""
    w = Window.partitionBy("user_id").orderBy("seconds")
    rows = events(spark, d).withColumn("new", F.coalesce((F.col("seconds") - F.lag("seconds").over(w) >= 21600).cast("int"), F.lit(1)))
    rows = rows.withColumn("session", F.sum("new").over(w)).groupBy("user_id", "session").agg(F.count("*").alias("n"))
    return rows.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def approximate_users(spark, d):
    """Sketches beside exact counts: both columns are exact functions of the table, the first within its stated error."""
    rows = events(spark, d).groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("about"), F.countDistinct("user_id").alias("users"))
    return rows.select("event_type", (F.abs(F.col("about") - F.col("users")) <= 0.1 * F.col("users")).alias("close"), "users")


QUERIES = {f.__name__: f for f in (revenue_by_nation, priority_rollup, top_parts_by_brand, last_click_before_purchase, sessions, approximate_users)}

SQL = {
    "revenue_by_nation": """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS items FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' GROUP BY n_name""",
    "priority_rollup": "SELECT coalesce(o_orderpriority, 'all') AS priority, coalesce(o_orderstatus, 'all') AS status, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)",
    "top_parts_by_brand": """SELECT p_brand, p_partkey, quantity, rank::INT AS rank, place::INT AS place, dense_place::INT AS dense_place, quarter::INT AS quarter FROM (SELECT p_brand, p_partkey, quantity, row_number() OVER (PARTITION BY p_brand ORDER BY quantity DESC, p_partkey) AS rank,
        rank() OVER (PARTITION BY p_brand ORDER BY quantity DESC) AS place, dense_rank() OVER (PARTITION BY p_brand ORDER BY quantity DESC) AS dense_place, ntile(4) OVER (PARTITION BY p_brand ORDER BY quantity DESC, p_partkey) AS quarter
      FROM (SELECT l_partkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_partkey) JOIN part ON l_partkey = p_partkey) WHERE rank <= 3""",
    "last_click_before_purchase": """SELECT event_id, coalesce(click_id, -1) AS click_id FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_type = 'purchase', event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS click_id FROM events WHERE event_type IN ('click', 'purchase')) WHERE event_type = 'purchase'""",
    "sessions": """SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, session, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM (
      SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, session) GROUP BY user_id""",
    "approximate_users": "SELECT event_type, true AS close, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
}
