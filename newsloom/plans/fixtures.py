"""Views of the given tables in the shape of the data model, shared by the example queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T
from .registry import table


def published(doc_id: str = "doc_id") -> Column:
    days = F.make_dt_interval((F.col(doc_id) % 30).cast("int"))
    return F.lit("2024-01-01").cast("timestamp_ntz") + days


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """documents with labels as article rows."""
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    group = F.when(F.col("toxic") == 1, F.lit("negative")).when(F.col("quality") == 1, F.lit("positive")).otherwise(F.lit("neutral"))
    return d.join(l, "doc_id", "left").select(
        F.col("doc_id").alias("article_id"), F.col("source").alias("domain"), F.col("text").alias("content"),
        T.headline("text").alias("title"), published().alias("published_at"), group.alias("sentiment_group"),
        (F.col("doc_id") % 7).alias("topic_id"))


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    """events as the mention fact."""
    e = table(spark, sf, "events")
    group = (F.when(F.col("event_type") == "error", F.lit("negative"))
             .when(F.col("event_type").isin("purchase", "signup"), F.lit("positive")).otherwise(F.lit("neutral")))
    topic = F.col("user_id") % 10
    return e.select(
        F.col("event_id").alias("article_id"), F.col("ts").alias("published_at"), topic.alias("topic_id"),
        F.concat(F.lit("topic "), topic).alias("topic_name"), F.concat(F.lit("site"), F.col("user_id"), F.lit(".vn")).alias("source_domain"),
        F.col("event_type").alias("emotion"), F.col("props").alias("title"), group.alias("sentiment_group"))


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly order totals per region as an indicator panel."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    joined = (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
              .join(r, n.n_regionkey == r.r_regionkey))
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return (joined.groupBy(F.col("r_name").alias("province"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
            .agg((F.sum(cents) / F.lit(100.0)).alias("actual_value")))


PANEL_SQL = """panel as (
  select r_name as province, cast(year(o_orderdate) as int) as year, cast(month(o_orderdate) as int) as month,
         cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / 100.0 as actual_value
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
  join region on n_regionkey = r_regionkey group by all)"""
