"""Example queries of the streaming jobs. Each drains a stream over the given tables and reads its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.files import shared_folder
from ..streaming import alerts as A, jobs as J
from . import sqlparts as S
from .registry import Registry, table

REGISTRY = Registry()
add = REGISTRY.add


def _events(spark, sf):
    """The event table as a stream; its timestamps get a zone, as watermarks need one."""
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    group = (F.when(F.col("event_type") == "error", F.lit("negative")).when(F.col("event_type").isin("purchase", "signup"), F.lit("positive")).otherwise(F.lit("neutral")))
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("topic_id", F.col("user_id") % 10).withColumn("sentiment_group", group)


@add("p1_ingest", "select source_type, count(*) as n from (select distinct 'newspaper' as source_type, doc_id from documents where length(trim(text)) >= 10 and doc_id % 10 <> 0) group by 1")
def _(spark, sf):
    base = shared_folder(spark, "ingest")
    d = table(spark, sf, "documents")
    raw = d.select(F.when(F.col("doc_id") % 10 != 0, F.concat(F.lit("https://a.vn/"), "doc_id")).alias("url"), F.col("text").alias("content"), F.lit("title").alias("title"),
                   F.lit("newspaper").alias("data_type"), F.lit("01/02/2024").alias("publish_date"))
    raw.write.json(f"{base}/in")
    J.ingest(J.file_stream(spark, f"{base}/in", raw.schema), f"{base}/articles", f"{base}/rejected", f"{base}/known", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/articles").groupBy("source_type").agg(F.count(F.lit(1)).alias("n"))


@add("p2_first_seen", "select user_id, 1 as n from events group by 1")
def _(spark, sf):
    base = shared_folder(spark, "seen")
    J.run_to_table(J.first_seen(_events(spark, sf), "user_id", "ts", "40 days").select("user_id"), f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("n"))


@add("p3_window_changes", f"""with {S.MENTIONS}, w as (select cast(published_at as date) as day, topic_id, count(*) as n, count(*) filter (sentiment_group = 'negative') as negative from mentions group by all)
  select w.day, w.topic_id, w.n, w.negative, coalesce(p.n, 0) as previous, round(case when p.n > 0 then (w.n - p.n) / p.n * 100 when w.n > 5 then 100 else 0 end, 4) as change_percent
  from w left join w p on p.day + interval 1 day = w.day and p.topic_id = w.topic_id""")
def _(spark, sf):
    base = shared_folder(spark, "windows")
    J.upsert_rows(J.mention_windows(_events(spark, sf), "ts", ["topic_id"]), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    changes = J.window_changes(J.latest(spark, f"{base}/out", ["window", "topic_id"]), ["topic_id"], 86400)
    return changes.select(F.to_date("start").alias("day"), "topic_id", "n", "negative", "previous", F.round("change_percent", 4).alias("change_percent"))


@add("p4_daily_snapshots", f"""with {S.MENTIONS} select cast(published_at as date) as day, count(*) as total, count(*) filter (sentiment_group = 'positive') as positive,
  count(*) filter (sentiment_group = 'negative') as negative from mentions group by 1""")
def _(spark, sf):
    base = shared_folder(spark, "daily")
    J.upsert_rows(J.daily_counts(_events(spark, sf), "ts"), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    days = J.latest(spark, f"{base}/out", ["window"])
    return days.select(F.to_date("window.start").alias("day"), "total", "positive", "negative")


@add("p3_window_alerts", f"""with {S.MENTIONS}, w as (select cast(published_at as date) as day, topic_id, count(*) as n, count(*) filter (sentiment_group = 'negative') as neg from mentions group by all),
  s as (select day, topic_id from w union select day + 1, topic_id from w),
  c as (select s.day, s.topic_id, coalesce(w.n, 0) as n, coalesce(w.neg, 0) as neg, coalesce(p.n, 0) as prev from s left join w on w.day = s.day and w.topic_id = s.topic_id
    left join w p on p.day + 1 = s.day and p.topic_id = s.topic_id where s.day + 1 <= (select max(published_at) - interval 1 hour from mentions)),
  r as (select *, case when prev > 0 then (n - prev) / prev * 100 when n > 5 then 100 else 0 end as change from c)
  select 'spike' as alert_type, day, topic_id, n as current_count, prev as previous_count, round(change, 4) as figure from r where change > 50 and n >= 10
  union all select 'crisis', day, topic_id, n, prev, round(neg / n, 4) from r where n >= 5 and neg / n > 0.4
  union all select 'drop', day, topic_id, n, prev, round((n - prev) / prev * 100, 4) from r where prev >= 10 and (n - prev) / prev * 100 < -50""")
def _(spark, sf):
    base = shared_folder(spark, "alerts")
    with A.keyed_state(spark):
        named = _events(spark, sf).withColumn("topic_name", F.concat(F.lit("topic "), "topic_id")).withColumn("emotion", F.col("event_type"))
        J.run_to_table(A.window_alerts(named, "ts"), f"{base}/out", f"{base}/checkpoint")
    found = spark.read.parquet(f"{base}/out")
    figure = F.round(F.coalesce("change_percent", "negative_ratio"), 4)
    return found.select("alert_type", F.to_date("period_start").alias("day"), "topic_id", "current_count", "previous_count", figure.alias("figure"))
