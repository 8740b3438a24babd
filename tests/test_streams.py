"""Streaming jobs over several batches."""

import uuid

from pyspark.sql import functions as F

from newsloom.session import shared_folder
from newsloom.streaming import jobs as J


def drop_file(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(folder)


def test_known_urls_stay_out_of_later_batches(spark):
    base = shared_folder(spark, f"t{uuid.uuid4().hex}")
    schema = "url string, content string, title string, data_type string, publish_date string"
    row = lambda n: (f"https://a.vn/{n}", "nội dung đủ dài để hợp lệ", "tiêu đề", "newspaper", "01/02/2024")
    args = (f"{base}/articles", f"{base}/rejected", f"{base}/known", f"{base}/checkpoint")
    for rows in ([row(1), row(2), row(2)], [row(2), row(3)], [row(1)]):
        drop_file(spark, f"{base}/in", rows, schema)
        stream = J.file_stream(spark, f"{base}/in", spark.createDataFrame([], schema).schema)
        J.ingest(stream, *args).awaitTermination()
    urls = sorted(r["url"] for r in spark.read.parquet(f"{base}/articles").select("url").collect())
    assert urls == [f"https://a.vn/{n}" for n in (1, 2, 3)]


def test_windows_of_two_batches(spark):
    base = shared_folder(spark, f"t{uuid.uuid4().hex}")
    schema = "ts timestamp, topic_id long, sentiment_group string"
    for rows in ([("2024-01-01 01:00:00", 1, "negative"), ("2024-01-02 01:00:00", 1, "neutral")],
                 [("2024-01-02 01:30:00", 1, "negative"), ("2023-12-01 00:00:00", 1, "negative")]):
        df = spark.createDataFrame([(t, k, g) for t, k, g in rows], "ts string, topic_id long, sentiment_group string")
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = J.file_stream(spark, f"{base}/in", spark.createDataFrame([], schema).schema, "parquet")
        J.upsert_rows(J.mention_windows(stream, "ts", ["topic_id"]), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    found = J.latest(spark, f"{base}/out", ["window", "topic_id"]).select(F.to_date("window.start").cast("string").alias("day"), "n", "negative").collect()
    # the row far behind the watermark of the first batch is late and left out
    assert sorted(tuple(r) for r in found) == [("2024-01-01", 1, 1), ("2024-01-02", 2, 1)]


def test_alerts_of_closed_windows(spark):
    """Three batches with a restart between each: every closed window's alerts once, as the table's rules give them."""
    import random
    from datetime import datetime, timedelta

    from newsloom.operators import trends as T
    from newsloom.streaming import alerts as A

    rng = random.Random(3)
    base, schema = shared_folder(spark, f"t{uuid.uuid4().hex}"), "published_at timestamp_ntz, topic_id long, topic_name string, emotion string, sentiment_group string"
    days = {1: [12, 40, 3, 0, 20], 2: [0, 11, 11, 30, 30], 3: [15, 0, 0, 6, 6]}
    rows = [(datetime(2024, 1, 1 + d) + timedelta(minutes=rng.randrange(1440)), t, f"t{t}", rng.choice(["joy", "anger"]), rng.choice(["positive", "negative"]))
            for t, counts in days.items() for d, n in enumerate(counts) for _ in range(n)]
    stray = [(datetime(2023, 12, 1), 1, "t1", "joy", "negative")] * 20  # far behind the watermark of the first batch
    future = [(datetime(2024, 1, 20), 9, "t9", "joy", "positive")]
    batches = [[r for r in rows if r[0] < datetime(2024, 1, 3)], stray + [r for r in rows if r[0] >= datetime(2024, 1, 3)], future]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = J.file_stream(spark, f"{base}/in", spark.createDataFrame([], schema).schema, "parquet")
        with A.keyed_state(spark):
            J.run_to_table(A.window_alerts(stream), f"{base}/out", f"{base}/checkpoint")
    facts = spark.createDataFrame(rows, schema)
    want = []
    for d in range(1, 12):
        want += T.alerts(facts, datetime(2024, 1, 1) + timedelta(days=d)).select("alert_type", "alert_level", "topic_id", "current_count", "previous_count", "title", F.col("period_end").cast("string")).collect()
    got = spark.read.parquet(f"{base}/out").select("alert_type", "alert_level", "topic_id", "current_count", "previous_count", "title", F.col("period_end").cast("string")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {r[0] for r in want} == {"spike", "crisis", "drop"}
