"""Structured Streaming jobs: ingest, de-duplication, windows and daily snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import count_where
from ..operators import normalize as N
from ..operators.ranking import first_per_key


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "json", files_per_batch: int | None = None) -> DataFrame:
    """Files dropped into a folder."""
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(folder)


#: Url buckets of the table of known urls; a batch reads only the buckets of its own urls.
URL_BUCKETS = 256


def ingest(stream: DataFrame, articles: str, rejected: str, known: str, checkpoint: str, keep: Sequence[str] = ()) -> StreamingQuery:
    """Normalise and validate each batch; valid rows are appended once per url, bad rows go to a side output.

    ``known`` holds the urls so far, by hash bucket, so that a batch never scans the articles. Every output is written
    under the batch's own id: a batch that runs twice after a failure replaces its own output instead of adding to it,
    and does not see its own urls as known.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        checked = N.validate(N.normalize_documents(batch, keep))
        checked.filter(~F.col("is_valid")).write.mode("overwrite").parquet(f"{rejected}/batch={batch_id}")
        bucket = F.pmod(F.xxhash64("url"), F.lit(URL_BUCKETS)).cast("int")
        good = first_per_key(checked.filter("is_valid").drop("errors", "is_valid"), ["url"], [F.col("published_at"), F.col("title")])
        if batch_id:
            buckets = [r["b"] for r in good.select(bucket.alias("b")).distinct().collect()]  # at most URL_BUCKETS
            urls = spark.read.parquet(known).filter((F.col("batch") != batch_id) & F.col("bucket").isin(buckets)).select("url")
            good = good.join(urls, "url", "left_anti")
        good.write.mode("overwrite").parquet(f"{articles}/batch={batch_id}")
        fresh = spark.read.parquet(f"{articles}/batch={batch_id}").select("url", bucket.alias("bucket"))
        fresh.write.mode("overwrite").partitionBy("bucket").parquet(f"{known}/batch={batch_id}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(stream: DataFrame, key: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """First row per key among those that arrive within the watermark; state is dropped after it."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def mention_windows(stream: DataFrame, ts: str, keys: Sequence[str], length: str = "24 hours", slide: str | None = None, delay: str = "1 hour",
                    group: str = "sentiment_group") -> DataFrame:
    """Mentions and negative mentions per key and event-time window."""
    return (stream.withWatermark(ts, delay).groupBy(F.window(ts, length, slide).alias("window"), *keys)
            .agg(F.count(F.lit(1)).alias("n"), count_where(F.col(group) == "negative").alias("negative")))


def window_changes(windows: DataFrame, keys: Sequence[str], seconds: int) -> DataFrame:
    """Each window beside the one that ends where it starts; the change is what spike rules look at."""
    flat = windows.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "negative")
    earlier = flat.select(F.col("end").alias("start"), *keys, F.col("n").alias("previous"))
    out = flat.join(earlier, ["start", *keys], "left").withColumn("previous", F.coalesce("previous", F.lit(0)))
    change = F.when(F.col("previous") > 0, (F.col("n") - F.col("previous")) / F.col("previous") * 100).otherwise(F.when(F.col("n") > 5, F.lit(100.0)).otherwise(F.lit(0.0)))
    return out.withColumn("change_percent", change)


def daily_counts(stream: DataFrame, ts: str, delay: str = "1 day", group: str = "sentiment_group") -> DataFrame:
    """Totals per day, kept up to date."""
    return (stream.withWatermark(ts, delay).groupBy(F.window(ts, "1 day").alias("window"))
            .agg(F.count(F.lit(1)).alias("total"), count_where(F.col(group) == "positive").alias("positive"), count_where(F.col(group) == "negative").alias("negative")))


def upsert_rows(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Changed rows of an aggregate, written under the id of their batch.

    Update mode: the state holds only windows that the watermark still leaves open, and a batch writes only what it
    changed. :func:`latest` reads the table.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, folder: str, keys: Sequence[str]) -> DataFrame:
    """The newest row of each key of a table written by :func:`upsert_rows`."""
    rows = spark.read.parquet(folder)
    rest = [c for c in rows.columns if c not in keys and c != "batch"]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
    return newest.select(*keys, "_row.*")


def run_to_table(result: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> None:
    """Drain a stream into Parquet (append) and wait for the end."""
    query = (result.writeStream.outputMode(mode).format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
