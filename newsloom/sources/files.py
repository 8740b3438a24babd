"""Raw envelopes, CSV imports, processed output and exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from ..functions.columns import ColumnLike, col
from ..operators.ranking import first_per_key
from ..session import shared_folder  # noqa: F401 - used by callers of this module


def read_envelopes(spark: SparkSession, paths: str | Sequence[str], record: T.StructType, lines: bool = False) -> DataFrame:
    """One row per record of raw files.

    A file (or, with ``lines``, a line) is ``{"records": [..]}``, ``{"data": [..]}``,
    a bare list or one object. ``lines`` keeps large feeds splittable; whole-file
    JSON is read by one task per file. Adds the file, its time and the position.
    """
    names = {f.name for f in record.fields}
    envelope = [T.StructField(n, T.ArrayType(record)) for n in ("records", "data") if n not in names]
    if "data_type" not in names:
        envelope.append(T.StructField("data_type", T.StringType()))
    raw = spark.read.schema(T.StructType(envelope + list(record.fields))).option("multiLine", not lines).json(paths)
    single = F.array(F.struct(*[F.col(f.name) for f in record.fields]))
    lists = [F.col(f.name) for f in envelope if f.name in ("records", "data")]
    keep = ["data_type"] if "data_type" not in names else []
    return (raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"),
                       *keep, F.posexplode(F.coalesce(*lists, single)).alias("position", "record"))
            .select("file", "modified", *keep, "position", "record.*"))


def merge_first_wins(records: DataFrame, key: str, order: Sequence[ColumnLike]) -> DataFrame:
    """One record per key; records without a key are all kept."""
    keyed = first_per_key(records.filter(F.col(key).isNotNull()), [key], order)
    return keyed.unionByName(records.filter(F.col(key).isNull()).select(*keyed.columns))


def merge_report(records: DataFrame, key: str, order: Sequence[str], kind: str) -> DataFrame:
    """Read, kept and dropped records per type."""
    firsts = records.groupBy(key).agg(F.min_by(kind, F.struct(*order)).alias(kind))
    kept = firsts.groupBy(kind).agg(F.count(F.lit(1)).alias("kept"))
    read = records.groupBy(kind).agg(F.count(F.lit(1)).alias("total"))
    return (read.join(kept, kind, "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
            .withColumn("duplicates", F.col("total") - F.col("kept")))


def latest_snapshot(records: DataFrame, kind: str, snapshot: str) -> DataFrame:
    """All records of the newest snapshot of each type."""
    newest = records.groupBy(kind).agg(F.max(snapshot).alias(snapshot))
    return records.join(newest, [kind, snapshot], "left_semi")


def safe_cast(value: ColumnLike, kind: str) -> Column:
    """Blank or unreadable text becomes NULL."""
    return F.nullif(F.trim(col(value)), F.lit("")).try_cast(kind)


def safe_casts(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    return df.select(*[safe_cast(c, types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


def read_csv(spark: SparkSession, path: str, types: Mapping[str, str]) -> DataFrame:
    """CSV with a header, every column read as text and cast on its own."""
    return safe_casts(spark.read.option("header", True).csv(path), types)


def write_processed(df: DataFrame, path: str, partition: str = "source_type", fmt: str = "parquet",
                    valid: Column | None = None) -> dict[str, int]:
    """Write valid records by type; the run statistics come from the same job."""
    ok = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    stats = Observation("processed")
    watched = df.withColumn("_ok", ok).observe(
        stats, F.count(F.lit(1)).alias("total"), F.count_if("_ok").alias("success"))
    watched.filter("_ok").drop("_ok").write.mode("overwrite").partitionBy(partition).format(fmt).save(path)
    out = stats.get
    return {"total": out["total"], "success": out["success"], "failed": out["total"] - out["success"]}


def export_newest(df: DataFrame, required: Sequence[str], newest: str, tie: str, limit: int) -> DataFrame:
    """Newest rows that have every required value."""
    for c in required:
        df = df.filter(F.col(c).isNotNull())
    return df.orderBy(F.desc(newest), tie).limit(limit)


def listing(df: DataFrame, order: Sequence[Column], page: int = 1, size: int = 20) -> DataFrame:
    """One page of a totally ordered listing with ``total`` and ``total_pages``."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = df.orderBy(*order).offset((page - 1) * size).limit(size)
    return rows.withColumn("total", total).withColumn("total_pages", F.ceil(F.col("total") / size).cast("bigint"))
