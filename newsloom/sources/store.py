"""A keyed table on files, dealt to buckets by key, so that a load reads and writes only the buckets that its keys touch."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_checkpoint
from .merge import keyed_load

BUCKET = "_bucket"


@dataclass(frozen=True)
class KeyedTable:
    """Parquet files below ``path``, one folder a bucket; ``keys`` identify a row (null-safe)."""

    path: str
    keys: tuple[str, ...]
    buckets: int = 256

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def create(self, rows: DataFrame) -> None:
        """Writes a new table; ``rows`` have unique keys."""
        self._dealt(rows).repartition(BUCKET).write.partitionBy(BUCKET).parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path).drop(BUCKET)

    def load(self, incoming: DataFrame, mode: str = "update", order: Sequence[str] | None = None) -> DataFrame:
        """Merges ``incoming`` as :func:`keyed_load` does and returns its rows with their ``action`` (of touched buckets also kept rows).

        Only buckets that hold an incoming key are read, and only those in which a row changes are written, each replaced as a
        whole. A repeated batch writes nothing. ``incoming`` has no columns that the table lacks.
        """
        spark = incoming.sparkSession
        stored = spark.read.parquet(self.path)
        extra = set(incoming.columns) - set(stored.columns) - set(order or ())
        if extra:
            raise ValueError(f"columns the table lacks: {sorted(extra)}")
        batch = shared_checkpoint(self._dealt(incoming))
        touched = sorted(r[BUCKET] for r in batch.select(BUCKET).distinct().collect())  # at most one row a bucket
        if not touched:
            return keyed_load(stored.limit(0), batch, self.keys, mode, order).drop(BUCKET)
        old = stored.filter(F.col(BUCKET).isin(touched))
        data = [c for c in stored.columns if c != BUCKET]
        marked = old.withColumn("_before", F.struct(*data))
        merged = shared_checkpoint(keyed_load(marked, batch, [*self.keys, BUCKET], mode, order))
        changed = F.col("_before").isNull() | ~F.struct(*data).eqNullSafe(F.col("_before"))
        dirty = [r[BUCKET] for r in merged.filter(changed).select(BUCKET).distinct().collect()]
        if dirty:
            out = merged.filter(F.col(BUCKET).isin(dirty)).select(*data, BUCKET)
            out.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        return merged.drop("_before", BUCKET)
