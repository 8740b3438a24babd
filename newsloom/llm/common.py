"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Stands for a null id in orders: before every other id.
LOWEST = -(2**63)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, under names of our own, so that extra columns cannot clash. A null text is empty."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")
    )


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(df: DataFrame, size: int = 64_000_000) -> int:
    """Partitions for a shuffle of ``df``: those of the session, or more where its files hold more than ``size`` bytes for each."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    found = [leaves.apply(i) for i in range(leaves.length())]
    held = sum(int(str(x.relation().sizeInBytes())) for x in found if x.nodeName().startswith("LogicalRelation") or x.nodeName().startswith("Relation"))
    return max(shuffle_partitions(df.sparkSession), -(-held // size))


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only where none is named (tests on one machine) one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset; name a folder that all executors share")
        folder = os.path.join(os.environ.get("TMPDIR", "/tmp"), "newsloom-checkpoints")
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def null_first(key: Column) -> Column:
    return F.coalesce(key, F.lit(LOWEST).cast("long"))


def joined(values: Column) -> Column:
    return F.array_join(values, ",")
