"""Session helpers shared by jobs, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "newsloom", cores: str | int = "*", shuffle_partitions: int | None = None,
                  memory: str = "16g") -> SparkSession:
    """Local session for tests and benchmarks; a cluster passes its own session in."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.parquet.filterPushdown", "true")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder named by ``spark.checkpoint.dir``.

    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_base(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A cluster must name it; only a session in one process (tests, a laptop) gets a temporary one where it is unset.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is unset; name a folder that all executors share")
    return (folder or os.path.join(tempfile.gettempdir(), "newsloom-checkpoints")).rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"
