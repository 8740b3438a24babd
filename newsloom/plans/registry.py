"""Collects the example queries (and their SQL) of every operator family."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FAMILIES = ["ingest", "normalize", "text", "dedup", "classify", "joins", "marts", "ranking", "mining", "topics",
            "search", "indicators", "trends", "streams"]

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Names queries and keeps the equivalent SQL beside them."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(build: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")

            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                spark.conf.set("spark.sql.session.timeZone", "UTC")
                return build(spark, sf_dir)

            self.queries[name] = run
            if sql is not None:
                self.oracles[name] = sql
            return build
        return register


def _families() -> list[Registry]:
    found = []
    for name in FAMILIES:
        module = f"{__package__}.{name}"
        try:
            found.append(importlib.import_module(module).REGISTRY)
        except ModuleNotFoundError as missing:
            if missing.name != module:
                raise
    return found


def queries() -> dict[str, Query]:
    return {n: q for r in _families() for n, q in r.queries.items()}


def oracles() -> dict[str, str]:
    return {n: s for r in _families() for n, s in r.oracles.items()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. One that lies in fewer splits than there are cores is dealt out; that changes no row and never fires on a large one."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "pages") and df.rdd.getNumPartitions() < cores else df
