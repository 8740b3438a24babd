"""First-per-key, top-k and distributed ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import ColumnLike, col
from ..session import shared_checkpoint


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[ColumnLike], last: bool = False) -> DataFrame:
    """The row with the smallest (``last``: largest) order per key.

    An aggregate, not a window: map tasks already reduce each key to one row, so
    a key that holds a third of the table costs no more than any other.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    pick = F.max_by if last else F.min_by
    best = df.groupBy(*keys).agg(
        pick(F.struct(*rest), F.struct(*[col(o).alias(f"o{i}") for i, o in enumerate(order)])).alias("_row"))
    return best.select(*[F.col(k) if k in keys else F.col("_row").getField(k).alias(k) for k in df.columns])


def first_by_id(df: DataFrame, keys: Sequence[Column], ident: str) -> DataFrame:
    """The rows of the smallest ``ident`` per key, where ``ident`` is unique per row.

    Only keys and ids are aggregated (hash aggregation of a fixed-width minimum); whole rows meet the winning ids once,
    and a caller that reads ids alone never moves another column.
    """
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    winners = df.select(*named, F.col(ident).alias("_first")).groupBy(*[f"_k{i}" for i in range(len(named))]).agg(F.min("_first").alias("_first"))
    return df.join(winners.select("_first"), F.col(ident) == F.col("_first"), "left_semi")


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group. Spark keeps k rows per map task and group before it shuffles."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("bigint")).filter(F.col(rank) <= k)


def nested_top_k(counts: DataFrame, group: Sequence[str], order: Sequence[Column], fields: Sequence[str], k: int,
                 name: str) -> DataFrame:
    """Top ``k`` rows per group as one ordered array of structs; ranked and cut before they are collected."""
    ranked = top_k_per_group(counts, group, order, k, rank="_rank")
    packed = F.sort_array(F.collect_list(F.struct("_rank", *fields)))
    return ranked.groupBy(*group).agg(
        F.transform(packed, lambda s: F.struct(*[s.getField(f).alias(f) for f in fields])).alias(name))


def overall_rank(df: DataFrame, order: Sequence[Column], rank: str = "rank", group: Sequence[str] = ()) -> DataFrame:
    """Row number over the whole table (or over each group) without one task sorting all of it."""
    ranked = running_total(df.withColumn("_one", F.lit(1)), "_one", order, rank, group).drop("_one")
    return ranked.withColumn(rank, F.col(rank).cast("bigint"))


def running_total(df: DataFrame, value: str, order: Sequence[Column], name: str, group: Sequence[str] = ()) -> DataFrame:
    """Sum of ``value`` up to and with each row, over the whole table or each group, without one task sorting all of it.

    ``order`` must tell all rows of a group apart. Range partitions are summed on their own; their totals (one row per
    partition and group) give the offsets. The ranged rows are checkpointed, so a lost executor cannot move a boundary
    between the two passes.
    """
    keys = [F.col(g) for g in group]
    ranged = shared_checkpoint(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part", *group).agg(F.sum(value).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", *[F.col(g).alias(f"_g_{g}") for g in group], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    on = F.col("a._part") == F.col("b._part")
    for g in group:
        on = on & F.col(f"a.{g}").eqNullSafe(F.col(f"b._g_{g}"))
    local = F.sum(value).over(Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return (ranged.withColumn("_local", local).alias("a").join(offsets.alias("b"), on)
            .select(*[F.col(f"a.{c}") for c in df.columns], (F.col("b._before") + F.col("a._local")).alias(name)))


def latest_first(*columns: str) -> list[Column]:
    """Newest first, where a missing part (a whole year has no quarter) sorts before a present one."""
    return [F.col(c).desc_nulls_first() for c in columns]
