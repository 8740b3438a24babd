"""Keyed loads: insert, update, fill, skip."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..operators.ranking import first_per_key


def keyed_load(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], mode: str = "update",
               order: Sequence[str] | None = None, action: str = "action") -> DataFrame:
    """Merged table with an ``action`` column: kept, inserted, updated or skipped.

    ``update``: incoming values win where they are not NULL. ``fill``: existing
    values win, incoming only fills NULLs. ``skip``: known keys stay untouched.
    Keys compare null-safe (a NULL quarter is a key). With ``order``, repeated
    incoming keys are first reduced to their first row.
    """
    if mode not in ("update", "fill", "skip"):
        raise ValueError(f"unknown mode {mode!r}")
    if order:
        incoming = first_per_key(incoming, keys, order).drop(*[c for c in order if c not in existing.columns])
    columns = list(existing.columns) + [c for c in incoming.columns if c not in existing.columns]
    old = existing.select(*[F.col(c).alias(f"_o_{c}") for c in existing.columns], F.lit(True).alias("_old"))
    new = incoming.select(*[F.col(c).alias(f"_n_{c}") for c in incoming.columns], F.lit(True).alias("_new"))
    on = None
    for k in keys:
        same = F.col(f"_o_{k}").eqNullSafe(F.col(f"_n_{k}"))
        on = same if on is None else on & same
    joined = old.join(new, on, "full_outer")
    is_old, is_new = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    matched = {"update": "updated", "fill": "updated", "skip": "skipped"}[mode]

    def value(c: str):
        o = F.col(f"_o_{c}") if c in existing.columns else F.lit(None)
        n = F.col(f"_n_{c}") if c in incoming.columns else F.lit(None)
        if mode == "update":
            return F.coalesce(n, o)
        if mode == "fill":
            return F.coalesce(o, n)
        return F.when(is_old, o).otherwise(n)

    return joined.select(
        *[value(c).alias(c) for c in columns],
        F.when(is_old & is_new, F.lit(matched)).when(is_new, F.lit("inserted")).otherwise(F.lit("kept")).alias(action))


def new_rows(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is unknown (null-safe)."""
    on = None
    for k in keys:
        same = incoming[k].eqNullSafe(existing[k])
        on = same if on is None else on & same
    return incoming.join(existing, on, "left_anti")


def load_report(merged: DataFrame, by: str | None = None, action: str = "action") -> DataFrame:
    """Counts of inserted, updated and skipped rows; with ``by`` also per type, the total as NULL type."""
    counts = [F.count_if(F.col(action) == a).alias(a) for a in ("inserted", "updated", "skipped")]
    touched = merged.filter(F.col(action) != "kept")
    return (touched.rollup(by) if by else touched.groupBy()).agg(F.count(F.lit(1)).alias("total"), *counts)


def import_report(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str],
                  required: Sequence[str] = ()) -> DataFrame:
    """(total, created, skipped, errors) of a bulk import that skips known and repeated keys."""
    bad = None
    for c in required:
        bad = F.col(c).isNull() if bad is None else bad | F.col(c).isNull()
    flagged = incoming.withColumn("_bad", bad if bad is not None else F.lit(False))
    valid = flagged.filter(~F.col("_bad"))
    unique = valid.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    created = new_rows(existing, unique, keys).agg(F.count(F.lit(1)).alias("n")).scalar()
    totals = flagged.agg(F.count(F.lit(1)).alias("total"), F.count_if("_bad").alias("errors"))
    return totals.withColumn("created", created).select(
        "total", "created", (F.col("total") - F.col("errors") - F.col("created")).alias("skipped"), "errors")
