"""Period panels: previous values, changes, coverage, validation and listings.

A panel row is (indicator or province keys, year, quarter, month, values). A
missing quarter or month means the whole year and takes part in keys, so keys
compare null-safe.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import count_where, strings
from ..sources.files import listing
from ..sources.merge import keyed_load
from .ranking import first_per_key

PANEL_KEYS = ["province", "year", "quarter", "month", "data_source"]


def upsert(panel: DataFrame, rows: DataFrame, keys: Sequence[str] = PANEL_KEYS, order: Sequence[str] | None = None) -> DataFrame:
    """Insert or update by key; only non-NULL incoming values overwrite."""
    return keyed_load(panel, rows, keys, "update", order)


def fill_only(panel: DataFrame, rows: DataFrame, keys: Sequence[str] = PANEL_KEYS) -> DataFrame:
    """Update only the values that are still NULL."""
    return keyed_load(panel, rows, keys, "fill")


def previous_known(panel: DataFrame, keys: Sequence[str], period: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds the latest earlier non-NULL value of the same key (a backward as-of lookup)."""
    w = Window.partitionBy(*keys).orderBy(*period).rowsBetween(Window.unboundedPreceding, -1)
    return panel.withColumn(name, F.last(value, ignorenulls=True).over(w))


def fill_changes(panel: DataFrame, keys: Sequence[str], period: Sequence[str], value: str = "actual_value",
                 change: str = "change_prev_period", year_change: str | None = "change_yoy", digits: int = 2) -> DataFrame:
    """Fills missing change columns: against the latest earlier value, and against the same period a year before.

    The year-on-year lookup is one more pass over the same partitions: periods
    are placed on the key (keys, rest of the period) and ordered by year.
    """
    out = previous_known(panel, keys, period, value, "_prev")
    percent = lambda now, then: F.when(then != 0, F.round((now - then) / then * 100, digits))
    has = lambda c: F.col(c) if c in panel.columns else F.lit(None).cast("double")
    out = out.withColumn(change, F.coalesce(has(change), percent(F.col(value), F.col("_prev")))).drop("_prev")
    if year_change:
        rest = [p for p in period if p != "year"]
        w = Window.partitionBy(*keys, *rest).orderBy("year")
        last_year = F.when(F.lag("year").over(w) == F.col("year") - 1, F.lag(value).over(w))
        out = out.withColumn(year_change, F.coalesce(has(year_change), percent(F.col(value), last_year)))
    return out


def latest_per_key(panel: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Newest row per key; a whole year is newer than its quarters."""
    order = [F.col("year"), F.coalesce(F.col("quarter"), F.lit(99)), F.coalesce(F.col("month"), F.lit(99)) if "month" in panel.columns else F.lit(0)]
    return first_per_key(panel, keys, order, last=True)


# Plausible values per indicator: lowest, highest (fixed values); yearly figures may be four times as high.
VALUE_RANGES = {
    "grdp": (40000.0, 250000.0), "iip": (None, None), "agri": (2000.0, 25000.0), "retail": (2000.0, 150000.0),
    "export": (50.0, 1000.0), "investment": (1000.0, 100000.0), "budget": (1000.0, 85480.0), "cpi": (95.0, 120.0),
}
NOT_SCALED = ("cpi", "grdp")


def range_errors(indicator: Column, value: Column, yearly: Column, yoy: Column | None = None, quarter: Column | None = None,
                 ranges: Mapping[str, tuple[float | None, float | None]] | None = None) -> Column:
    """Messages for values outside the range of their indicator, growth beyond 100 % and unknown quarters."""
    low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, (lo, hi) in (ranges or VALUE_RANGES).items():
        if lo is not None and hi is not None:
            low = F.when(indicator == name, F.lit(lo)).otherwise(low)
            high = F.when(indicator == name, F.lit(hi)).otherwise(high)
    top = high * F.when(yearly & ~indicator.isin(*NOT_SCALED), F.lit(4.0)).otherwise(F.lit(1.0))
    rules = [F.when(~value.between(low, top), F.lit("value out of range"))]
    if yoy is not None:
        rules.append(F.when(F.abs(yoy) > 100, F.lit("growth out of range")))
    if quarter is not None:
        rules.append(F.when(~quarter.isin(1, 2, 3, 4), F.lit("unknown quarter")))
    return F.array_compact(F.array(*rules))


def coverage(panel: DataFrame, period: Sequence[str], indicator: str, expected: Sequence[str]) -> DataFrame:
    """Per period: expected indicators present and missing, in the expected order."""
    present = panel.filter(F.col(indicator).isin(*expected)).groupBy(*period).agg(F.collect_set(indicator).alias("_seen"))
    names = strings(expected)
    return present.select(
        *period, F.filter(names, lambda n: F.array_contains("_seen", n)).alias("available"),
        F.filter(names, lambda n: ~F.array_contains("_seen", n)).alias("missing"),
        (F.size("_seen") / len(expected)).alias("share"))


def incomplete(panel: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Rows with any of the metrics missing, with the names of the missing ones."""
    missing = F.array_compact(F.array(*[F.when(F.col(m).isNull(), F.lit(m)) for m in metrics]))
    return panel.withColumn("missing", missing).filter(F.size("missing") > 0)


def panel_page(panel: DataFrame, keys: Sequence[str], page: int = 1, size: int = 20, **filters: object) -> DataFrame:
    """Filtered panel listing, newest first, with totals."""
    for name, wanted in filters.items():
        panel = panel.filter(F.col(name).eqNullSafe(F.lit(wanted)))
    order = [F.desc("year")] + [F.col(c).desc_nulls_first() for c in ("quarter", "month") if c in panel.columns] + [F.col(k) for k in keys]
    return listing(panel, order, page, size)


def two_windows(rows: DataFrame, keys: Sequence[str], current: Column, previous: Column) -> DataFrame:
    """Current and previous counts per key from one scan instead of a join."""
    return rows.groupBy(*keys).agg(count_where(current).alias("current_count"), count_where(previous).alias("previous_count"))
