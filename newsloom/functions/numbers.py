"""Figures and reporting periods in text (column to column)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .columns import ColumnLike, col, lookup

# Unit multipliers (fixed values).
UNIT_FACTORS = {"nghìn": 1e3, "ngàn": 1e3, "triệu": 1e6, "tỷ": 1e9}
VIEW_FACTORS = {"K": 1e3, "M": 1e6, "B": 1e9}
ROMAN_QUARTERS = {"I": "1", "II": "2", "III": "3", "IV": "4", "1": "1", "2": "2", "3": "3", "4": "4"}
MONTH_WORDS = {
    "một": "1", "hai": "2", "ba": "3", "bốn": "4", "năm": "5", "sáu": "6",
    "bảy": "7", "tám": "8", "chín": "9", "mười": "10", "mười một": "11", "mười hai": "12",
}


def group_of(text: ColumnLike, pattern: str, group: int = 1) -> Column:
    """Captured group of the first match, NULL when there is no match or the group is empty."""
    return F.nullif(F.regexp_extract(col(text), pattern, group), F.lit(""))


def decimal_comma(c: ColumnLike) -> Column:
    """Number with a comma or point as decimal mark; blanks ignored; NULL when unreadable."""
    return F.regexp_replace(F.replace(col(c), F.lit(","), F.lit(".")), r"(?U)\s", "").try_cast("double")


def number_with_unit(value: ColumnLike, unit: ColumnLike) -> Column:
    u = F.lower(F.trim(col(unit)))
    factor = F.lit(1.0)
    for name, by in UNIT_FACTORS.items():
        factor = F.when(u == name, F.lit(by)).otherwise(factor)
    return decimal_comma(value) * F.when(u.isNull(), F.lit(1.0)).otherwise(factor)


def view_count(text: ColumnLike) -> Column:
    """``46.3K`` style counters as whole numbers, 0 when unreadable."""
    t = F.upper(F.trim(col(text)))
    out = t.try_cast("double")
    for suffix, by in reversed(VIEW_FACTORS.items()):
        out = F.when(t.contains(suffix), F.coalesce(F.replace(t, F.lit(suffix), F.lit("")).try_cast("double") * by, t.try_cast("double"))).otherwise(out)
    # A tiny nudge keeps 46.3 * 1000 from truncating to 46299.
    return F.coalesce(F.floor(F.round(out, 6)).cast("bigint"), F.lit(0).cast("bigint"))


def year_in(text: ColumnLike) -> Column:
    return F.coalesce(group_of(text, r"(?U)năm\s*(20\d{2})"), group_of(text, r"(20\d{2})")).cast("int")


def quarter_in(text: ColumnLike) -> Column:
    return lookup(ROMAN_QUARTERS, F.upper(group_of(text, r"(?iU)quý\s*([IVX]+|[1-4])"))).cast("int")


def month_in(text: ColumnLike) -> Column:
    m = group_of(text, r"(?U)tháng\s*(\d{1,2})").cast("int")
    return F.when(m.between(1, 12), m)


def last_quarter_in(text: ColumnLike) -> Column:
    """The last quarter named in the text."""
    found = F.regexp_extract_all(col(text), F.lit(r"(?iU)quý\s*(IV|III|II|I|[1-4]\b)"), F.lit(1))
    return lookup(ROMAN_QUARTERS, F.upper(F.try_element_at(found, F.lit(-1)))).cast("int")


def period_of_title(title: ColumnLike, default_year: int) -> Column:
    """struct(year, month, quarter) of a report title; a month wins over a quarter."""
    t = F.lower(col(title))
    year = F.coalesce(group_of(t, r"(?U)năm\s+(20\d{2})").cast("int"), F.lit(default_year))
    words = "|".join(sorted(MONTH_WORDS, key=len, reverse=True))
    named = group_of(t, rf"(?U)tháng\s+(\d+|{words})")
    month = F.coalesce(lookup(MONTH_WORDS, named), named).try_cast("int")
    month = F.when(month > 0, month)
    quarter = F.when(month.isNull(), quarter_in(t))
    return F.struct(year.alias("year"), month.alias("month"), quarter.alias("quarter"))
