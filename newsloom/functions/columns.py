"""Small column helpers used by every module."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

ColumnLike = Column | str


def col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def non_blank(value: ColumnLike) -> Column:
    """NULL for NULL, empty and whitespace-only strings; the string otherwise."""
    c = col(value)
    return F.when(F.length(F.trim(c)) > 0, c)


def first_non_blank(*values: ColumnLike) -> Column:
    return F.coalesce(*[non_blank(v) for v in values])


def strings(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def literal_map(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def lookup(mapping: Mapping[str, str], key: ColumnLike) -> Column:
    """Value of a fixed small mapping, NULL when the key is absent."""
    return F.try_element_at(literal_map(mapping), col(key))


def count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def attach_table(df: DataFrame, table: DataFrame, name: str, max_rows: int = 5000) -> DataFrame:
    """Attach a small table to every row as ``array<struct>`` column ``name``.

    The table is read once through a scalar subquery, so no join is planned and
    nothing is shuffled on the big side. Its size is checked inside the plan
    before it is gathered: a table above ``max_rows`` fails the job.
    Rows arrive in the order of the table's ``rank`` column when it has one.
    """
    columns = list(table.columns)
    if "rank" in columns:
        columns = ["rank"] + [c for c in columns if c != "rank"]
    packed = F.struct(*columns)
    array = (
        table.limit(max_rows + 1).agg(F.collect_list(packed).alias("rows"), F.count(F.lit(1)).alias("n"))
        .select(
            F.when(F.col("n") <= max_rows, F.sort_array("rows") if "rank" in columns else F.col("rows"))
            .otherwise(F.raise_error(F.lit(f"lookup table for {name} has more than {max_rows} rows")))
            .alias("rows")
        )
        .scalar()
    )
    return df.withColumn(name, array)


def in_blocks(table: DataFrame, key: str, most: int) -> list[DataFrame]:
    """The table itself if it has at most ``most`` rows, else parts by hash of a unique key that each stay well below."""
    rows = table.count()
    if rows <= most:
        return [table]
    parts = -(-2 * rows // most)
    return [table.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == i) for i in range(parts)]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Inside a lambda an outer expression is evaluated again for every element;
    binding it to a lambda variable avoids that.
    """
    return F.get(F.transform(F.array(value), body), 0)


def contained(text: ColumnLike, terms: Column) -> Column:
    """Elements of the string array ``terms`` that occur in ``text`` as substrings."""
    return let(col(text), lambda t: F.filter(terms, lambda k: t.contains(k)))


def contained_words(padded_text: ColumnLike, terms: Column) -> Column:
    """Elements that occur as whole words in a text padded with one blank on both sides."""
    return let(col(padded_text), lambda t: F.filter(terms, lambda k: t.contains(F.concat(F.lit(" "), k, F.lit(" ")))))


def sum_array(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a costly column that is computed exactly once per row.

    A plain projection can be merged into later filters and projections, which
    then compute the value again for each use; a one-element generator cannot.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
