"""Rule-based entities and report sections."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..functions.columns import col, let
from ..functions.matches import between, blocks_of, may_match, placed
from ..resources import entity_patterns as P, words as W


def _typed(kind: str, values: Column, source: str) -> Column:
    return F.transform(values, lambda v: F.struct(
        F.lit(kind).alias("type"), T.strip(v).alias("entity"), F.lit(source).alias("source")))


def extract_entities(df: DataFrame, key: str, text: str, provinces: Iterable[str] | None = None,
                     offsets: bool = False) -> DataFrame:
    """One row per (key, type, lower-cased entity): PERSON, ORG, LOCATION, DATE and MONEY; the first match of the first pattern.

    ``offsets`` adds ``start`` and ``end`` of that match in code points.
    """
    places = list(W.PROVINCES if provinces is None else provinces)
    t = F.coalesce(col(text), F.lit(""))

    fields = {"type": "string", "entity": "string", "source": "string"} | ({"start": "int", "end": "int"} if offsets else {})
    nothing = F.array().cast(f"array<struct<{','.join(f'{n}:{t}' for n, t in fields.items())}>>")

    def typed(kind: str, pattern: str) -> Column:
        """The matches of a pattern; texts without its literals are not searched."""
        return F.when(may_match(t, "(?U)" + pattern), matched(kind, pattern)).otherwise(nothing)

    def matched(kind: str, pattern: str) -> Column:
        if offsets:
            return F.transform(placed(t, "(?U)" + pattern), lambda m: F.struct(
                F.lit(kind).alias("type"), T.strip(m["hit"]).alias("entity"), F.lit("rule").alias("source"), m["at"].alias("start"), m["to"].alias("end")))
        return _typed(kind, F.regexp_extract_all(t, F.lit("(?U)" + pattern), F.lit(0)), "rule")

    hits = [typed(kind, p) for kind, p in P.patterns()]
    pairs = F.array(*[F.struct(F.lit(p).alias("name"), F.lit(p.lower()).alias("low")) for p in places])
    found = let(F.lower(t), lambda low: F.transform(
        F.filter(pairs, lambda p: low.contains(p["low"])),
        lambda p: F.struct(p["name"].alias("name"), (F.instr(low, p["low"]) - 1).alias("at"), F.char_length(p["low"]).alias("n"))))
    known = F.transform(found, lambda p: F.struct(
        F.lit("LOCATION").alias("type"), p["name"].alias("entity"), F.lit("gazetteer").alias("source"),
        *([p["at"].alias("start"), (p["at"] + p["n"]).alias("end")] if offsets else [])))
    hits.insert(len(hits) - len(P.DATES) - len(P.MONEY), known)
    # One entity per type and spelling, first pattern wins; settled inside the row.
    spelled = lambda every: F.transform(every, lambda h: F.struct(h["type"].alias("type"), F.lower(h["entity"]).alias("low")))
    firsts = let(F.concat(*hits), lambda every: let(spelled(every), lambda names: F.filter(
        every, lambda h, i: F.array_position(names, F.get(names, i)) == i + 1)))
    return df.select(key, F.explode(firsts).alias("hit")).select(key, *[f"hit.{f}" for f in fields])


def entity_summary(entities: DataFrame, top_n: int = 5) -> DataFrame:
    """Most frequent entities per type with the total of the type."""
    counts = entities.groupBy("type", "entity").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("type").agg(F.sum("n").alias("type_total"))
    ranked = counts.withColumn(
        "rank", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("n"), "entity")).cast("bigint"))
    return ranked.filter(F.col("rank") <= top_n).join(totals, "type").select("type", "entity", "n", "rank", "type_total")


# Heading shapes: numbered, roman, lettered (fixed values).
HEADINGS = [r"\n\d+\.?\s+\p{L}[\p{L}\s]+", r"\n[IVX]+\.?\s+\p{L}[\p{L}\s]+", r"\n[a-z]\)\s+\p{L}[\p{L}\s]+"]


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per heading: number, title, start, end and the text up to the next heading (code points from 0)."""
    body = F.coalesce(col(text), F.lit(""))
    heads = F.array_sort(F.concat(*[
        F.transform(placed(body, "(?iU)" + p), lambda m, i=i: F.struct(m["at"].alias("at"), F.lit(i).alias("shape"), m["hit"].alias("hit"))) for i, p in enumerate(HEADINGS)]))

    def listed(found: Column, blocks: Column) -> Column:
        def section(h: Column, i: Column) -> Column:
            end = F.coalesce(F.get(found, i + 1)["at"], F.char_length(body))
            return F.struct((i + 1).alias("section"), T.strip(h["hit"]).alias("title"), h["at"].alias("start"), end.alias("end"), between(blocks, h["at"], end).alias("content"))

        return F.transform(found, section)

    rows = let(heads, lambda found: let(blocks_of(body), lambda blocks: listed(found, blocks)))
    return df.select(key, F.explode(rows).alias("s")).select(key, "s.*")
