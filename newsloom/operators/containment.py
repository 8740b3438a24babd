"""Which terms of a large dictionary occur in which texts, without a row for each pair of text and term.

Every term is listed under the one of its grams that is rarest in the texts. Texts give their distinct grams, those that
list a term meet the list by an equi-join, and only these candidates are looked for in the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import settled

#: Longest gram that lists a term; a shorter term is listed under itself.
GRAM = 4
#: Slots in which grams of the texts are counted, and bits of the filter of listing grams: the same at any size of input.
COUNT_SLOTS, FILTER_BITS = 1 << 20, 1 << 24


def grams(text: Column, q: int) -> Column:
    """All character grams of length ``q``, in order; one pass, by a look-ahead at each place."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{q}}}))"), F.lit(1))


def _slot(gram: Column, count: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(count)).cast("int")


def _distinct_grams(text: str, lengths: list[int]) -> Column:
    return F.array_distinct(F.concat(*[grams(F.col(text), q) for q in lengths]))


def listed_terms(texts: DataFrame, text: str, terms: DataFrame, lengths: list[int]) -> DataFrame:
    """(gram, term): each term under its rarest gram by the counts of slots over all texts."""
    counts = texts.select(F.explode(_distinct_grams(text, lengths)).alias("g")).groupBy(_slot(F.col("g"), COUNT_SLOTS).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    own = terms.select("term", F.explode(F.when(F.length("term") >= GRAM, F.array_distinct(grams(F.col("term"), GRAM))).otherwise(F.array("term"))).alias("gram"))
    rated = own.withColumn("slot", _slot(F.col("gram"), COUNT_SLOTS)).join(counts, "slot", "left")
    return rated.groupBy("term").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), F.col("gram"))).alias("gram"))


def contained_terms(texts: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(key, found): the distinct terms (column ``term``) that occur in each text as substrings; texts without any are left out.

    ``key`` is unique. Null and empty terms occur nowhere. Each text is shuffled once, with its candidates; a frequent gram lists
    only terms that have no rarer one.
    """
    own = terms.select("term").filter(F.length("term") > 0).distinct()
    lengths = sorted(r["q"] for r in own.select(F.least(F.length("term"), F.lit(GRAM)).alias("q")).distinct().collect())
    if not lengths:
        return texts.select(key, F.array().cast("array<string>").alias("found")).limit(0)
    bodies = texts.select(key, F.col(text).alias("_text")).filter(F.length("_text") > 0)
    index = listed_terms(bodies, "_text", own, lengths)
    # bits of the listing grams as 64-bit words, attached as one constant of fixed size
    bits = index.select(_slot(F.col("gram"), FILTER_BITS).alias("bit")).distinct().select(
        F.floor(F.col("bit") / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int")).alias("mask"))
    words = bits.groupBy("word").agg(F.bit_or("mask").alias("mask")).agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("m")).select(
        F.transform(F.sequence(F.lit(0), F.lit(FILTER_BITS // 64 - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("long")))).scalar()
    held = settled(bodies.withColumn("_words", words), "_grams", F.filter(
        _distinct_grams("_text", lengths),
        lambda g: F.call_function("shiftright", F.get(F.col("_words"), F.floor(_slot(g, FILTER_BITS) / 64).cast("int")), _slot(g, FILTER_BITS) % 64).bitwiseAND(1) == 1))
    candidates = held.select(key, F.explode("_grams").alias("gram")).join(index, "gram").groupBy(key).agg(F.collect_set("term").alias("_terms"))
    found = F.filter("_terms", lambda t: F.col("_text").contains(t))
    return settled(bodies.join(candidates, key), "found", found).filter(F.size("found") > 0).select(key, "found")
