"""SpotSigs fingerprints: chains of content words that follow common words.

Plain column expressions; no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom.llm.common import keyed_texts, null_first, shuffle_partitions

#: Common words after which a chain begins (English, German, French, Spanish).
ANCHORS = ["the", "and", "is", "that", "was", "der", "die", "und", "den", "ist", "le", "et", "les", "est", "des", "el", "los", "que", "y", "por"]
#: A chain is the first CHAIN content words among the REACH words after its anchor.
CHAIN, REACH = 3, 8
#: Hex digits of a signature.
DIGITS = 12
#: Ranges of ids that are bounded by quantiles; each is cut further into equal steps.
MOST_RANGES = 512


def signatures(text: Column, anchors: list[str] | None = None) -> Column:
    """The set of signatures of a text, ascending.

    Words are runs of letters and digits, lower-cased. A text without an anchor takes every word as one. A chain at
    the end may be shorter, down to no word. A text without words has the empty set.
    """
    common = F.array(*[F.lit(a) for a in anchors or ANCHORS])

    def chain(words: Column, i: Column) -> Column:
        after = F.filter(F.slice(words, i + 2, REACH), lambda w: ~F.array_contains(common, w))
        return F.substring(F.md5(F.concat_ws(" ", F.get(words, i), F.slice(after, 1, CHAIN))), 1, DIGITS)

    def of(words: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(common, F.get(words, i)))
        some = F.when(F.arrays_overlap(words, common), places).otherwise(F.sequence(F.lit(0), F.size(words) - 1))
        return F.when(F.size(words) > 0, F.array_sort(F.array_distinct(F.transform(some, lambda i: chain(words, i))))).otherwise(F.array().cast("array<string>"))

    return F.get(F.transform(F.array(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))), of), 0)


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard likeness of two sets; 0 without a look inside where their lengths alone rule out ``least``.

    Two empty sets are alike (1), an empty and another one are not (0).
    """
    na, nb = F.size(a), F.size(b)
    short, long = F.least(na, nb).cast("double"), F.greatest(na, nb).cast("double")
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(long == 0, F.lit(1.0)).when((short == 0) | (short < F.lit(least) * long), F.lit(0.0)).otherwise(shared / (na + nb - shared))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """doc_id, text and each of ``more`` (made from the text), with the next document's as ``next_<name>``, ascending
    doc_id; after the last, the first.

    Null ids come first, equal ids are ordered by text. Ids fall into many ranges, so that no task sorts the table; the
    first row of each range is also sent to the range before it. Texts are shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(null_first(docs[id_col]).alias("_at"), docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    more = more or {}
    names = ["text", *more]
    wanted = 8 * shuffle_partitions(spark)
    ranges = min(MOST_RANGES, wanted)
    bounds = sorted({int(x) for x in rows.approxQuantile("_at", [i / ranges for i in range(ranges + 1)], 0.25 / ranges)})
    if not bounds:
        return rows.select("*", *[make(F.col("text")).alias(n) for n, make in more.items()]).select("doc_id", *names, *[F.col(n).alias(f"next_{n}") for n in names])
    steps = max(1, wanted // ranges)
    edges = F.array(*[F.lit(b).cast("long") for b in bounds])

    def bucket(at: Column) -> Column:
        k = F.greatest(F.size(F.filter(edges, lambda e: e <= at)), F.lit(1))
        low, high = (e.cast("double") for e in (F.element_at(edges, k), F.coalesce(F.try_element_at(edges, k + 1), F.element_at(edges, k))))
        part = F.when(high > low, F.floor((at.cast("double") - low) / (high - low) * steps)).otherwise(F.lit(0))
        return k * steps + F.least(F.greatest(part.cast("int"), F.lit(0)), F.lit(steps - 1))

    placed = rows.withColumn("_bucket", bucket(F.col("_at")))
    firsts = sorted((r["_bucket"], r["first"]) for r in placed.groupBy("_bucket").agg(F.min("_at").alias("first")).collect())
    sent = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    before = F.broadcast(spark.createDataFrame(sent, "_at long, _to int"))
    ghosts = rows.join(before, "_at").select("_at", "doc_id", "text", F.col("_to").alias("_bucket"), F.lit(True).alias("_ghost"))
    both = placed.select("_at", "doc_id", "text", "_bucket", F.lit(False).alias("_ghost")).unionByName(ghosts)
    for name, make in more.items():
        both = both.select("*", F.explode(F.array(make(F.col("text")))).alias(name))
    w = Window.partitionBy("_bucket").orderBy("_ghost", "_at", "text")
    return both.select("doc_id", "_ghost", *names, *[F.lead(n).over(w).alias(f"next_{n}") for n in names]).where(~F.col("_ghost")).drop("_ghost")


def fingerprint(found: Column) -> Column:
    return F.array_join(found, " ")


def signature_set(print_: Column) -> Column:
    return F.when(print_ == "", F.array().cast("array<string>")).otherwise(F.split(print_, " "))


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form (its second half replaced by the next text's beginning), and
    the likeness of the text's fingerprint to the edited text's and to the next document's.

    Null texts are empty. Equal texts have equal fingerprints; repeated rows each give a row; extra columns are left out.
    """
    pairs = with_next(keyed_texts(docs, id_col, text_col), more={"fp": lambda text: fingerprint(signatures(text))})
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    made = pairs.select("doc_id", n.cast("long").alias("n_chars"), "fp", "next_fp", F.explode(F.array(edited)).alias("edited"))
    told = made.select("*", F.explode(F.array(fingerprint(signatures(F.col("edited"))))).alias("efp"))
    like = lambda other: likeness(signature_set(F.col("fp")), signature_set(F.col(other)))
    return told.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("fp").alias("fingerprint"), F.col("efp").alias("edited_fingerprint"),
        like("efp").alias("near_edited"), like("next_fp").alias("near_next"))


def near_pairs(docs: DataFrame, least: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs (a, b, likeness) of documents with different signature sets of likeness ``least`` or more; with a < b.

    Sets are split into partitions by length such that a set only meets its own and the next partition; inside, an
    inverted index over the first signatures of each set gives the candidates, whose lengths must allow ``least``.
    Documents with equal sets stand under their smallest id, so copies never multiply pairs; sets without signatures
    pair with nothing.
    """
    import math

    sets = keyed_texts(docs, id_col, text_col).select("doc_id", F.explode(F.array(signatures(F.col("text")))).alias("sigs")).where(F.size("sigs") > 0)
    kinds = sets.groupBy(F.sha2(fingerprint(F.col("sigs")), 256).alias("set")).agg(F.min_by("sigs", "doc_id").alias("sigs"), F.min("doc_id").alias("id"))
    band = F.floor(F.log(F.size("sigs").cast("double")) / F.lit(-math.log(least))).cast("int")
    size = F.size("sigs")
    head = F.slice("sigs", 1, size - F.ceil(size * F.lit(least) - F.lit(1e-9)).cast("int") + 1)
    index = kinds.select("id", size.alias("n"), band.alias("band"), F.explode(head).alias("sig"))
    left, right = index.alias("l"), index.select("id", "n", "sig", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band")).alias("r")
    met = left.join(right, ["sig", "band"]).where(F.col("l.id") != F.col("r.id")).where(
        F.least("l.n", "r.n") >= F.lit(least) * F.greatest("l.n", "r.n") - F.lit(1e-9))
    pairs = met.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct()
    own = kinds.select("id", "sigs")
    full = pairs.join(own.withColumnsRenamed({"id": "a", "sigs": "sa"}), "a").join(own.withColumnsRenamed({"id": "b", "sigs": "sb"}), "b")
    return full.select("a", "b", likeness(F.col("sa"), F.col("sb"), least).alias("likeness")).where(F.col("likeness") >= least)
