"""A stored index of term postings for BM25: a question reads the buckets of its terms, and a top-k skips blocks that cannot reach it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..session import shared_checkpoint
from .ranking import top_k


@dataclass(frozen=True)
class Postings:
    """Files below ``path``: postings (term, block, doc, tf, n) and bounds (term, block, docs, most), each by bucket of the term, and stats.

    A block holds documents of like length, so that its bound is near its scores; ``spread`` blocks share a length.
    """

    path: str
    buckets: int = 64
    spread: int = 8
    k1: float = 1.2
    b: float = 0.75

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _part(self, tf: Column, n: Column, average: Column) -> Column:
        """What a term adds to a document's score, without its idf; rises with tf, falls with n."""
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * n / average))

    def build(self, docs: DataFrame, key: str, tokens: Column) -> None:
        """Writes the index of ``docs`` (unique integer keys); documents without tokens count in the statistics."""
        rows = shared_checkpoint(docs.select(F.col(key).cast("long").alias("doc"), tokens.alias("ts")).select("doc", F.size("ts").alias("n"), "ts").filter("n >= 0"))
        stats = rows.agg(F.count(F.lit(1)).alias("N"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("average"))
        stats.coalesce(1).write.parquet(f"{self.path}/stats")
        block = F.floor(F.log2(F.col("n") + 1) * 4).cast("int") * self.spread + F.pmod(F.xxhash64("doc"), F.lit(self.spread)).cast("int")
        # Keys are unique, so a document's terms are counted inside its row; they are shuffled once, to their buckets.
        counted = rows.select("doc", "n", block.alias("block"), F.explode(X.term_runs("ts")).alias("r")).select("doc", "n", "block", "r.term", F.col("r.count").alias("tf"))
        counted = counted.withColumn("bucket", self._bucket(F.col("term")))
        # the block takes part, so that a frequent term's postings are dealt to several tasks
        counted.repartition("bucket", "block").sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{self.path}/postings")
        stored = docs.sparkSession.read.parquet(f"{self.path}/postings").withColumn("average", self._stats(docs.sparkSession).select("average").scalar())
        bounds = stored.groupBy("bucket", "term", "block").agg(F.count(F.lit(1)).alias("docs"), F.max(self._part(F.col("tf"), F.col("n"), F.col("average"))).alias("most"))
        bounds.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{self.path}/bounds")

    def _stats(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("N long, average double").parquet(f"{self.path}/stats")

    def _of(self, spark: SparkSession, kind: str, terms: Sequence[str]) -> DataFrame:
        """Rows of some terms; only their buckets are read."""
        asked = spark.createDataFrame([(t,) for t in terms], "term string").select(self._bucket(F.col("term")).alias("bucket")).distinct()
        columns = {"postings": "doc long, n int, block int, term string, tf int", "bounds": "term string, block int, docs long, most double"}[kind]
        rows = spark.read.schema(columns + ", bucket int").parquet(f"{self.path}/{kind}")
        return rows.filter(F.col("bucket").isin([r["bucket"] for r in asked.collect()]) & F.col("term").isin(list(terms)))

    def _idf(self, spark: SparkSession, terms: Sequence[str]) -> DataFrame:
        df = self._of(spark, "bounds", terms).groupBy("term").agg(F.sum("docs").alias("df"))
        stats = self._stats(spark).select(F.struct("N", "average").alias("s")).scalar()
        return df.withColumn("s", stats).select("term", F.log(1 + (F.col("s.N") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), F.col("s.average").alias("average"))

    def scores(self, spark: SparkSession, terms: Sequence[str], blocks: Sequence[int] | None = None) -> DataFrame:
        """(doc, score) of the documents (of some blocks) that hold any term, as a scan of the texts gives them."""
        names = list(dict.fromkeys(terms))
        rows = self._of(spark, "postings", names)
        if blocks is not None:
            rows = rows.filter(F.col("block").isin(list(blocks)))
        # at most one row a term
        weighed = rows.join(F.broadcast(self._idf(spark, names)), "term")
        return weighed.groupBy("doc").agg(F.sum(F.col("idf") * self._part(F.col("tf"), F.col("n"), F.col("average"))).alias("score"))

    def top(self, spark: SparkSession, terms: Sequence[str], k: int = 10) -> DataFrame:
        """The exact best ``k`` (doc, score), smaller ids first among equals.

        Blocks are scored from the highest bound on until they hold ``k`` documents; then only blocks whose bound reaches the
        k-th score. The bounds that come to the driver are one row a block, of which there are a few hundred at any size.
        """
        names = list(dict.fromkeys(terms))
        bounds = self._of(spark, "bounds", names).join(F.broadcast(self._idf(spark, names)), "term").groupBy("block").agg(
            F.sum(F.col("idf") * F.col("most")).alias("most"), F.max("docs").alias("docs"))
        order = sorted(bounds.collect(), key=lambda r: -r["most"])
        first, held = [], 0
        for r in order:
            first.append(r["block"])
            held += r["docs"]
            if held >= k:
                break
        best = lambda rows: top_k(rows.withColumn("score", F.round("score", 12)), k, F.desc("score"), F.col("doc"))
        found = best(self.scores(spark, names, first)).collect()
        least = found[-1]["score"] if len(found) == k else float("-inf")
        more = [r["block"] for r in order[len(first):] if r["most"] >= least - 1e-9]
        known = spark.createDataFrame(found, "doc long, score double")
        return best(known.unionByName(self.scores(spark, names, more))) if more else known
