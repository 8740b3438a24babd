"""Topic discovery on a vector column: fit, transform, describe, drift, merge, search."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..functions import dates as D
from ..functions.columns import attach_table, count_where, in_blocks
from . import mining as K
from .dedup import cosine
from .ranking import nested_top_k

OUTLIER = -1


@dataclass
class TopicModel:
    """Fitted pipeline with the clusters that are large enough to be topics."""

    pipeline: PipelineModel
    topics: list[int]
    min_probability: float


def _centers(model: PipelineModel) -> list[list[float]]:
    return [[float(x) for x in c] for c in model.stages[-1].clusterCenters()]


def fit_topics(docs: DataFrame, vector: str, topics: int = 10, dims: int = 5, min_topic_size: int = 10, min_probability: float = 0.0,
               seed: int = 42) -> TopicModel:
    """Normalise, reduce and cluster; clusters below ``min_topic_size`` become outliers."""
    data = docs.select(array_to_vector(F.col(vector).cast("array<double>")).alias("raw"))
    stages = [Normalizer(inputCol="raw", outputCol="unit"), PCA(k=dims, inputCol="unit", outputCol="reduced"),
              KMeans(k=topics, featuresCol="reduced", predictionCol="cluster", distanceMeasure="cosine", seed=seed)]
    model = Pipeline(stages=stages).fit(data)
    sizes = model.transform(data).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_topic_size)
    # At most ``topics`` rows come back.
    return TopicModel(model, sorted(r["cluster"] for r in sizes.collect()), min_probability)


def assign_topics(model: TopicModel, docs: DataFrame, vector: str) -> DataFrame:
    """Adds topic_id (-1 for outliers) and probability: the cosine with the own centre, cut to [0, 1]."""
    data = docs.withColumn("raw", array_to_vector(F.col(vector).cast("array<double>")))
    out = model.pipeline.transform(data)
    centers = F.array(*[F.array(*[F.lit(x) for x in c]) for c in _centers(model.pipeline)])
    near = cosine(vector_to_array("reduced"), F.get(centers, F.col("cluster")))
    out = out.withColumn("probability", F.greatest(F.lit(0.0), F.least(F.lit(1.0), near)))
    keep = F.col("cluster").isin(*model.topics) if model.topics else F.lit(False)
    return out.withColumn("topic_id", F.when(keep & (F.col("probability") >= model.min_probability), F.col("cluster")).otherwise(F.lit(OUTLIER))).drop(
        "raw", "unit", "reduced", "cluster")


def transform_new(model: TopicModel, docs: DataFrame, done: DataFrame, key: str, vector: str) -> DataFrame:
    """Topics of the documents not mapped yet; outliers are skipped."""
    fresh = docs.join(done.select(key).distinct(), key, "left_anti")
    return assign_topics(model, fresh, vector).filter(F.col("topic_id") != OUTLIER)


def topic_words(docs: DataFrame, text: str, topic: str, top_n: int = 20, **options: object) -> DataFrame:
    """(topic, words): best class-based TF-IDF terms per topic with their scores."""
    scores = K.class_tfidf(docs, text, topic, **options).select(F.col("label").alias(topic), F.col("term").alias("word"), "score")
    return nested_top_k(scores, [topic], [F.desc("score"), F.col("word")], ["word", "score"], top_n, "words")


def topic_info(docs: DataFrame, key: str, text: str, topic: str, probability: str, top_n: int = 20, representative: int = 3,
               **options: object) -> DataFrame:
    """Size, words, default name (three best words) and the documents nearest to the centre per topic."""
    sizes = docs.groupBy(topic).agg(F.count(F.lit(1)).alias("size"))
    words = topic_words(docs.filter(F.col(topic) != OUTLIER), text, topic, top_n, **options)
    near = nested_top_k(docs.select(topic, key, probability), [topic], [F.desc(probability), F.col(key)], [key], representative, "_near")
    name = F.array_join(F.transform(F.slice("words", 1, 3), lambda w: w["word"]), " - ")
    return (sizes.join(words, topic, "left").join(near, topic, "left")
            .withColumn("name", F.when(F.col(topic) == OUTLIER, F.lit("outliers")).otherwise(name))
            .withColumn("representative", F.transform("_near", lambda s: s[key])).drop("_near"))


def document_topics(assigned: DataFrame, key: str, session: str) -> DataFrame:
    """(document, topic, probability, session) mapping rows."""
    return assigned.select(key, "topic_id", F.round("probability", 6).alias("probability"), F.lit(session).alias("session_id"))


def training_session(assigned: DataFrame, session: str, started: datetime, min_topic_size: int) -> DataFrame:
    """One row that records a training run."""
    found = F.col("topic_id") != OUTLIER
    return assigned.agg(
        F.count(F.lit(1)).alias("num_documents"), F.count_distinct(F.when(found, F.col("topic_id"))).alias("num_topics"),
        F.count_if(~found).alias("num_outliers")).select(
        F.lit(session).alias("session_id"), F.lit(started).alias("started_at"), F.lit(min_topic_size).alias("min_topic_size"),
        F.lit("completed").alias("status"), "num_documents", "num_topics", "num_outliers")


def drift(rows: DataFrame, topic: str, ts: str, now: date, recent_days: int = 7, history_days: int = 30) -> DataFrame:
    """Total variation distance between the recent and the earlier topic mix, 0 when either is empty."""
    split, start = now - timedelta(days=recent_days), now - timedelta(days=history_days)
    recent, earlier = D.within(ts, split, now), D.within(ts, start, split)
    counts = rows.filter(D.within(ts, start, now)).groupBy(topic).agg(count_where(recent).alias("r"), count_where(earlier).alias("h"))
    totals = counts.agg(F.sum("r").alias("R"), F.sum("h").alias("H"))
    joined = counts.withColumn("_t", totals.select(F.struct("R", "H").alias("t")).scalar())
    gap = F.abs(F.col("r") / F.nullif(F.col("_t.R"), F.lit(0)) - F.col("h") / F.nullif(F.col("_t.H"), F.lit(0)))
    return joined.agg(F.coalesce(F.sum(gap) / 2, F.lit(0.0)).alias("drift"))


def retrain_decision(rows: DataFrame, topic: str, ts: str, now: date, last_trained: date | None, drift_threshold: float = 0.3,
                     max_age_days: int = 30, new_share: float = 0.2) -> DataFrame:
    """One row: whether to train again, the reason and the figures behind it."""
    score = drift(rows, topic, ts, now)
    since = F.col(ts) >= F.lit(last_trained).cast("timestamp_ntz") if last_trained else F.lit(False)
    counts = rows.agg(F.count(F.lit(1)).alias("total_articles"), count_where(since).alias("new_articles"))
    age = (now - last_trained).days if last_trained else None
    out = counts.withColumn("_d", score.scalar()).withColumn(
        "new_ratio", F.when(F.col("total_articles") > 0, F.col("new_articles") / F.col("total_articles")).otherwise(F.lit(0.0)))
    reason = (F.when(F.lit(last_trained is None), F.lit("No previous training found"))
              .when(F.lit(age is not None and age >= max_age_days), F.lit(f"Monthly retrain due ({age} days since last)"))
              .when(F.col("_d") > drift_threshold, F.concat(F.lit("Concept drift detected (score: "), F.format_string("%.2f", F.col("_d")), F.lit(")")))
              .when(F.col("new_ratio") > new_share, F.concat(F.lit("Significant new data ("), F.format_string("%.1f", F.col("new_ratio") * 100), F.lit("%)"))))
    return out.select(
        F.when(reason.isNotNull(), F.lit("full_train")).otherwise(F.lit("transform")).alias("recommendation"),
        F.coalesce(reason, F.lit("Model still fresh")).alias("reason"), F.lit(age).cast("int").alias("days_since_training"),
        "new_articles", "total_articles", "new_ratio", F.round("_d", 3).alias("concept_drift_score"), F.lit(drift_threshold).alias("drift_threshold"))


def topics_per_day(rows: DataFrame, topic: str, ts: str) -> DataFrame:
    return rows.groupBy(F.col(topic), D.day(ts).alias("day")).agg(F.count(F.lit(1)).alias("frequency"))


def topics_per_bin(rows: DataFrame, topic: str, ts: str, bins: int = 20) -> DataFrame:
    """Frequencies per topic and equal-width time bin (1 to ``bins``)."""
    seconds = D.epoch_seconds(ts)
    ends = rows.agg(F.min(seconds).alias("lo"), F.max(seconds).alias("hi")).select(F.struct("lo", "hi").alias("b")).scalar()
    timed = rows.select(F.col(topic), seconds.alias("_s")).withColumn("_b", ends)
    width = (F.col("_b.hi") - F.col("_b.lo")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col("_s") - F.col("_b.lo")) / width) + 1, F.lit(bins))).otherwise(F.lit(1))
    return timed.withColumn("bin", place.cast("int")).groupBy(topic, "bin").agg(F.count(F.lit(1)).alias("frequency"))


#: Topics that travel as one array.
TOPICS = 2000


def merge_suggestions(centroids: DataFrame, topic: str, vector: str, threshold: float = 0.85, words: str | None = None) -> DataFrame:
    """Pairs of similar topics (smaller id first), with keyword overlap as a second signal.

    Each row compares itself with an array of later topics; more topics than fit one array come as several.
    """
    fields = [F.col(topic).alias("rank"), F.col(vector).alias("v")] + ([F.col(words).alias("w")] if words else [])
    overlap = (F.size(F.array_intersect(words, "_o.w")) / F.size(F.array_union(words, "_o.w"))) if words else F.lit(None).cast("double")

    def near(block: DataFrame) -> DataFrame:
        rows = attach_table(centroids, block.select(*fields), "_all", TOPICS)
        later = F.filter("_all", lambda o: (o["rank"] > F.col(topic)) & (cosine(F.col(vector), o["v"]) >= threshold))
        return rows.withColumn("_o", F.explode(later)).select(
            F.col(topic).alias("topic_a"), F.col("_o.rank").alias("topic_b"), cosine(F.col(vector), F.col("_o.v")).alias("similarity"), overlap.alias("keyword_overlap"))

    return reduce(DataFrame.unionByName, map(near, in_blocks(centroids, topic, TOPICS)))
