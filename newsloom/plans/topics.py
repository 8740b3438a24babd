"""Example queries of topic discovery."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from ..operators import classify as C, topics as L, vectors as V
from . import fixtures as X, sqlparts as S
from .mining import STOP, _CT
from .registry import Registry, table

REGISTRY = Registry()
add = REGISTRY.add

#: Cells of 32 that a search reads: the given vectors hardly cluster, so that most are needed for a recall of 0.9.
_PROBES = 20


def _fitted(spark, sf):
    e = table(spark, sf, "embeddings")
    return L.fit_topics(e, "embedding", topics=10, min_topic_size=5), e


@add("l1_fit_topics")
def _(spark, sf):
    model, e = _fitted(spark, sf)
    return L.assign_topics(model, e, "embedding").select("vec_id", "topic_id", "probability")


@add("l2_transform_new")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    old, new = e.filter("vec_id % 2 = 1"), e.filter("vec_id % 2 = 0")
    return L.transform_new(L.fit_topics(old, "embedding", topics=10, min_topic_size=5), e, old, "vec_id", "embedding").select("vec_id", "topic_id", "probability")


@add("l3_topic_words", _CT + """, r as (select *, row_number() over (partition by label order by round(score, 9) desc, term) as r from s)
  select label as quality, string_agg(term, '|' order by r) as words, max(term) filter (r = 1) || ' - ' || max(term) filter (r = 2) || ' - ' || max(term) filter (r = 3) as name from r where r <= 20 group by 1""")
def _(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    w = L.topic_words(docs, "text", "quality", 20, stopwords=STOP)
    words = F.transform("words", lambda s: s["word"])
    return w.select("quality", F.array_join(words, "|").alias("words"), F.array_join(F.slice(words, 1, 3), " - ").alias("name"))


@add("l3_topic_info")
def _(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id")
    model = L.fit_topics(d, "embedding", topics=6, min_topic_size=5)
    assigned = L.assign_topics(model, d, "embedding")
    return L.topic_info(assigned, "doc_id", "text", "topic_id", "probability", stopwords=STOP).select("topic_id", "size", "name", "representative")


@add("l4_document_topics")
def _(spark, sf):
    model, e = _fitted(spark, sf)
    return L.document_topics(L.assign_topics(model, e, "embedding"), "vec_id", "session-1")


@add("l5_training_session")
def _(spark, sf):
    model, e = _fitted(spark, sf)
    return L.training_session(L.assign_topics(model, e, "embedding"), "session-1", datetime(2024, 1, 31), 5)


_DRIFT = f"""{S.MENTIONS}, c as (select topic_id, count(*) filter (published_at >= '2024-01-24') as r, count(*) filter (published_at < '2024-01-24') as h from mentions
  where published_at >= '2024-01-01' and published_at < '2024-01-31' group by 1), d as (select sum(abs(r / (select sum(r) from c) - h / (select sum(h) from c))) / 2 as drift from c)"""


@add("l6_drift", f"with {_DRIFT} select round(drift, 6) as drift from d")
def _(spark, sf):
    return L.drift(X.mentions(spark, sf), "topic_id", "published_at", date(2024, 1, 31)).select(F.round("drift", 6).alias("drift"))


@add("l7_retrain_decision", f"""with {_DRIFT}, n as (select count(*) as total_articles, count(*) filter (published_at >= '2024-01-20') as new_articles from mentions)
  select case when drift > 0.3 or new_articles / total_articles > 0.2 then 'full_train' else 'transform' end as recommendation, 11 as days_since_training, new_articles, total_articles,
    round(new_articles / total_articles, 6) as new_ratio, round(drift, 3) as concept_drift_score from n, d""")
def _(spark, sf):
    r = L.retrain_decision(X.mentions(spark, sf), "topic_id", "published_at", date(2024, 1, 31), date(2024, 1, 20))
    return r.select("recommendation", "days_since_training", "new_articles", "total_articles", F.round("new_ratio", 6).alias("new_ratio"), "concept_drift_score")


@add("l8_topics_per_day", f"with {S.MENTIONS} select topic_id, cast(published_at as date) as day, count(*) as frequency from mentions group by all")
def _(spark, sf):
    return L.topics_per_day(X.mentions(spark, sf), "topic_id", "published_at")


@add("l8_topics_per_bin", f"""with {S.MENTIONS}, b as (select min(epoch_us(published_at)) / 1e6 as lo, max(epoch_us(published_at)) / 1e6 as hi from mentions)
  select topic_id, cast(least(floor((epoch_us(published_at) / 1e6 - lo) / ((hi - lo) / 20)) + 1, 20) as int) as bin, count(*) as frequency from mentions, b group by all""")
def _(spark, sf):
    return L.topics_per_bin(X.mentions(spark, sf), "topic_id", "published_at", 20)


_MEANS = """cell as (select label, unnest(range(1, 65)) as pos, unnest(list_transform(embedding, lambda v: cast(v as double) / sqrt(list_sum(list_transform(embedding, lambda u: cast(u as double) * u))))) as v from embeddings),
  mean as (select label, list(m order by pos) as c from (select label, pos, avg(v) as m from cell group by all) group by 1)"""


@add("l9_merge_suggestions", f"""with {_MEANS} select a.label as topic_a, b.label as topic_b, round(list_cosine_similarity(a.c, b.c), 5) as similarity
  from mean a join mean b on a.label < b.label where list_cosine_similarity(a.c, b.c) >= 0.05""")
def _(spark, sf):
    c = C.topic_vectors(table(spark, sf, "embeddings"), "label", "embedding")
    return L.merge_suggestions(c, "label", "topic_vector", 0.05).select("topic_a", "topic_b", F.round("similarity", 5).alias("similarity"))


_NEAREST = """with q as (select vec_id as query, embedding as qv from embeddings where vec_id % 20 = 0),
  s as (select query, vec_id, list_cosine_similarity(list_transform(embedding, lambda v: cast(v as double)), list_transform(qv, lambda v: cast(v as double))) as sim from embeddings cross join q)
  select query, vec_id, round(sim, 5) as similarity, row_number() over (partition by query order by round(sim, 12) desc, vec_id) as rank from s qualify rank <= 10"""


def _asked(e):
    return e.filter("vec_id % 20 = 0")


@add("l10_nearest", _NEAREST)
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    return V.nearest(e, "vec_id", "embedding", _asked(e), "vec_id", "embedding", 10).select(
        "query", "vec_id", F.round("similarity", 5).alias("similarity"), "rank")


@add("l10_nearest_approximate")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    return V.search_index(V.build_index(e, "vec_id", "embedding", 32), _asked(e), "vec_id", "embedding", 10, probes=_PROBES)


@add("l10_recall", "select count(*) as queries, true as enough from embeddings where vec_id % 20 = 0")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    exact = V.nearest(e, "vec_id", "embedding", _asked(e), "vec_id", "embedding", 10)
    near = V.search_index(V.build_index(e, "vec_id", "embedding", 32), _asked(e), "vec_id", "embedding", 10, probes=_PROBES)
    return V.recall(exact, near, "vec_id").select("queries", (F.col("recall") >= 0.9).alias("enough"))
