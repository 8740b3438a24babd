"""Example queries of search and retrieval, with words of the test texts in the place of the defaults."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import search as Q
from ..operators.postings import Postings
from ..session import shared_folder
from . import fixtures as X, sqlparts as S
from .registry import Registry, table

REGISTRY = Registry()
add = REGISTRY.add

TERMS = ["ouen", "shth", "eau", "sch", "ción", "never used"]
WORDS = ["the", "la", "und", "tion"]


def _any(text: str, words) -> str:
    return "(" + " or ".join(f"contains({text}, '{w.lower()}')" for w in words) + ")"


_LOW = "lower(title || chr(10) || content)"
_LOW2 = "lower(title || ' ' || content)"
_RECALL = f"""{S.ARTICLES}, dated as (select * replace (content || case when article_id % 2 = 0 then ' năm 2024 tỷ đồng 5 tỷ' else ' 2023' end as content) from articles),
  recall as (select * from dated where published_at >= '2023-01-01' and published_at < '2026-01-01' and {_any(_LOW, TERMS[:5])} order by length(content) desc, published_at desc, article_id limit 300)"""
_GATE = _RECALL + f", gate as (select * from recall where contains({_LOW2}, 'the') and {_any(_LOW2, ['2024', 'năm 2023'])} and {_any(_LOW2, WORDS)})"
_COUNTS = " + ".join(f"cast((length({_LOW2}) - length(replace({_LOW2}, '{w}', ''))) / {len(w)} as int) * 0.5" for w in WORDS)
_SCORE = _GATE + f""", scored as (select *, cast(case when contains(lower(title), 'the') then 2 else 0 end + case when contains({_LOW2}, 'năm 2024') then 3 else 0 end
  + case when contains({_LOW2}, 'quý 1') then 2 else 0 end + {_COUNTS} + case when length(content) > 2000 then 1 else 0 end
  + case when abs(date_diff('day', date '2024-06-30', cast(published_at as date))) < 180 then 1 else 0 end as double) as score,
  regexp_matches({_LOW2}, '\\d+[.,]?\\d*\\s*tỷ|\\d+[.,]?\\d*%|\\d+[.,]?\\d*\\s*triệu') as has_numbers from gate)"""


def _articles(spark, sf):
    a = X.articles(spark, sf)
    tail = F.when(F.col("article_id") % 2 == 0, F.lit(" năm 2024 tỷ đồng 5 tỷ")).otherwise(F.lit(" 2023"))
    return a.withColumn("content", F.concat("content", tail))


def _scored(spark, sf):
    found = Q.recall(_articles(spark, sf), TERMS, 2024, 100)
    return Q.relevance(Q.gate(found, "the", 2024, domain_words=WORDS), "the", 2024, 1, words=WORDS)


@add("m1_recall", f"with {_RECALL} select article_id from recall")
def _(spark, sf):
    return Q.recall(_articles(spark, sf), TERMS, 2024, 100).select("article_id")


@add("m2_gate", f"with {_GATE} select article_id from gate")
def _(spark, sf):
    return Q.gate(Q.recall(_articles(spark, sf), TERMS, 2024, 100), "the", 2024, domain_words=WORDS).select("article_id")


@add("m3_relevance", f"with {_SCORE} select article_id, score, has_numbers from scored")
def _(spark, sf):
    return _scored(spark, sf).select("article_id", "score", "has_numbers")


@add("m3_rank", f"with {_SCORE} select article_id, score from scored order by score desc, has_numbers desc, article_id limit 10")
def _(spark, sf):
    return Q.rank_by_relevance(_scored(spark, sf), 10).select("article_id", "score")


@add("m4_pack_context", f"""with {_SCORE}, top as (select *, row_number() over (order by score desc, has_numbers desc, article_id) as position from scored qualify position <= 5),
  sn as (select position, article_id, chr(10) || '[Nguồn ' || position || '] ' || title || chr(10) || 'URL: N/A' || chr(10) || 'Ngày: ' || strftime(published_at, '%d/%m/%Y') || chr(10) ||
    'Relevance Score: ' || printf('%.2f', score) || chr(10) || chr(10) || case when length(content) > 2000 then substring(content, 1, 1500) || '...' || right(content, 500) else substring(content, 1, 1500) end
    || chr(10) || chr(10) || '---' || chr(10) as snippet from top), u as (select *, sum(length(snippet)) over (order by position) as used from sn)
  select position, article_id, snippet, cast(used as bigint) as used from u where used <= 7500""")
def _(spark, sf):
    return Q.pack_context(_scored(spark, sf), 2500).select("position", "article_id", "snippet", "used")


@add("m5_listing_search", f"""with {S.ARTICLES}, f as (select * from articles where (contains(lower(title), 'tion') or contains(lower(content), 'tion')) and domain = 'src1')
  select article_id, (select count(*) from f) as total from f order by published_at desc, article_id limit 20""")
def _(spark, sf):
    return Q.listing_search(X.articles(spark, sf), "Tion", [F.desc("published_at"), F.col("article_id")], domain="src1").select("article_id", "total")


@add("m6_topic_articles", f"""with {S.MENTIONS}, a as (select event_id as article_id, user_id % 10 as topic_id, value as confidence from events), j as (select article_id, confidence from mentions join a using (article_id) where a.topic_id = 3 and confidence >= 20)
  select article_id, confidence, (select count(*) from j) as total from j order by confidence desc, article_id limit 20 offset 20""")
def _(spark, sf):
    links = table(spark, sf, "events").select(F.col("event_id").alias("article_id"), (F.col("user_id") % 10).alias("topic_id"), F.col("value").alias("confidence"))
    articles = X.mentions(spark, sf).drop("topic_id")
    return Q.topic_articles(articles, links, "article_id", 3, 20.0, page=2).select("article_id", "confidence", "total")


_BM25 = f"""with w as (select doc_id, regexp_extract_all(lower(text), '\\p{{L}}+') as a from documents), n as (select count(*) as n, avg(len(a)) as avg from w),
  tf as (select doc_id, term, len(a) as len, len(list_filter(a, lambda x: x = term)) as tf from w cross join (values ('the'), ('und'), ('ouen')) t(term)),
  df as (select term, count(*) filter (tf > 0) as df from tf group by 1)
  select doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg))), 5) as score from tf join df using (term), n group by 1 having sum(tf) > 0"""


@add("m1_bm25", _BM25)
def _(spark, sf):
    d = table(spark, sf, "documents")
    return Q.bm25(d, "doc_id", T.words("text", [], 1, None), ["the", "und", "ouen"]).select("doc_id", F.round("score", 5).alias("score"))


def _index(spark, sf):
    index = Postings(shared_folder(spark, "postings"), 16)
    index.build(table(spark, sf, "documents"), "doc_id", T.words("text", [], 1, None))
    return index


@add("m1_bm25_stored", _BM25)
def _(spark, sf):
    return _index(spark, sf).scores(spark, ["the", "und", "ouen"]).select(F.col("doc").alias("doc_id"), F.round("score", 5).alias("score"))


_BM25_EXACT = _BM25.replace("round(sum(", "sum(").replace(", 5) as score", " as score")


@add("m1_bm25_top", f"select doc_id, round(score, 5) as score from ({_BM25_EXACT}) order by round(score, 12) desc, doc_id limit 10")
def _(spark, sf):
    top = _index(spark, sf).top(spark, ["the", "und", "ouen"], 10)
    return top.select(F.col("doc").alias("doc_id"), F.round("score", 5).alias("score"))
