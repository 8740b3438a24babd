"""Example queries of alerts and trends."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import marts as M, trends as O
from . import fixtures as X, sqlparts as S
from .marts import REF, WEEK, _EMO, _SENT, flat, flat_list
from .registry import Registry

REGISTRY = Registry()
add = REGISTRY.add
NOW = datetime(2024, 1, 16)

# A finer topic split makes counts small enough for spikes and drops.
_FINE = f"""{S.MENTIONS}, fine as (select *, cast(substring(source_domain, 5, len(source_domain) - 7) as int) % 60 as t from mentions),
  w as (select t as topic_id, count(*) filter (published_at >= '2024-01-15') as n, count(*) filter (published_at < '2024-01-15') as prev,
    count(*) filter (published_at >= '2024-01-15' and sentiment_group = 'negative') as neg from fine where published_at >= '2024-01-14' and published_at < '2024-01-16' group by 1),
  c as (select *, case when prev > 0 then (n - prev) / prev * 100 when n > 5 then 100 else 0 end as change, neg / nullif(n, 0) as ratio from w)"""


def _fine(spark, sf):
    m = X.mentions(spark, sf)
    t = F.regexp_extract("source_domain", r"(\d+)", 1).cast("int") % 60
    return m.withColumn("topic_id", t).withColumn("topic_name", F.concat(F.lit("topic "), t))


@add("o1_spikes", f"""with {_FINE} select topic_id, n as current_count, prev as previous_count, round(change, 4) as change_percent,
  case when change > 200 and n > 50 then 'critical' when change > 100 and n > 30 then 'high' when change > 50 and n > 10 then 'medium' else 'low' end as alert_level from c where change > 50 and n >= 10""")
def _(spark, sf):
    return O.spikes(O.window_counts(_fine(spark, sf), NOW)).select(
        "topic_id", "current_count", "previous_count", F.round("change_percent", 4).alias("change_percent"), "alert_level")


@add("o2_crises", f"""with {_FINE}, e as (select t as topic_id, emotion, count(*) as n from fine where published_at >= '2024-01-15' and published_at < '2024-01-16' group by all),
  ed as (select topic_id, {_EMO} as emotions from e group by 1)
  select topic_id, n as current_count, round(ratio, 4) as negative_ratio, case when ratio > 0.6 then 'high' else 'medium' end as alert_level, emotions from c join ed using (topic_id) where n >= 5 and ratio > 0.4""")
def _(spark, sf):
    return O.crises(O.window_counts(_fine(spark, sf), NOW)).select(
        "topic_id", "current_count", F.round("negative_ratio", 4).alias("negative_ratio"), "alert_level", flat("emotion_distribution").alias("emotions"))


@add("o3_drops", f"with {_FINE} select topic_id, n as current_count, prev as previous_count, round((n - prev) / prev * 100, 4) as change_percent from c where prev >= 10 and (n - prev) / prev * 100 < -50")
def _(spark, sf):
    return O.drops(O.window_counts(_fine(spark, sf), NOW)).select(
        "topic_id", "current_count", "previous_count", F.round("change_percent", 4).alias("change_percent"))


@add("o3_alerts", f"""with {_FINE} select 'spike' as alert_type, topic_id, n as current_count from c where change > 50 and n >= 10 union all
  select 'crisis', topic_id, n from c where n >= 5 and ratio > 0.4 union all select 'drop', topic_id, n from c where prev >= 10 and (n - prev) / prev * 100 < -50""")
def _(spark, sf):
    return O.alerts(_fine(spark, sf), NOW).select("alert_type", "topic_id", "current_count")


_TAGS = r"list_distinct(regexp_extract_all(lower(regexp_replace(content, '([A-Z]\p{L}+)', '#\1', 'g')), '#([\p{L}\p{N}_]+)', 1))"


@add("o4_hashtag_stats", f"""with {S.ARTICLES}, a as (select *, published_at >= '2024-01-15' as cur, unnest({_TAGS}) as tag from articles where published_at >= '2024-01-08' and published_at < '2024-01-22'),
  k as (select tag, count(*) filter (cur) as mention_count, count(*) filter (not cur) as previous_count, count(distinct domain) filter (cur) as unique_sources,
    count(*) filter (cur and sentiment_group = 'positive') as positive_count, count(*) filter (cur and sentiment_group = 'negative') as negative_count from a group by 1 having count(*) filter (cur) > 0),
  b as (select *, row_number() over (order by mention_count desc, tag) as rank, case when previous_count > 0 then (mention_count - previous_count) / previous_count * 100 else 100 end as c from k),
  tt as (select tag, topic_id, count(*) as n from a where cur group by tag, topic_id qualify row_number() over (partition by tag order by n desc, topic_id) <= 5),
  td as (select tag, string_agg(topic_id || '=' || n, '|' order by n desc, topic_id) as topics from tt group by 1)
  select tag, mention_count, previous_count, unique_sources, positive_count, negative_count, mention_count - positive_count - negative_count as neutral_count, round(c, 2) as change_percent,
    c > 30 and mention_count >= 5 as is_trending, previous_count = 0 and mention_count >= 3 as is_new, round((positive_count - negative_count) / mention_count, 4) as sentiment_score, topics, rank from b join td using (tag) where rank <= 100""")
def _(spark, sf):
    m = X.articles(spark, sf).withColumnRenamed("domain", "source_domain").withColumn("topic_name", F.lit("t"))
    tags = T.hashtags(F.regexp_replace("content", r"([A-Z]\p{L}+)", "#$1"))
    h = O.hashtag_stats(m, tags, "weekly", REF)
    return h.select("tag", "mention_count", "previous_count", "unique_sources", "positive_count", "negative_count", "neutral_count", "change_percent",
                    "is_trending", "is_new", "sentiment_score", flat_list("related_topics", "topic_id", "count").alias("topics"), "rank")


@add("o5_viral_content", f"""with {S.ARTICLES} select article_id, round((1 + coalesce(least(length(title) / 50.0, 2), 0)) * case when sentiment_group = 'negative' then 1.5 else 1 end, 4) as viral_score,
  row_number() over (order by round((1 + coalesce(least(length(title) / 50.0, 2), 0)) * case when sentiment_group = 'negative' then 1.5 else 1 end, 6) desc, article_id) as rank from articles qualify rank <= 20""")
def _(spark, sf):
    return O.viral_content(X.articles(spark, sf), "article_id", "title", "sentiment_group").select("article_id", F.round("viral_score", 4).alias("viral_score"), "rank")


@add("o6_viral_newest", f"""with {S.ARTICLES}, n as (select * from articles order by published_at desc, article_id limit 100) select article_id, round(least(100, length(content) / 100), 4) as viral_score from n where length(content) >= 50""")
def _(spark, sf):
    return O.viral_newest(X.articles(spark, sf), "article_id", "published_at", "content").select("article_id", F.round("viral_score", 4).alias("viral_score"))


@add("o7_hot_topics_by_articles", f"with {S.MENTIONS} select topic_id, count(*) as article_count from mentions where topic_id <> 3 and published_at >= '2024-01-10' and published_at < '2024-01-17' group by 1 order by 2 desc, 1 limit 6")
def _(spark, sf):
    return O.hot_topics_by_articles(X.mentions(spark, sf), "published_at", REF, 7, 6, outlier=3).select("topic_id", "article_count")


@add("o8_category_trends", f"""with {WEEK}, c as (select title as category, count(*) as n, count(distinct source_domain) as unique_sources, count(distinct article_id) as unique_articles, {_SENT} from cur group by 1),
  p as (select title as category, count(*) as prev from prev group by 1), e as (select title as category, emotion, count(*) as n from cur group by all),
  ed as (select category, {_EMO} as emotions, min_by(emotion, [-n, rk]) as dominant from (select *, dense_rank() over (order by emotion) as rk from e) group by 1),
  v as (select *, case when coalesce(prev, 0) > 0 then (n - prev) / prev * 100 else 0 end as ch from c left join p using (category) join ed using (category))
  select category, n as mention_count, coalesce(prev, 0) as previous_count, unique_sources, unique_articles, positive_count, negative_count, dominant as dominant_emotion, round(ch, 2) as change_percent,
    ch > 20 as is_trending_up, ch < -20 as is_trending_down, negative_count / n > 0.4 as has_crisis, row_number() over (order by n desc, category) as rank_by_mention,
    row_number() over (order by round(ch, 2) desc, category) as rank_by_growth from v""")
def _(spark, sf):
    m = X.mentions(spark, sf).withColumnRenamed("title", "category")
    return O.category_trends(m, "category", "weekly", REF).select(
        "category", "mention_count", "previous_count", "unique_sources", "unique_articles", "positive_count", "negative_count", "dominant_emotion", "change_percent",
        "is_trending_up", "is_trending_down", "has_crisis", "rank_by_mention", "rank_by_growth")


@add("o8_category_trends_proxy", f"""with {WEEK}, c as (select title as category, count(*) as n from cur group by 1)
  select category, n as mention_count, cast(floor((select count(*) from prev) * (n / (select count(*) from cur))) as bigint) as previous_count from c""")
def _(spark, sf):
    m = X.mentions(spark, sf).withColumnRenamed("title", "category")
    return O.category_trends(m, "category", "weekly", REF, proxy_previous=True).select("category", "mention_count", "previous_count")


@add("o9_refresh_trends")
def _(spark, sf):
    trends = O.refresh_trends(X.mentions(spark, sf), X.articles(spark, sf), NOW, "daily", tags=F.array("emotion"), category="emotion")
    return M.table_counts(trends)
