"""Example queries of the periodic statistics. The reference week is 2024-01-15 to 2024-01-21."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import marts as M
from ..session import shared_checkpoint
from ..sources import merge as L
from . import fixtures as X, sqlparts as S
from .ingest import _LOAD_SQL, _halves
from .registry import Registry, table

REGISTRY = Registry()
add = REGISTRY.add
REF = date(2024, 1, 17)


def flat(c: str):
    """Map column as text, sorted by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "|")


def flat_list(c: str, *fields: str):
    return F.array_join(F.transform(c, lambda s: F.concat_ws("=", *[s[f].cast("string") for f in fields])), "|")


_EMO = "string_agg(emotion || '=' || n, '|' order by emotion)"
WEEK = f"""{S.MENTIONS}, cur as (select * from mentions where published_at >= '2024-01-15' and published_at < '2024-01-22'),
  prev as (select * from mentions where published_at >= '2024-01-08' and published_at < '2024-01-15')"""
_SENT = "count(*) filter (sentiment_group = 'positive') as positive_count, count(*) filter (sentiment_group = 'negative') as negative_count, count(*) filter (sentiment_group = 'neutral') as neutral_count"


@add("g1_trend_report", f"""with {WEEK}, w as (select unnest({S.words("title || ' ' || emotion", [], 3, 10000)}) as word from cur),
  tw as (select word, count(*) as n from w group by 1 order by n desc, word limit 20), ts as (select source_domain as d, count(*) as n from cur group by 1 order by n desc, d limit 10),
  e as (select emotion, count(*) as n from cur group by 1), p as (select count(*) as n from prev)
  select date '2024-01-15' as period_start, date '2024-01-21' as period_end, 'Tuần 3/2024' as period_label, count(*) as total_mentions,
    count(distinct source_domain) as total_sources, count(distinct topic_id) as total_topics, {_SENT},
    round(count(*) filter (sentiment_group = 'positive') / count(*) * 100, 2) as positive_ratio, round(count(*) filter (sentiment_group = 'negative') / count(*) * 100, 2) as negative_ratio,
    round((count(*) - (select n from p)) / (select n from p) * 100, 2) as mention_change, (select {_EMO} from e) as emotions,
    (select string_agg(d || '=' || n, '|' order by n desc, d) from ts) as sources, (select string_agg(word || '=' || n, '|' order by n desc, word) from tw) as keywords from cur""")
def _(spark, sf):
    m = X.mentions(spark, sf).withColumn("text", F.concat_ws(" ", "title", "emotion"))
    r = M.trend_report(m, "weekly", REF, "text", stopwords=[])
    return r.select("period_start", "period_end", "period_label", "total_mentions", "total_sources", "total_topics", "positive_count", "negative_count",
                    "neutral_count", "positive_ratio", "negative_ratio", "mention_change", flat("emotion_distribution").alias("emotions"),
                    flat_list("top_sources", "domain", "count").alias("sources"), flat_list("top_keywords", "word", "count").alias("keywords"))


_HOT = f"""with {WEEK}, c as (select topic_id, topic_name, count(*) as n, {_SENT} from cur group by all), p as (select topic_id, count(*) as prev from prev group by 1),
  e as (select topic_id, emotion, count(*) as n from cur group by all), ed as (select topic_id, {_EMO} as emotions, min_by(emotion, [-n, rk]) as dominant from
    (select *, dense_rank() over (order by emotion) as rk from e) group by 1),
  t as (select topic_id, string_agg(title, '|' order by article_id) as titles from (select *, row_number() over (partition by topic_id order by article_id) as r from cur) where r <= 5 group by 1),
  v as (select *, case when prev > 0 then (n - prev) / prev else 1 end as v from c left join p using (topic_id)),
  h as (select *, n * (1 + greatest(0, v)) as hot, case when v > 0 then negative_count / n * v else negative_count / n end as crisis from v)"""


@add("g2_hot_topics", _HOT + """ select topic_id, topic_name, n as mention_count, coalesce(prev, 0) as previous_count, positive_count, negative_count, neutral_count,
  round(v, 4) as mention_velocity, round(hot, 2) as hot_score, round(crisis, 4) as crisis_score, hot > n * 1.5 as is_hot, crisis > 0.3 as is_crisis,
  v > 0.2 as is_trending_up, v < -0.2 as is_trending_down, emotions, dominant as dominant_emotion, titles,
  row_number() over (order by n desc, topic_id) as rank from h join ed using (topic_id) join t using (topic_id) order by n desc, topic_id limit 8""")
def _(spark, sf):
    h = M.hot_topics(X.mentions(spark, sf), "weekly", REF, top_n=8)
    return h.select("topic_id", "topic_name", "mention_count", "previous_count", "positive_count", "negative_count", "neutral_count", "mention_velocity",
                    "hot_score", "crisis_score", "is_hot", "is_crisis", "is_trending_up", "is_trending_down", flat("emotion_distribution").alias("emotions"),
                    "dominant_emotion", F.array_join("sample_titles", "|").alias("titles"), "rank")


_STOP = ["the", "of", "and", "la", "le", "und", "der", "el"]


@add("g3_keyword_stats", f"""with {S.ARTICLES}, cur as (select *, {S.words('content', _STOP)} as a from articles where published_at >= '2024-01-15' and published_at < '2024-01-22'),
  g as (select article_id, sentiment_group, topic_id, domain, unnest({S.grams('a', 2, 40)} || {S.grams('a', 3, 50)}) as phrase from cur),
  f as (select * from g where not contains(phrase, 'ouen')),
  k as (select phrase, count(*) as mention_count, count(distinct article_id) as document_count, count(distinct article_id) filter (sentiment_group = 'positive') as positive_count,
    count(distinct article_id) filter (sentiment_group = 'negative') as negative_count from f group by 1),
  s as (select *, mention_count * case when contains(phrase, 'tion') then 2.0 else 1.0 end * case when len(string_split(phrase, ' ')) >= 3 then 1.5 else 1.0 end as score from k),
  b as (select * from s order by score desc, phrase limit 50),
  tt as (select phrase, topic_id, count(distinct article_id) as n from f join b using (phrase) group by phrase, topic_id qualify row_number() over (partition by phrase order by n desc, topic_id) <= 5),
  ts as (select phrase, domain, count(distinct article_id) as n from f join b using (phrase) group by phrase, domain qualify row_number() over (partition by phrase order by n desc, domain) <= 5)
  select phrase as keyword, mention_count, document_count, positive_count, negative_count, document_count - positive_count - negative_count as neutral_count,
    round((positive_count - negative_count) / document_count, 4) as sentiment_score, round(cast(score as double) / cast(max(score) over () as double), 4) as weight,
    (select string_agg(topic_id || '=' || n, '|' order by n desc, topic_id) from tt where tt.phrase = b.phrase) as topics,
    (select string_agg(domain || '=' || n, '|' order by n desc, domain) from ts where ts.phrase = b.phrase) as sources from b""")
def _(spark, sf):
    m = X.articles(spark, sf).withColumnRenamed("domain", "source_domain").withColumn("topic_name", F.lit("t"))
    k = M.keyword_stats(m, "content", "weekly", REF, 50, _STOP, ["ouen"], ["tion"])
    return k.select("keyword", "mention_count", "document_count", "positive_count", "negative_count", "neutral_count", "sentiment_score", "weight",
                    flat_list("related_topics", "topic_id", "count").alias("topics"), flat_list("top_sources", "domain", "count").alias("sources"))


_G4 = f"""with {WEEK}, c as (select topic_id, topic_name, count(*) as n, count(distinct source_domain) as unique_sources, {_SENT} from cur group by all),
  p as (select topic_id, count(*) as prev from prev group by 1), e as (select topic_id, emotion, count(*) as n from cur group by all), ed as (select topic_id, {_EMO} as emotions from e group by 1)
  select topic_id, n as mention_count, coalesce(prev, 0) as previous_count, unique_sources, positive_count, negative_count, neutral_count, emotions,
    round((positive_count - negative_count) / n, 4) as sentiment_score, round(case when prev > 0 then (n - prev) / prev * 100 else 0 end, 2) as mention_change,
    row_number() over (order by n desc, topic_id) as rank_by_mention, row_number() over (order by negative_count desc, topic_id) as rank_by_negative
  from c left join p using (topic_id) join ed using (topic_id)"""


def _topics_shown(t):
    return t.select("topic_id", "mention_count", "previous_count", "unique_sources", "positive_count", "negative_count", "neutral_count",
                    flat("emotion_distribution").alias("emotions"), "sentiment_score", "mention_change", "rank_by_mention", "rank_by_negative")


@add("g4_topic_mentions", _G4)
def _(spark, sf):
    return _topics_shown(M.topic_mentions(X.mentions(spark, sf), "weekly", REF))


@add("g4_from_partials", _G4)
def _(spark, sf):
    return _topics_shown(M.topic_mentions(shared_checkpoint(M.daily_partials(X.mentions(spark, sf))), "weekly", REF))


_ART_WEEK = f"{S.ARTICLES}, cur as (select * from articles where published_at >= '2024-01-15' and published_at < '2024-01-22')"


def _article_mentions(spark, sf):
    return X.articles(spark, sf).select("article_id", "published_at", "topic_id", F.lit("t").alias("topic_name"), F.col("domain").alias("source_domain"),
                                        F.col("sentiment_group").alias("emotion"), "title", "sentiment_group")


@add("g5_website_activity", f"""with {_ART_WEEK}, s as (select domain, topic_id, count(*) as n, {_SENT} from cur where domain not in ('src1', 'src2') group by all),
  t as (select domain, row_number() over (order by sum(n) desc, domain) as rank_overall from s group by 1)
  select domain as source_domain, topic_id, n as mention_count, positive_count, negative_count, neutral_count, round((positive_count - negative_count) / n, 4) as avg_sentiment_score, rank_overall
  from s join t using (domain)""")
def _(spark, sf):
    hosts = {"src1": "facebook", "src2": "tiktok"}
    return M.website_activity(_article_mentions(spark, sf), "weekly", REF, hosts).select(
        "source_domain", "topic_id", "mention_count", "positive_count", "negative_count", "neutral_count", "avg_sentiment_score", "rank_overall")


@add("g6_social_activity", f"""with {WEEK}, s as (select case cast(substring(source_domain, 5, len(source_domain) - 7) as int) % 3 when 0 then 'facebook' else 'tiktok' end as platform,
    source_domain as account_name, topic_id, count(*) as n, {_SENT} from cur where cast(substring(source_domain, 5, len(source_domain) - 7) as int) % 3 <> 2 group by all),
  t as (select platform, account_name, row_number() over (partition by platform order by sum(n) desc, account_name) as rank_in_platform from s group by platform, account_name)
  select platform, account_name, topic_id, n as mention_count, positive_count, negative_count, rank_in_platform from s join t using (platform, account_name)""")
def _(spark, sf):
    user = F.regexp_extract("source_domain", r"(\d+)", 1).cast("int") % 3
    platform = F.when(user == 0, F.lit("facebook")).when(user == 1, F.lit("tiktok"))
    return M.social_activity(X.mentions(spark, sf), "weekly", REF, platform=platform).select(
        "platform", "account_name", "topic_id", "mention_count", "positive_count", "negative_count", "rank_in_platform")


_G7 = f"""with {S.MENTIONS}, d as (select *, cast(published_at as date) as snapshot_date from mentions),
  t as (select snapshot_date, count(*) as mention_count, count(distinct source_domain) as unique_sources, count(distinct topic_id) as unique_topics, {_SENT} from d group by 1),
  e as (select snapshot_date, emotion, count(*) as n from d group by all), ed as (select snapshot_date, {_EMO} as emotions from e group by 1),
  tt as (select snapshot_date, topic_id, count(*) as n from d group by snapshot_date, topic_id qualify row_number() over (partition by snapshot_date order by n desc, topic_id) <= 10),
  td as (select snapshot_date, string_agg(topic_id || '=' || n, '|' order by n desc, topic_id) as topics from tt group by 1),
  st as (select snapshot_date, source_domain, count(*) as n from d group by snapshot_date, source_domain qualify row_number() over (partition by snapshot_date order by n desc, source_domain) <= 10),
  sd as (select snapshot_date, string_agg(source_domain || '=' || n, '|' order by n desc, source_domain) as sources from st group by 1)
  select * from t join ed using (snapshot_date) join td using (snapshot_date) join sd using (snapshot_date)"""


def _days_shown(s):
    return s.select("snapshot_date", "mention_count", "unique_sources", "unique_topics", "positive_count", "negative_count", "neutral_count",
                    flat("emotion_distribution").alias("emotions"), flat_list("top_topics", "topic_id", "count").alias("topics"),
                    flat_list("top_sources", "domain", "count").alias("sources"))


@add("g7_daily_snapshots", _G7)
def _(spark, sf):
    return _days_shown(M.daily_snapshots(X.mentions(spark, sf)))


@add("g7_from_partials", _G7)
def _(spark, sf):
    return _days_shown(M.daily_snapshots(shared_checkpoint(M.daily_partials(X.mentions(spark, sf)))))


def _sizes(name: str, rows: str) -> str:
    """Rows of each mart of a period: no site is social, and titles and emotions make no phrase."""
    counts = {"trend_report": "least(1, count(*))", "hot_topics": "least(20, count(distinct topic_id))", "topic_mentions": "count(distinct topic_id)",
              "website_activity": "count(distinct (source_domain, topic_id))", "social_activity": "0 * count(*)", "keyword_stats": "0 * count(*)"}
    return " union all ".join(f"select '{name}_{mart}' as table_name, cast({n} as bigint) as n from {rows}" for mart, n in counts.items())


@add("g8_refresh_marts", f"""with {WEEK}, today as (select * from cur where published_at >= '2024-01-17' and published_at < '2024-01-18')
  select 'daily_snapshots' as table_name, cast(count(distinct cast(published_at as date)) as bigint) as n from today union all {_sizes('daily', 'today')} union all {_sizes('weekly', 'cur')}""")
def _(spark, sf):
    marts = M.refresh_marts(X.mentions(spark, sf).withColumn("text", F.concat_ws(" ", "title", "emotion")), REF, "text")
    return M.table_counts(marts)


@add("g9_field_distribution", """select n_nationkey, count(c_custkey) as article_count, round(count(c_custkey) * 100 / sum(count(c_custkey)) over (), 2) as percentage
  from nation left join customer on n_nationkey = c_nationkey group by 1""")
def _(spark, sf):
    n, c = table(spark, sf, "nation"), table(spark, sf, "customer")
    return M.distribution(n.select("n_nationkey"), c, "n_nationkey", "c_nationkey")


@add("g10_field_statistics", """select o_orderpriority, count(*) as total_articles, count(*) filter (o_orderdate >= '1998-06-17') as articles_today,
  count(*) filter (o_orderdate >= '1998-06-15') as articles_this_week, count(*) filter (o_orderdate >= '1998-06-01') as articles_this_month,
  round(avg(o_custkey), 4) as avg_likes, round(avg(o_orderkey % 10), 4) as avg_shares, cast(sum(coalesce(o_custkey, 0) + coalesce(o_orderkey % 10, 0)) as bigint) as total_engagement
  from orders group by 1""")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("likes", F.col("o_custkey")).withColumn("shares", F.col("o_orderkey") % 10)
    s = M.field_statistics(o, "o_orderpriority", "o_orderdate", date(1998, 6, 17), ("likes", "shares"))
    return s.withColumn("avg_likes", F.round("avg_likes", 4)).withColumn("avg_shares", F.round("avg_shares", 4))


@add("g10_field_source_map", """with c as (select o_orderpriority, o_orderstatus, count(*) as n from orders group by all)
  select o_orderpriority, string_agg(o_orderstatus || '=' || n, '|' order by o_orderstatus) as sources from c group by 1""")
def _(spark, sf):
    return M.count_map(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", "m").select("o_orderpriority", flat("m").alias("sources"))


@add("g11_field_summary", """with c as (select o_orderpriority, o_custkey % 20 as source, count(*) as n from orders group by o_orderpriority, o_custkey % 20 qualify row_number() over (partition by o_orderpriority order by n desc, source) <= 5),
  s as (select o_orderpriority, string_agg(source || '=' || n, '|' order by n desc, source) as sources from c group by 1)
  select o_orderpriority, count(*) as total, round(avg(o_custkey + o_orderkey % 10), 4) as avg_engagement, any_value(sources) as sources from orders join s using (o_orderpriority) group by 1""")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("shares", F.col("o_orderkey") % 10).withColumn("source", F.col("o_custkey") % 20)
    s = M.field_summary(o, "o_orderpriority", "source", ["o_custkey", "shares"])
    return s.select("o_orderpriority", "total", F.round("avg_engagement", 4).alias("avg_engagement"), flat_list("top_sources", "source", "count").alias("sources"))


@add("g12_top_articles", """select o_orderpriority, o_orderkey, o_custkey + o_orderkey % 10 as engagement, row_number() over (partition by o_orderpriority order by o_custkey + o_orderkey % 10 desc, o_orderkey) as rank
  from orders qualify rank <= 10""")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("shares", F.col("o_orderkey") % 10)
    return M.top_articles(o, ["o_orderpriority"], ["o_custkey", "shares"], "o_orderkey").select("o_orderpriority", "o_orderkey", "engagement", "rank")


@add("g13_field_sentiment", f"""with {S.ARTICLES} select domain, count(*) as total_articles, {_SENT},
  round(count(*) filter (sentiment_group = 'positive') / count(*), 6) as sentiment_positive from articles group by 1""")
def _(spark, sf):
    s = M.field_sentiment(X.articles(spark, sf), "domain")
    return s.select("domain", "total_articles", "positive_count", "negative_count", "neutral_count", F.round("sentiment_positive", 6).alias("sentiment_positive"))


@add("g13_counts_from_ratios", """with l as (select quality, count(*) as n from labels group by 1) select quality, cast(floor(n * 0.37) as bigint) as positive, cast(floor(n * 0.2) as bigint) as negative,
  cast(n - floor(n * 0.37) - floor(n * 0.2) as bigint) as neutral from l""")
def _(spark, sf):
    l = table(spark, sf, "labels").groupBy("quality").agg(F.count(F.lit(1)).alias("n"))
    return l.select("quality", M.counts_from_ratios("n", F.lit(0.37), F.lit(0.2)).alias("c")).select("quality", "c.*")


@add("g14_topic_sentiment", f"""with {S.MENTIONS}, e as (select topic_id, emotion, count(*) as n from mentions group by all), ed as (select topic_id, {_EMO} as emotions from e group by 1)
  select topic_id, count(*) as mention_count, {_SENT}, round((count(*) filter (sentiment_group = 'positive') - count(*) filter (sentiment_group = 'negative')) / count(*), 4) as sentiment_score,
    round(count(*) filter (sentiment_group = 'positive') / count(*), 3) as positive_ratio, any_value(emotions) as emotions from mentions join ed using (topic_id) group by 1""")
def _(spark, sf):
    return M.topic_sentiment(X.mentions(spark, sf)).select(
        "topic_id", "mention_count", "positive_count", "negative_count", "neutral_count", "sentiment_score", "positive_ratio", flat("emotion_distribution").alias("emotions"))


@add("g15_classification_overview", """with a as (select l_orderkey as id, l_partkey % 20 as topic_id, l_discount as c, l_linestatus as method from lineitem),
  b as (select topic_id, count(*) as n, round(avg(c), 3) as conf from a group by 1 order by n desc, topic_id limit 10), m as (select method, count(*) as n from a group by 1)
  select (select count(*) from nation) as total_topics, (select count(*) from nation where n_regionkey > 0) as active_topics, count(distinct id) as total_classified,
    (select count(*) from orders) - count(distinct id) as total_unclassified, round(count(*) / count(distinct id), 2) as avg_topics_per_article,
    (select string_agg(method || '=' || n, '|' order by method) from m) as methods, (select string_agg(topic_id || '=' || n, '|' order by n desc, topic_id) from b) as topics from a""")
def _(spark, sf):
    a = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 20).alias("topic_id"), F.col("l_discount").alias("confidence"), F.col("l_linestatus").alias("method"))
    topics = table(spark, sf, "nation").withColumn("is_active", F.col("n_regionkey") > 0)
    o = M.classification_overview(table(spark, sf, "orders"), a, topics, "id")
    return o.select("total_topics", "active_topics", "total_classified", "total_unclassified", "avg_topics_per_article", flat("methods").alias("methods"),
                    flat_list("top_topics", "topic_id", "article_count").alias("topics"))


@add("g16_post_overview", """select p_type, count(*) as total, count(*) filter (p_size > 25) as featured, round(avg(p_retailprice), 4) as avg_score from part group by rollup (p_type)""")
def _(spark, sf):
    return M.post_overview(table(spark, sf, "part"), "p_type", F.col("p_size") > 25, "p_retailprice").withColumn("avg_score", F.round("avg_score", 4))


@add("g17_topic_list", f"with {S.MENTIONS} select topic_id, topic_name, count(*) as article_count from mentions group by all")
def _(spark, sf):
    return M.topic_list(X.mentions(spark, sf))


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@add("g18_table_counts", " union all ".join(f"select '{t}' as table_name, count(*) as n from {t}" for t in _TABLES))
def _(spark, sf):
    return M.table_counts({t: table(spark, sf, t) for t in _TABLES})


@add("g19_sensor_statistics", "select count(*) as total, count(distinct user_id) as provinces, cast(max(year(ts)) as int) as latest_year, round(avg(value), 4) as average from events")
def _(spark, sf):
    return M.sensor_statistics(table(spark, sf, "events"), "user_id", F.year("ts"), "value").withColumn("average", F.round("average", 4))


@add("g20_indicator_summary", """with p as (select l_returnflag, cast(year(l_shipdate) as int) as year, case when l_linenumber = 1 then null else cast(quarter(l_shipdate) as int) end as quarter, cast(round(sum(l_quantity)) as bigint) as value from lineitem group by all),
  r as (select *, row_number() over (partition by l_returnflag order by year desc, quarter desc nulls first) as rn, count(*) over (partition by l_returnflag) as records from p)
  select l_returnflag, records, year as latest_year, quarter as latest_quarter, value as latest_value from r where rn = 1""")
def _(spark, sf):
    l = table(spark, sf, "lineitem")
    quarter = F.when(F.col("l_linenumber") != 1, F.quarter("l_shipdate"))
    p = l.groupBy("l_returnflag", F.year("l_shipdate").alias("year"), quarter.alias("quarter")).agg(F.round(F.sum("l_quantity")).cast("bigint").alias("value"))
    return M.indicator_summary(p, "l_returnflag", "value")


@add("g21_load_report", _LOAD_SQL + """, m as (select coalesce(n.lang, o.lang) as lang, case when o.url is not null and n.url is not null then 'updated' when o.url is null then 'inserted' else 'kept' end as action
  from o full join n on o.url = n.url) select lang, count(*) as total, count(*) filter (action = 'inserted') as inserted, count(*) filter (action = 'updated') as updated,
  count(*) filter (action = 'skipped') as skipped from m where action <> 'kept' group by rollup (lang)""")
def _(spark, sf):
    old, new = _halves(spark, sf)
    return L.load_report(L.keyed_load(old, new, ["url"]), "lang")
