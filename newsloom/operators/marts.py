"""Periodic statistics over the mention fact.

The fact has article_id, published_at, topic_id, topic_name, source_domain,
emotion, sentiment_group and optionally title and text. Each mart scans a
period and the one before it once and counts both sides conditionally. Counts
are first taken per (entity, emotion), which task-side partial sums keep small
even when one entity holds most of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import dates as D, text as X, urls as U
from ..functions.columns import ColumnLike, col, contained, count_where, strings
from ..resources import words as W
from ..session import shared_checkpoint
from .ranking import nested_top_k, overall_rank, top_k, top_k_per_group

GROUPS = ("positive", "negative", "neutral")


def sentiment_score(positive: ColumnLike, negative: ColumnLike, total: ColumnLike) -> Column:
    """(positive - negative) / total to four digits, 0 without mentions."""
    return F.when(col(total) > 0, F.round((col(positive) - col(negative)) / col(total), 4)).otherwise(F.lit(0.0))


def change_percent(current: ColumnLike, previous: ColumnLike, when_new: ColumnLike | float = 0.0) -> Column:
    fallback = F.lit(float(when_new)) if isinstance(when_new, (int, float)) else col(when_new)
    return F.when(col(previous) > 0, (col(current) - col(previous)) / col(previous) * 100).otherwise(fallback)


def tally(rows: DataFrame, condition: Column | None = None) -> Column:
    """Mentions (for which ``condition`` holds) of facts, or of daily partials, whose rows stand for ``mentions`` each."""
    if "mentions" not in rows.columns:
        return F.count(F.lit(1)) if condition is None else count_where(condition)
    return F.coalesce(F.sum("mentions" if condition is None else F.when(condition, F.col("mentions"))), F.lit(0)).cast("bigint")


#: What a partial row is a count of.
PARTIAL_KEYS = ("published_at", "topic_id", "topic_name", "source_domain", "emotion", "sentiment_group")


def daily_partials(mentions: DataFrame) -> DataFrame:
    """Mentions per day, topic, source, emotion and sentiment: one scan of the facts that every mart of whole days can be rolled up from.

    Counts and distinct counts of topics and sources are exact. Titles and texts are not in it.
    """
    days = mentions.withColumn("published_at", F.date_trunc("day", "published_at").cast(mentions.schema["published_at"].dataType))
    return days.groupBy(*PARTIAL_KEYS).agg(tally(mentions).alias("mentions"))


def refresh_partials(stored: DataFrame, mentions: DataFrame, days: Sequence[date]) -> DataFrame:
    """``stored`` with the partials of ``days`` counted anew from the facts of these days alone."""
    wanted = F.to_date("published_at").isin(list(days))
    facts = None
    for day in days:  # bounds on the raw timestamp reach the scan
        bound = D.within("published_at", day, day + timedelta(days=1))
        facts = bound if facts is None else facts | bound
    if facts is None:
        return stored
    return stored.filter(~F.coalesce(wanted, F.lit(False))).unionByName(daily_partials(mentions.filter(facts)))


def both_periods(mentions: DataFrame, period: str, reference: date, ts: str = "published_at") -> tuple[DataFrame, dict]:
    """Rows of the period and of the equally long one before it, flagged ``current``."""
    start, end, before, _, label = D.period_range(period, reference)
    stop = end + timedelta(days=1)
    rows = mentions.filter(D.within(ts, before, stop)).withColumn("current", D.within(ts, start, stop))
    return rows, {"period_type": period, "period_start": start, "period_end": end, "period_label": label}


def counted(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n, previous, positive, negative, neutral per key and emotion in one scan."""
    cur = F.col("current")
    group = F.col("sentiment_group")
    return rows.groupBy(*keys, "emotion").agg(
        tally(rows, cur).alias("n"), tally(rows, ~cur).alias("previous"),
        tally(rows, cur & (group == "positive")).alias("positive"), tally(rows, cur & (group == "negative")).alias("negative"))


def rolled_up(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums per key with the emotion map and the dominant emotion (first by name among equals)."""
    shown = F.when((F.col("n") > 0) & F.col("emotion").isNotNull(), F.struct("emotion", "n"))
    return cells.groupBy(*keys).agg(
        F.sum("n").alias("mention_count"), F.sum("previous").alias("previous_count"), F.sum("positive").alias("positive_count"),
        F.sum("negative").alias("negative_count"),
        F.map_from_entries(F.sort_array(F.collect_list(shown))).alias("emotion_distribution"),
        F.min_by("emotion", F.when((F.col("n") > 0) & F.col("emotion").isNotNull(), F.struct(-F.col("n"), F.col("emotion")))).alias("dominant_emotion"),
    ).withColumn("neutral_count", F.col("mention_count") - F.col("positive_count") - F.col("negative_count"))


def stamped(df: DataFrame, period: dict) -> DataFrame:
    return df.select(*[F.lit(period[k]).alias(k) for k in ("period_type", "period_start", "period_end")], *df.columns)


def keyword_counts(docs: DataFrame, text: str, top_n: int | None = 50, stopwords: Sequence[str] | None = None,
                   keys: Sequence[str] = ()) -> DataFrame:
    """Single words of more than two letters by count: what the marts store as keywords."""
    stop = W.KEYWORD_STOPWORDS if stopwords is None else stopwords
    found = docs.select(*keys, F.explode(X.words(text, stop, 3, None)).alias("word"))
    counts = found.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("count"))
    if top_n is None:
        return counts
    order = [F.desc("count"), F.col("word")]
    return top_k_per_group(counts, keys, order, top_n) if keys else top_k(counts, top_n, *order)


def _as_array(rows: DataFrame, order: Column, fields: Sequence[str]) -> Column:
    """A short, already cut list as one scalar array."""
    packed = F.sort_array(F.collect_list(F.struct(order.alias("_o"), *fields)))
    return rows.agg(F.transform(packed, lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias("a")).scalar()


def trend_report(mentions: DataFrame, period: str, reference: date, text: str | None = None, keywords: int = 20, sources: int = 10,
                 stopwords: Sequence[str] | None = None) -> DataFrame:
    """One row: totals, sentiment shares, emotion map, change, top keywords and sources."""
    rows, info = both_periods(mentions, period, reference)
    current = rows.filter("current")
    totals = current.agg(
        tally(rows).alias("total_mentions"), F.count_distinct("source_domain").alias("total_sources"),
        F.count_distinct("topic_id").alias("total_topics"), tally(rows, F.col("sentiment_group") == "positive").alias("positive_count"),
        tally(rows, F.col("sentiment_group") == "negative").alias("negative_count"))
    previous = rows.filter(~F.col("current")).agg(tally(rows).alias("n")).scalar()
    emotions = (current.filter(F.col("emotion").isNotNull()).groupBy("emotion").agg(tally(rows).alias("n"))
                .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("emotion", "n")))).alias("m")).scalar())
    by_source = current.filter(F.col("source_domain").isNotNull()).groupBy(F.col("source_domain").alias("domain")).agg(tally(rows).alias("count"))
    best_sources = top_k(by_source, sources, F.desc("count"), F.col("domain"))
    total = F.col("total_mentions")
    share = lambda c: F.when(total > 0, F.round(F.col(c) / total * 100, 2)).otherwise(F.lit(0.0))
    out = (totals.withColumn("_prev", previous).withColumn("neutral_count", total - F.col("positive_count") - F.col("negative_count"))
           .withColumn("positive_ratio", share("positive_count")).withColumn("negative_ratio", share("negative_count"))
           .withColumn("mention_change", F.round(change_percent(total, "_prev"), 2)).withColumn("emotion_distribution", emotions)
           .withColumn("top_sources", _as_array(best_sources, -F.col("count"), ["domain", "count"])).drop("_prev"))
    if text:
        words = keyword_counts(current, text, keywords, stopwords)
        out = out.withColumn("top_keywords", _as_array(words, -F.col("count"), ["word", "count"]))
    return stamped(out.withColumn("period_label", F.lit(info["period_label"])), info)


def hot_topics(mentions: DataFrame, period: str, reference: date, top_n: int = 20, titles: int = 5) -> DataFrame:
    """Most mentioned topics with velocity, hot and crisis scores, emotions and sample titles."""
    rows, info = both_periods(mentions.filter(F.col("topic_id").isNotNull()), period, reference)
    topics = rolled_up(counted(rows, ["topic_id", "topic_name"]), ["topic_id", "topic_name"]).filter("mention_count > 0")
    best = top_k(topics, top_n, F.desc("mention_count"), F.col("topic_id"))
    n, prev, neg = F.col("mention_count"), F.col("previous_count"), F.col("negative_count")
    velocity = F.when(prev > 0, (n - prev) / prev).otherwise(F.lit(1.0))
    out = best.withColumn("_v", velocity).withColumn("_ratio", neg / n)
    out = out.withColumn("_hot", n * (1 + F.greatest(F.lit(0.0), F.col("_v")))).withColumn(
        "_crisis", F.when(F.col("_v") > 0, F.col("_ratio") * F.col("_v")).otherwise(F.col("_ratio")))
    out = (out.withColumn("mention_velocity", F.round("_v", 4)).withColumn("hot_score", F.round("_hot", 2))
           .withColumn("crisis_score", F.round("_crisis", 4)).withColumn("is_hot", F.col("_hot") > n * 1.5)
           .withColumn("is_crisis", F.col("_crisis") > 0.3).withColumn("is_trending_up", F.col("_v") > 0.2)
           .withColumn("is_trending_down", F.col("_v") < -0.2)
           # At most top_n rows reach this window.
           .withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mention_count"), "topic_id")).cast("bigint"))
           .drop("_v", "_ratio", "_hot", "_crisis"))
    if titles and "title" in mentions.columns:
        # top_n topic ids, so the broadcast is small by construction.
        named = rows.filter(F.col("current") & F.col("title").isNotNull()).select("topic_id", "article_id", "title")
        named = named.join(F.broadcast(best.select("topic_id")), "topic_id", "left_semi")
        samples = nested_top_k(named, ["topic_id"], [F.col("article_id")], ["title"], titles, "_titles")
        out = out.join(samples, "topic_id", "left").withColumn(
            "sample_titles", F.coalesce(F.transform("_titles", lambda s: s["title"]), F.array().cast("array<string>"))).drop("_titles")
    return stamped(out, info)


def phrase_rows(docs: DataFrame, tokens: Column, keep: Sequence[str]) -> DataFrame:
    """One row per 2- or 3-gram occurrence, ``first`` marking the first of its kind in the document."""
    grams = docs.select(*keep, F.sort_array(X.phrases(tokens, 2, 3)).alias("g"))
    pairs = F.arrays_zip(F.col("g").alias("phrase"), F.concat(F.array(F.lit(None).cast("string")), F.col("g")).alias("before"))
    return (grams.select(*keep, F.explode(F.slice(pairs, 1, F.size("g"))).alias("p"))
            .select(*keep, F.col("p.phrase").alias("phrase"), (~F.col("p.phrase").eqNullSafe(F.col("p.before"))).alias("first")))


def keyword_stats(mentions: DataFrame, text: str, period: str, reference: date, top_n: int = 100, stopwords: Sequence[str] | None = None,
                  garbage: Sequence[str] | None = None, hot_events: Sequence[str] | None = None, nested: int = 5) -> DataFrame:
    """Phrase statistics: mentions, documents, sentiment, boosted weight, top topics and sources."""
    start, end, _, _, label = D.period_range(period, reference)
    info = {"period_type": period, "period_start": start, "period_end": end, "period_label": label}
    rows = mentions.filter(D.within("published_at", start, end + timedelta(days=1)))
    tokens = X.words(text, W.KEYWORD_STOPWORDS if stopwords is None else stopwords)
    found = phrase_rows(rows, tokens, ["sentiment_group", "topic_id", "topic_name", "source_domain"])
    for bad in W.KEYWORD_GARBAGE if garbage is None else garbage:
        found = found.filter(~F.col("phrase").contains(bad))
    is_first = F.col("first")
    # Ranks need no more than mentions, so only (phrase, count) is shuffled for all phrases; the rest is counted for the best ones.
    counts = found.groupBy("phrase").agg(F.count(F.lit(1)).alias("mention_count"))
    hot = strings(W.HOT_EVENTS if hot_events is None else hot_events)
    boost = (F.when(F.size(contained("phrase", hot)) > 0, F.lit(2.0)).otherwise(F.lit(1.0))
             * F.when(F.size(F.split("phrase", " ")) >= 3, F.lit(1.5)).otherwise(F.lit(1.0)))
    ranked = shared_checkpoint(top_k(counts.withColumn("score", F.col("mention_count") * boost), top_n, F.desc("score"), F.col("phrase")))
    # At most top_n rows, so the broadcast is small by construction.
    cells = found.join(F.broadcast(ranked.select("phrase")), "phrase", "left_semi").groupBy("phrase", "topic_id", "topic_name", "source_domain").agg(
        count_where(is_first).alias("document_count"), count_where(is_first & (F.col("sentiment_group") == "positive")).alias("positive_count"),
        count_where(is_first & (F.col("sentiment_group") == "negative")).alias("negative_count"))
    cells = shared_checkpoint(cells)
    best = ranked.join(cells.groupBy("phrase").agg(*[F.sum(c).alias(c) for c in ("document_count", "positive_count", "negative_count")]), "phrase")
    docs = cells.filter("document_count > 0")
    by_topic = docs.filter(F.col("topic_id").isNotNull()).groupBy("phrase", "topic_id", "topic_name").agg(F.sum("document_count").alias("count"))
    by_source = docs.filter(F.col("source_domain").isNotNull()).groupBy("phrase", F.col("source_domain").alias("domain")).agg(F.sum("document_count").alias("count"))
    topics = nested_top_k(by_topic, ["phrase"], [F.desc("count"), F.col("topic_id")], ["topic_id", "topic_name", "count"], nested, "related_topics")
    sources = nested_top_k(by_source, ["phrase"], [F.desc("count"), F.col("domain")], ["domain", "count"], nested, "top_sources")
    out = (best.withColumn("neutral_count", F.col("document_count") - F.col("positive_count") - F.col("negative_count"))
           .withColumn("sentiment_score", sentiment_score("positive_count", "negative_count", "document_count"))
           .withColumn("_max", F.max("score").over(Window.partitionBy(F.lit(1))))  # at most top_n rows
           .withColumn("weight", F.round(F.col("score") / F.col("_max"), 4)).drop("_max", "score")
           .join(topics, "phrase", "left").join(sources, "phrase", "left").withColumnRenamed("phrase", "keyword"))
    return stamped(out, info)


def topic_mentions(mentions: DataFrame, period: str, reference: date) -> DataFrame:
    """Per topic: mentions, sources, sentiment, emotions, change and ranks by mentions and by negatives."""
    rows, info = both_periods(mentions.filter(F.col("topic_id").isNotNull()), period, reference)
    keys = ["topic_id", "topic_name"]
    stats = rolled_up(counted(rows, keys), keys).filter("mention_count > 0")
    sources = rows.filter("current").groupBy(*keys).agg(F.count_distinct("source_domain").alias("unique_sources"))
    out = stats.join(sources, keys, "left").withColumn(
        "sentiment_score", sentiment_score("positive_count", "negative_count", "mention_count")).withColumn(
        "mention_change", F.round(change_percent("mention_count", "previous_count"), 2))
    out = with_ranks(out, keys, {"rank_by_mention": "mention_count", "rank_by_negative": "negative_count"})
    return stamped(out, info)


def with_ranks(rows: DataFrame, keys: Sequence[str], ranks: dict[str, str]) -> DataFrame:
    """Adds overall ranks, largest measure first, ties by the keys. Only keys and measures are sorted; keys are unique."""
    for name, measure in ranks.items():
        ranked = overall_rank(rows.select(*keys, measure), [F.desc(measure), *[F.col(k) for k in keys]], name).select(*[F.col(k).alias(f"_{k}") for k in keys], name)
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
        rows = rows.join(ranked, on).drop(*[f"_{k}" for k in keys])
    return rows


def website_activity(mentions: DataFrame, period: str, reference: date, hosts: dict[str, str] | None = None) -> DataFrame:
    """Domain x topic activity of news sites, with the overall rank of the domain."""
    rows, info = both_periods(mentions.filter(F.col("source_domain").isNotNull()), period, reference)
    social = U.platform_of_url(F.concat(F.lit("https://"), F.col("source_domain")), hosts)
    keys = ["source_domain", "topic_id", "topic_name"]
    cells = counted(rows.filter("current"), keys).withColumn("_social", social).filter(F.col("_social").isNull()).drop("_social")
    stats = rolled_up(cells, keys)
    domains = stats.groupBy("source_domain").agg(F.sum("mention_count").alias("_total"))
    ranked = overall_rank(domains, [F.desc("_total"), F.col("source_domain")], "rank_overall").drop("_total")
    out = stats.join(ranked, "source_domain").withColumn("avg_sentiment_score", sentiment_score("positive_count", "negative_count", "mention_count"))
    return stamped(out.drop("previous_count"), info)


def social_activity(mentions: DataFrame, period: str, reference: date, hosts: dict[str, str] | None = None,
                    platform: Column | None = None) -> DataFrame:
    """Platform x account x topic activity, with the rank of the account in its platform."""
    rows, info = both_periods(mentions.filter(F.col("source_domain").isNotNull()), period, reference)
    where = platform if platform is not None else U.platform_of_url(F.concat(F.lit("https://"), F.col("source_domain")), hosts)
    keys = ["platform", "source_domain", "topic_id", "topic_name"]
    cells = counted(rows.filter("current"), keys[1:]).withColumn("platform", where).filter(F.col("platform").isNotNull())
    stats = rolled_up(cells, keys)
    accounts = stats.groupBy("platform", "source_domain").agg(F.sum("mention_count").alias("_total"))
    ranked = overall_rank(accounts, [F.desc("_total"), F.col("source_domain")], "rank_in_platform", group=["platform"]).drop("_total")
    out = stats.join(ranked, ["platform", "source_domain"]).withColumn(
        "avg_sentiment_score", sentiment_score("positive_count", "negative_count", "mention_count"))
    return stamped(out.drop("previous_count").withColumnRenamed("source_domain", "account_name"), info)


def daily_snapshots(mentions: DataFrame, text: str | None = None, top: int = 10, keywords: int = 20,
                    stopwords: Sequence[str] | None = None) -> DataFrame:
    """One row per day: totals, sentiment, emotion map, top topics, sources and keywords, for all days at once."""
    rows = mentions.withColumn("snapshot_date", D.day("published_at")).withColumn("current", F.lit(True))
    key = ["snapshot_date"]
    out = rolled_up(counted(rows, key), key).drop("previous_count")
    distinct = rows.groupBy(*key).agg(F.count_distinct("source_domain").alias("unique_sources"), F.count_distinct("topic_id").alias("unique_topics"))
    by_topic = rows.filter(F.col("topic_id").isNotNull()).groupBy(*key, "topic_id", "topic_name").agg(tally(rows).alias("count"))
    by_source = rows.filter(F.col("source_domain").isNotNull()).groupBy(*key, F.col("source_domain").alias("domain")).agg(tally(rows).alias("count"))
    parts = [nested_top_k(by_topic, key, [F.desc("count"), F.col("topic_id")], ["topic_id", "topic_name", "count"], top, "top_topics"),
             nested_top_k(by_source, key, [F.desc("count"), F.col("domain")], ["domain", "count"], top, "top_sources")]
    if text:
        words = keyword_counts(rows, text, None, stopwords, keys=key)
        parts.append(nested_top_k(words, key, [F.desc("count"), F.col("word")], ["word", "count"], keywords, "top_keywords"))
    for part in [distinct, *parts]:
        out = out.join(part, key, "left")
    return out


def refresh_marts(mentions: DataFrame, reference: date, text: str | None = None) -> dict[str, DataFrame]:
    """Every mart that is due: daily and weekly always, monthly around the turn of the month.

    ``mentions`` are facts, or daily partials (then without ``text``, and hot topics have no sample titles).
    """
    periods = ["daily", "weekly"] + (["monthly"] if reference.day <= 7 or reference.day >= 25 else [])
    marts: dict[str, DataFrame] = {"daily_snapshots": daily_snapshots(mentions.filter(D.within("published_at", reference, reference + timedelta(days=1))), text)}
    for p in periods:
        marts[f"{p}_trend_report"] = trend_report(mentions, p, reference, text)
        marts[f"{p}_hot_topics"] = hot_topics(mentions, p, reference)
        marts[f"{p}_topic_mentions"] = topic_mentions(mentions, p, reference)
        marts[f"{p}_website_activity"] = website_activity(mentions, p, reference)
        marts[f"{p}_social_activity"] = social_activity(mentions, p, reference)
        if text:
            marts[f"{p}_keyword_stats"] = keyword_stats(mentions, text, p, reference)
    return marts


def topic_sentiment(mentions: DataFrame, digits: int = 4) -> DataFrame:
    """All-time sentiment roll-up per topic with shares."""
    rows = mentions.filter(F.col("topic_id").isNotNull()).withColumn("current", F.lit(True))
    stats = rolled_up(counted(rows, ["topic_id"]), ["topic_id"]).drop("previous_count")
    total = F.col("mention_count")
    return (stats.withColumn("sentiment_score", F.round((F.col("positive_count") - F.col("negative_count")) / total, digits))
            .withColumn("positive_ratio", F.round(F.col("positive_count") / total, 3))
            .withColumn("negative_ratio", F.round(F.col("negative_count") / total, 3)))


def topic_list(mentions: DataFrame) -> DataFrame:
    return mentions.filter(F.col("topic_id").isNotNull()).groupBy("topic_id", "topic_name").agg(F.count(F.lit(1)).alias("article_count"))


# --- Fields --------------------------------------------------------------------------------------------------------

def distribution(dimension: DataFrame, facts: DataFrame, key: str, fact_key: str | None = None) -> DataFrame:
    """Fact count and percentage per dimension row, zero rows kept."""
    counts = facts.groupBy(F.col(fact_key or key).alias(key)).agg(F.count(F.lit(1)).alias("article_count"))
    total = counts.join(dimension.select(key), key, "left_semi").agg(F.sum("article_count").alias("t")).scalar()
    return (dimension.join(counts, key, "left").withColumn("article_count", F.coalesce("article_count", F.lit(0)))
            .withColumn("_total", total)
            .withColumn("percentage", F.when(F.col("_total") > 0, F.round(F.col("article_count") * 100 / F.col("_total"), 2)).otherwise(F.lit(0.0)))
            .drop("_total"))


def engagement_sum(*columns: str) -> Column:
    total = F.lit(0)
    for c in columns:
        total = total + F.coalesce(F.col(c), F.lit(0))
    return total


def count_map(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """value -> count map per key with every value: for columns of few values; others are better read from ``value_counts``."""
    return value_counts(rows, key, value).groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(value, "count")))).alias(name))


def value_counts(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("count"))


def field_statistics(articles: DataFrame, field: str, created: str, reference: date, measures: Sequence[str] = ("likes", "shares", "comments")) -> DataFrame:
    """Totals, counts of today, this week and this month, average measures and summed engagement per field."""
    since = lambda d: count_where(F.col(created) >= F.lit(d).cast("timestamp_ntz"))
    week = D.period_range("weekly", reference)[0]
    return articles.groupBy(field).agg(
        F.count(F.lit(1)).alias("total_articles"), since(reference).alias("articles_today"), since(week).alias("articles_this_week"),
        since(reference.replace(day=1)).alias("articles_this_month"),
        *[F.coalesce(F.avg(m), F.lit(0.0)).alias(f"avg_{m}") for m in measures], F.sum(engagement_sum(*measures)).alias("total_engagement"))


def field_summary(articles: DataFrame, field: str, source: str, measures: Sequence[str], top: int = 5) -> DataFrame:
    """Articles, average engagement and top sources per field."""
    totals = articles.groupBy(field).agg(F.count(F.lit(1)).alias("total"), F.avg(engagement_sum(*measures)).alias("avg_engagement"))
    best = nested_top_k(value_counts(articles, field, source), [field], [F.desc("count"), F.col(source)], [source, "count"], top, "top_sources")
    return totals.join(best, field, "left")


def top_articles(articles: DataFrame, group: Sequence[str], measures: Sequence[str], key: str, limit: int = 10) -> DataFrame:
    rows = articles.withColumn("engagement", engagement_sum(*measures))
    return top_k_per_group(rows, group, [F.desc("engagement"), F.col(key)], limit)


def field_sentiment(rows: DataFrame, field: str, group: str = "sentiment_group") -> DataFrame:
    """Counts and shares of positive, negative and the rest per field."""
    out = rows.groupBy(field).agg(
        F.count(F.lit(1)).alias("total_articles"), count_where(F.col(group) == "positive").alias("positive_count"),
        count_where(F.col(group) == "negative").alias("negative_count"))
    total = F.col("total_articles")
    return (out.withColumn("neutral_count", total - F.col("positive_count") - F.col("negative_count"))
            .withColumn("sentiment_positive", F.col("positive_count") / total).withColumn("sentiment_negative", F.col("negative_count") / total))


def counts_from_ratios(total: ColumnLike, positive: ColumnLike, negative: ColumnLike) -> Column:
    """struct(positive, negative, neutral): whole numbers cut from shares, the remainder is neutral."""
    p, n = F.floor(col(total) * col(positive)), F.floor(col(total) * col(negative))
    return F.struct(p.alias("positive"), n.alias("negative"), (col(total) - p - n).alias("neutral"))


# --- Overviews -----------------------------------------------------------------------------------------------------

def classification_overview(articles: DataFrame, assignments: DataFrame, topics: DataFrame, key: str, top: int = 10) -> DataFrame:
    """One row: topics, active, classified, unclassified, topics per article, methods and top topics."""
    per_article = assignments.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = articles.agg(F.count(F.lit(1)).alias("n")).scalar()
    methods = (assignments.filter(F.col("method").isNotNull()).groupBy("method").agg(F.count(F.lit(1)).alias("n"))
               .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("method", "n")))).alias("m")).scalar())
    by_topic = assignments.groupBy("topic_id").agg(F.count(F.lit(1)).alias("article_count"), F.round(F.avg("confidence"), 3).alias("avg_confidence"))
    best = top_k(by_topic, top, F.desc("article_count"), F.col("topic_id"))
    totals = topics.agg(F.count(F.lit(1)).alias("total_topics"), F.count_if("is_active").alias("active_topics"))
    per = per_article.agg(F.count(F.lit(1)).alias("c"), F.avg("n").alias("a"))
    return (totals.withColumn("total_classified", per.select("c").scalar()).withColumn("_all", total)
            .withColumn("total_unclassified", F.col("_all") - F.col("total_classified"))
            .withColumn("avg_topics_per_article", F.coalesce(F.round(per.select("a").scalar(), 2), F.lit(0.0)))
            .withColumn("methods", methods)
            .withColumn("top_topics", _as_array(best, -F.col("article_count"), ["topic_id", "article_count", "avg_confidence"])).drop("_all"))


def post_overview(posts: DataFrame, kind: str, featured: Column, score: str) -> DataFrame:
    """Posts, featured posts and average score per type; the total has a NULL type."""
    return posts.rollup(kind).agg(F.count(F.lit(1)).alias("total"), count_where(featured).alias("featured"), F.avg(score).alias("avg_score"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no table given")
    return out


def sensor_statistics(readings: DataFrame, province: str, year: Column, value: str) -> DataFrame:
    return readings.agg(F.count(F.lit(1)).alias("total"), F.count_distinct(province).alias("provinces"), F.max(year).alias("latest_year"),
                        F.avg(value).alias("average"))


def indicator_summary(panel: DataFrame, field: str, value: str) -> DataFrame:
    """Records and latest value per field; a whole year (no quarter) counts as later than its quarters."""
    order = F.struct(F.col("year"), F.coalesce(F.col("quarter"), F.lit(99)))
    return panel.groupBy(field).agg(F.count(F.lit(1)).alias("records"), F.max_by("year", order).alias("latest_year"),
                                    F.max_by("quarter", order).alias("latest_quarter"), F.max_by(value, order).alias("latest_value"))
