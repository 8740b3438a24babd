"""Alerts, hashtags, viral content and category trends.

Reference times are parameters; windows are half-open, so a row on a boundary
counts once.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import dates as D
from ..functions.columns import count_where
from . import marts as M
from .ranking import nested_top_k, top_k


def alert_windows(mentions: DataFrame, now: datetime, hours: int = 24, ts: str = "published_at") -> DataFrame:
    """Rows of the last window and the one before, flagged ``current``."""
    start = now - timedelta(hours=hours)
    before = start - timedelta(hours=hours)
    return mentions.filter(D.within(ts, before, now)).withColumn("current", D.within(ts, start, now))


def window_counts(mentions: DataFrame, now: datetime, hours: int = 24) -> DataFrame:
    """Per topic: current and previous counts and the current emotions, from one scan."""
    rows = alert_windows(mentions.filter(F.col("topic_id").isNotNull()), now, hours)
    keys = ["topic_id", "topic_name"]
    return M.rolled_up(M.counted(rows, keys), keys)


def spike_level(change: Column, count: Column) -> Column:
    return (F.when((change > 200) & (count > 50), F.lit("critical")).when((change > 100) & (count > 30), F.lit("high"))
            .when((change > 50) & (count > 10), F.lit("medium")).otherwise(F.lit("low")))


def spike_change(current: Column, previous: Column) -> Column:
    """Change in percent; a new topic counts as +100 once it has more than five mentions."""
    return F.when(previous > 0, (current - previous) / previous * 100).otherwise(F.when(current > 5, F.lit(100.0)).otherwise(F.lit(0.0)))


def _alert(rows: DataFrame, kind: str, level: Column, change: Column, ratio: Column) -> DataFrame:
    return rows.select(
        F.lit(kind).alias("alert_type"), level.alias("alert_level"), "topic_id", "topic_name", F.col("mention_count").alias("current_count"),
        F.col("previous_count"), change.alias("change_percent"), ratio.alias("negative_ratio"), "emotion_distribution")


def spikes(counts: DataFrame) -> DataFrame:
    """Topics up by more than half with at least ten mentions."""
    change = spike_change(F.col("mention_count"), F.col("previous_count"))
    rows = counts.withColumn("_c", change).filter((F.col("_c") > 50) & (F.col("mention_count") >= 10))
    return _alert(rows, "spike", spike_level(F.col("_c"), F.col("mention_count")), F.col("_c"), F.lit(None).cast("double"))


def crises(counts: DataFrame) -> DataFrame:
    """Topics of at least five mentions with more than 40 % negative ones."""
    rows = counts.filter("mention_count >= 5").withColumn("_r", F.col("negative_count") / F.col("mention_count")).filter("_r > 0.4")
    level = F.when(F.col("_r") > 0.6, F.lit("high")).otherwise(F.lit("medium"))
    return _alert(rows, "crisis", level, F.lit(None).cast("double"), F.col("_r"))


def drops(counts: DataFrame) -> DataFrame:
    """Topics of at least ten earlier mentions that lost more than half, vanished ones included."""
    rows = counts.filter("previous_count >= 10").withColumn(
        "_c", (F.col("mention_count") - F.col("previous_count")) / F.col("previous_count") * 100).filter("_c < -50")
    return _alert(rows, "drop", F.lit("low"), F.col("_c"), F.lit(None).cast("double"))


def alerts(mentions: DataFrame, now: datetime, hours: int = 24) -> DataFrame:
    """Spikes, crises and drops of the last window. One aggregation feeds all three rules."""
    return judged(window_counts(mentions, now, hours), F.lit(now - timedelta(hours=hours)), F.lit(now))


def judged(counts: DataFrame, start: Column, end: Column) -> DataFrame:
    """Alerts from the current and previous counts of a window, also of a stream."""
    n, prev, neg = F.col("mention_count"), F.col("previous_count"), F.col("negative_count")
    change, ratio = spike_change(n, prev), neg / F.nullif(n, F.lit(0))
    lost = (n - prev) / F.nullif(prev, F.lit(0)) * 100
    none = F.lit(None).cast("double")
    found = F.array_compact(F.array(
        F.when((change > 50) & (n >= 10), F.struct(F.lit("spike").alias("alert_type"), spike_level(change, n).alias("alert_level"),
                                                   change.alias("change_percent"), none.alias("negative_ratio"))),
        F.when((n >= 5) & (ratio > 0.4), F.struct(F.lit("crisis").alias("alert_type"), F.when(ratio > 0.6, F.lit("high")).otherwise(F.lit("medium")).alias("alert_level"),
                                                  none.alias("change_percent"), ratio.alias("negative_ratio"))),
        F.when((prev >= 10) & (lost < -50), F.struct(F.lit("drop").alias("alert_type"), F.lit("low").alias("alert_level"),
                                                     lost.alias("change_percent"), none.alias("negative_ratio")))))
    rows = counts.withColumn("_a", F.explode(found))
    number = lambda c: F.format_string("%.0f", c)
    title = (F.when(F.col("_a.alert_type") == "spike", F.concat(F.lit("Đột biến: "), "topic_name", F.lit(" tăng "), number(F.col("_a.change_percent")), F.lit("%")))
             .when(F.col("_a.alert_type") == "crisis", F.concat(F.lit("Khủng hoảng: "), "topic_name", F.lit(" ("), number(F.col("_a.negative_ratio") * 100), F.lit("% tiêu cực)")))
             .otherwise(F.concat(F.lit("Sụt giảm: "), "topic_name", F.lit(" giảm "), number(F.abs(F.col("_a.change_percent"))), F.lit("%"))))
    return rows.select("_a.alert_type", "_a.alert_level", "topic_id", "topic_name", n.alias("current_count"), "previous_count",
                       "_a.change_percent", "_a.negative_ratio", "emotion_distribution", title.alias("title"),
                       start.alias("period_start"), end.alias("period_end"), F.lit("active").alias("alert_status"))


def hashtag_stats(mentions: DataFrame, tags: Column, period: str, reference: date, top_n: int = 100, nested: int = 5,
                  prefix_previous: bool = False) -> DataFrame:
    """Hashtags of the period against the period before: counts, sources, sentiment, trend flags, topics.

    ``tags`` is the distinct tag array of a row. ``prefix_previous`` counts an earlier row for every
    shown tag that one of its tags merely starts with.
    """
    rows, info = M.both_periods(mentions, period, reference)
    keep = ["current", "sentiment_group", "source_domain", "topic_id", "topic_name"]
    found = rows.select(*keep, F.explode(tags).alias("tag"))
    cur, group = F.col("current"), F.col("sentiment_group")
    counts = found.groupBy("tag").agg(
        count_where(cur).alias("mention_count"), count_where(~cur).alias("previous_count"),
        count_where(cur & (group == "positive")).alias("positive_count"), count_where(cur & (group == "negative")).alias("negative_count")).filter("mention_count > 0")
    best = top_k(counts, top_n, F.desc("mention_count"), F.col("tag"))
    shown = F.broadcast(best.select("tag"))
    if prefix_previous:
        shown_tags = best.agg(F.collect_list("tag").alias("t")).select("t").scalar()
        earlier = rows.filter(~cur).withColumn("_shown", shown_tags).withColumn("_tags", tags)
        hits = earlier.select(F.explode(F.filter("_shown", lambda s: F.exists("_tags", lambda t: t.startswith(s)))).alias("tag"))
        prev = hits.groupBy("tag").agg(F.count(F.lit(1)).alias("previous_count"))
        best = best.drop("previous_count").join(prev, "tag", "left").withColumn("previous_count", F.coalesce("previous_count", F.lit(0)))
    now = found.filter("current").join(shown, "tag", "left_semi")
    sources = now.groupBy("tag").agg(F.count_distinct("source_domain").alias("unique_sources"))
    by_topic = now.filter(F.col("topic_id").isNotNull()).groupBy("tag", "topic_id", "topic_name").agg(F.count(F.lit(1)).alias("count"))
    topics = nested_top_k(by_topic, ["tag"], [F.desc("count"), F.col("topic_id")], ["topic_id", "topic_name", "count"], nested, "related_topics")
    change = M.change_percent("mention_count", "previous_count", when_new=100)
    out = (best.withColumn("_c", change).withColumn("change_percent", F.round("_c", 2))
           .withColumn("is_trending", (F.col("_c") > 30) & (F.col("mention_count") >= 5))
           .withColumn("is_new", (F.col("previous_count") == 0) & (F.col("mention_count") >= 3))
           .withColumn("neutral_count", F.col("mention_count") - F.col("positive_count") - F.col("negative_count"))
           .withColumn("sentiment_score", M.sentiment_score("positive_count", "negative_count", "mention_count"))
           # At most top_n rows reach this window.
           .withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mention_count"), "tag")).cast("bigint")).drop("_c"))
    return M.stamped(out.join(sources, "tag", "left").join(topics, "tag", "left"), info)


def viral_content(articles: DataFrame, key: str, title: str, group: str, top_n: int = 20, hot: int = 10) -> DataFrame:
    """Highest (1 + title length / 50, at most 2) times 1.5 for negative articles."""
    score = (1 + F.coalesce(F.least(F.length(title) / 50, F.lit(2.0)), F.lit(0.0))) * F.when(F.col(group) == "negative", F.lit(1.5)).otherwise(F.lit(1.0))
    best = top_k(articles.withColumn("viral_score", score), top_n, F.desc("viral_score"), F.col(key))
    out = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("viral_score"), key)).cast("bigint"))
    return out.withColumn("is_hot", F.col("rank") <= hot)


def viral_newest(articles: DataFrame, key: str, newest: str, content: str, newest_n: int = 100, min_length: int = 50) -> DataFrame:
    """Among the newest articles, those long enough, scored by length (at most 100)."""
    latest = top_k(articles, newest_n, F.desc(newest), F.col(key))
    return latest.filter(F.length(content) >= min_length).withColumn("viral_score", F.least(F.lit(100.0), F.length(content) / 100))


def hot_topics_by_articles(links: DataFrame, published: str, now: date, days: int = 7, top_n: int = 50, outlier: int = -1) -> DataFrame:
    """Most linked topics of the last days, outliers left out."""
    recent = links.filter(D.within(published, now - timedelta(days=days), now) & (F.col("topic_id") != outlier))
    counts = recent.groupBy("topic_id", "topic_name").agg(F.count(F.lit(1)).alias("article_count"))
    return top_k(counts, top_n, F.desc("article_count"), F.col("topic_id"))


def category_trends(mentions: DataFrame, category: str, period: str, reference: date, proxy_previous: bool = False) -> DataFrame:
    """Per category: totals, sentiment, dominant emotion, change, crisis flag and two ranks.

    The previous count is the category's own; ``proxy_previous`` takes the
    category's current share of the whole previous period instead.
    """
    rows, info = M.both_periods(mentions, period, reference)
    stats = M.rolled_up(M.counted(rows, [category]), [category]).filter("mention_count > 0")
    extra = rows.filter("current").groupBy(category).agg(
        F.count_distinct("source_domain").alias("unique_sources"), F.count_distinct("article_id").alias("unique_articles"))
    by_topic = rows.filter(F.col("current") & F.col("topic_id").isNotNull()).groupBy(category, "topic_id", "topic_name").agg(F.count(F.lit(1)).alias("count"))
    topics = nested_top_k(by_topic, [category], [F.desc("count"), F.col("topic_id")], ["topic_id", "topic_name", "count"], 5, "top_topics")
    out = stats.join(extra, category, "left").join(topics, category, "left")
    if proxy_previous:
        sums = stats.agg(F.sum("mention_count").alias("n"))
        previous = rows.filter(~F.col("current")).agg(F.count(F.lit(1)).alias("p"))
        out = (out.withColumn("_n", sums.scalar()).withColumn("_p", previous.scalar())
               .withColumn("previous_count", F.floor(F.col("_p") * (F.col("mention_count") / F.greatest("_n", F.lit(1)))).cast("bigint")).drop("_n", "_p"))
    total = F.col("mention_count")
    out = (out.withColumn("_c", M.change_percent("mention_count", "previous_count")).withColumn("change_percent", F.round("_c", 2))
           .withColumn("is_trending_up", F.col("_c") > 20).withColumn("is_trending_down", F.col("_c") < -20)
           .withColumn("has_crisis", F.col("negative_count") / total > 0.4)
           .withColumn("sentiment_score", M.sentiment_score("positive_count", "negative_count", "mention_count")).drop("_c"))
    return M.stamped(M.with_ranks(out, [category], {"rank_by_mention": "mention_count", "rank_by_growth": "change_percent"}), info)


def refresh_trends(mentions: DataFrame, articles: DataFrame, now: datetime, period: str = "daily", tags: Column | None = None,
                   category: str | None = None) -> dict[str, DataFrame]:
    """Every trend table of a period."""
    out = {"alerts": alerts(mentions, now), "viral": viral_content(articles, "article_id", "title", "sentiment_group")}
    if tags is not None:
        out["hashtags"] = hashtag_stats(mentions, tags, period, now.date())
    if category:
        out["categories"] = category_trends(mentions, category, period, now.date())
    return out
