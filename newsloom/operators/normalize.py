"""Raw documents of any shape to one article row, batch statistics and validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates as D, text as X, urls as U
from ..functions.columns import first_non_blank, non_blank
from .ranking import top_k_per_group

# Accepted field names per output field, in this order (fixed values).
CONTENT_FIELDS = ["cleaned_content", "content", "text", "raw_content", "message", "message_rich", "body", "description"]
URL_FIELDS = ["source_id", "url", "canonical_url"]
TITLE_FIELDS = ["title", "headline", "subject"]
PUBLISHED_FIELDS = ["published_at", "published", "published_time", "publish_date", "created_time", "date", "timestamp", "created_at"]
AUTHOR_FIELDS = ["author", "creator", "writer"]
CATEGORY_FIELDS = ["category", "section", "topic"]
TAG_FIELDS = ["tags", "keywords", "hashtags"]
ENGAGEMENT_FIELDS = {
    "likes": ["likes", "like_count", "reaction_count", "thumbs_up", "digg_count"],
    "shares": ["shares", "share_count", "retweet_count", "reshare"],
    "comments": ["comments", "comment_count", "reply_count"],
    "views": ["views", "view_count", "play_count", "impressions"],
}


def _pick(df: DataFrame, names: Sequence[str], kind: str = "string") -> Column:
    """First non-blank of the named columns that exist."""
    present = [n for n in names if n in df.columns]
    return first_non_blank(*[F.col(n).cast("string") for n in present]) if present else F.lit(None).cast(kind)


def engagement(df: DataFrame) -> dict[str, Column]:
    """likes, shares, comments, views: first alias that reads as a whole number."""
    out = {}
    for name, aliases in ENGAGEMENT_FIELDS.items():
        present = [F.trim(F.col(a).cast("string")).try_cast("double").try_cast("bigint") for a in aliases if a in df.columns]
        out[name] = F.coalesce(*present) if present else F.lit(None).cast("bigint")
    return out


def engagement_rate(likes: Column, shares: Column, comments: Column, views: Column) -> Column:
    """(likes + shares + comments) / views, NULL without views."""
    total = F.coalesce(likes, F.lit(0)) + F.coalesce(shares, F.lit(0)) + F.coalesce(comments, F.lit(0))
    return total / F.when(views > 0, views)


def post_type(platform: Column, given: Column, has_images: Column, has_videos: Column) -> Column:
    """Given type, else the default of the platform; youtube and tiktok posts are always videos."""
    return (F.when(platform.isin("youtube", "tiktok"), F.lit("video")).when(given.isNotNull(), given)
            .when(platform == "facebook",
                  F.when(has_images, F.lit("photo")).when(has_videos, F.lit("video")).otherwise(F.lit("status")))
            .when(platform == "twitter", F.lit("tweet")))


def normalize_documents(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One article row per raw document; missing columns are simply absent aliases."""
    has = lambda n: n in df.columns
    text_or_null = lambda n: F.col(n).cast("string") if has(n) else F.lit(None).cast("string")
    url = U.with_scheme(_pick(df, URL_FIELDS))
    source = text_or_null("source")
    platform = U.platform(F.coalesce(text_or_null("data_type"), source), url)
    social = F.when(platform.isin(*set(U.W.PLATFORM_HOSTS.values())), platform)
    account = F.coalesce(non_blank(text_or_null("account_name")), U.account_name(url, platform))
    content = X.squeeze(_pick(df, CONTENT_FIELDS))
    has_list = lambda n: (F.size(n) > 0) if has(n) else F.lit(False)
    counts = engagement(df)
    published = [D.parse_timestamp(n) for n in PUBLISHED_FIELDS if has(n)]
    followers = F.coalesce(*[F.col(n) for n in ("followers", "subscribers") if has(n)], F.lit(None).cast("bigint"))
    return df.select(
        *keep, url.alias("url"), F.lower(F.coalesce(text_or_null("data_type"), platform)).alias("source_type"),
        social.alias("platform"), U.domain(url, source, social, account).alias("domain"),
        F.coalesce(_pick(df, TITLE_FIELDS), F.lit("Untitled")).alias("title"), content.alias("content"),
        (F.coalesce(*published) if published else F.lit(None).cast("timestamp")).alias("published_at"),
        _pick(df, AUTHOR_FIELDS).alias("author"), _pick(df, CATEGORY_FIELDS).alias("category"),
        U.split_tags(_pick(df, TAG_FIELDS)).alias("tags"),
        *[c.alias(n) for n, c in counts.items()], account.alias("account_name"),
        U.account_type(text_or_null("account_type"), followers, social).alias("account_type"),
        post_type(social, text_or_null("post_type"), has_list("images"), has_list("videos")).alias("post_type"),
        U.province(text_or_null("province")).alias("province"))


def validation_errors(df: DataFrame, min_content: int = 10) -> Column:
    """Messages of every broken rule of an article row, in rule order."""
    bad = lambda condition, message: F.when(F.coalesce(condition, F.lit(False)), F.lit(message))
    url = non_blank("url")
    rules = [
        bad(url.isNull(), "Missing URL"),
        bad(F.coalesce(F.length("content"), F.lit(0)) < min_content, "Content too short or missing"),
        bad(non_blank("title").isNull(), "Missing title"),
        bad(F.col("published_at").isNull(), "Missing published date"),
        bad(url.isNotNull() & ~url.rlike("^https?://"), "Invalid URL format"),
    ]
    rules += [bad(F.col(n) < 0, f"Negative {n} count") for n in ENGAGEMENT_FIELDS if n in df.columns]
    return F.array_compact(F.array(*rules))


def validate(df: DataFrame) -> DataFrame:
    """Adds ``errors`` and ``is_valid``."""
    return df.withColumn("errors", validation_errors(df)).withColumn("is_valid", F.size("errors") == 0)


def batch_statistics(df: DataFrame, key: str, order: Sequence[str], by: str | None = None, errors: str = "errors",
                     sample: int = 3) -> DataFrame:
    """total, success, failed and a sample of messages; repeated keys count as failed."""
    # Keys are reduced before anything is grouped by type, so a hot type stays cheap.
    firsts = df.groupBy(*([by] if by else []), key).agg(
        F.count(F.lit(1)).alias("_n"), F.min_by(errors, F.struct(*order)).alias("_errors"))
    ok = (F.size("_errors") == 0).cast("bigint")
    grouped = firsts.groupBy(by) if by else firsts.groupBy()
    counts = grouped.agg(F.sum("_n").alias("total"), F.sum(ok).alias("success"), (F.sum("_n") - F.sum(ok)).alias("failed"))
    # Messages are made distinct, ranked and cut before they are gathered.
    group = F.col(by) if by else F.lit(1)
    messages = firsts.select(group.alias("_by"), F.explode("_errors").alias("_m")).distinct()
    cut = top_k_per_group(messages, ["_by"], [F.col("_m")], sample, "_r").groupBy("_by").agg(F.sort_array(F.collect_list("_m")).alias("error_sample"))
    out = counts.join(cut, group.eqNullSafe(F.col("_by")), "left").drop("_by")
    return out.withColumn("error_sample", F.coalesce("error_sample", F.array().cast("array<string>")))


def article_texts(df: DataFrame, content: str = "content", title: str = "title", source: str = "source") -> DataFrame:
    """Adds the snippet (200 characters), the shortened source (512) and the training text."""
    return (df.withColumn("content_snippet", F.substring(content, 1, 200))
            .withColumn("source", F.substring(source, 1, 512))
            .withColumn("training_text", F.concat_ws("\n", non_blank(title), non_blank(content))))
