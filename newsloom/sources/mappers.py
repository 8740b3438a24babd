"""One mapper per source: raw record columns to the common article schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import dates as D, numbers as N, text as X, urls as U
from ..functions.columns import first_non_blank, non_blank


# Raw record shapes per source (fixed values).
RAW_META = {
    "facebook": (
        "post_id:string,type:string,url:string,message:string,message_rich:string,timestamp:bigint,comments_count:bigint,"
        "reactions_count:bigint,reshare_count:bigint,reactions:map<string,bigint>,"
        "author:struct<id:string,name:string,url:string,profile_picture_url:string>,author_title:string,image:string,video:string,"
        "album_preview:array<struct<type:string,image_file_uri:string,url:string>>,external_url:string,attached_post_url:string"),
    "tiktok": ("url_video:string,username:string,views:bigint,views_text:string,hashtags:array<string>,"
                      "thumbnail_url:string,badge:string,timestamp:bigint"),
    "threads": ("username:string,likes:bigint,replies:bigint,reposts:bigint,shares:bigint,time:string,datetime:string,"
                       "timestamp:bigint"),
    "newspaper": (
        "time_int:bigint,publish_date:string,published_date:string,publication_date:string,published_at:string,date:string,"
        "timestamp:string,author:string,source:string,newspaper_name:string,site_name:string,publisher:string,"
        "type_newspaper:string,category:string,section:string,tags:string,images:array<string>,image:string,thumbnail:string,"
        "description:string,summary:string,excerpt:string,headline:string,title:string,body:string,text:string,"
        "likes:bigint,shares:bigint,comments:bigint,comments_count:bigint,views:bigint,view_count:bigint"),
}


RAW_HEAD = ("url string, title string, id bigint, content string, data_type string, created_at double, updated_at double, "
            "published_at string, meta_data struct<{meta}>")


def raw_schema(kind: str) -> T.StructType:
    """Schema of one raw record of a source."""
    return T.DataType.fromDDL(RAW_HEAD.format(meta=RAW_META[kind]))


def _m(name: str) -> Column:
    return F.col(f"meta_data.{name}")


def _count(*columns: Column) -> Column:
    """First count that is present and not zero, else 0."""
    return F.coalesce(*[F.nullif(c, F.lit(0).cast("bigint")) for c in columns], F.lit(0).cast("bigint"))


def _list(value: Column) -> Column:
    return F.when(F.size(value) > 0, value)


def _article(kind: str, df: DataFrame, content: Column, title: Column, published: Column, **fields: Column) -> DataFrame:
    social = kind in ("facebook", "tiktok", "threads")
    clean = X.clean_ingest(content)
    null = F.lit(None).cast("string")
    zero = F.lit(0).cast("bigint")
    out = {
        "url": F.col("url"), "source_type": F.lit(kind), "source": F.col("url"), "domain": U.domain_of_url("url"),
        "social_platform": F.lit(kind) if social else null,
        "title": non_blank(X.clean_ingest(title)), "content": clean, "word_count": X.word_count(clean),
        "published_at": published, "published_date": F.unix_micros(published) / F.lit(1e6),
        "likes_count": zero, "shares_count": zero, "comments_count": zero, "views_count": zero,
        "reactions": F.lit(None).cast("map<string,bigint>"),
        "account_id": null, "account_name": null, "account_url": null,
        "post_id": F.col("id").cast("string"), "post_type": null,
        "raw_metadata": F.to_json("meta_data"), "is_cleaned": F.lit(True), "data_type": F.lit(kind),
        "images": F.lit(None).cast("array<string>"), "videos": F.lit(None).cast("array<string>"),
        "tags": F.lit(None).cast("array<string>"), "category": null, "summary": null, "source_name": null,
    }
    out.update(fields)
    valid = non_blank("url").isNotNull() & (F.length(X.strip(content)) >= 10)
    return df.filter(valid).select(*[c.alias(n) for n, c in out.items()])


def facebook(df: DataFrame) -> DataFrame:
    content = first_non_blank("content", _m("message"), _m("message_rich"), "title")
    album = F.coalesce(_m("album_preview"), F.array().cast("array<struct<type:string,image_file_uri:string,url:string>>"))
    one = lambda c: F.when(non_blank(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    of_type = lambda kind, field: F.transform(F.filter(album, lambda i: i["type"] == kind), lambda i: i[field])
    summed = F.aggregate(F.map_values(_m("reactions")), F.lit(0).cast("bigint"), lambda a, v: a + F.coalesce(v, F.lit(0)))
    return _article(
        "facebook", df, content, X.headline(content),
        D.parse_timestamp(F.coalesce(_m("timestamp").cast("string"), F.col("created_at").cast("decimal(20,3)").cast("string"))),
        likes_count=_count(_m("reactions_count"), summed), shares_count=_count(_m("reshare_count")),
        comments_count=_count(_m("comments_count")), reactions=F.when(F.size(_m("reactions")) > 0, _m("reactions")),
        account_id=_m("author.id"), account_name=_m("author.name"), account_url=_m("author.url"),
        post_id=F.coalesce(_m("post_id"), F.col("id").cast("string")), post_type=F.coalesce(_m("type"), F.lit("post")),
        images=_list(F.concat(of_type("photo", "image_file_uri"), one(_m("image")))),
        videos=_list(F.concat(of_type("video", "url"), one(_m("video")))))


CREDIT = r"(?U)\s+created by .+$"


def _user(host: str) -> dict[str, Column]:
    name = F.coalesce(non_blank(_m("username")), N.group_of("url", rf"{host}/@([^/]+)"))
    return {"account_id": name, "account_name": name, "account_url": F.concat(F.lit(f"https://www.{host}/@"), name)}


def tiktok(df: DataFrame) -> DataFrame:
    raw = first_non_blank("content", "title")
    found = F.regexp_extract_all(raw, F.lit(r"#([\p{L}\p{N}_]+)"), F.lit(1))
    one = lambda c: F.when(non_blank(c).isNotNull(), F.array(c))
    return _article(
        "tiktok", df, X.replace(raw, CREDIT, ""), X.headline(X.replace("title", CREDIT, ""), 200),
        D.parse_timestamp(F.coalesce(_m("timestamp").cast("string"), F.col("created_at").cast("decimal(20,3)").cast("string"))),
        views_count=_count(_m("views"), N.view_count(_m("views_text"))), post_type=F.lit("video"),
        tags=F.coalesce(_list(_m("hashtags")), _list(found)), images=one(_m("thumbnail_url")), videos=one(_m("url_video")),
        **_user("tiktok.com"))


def threads(df: DataFrame) -> DataFrame:
    content = X.replace(first_non_blank("content", "title"), r"(?U)\s+Translate\s*$", "")
    published = F.coalesce(
        D.parse_timestamp(_m("datetime"), formats=[]), D.parse_timestamp(_m("time"), formats=["MM/dd/yy"]),
        D.parse_timestamp(F.coalesce(_m("timestamp").cast("string"), F.col("created_at").cast("decimal(20,3)").cast("string"))))
    return _article(
        "threads", df, content, X.headline(content), published,
        likes_count=_count(_m("likes")), comments_count=_count(_m("replies")),
        shares_count=F.coalesce(_m("shares"), F.lit(0)) + F.coalesce(_m("reposts"), F.lit(0)),
        post_type=F.lit("thread"), **_user("threads.net"))


def newspaper(df: DataFrame) -> DataFrame:
    """The publication date only: crawl times never stand in for it."""
    content = first_non_blank("content", _m("body"), _m("text"), _m("description"))
    title = first_non_blank("title", _m("headline"), _m("title"))
    published = F.coalesce(
        F.timestamp_seconds(F.nullif(_m("time_int"), F.lit(0).cast("bigint"))),
        *[D.parse_timestamp(_m(f), prefer="dd/MM/yyyy") for f in ("publish_date", "published_date", "publication_date")],
        D.parse_timestamp(F.coalesce(_m("published_at"), F.col("published_at")), prefer="dd-MM-yyyy HH:mm:ss"),
        D.parse_timestamp(_m("date")), D.parse_timestamp(_m("timestamp")))
    tags = F.filter(F.transform(F.split(_m("tags"), ","), lambda t: F.trim(t)), lambda t: F.length(t) > 0)
    one = lambda c: F.when(non_blank(c).isNotNull(), F.array(c))
    return _article(
        "newspaper", df, content, title, published,
        likes_count=_count(_m("likes")), shares_count=_count(_m("shares")),
        comments_count=_count(_m("comments"), _m("comments_count")), views_count=_count(_m("views"), _m("view_count")),
        account_name=_m("author"), post_type=F.lit("article"),
        category=first_non_blank(_m("type_newspaper"), _m("category"), _m("section")),
        summary=first_non_blank(_m("description"), _m("summary"), _m("excerpt")), tags=_list(tags),
        images=F.coalesce(_list(_m("images")), one(_m("image")), one(_m("thumbnail"))),
        source_name=F.coalesce(first_non_blank(_m("source"), _m("newspaper_name"), _m("site_name"), _m("publisher")),
                               U.domain_of_url("url")))


SOURCE_MAPPERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "facebook": facebook, "tiktok": tiktok, "threads": threads, "newspaper": newspaper,
}


def map_sources(raw: dict[str, DataFrame]) -> DataFrame:
    """Map every source with its registered mapper and union the results."""
    out = None
    for kind, df in raw.items():
        part = SOURCE_MAPPERS[kind](df)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no source given")
    return out


def curated_posts(df: DataFrame) -> DataFrame:
    """Curated-post rows from raw posts with nested metadata."""
    has = {f.name for f in df.schema["meta_data"].dataType.fields}
    meta = lambda n, t="string": _m(n) if n in has else F.lit(None).cast(t)
    empty = F.array().cast("array<string>")
    return df.select(
        "url", "title", "content", F.coalesce("data_type", F.lit("newspaper")).alias("data_type"),
        meta("type_newspaper").alias("type_newspaper"), F.col("id").alias("original_id"),
        F.col("created_at").alias("original_created_at"), F.col("updated_at").alias("original_updated_at"),
        F.to_json("meta_data").alias("meta_data"), meta("author").alias("author"), meta("date").alias("published_date"),
        meta("dvhc").alias("dvhc"), F.coalesce(meta("statistics", "array<string>"), empty).alias("statistics"),
        F.coalesce(meta("organizations", "array<string>"), empty).alias("organizations"),
        F.lit(1).alias("is_featured"), F.lit(None).cast("double").alias("importance_score"),
        empty.alias("tags"), empty.alias("categories"))


def sync_documents(df: DataFrame) -> DataFrame:
    """Aliased documents of a sync feed: content, url, title (else the first 100 characters), source type."""
    cols = set(df.columns)
    pick = lambda *names: first_non_blank(*[n for n in names if n in cols]) if cols & set(names) else F.lit(None).cast("string")
    content = F.coalesce(pick("content", "body", "text", "description"), F.lit(""))
    url = F.coalesce(pick("url", "link", "source_url"), pick("id"))
    title = F.coalesce(pick("title", "headline"), F.nullif(F.substring(content, 1, 100), F.lit("")), F.lit("Untitled"))
    declared = pick("platform", "social_platform")
    found = U.platform_of_url(url)
    kind = F.when(found.isin("facebook", "youtube", "tiktok"), found).when(declared.isin("facebook", "youtube", "tiktok"), declared)
    return df.select(F.coalesce(kind, pick("source_type"), F.lit("web")).alias("source"), url.alias("source_id"),
                     title.alias("title"), content.alias("content"))
