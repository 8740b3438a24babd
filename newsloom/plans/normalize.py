"""Example queries of normalisation, source mapping and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D, urls as U
from ..operators import normalize as N
from ..sources import mappers as M
from . import fixtures as X, sqlparts as S
from .registry import Registry, table

REGISTRY = Registry()
add = REGISTRY.add


def _raw_documents(spark, sf):
    """documents in the shape of a mixed feed: contents and urls under several names."""
    d = table(spark, sf, "documents")
    on = lambda r, c: F.when(F.col("doc_id") % 4 == r, F.col(c))
    return d.select(
        "doc_id", on(0, "text").alias("cleaned_content"), on(1, "text").alias("content"), F.lit(" ").alias("text"), on(2, "text").alias("body"),
        F.when(F.col("doc_id") % 11 == 0, F.lit("")).otherwise(F.concat(F.col("source"), F.lit(".vn/a/"), F.col("doc_id"))).alias("url"),
        F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("headline"), F.col("lang").alias("section"),
        F.date_format(X.published(), "dd/MM/yyyy").alias("publish_date"),
        F.when(F.col("doc_id") % 13 == 0, F.lit(-1)).otherwise(F.col("n_chars")).cast("string").alias("view_count"),
        F.col("source").alias("author"))


_NORMALIZED = f"""select doc_id, case when doc_id % 11 = 0 then null else 'https://' || source || '.vn/a/' || doc_id end as url,
  case when doc_id % 11 = 0 then null else source || '.vn' end as domain, case when doc_id % 4 = 3 then null else {S.squeeze('text')} end as content,
  case when doc_id % 5 <> 0 then lang else 'Untitled' end as title, cast(timestamp '2024-01-01' + to_days(cast(doc_id % 30 as int)) as date) as published,
  lang as category, source as author, case when doc_id % 13 = 0 then -1 else n_chars end as views from documents"""


@add("b1_normalize_documents", _NORMALIZED)
def _(spark, sf):
    return N.normalize_documents(_raw_documents(spark, sf), keep=["doc_id"]).select(
        "doc_id", "url", "domain", "content", "title", F.to_date("published_at").alias("published"), "category", "author", "views")


@add("b2_sync_documents", """select case when page_id % 3 = 0 then 'facebook' else 'web' end as source,
  case when page_id % 3 = 0 then 'https://facebook.com/' || page_id else url end as source_id,
  case when page_id % 2 = 0 then 'page ' || page_id else substring(html, 1, 100) end as title, html as content from pages""")
def _(spark, sf):
    p = table(spark, sf, "pages")
    feed = p.select(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://facebook.com/"), "page_id")).alias("url"), F.col("url").alias("link"),
                    F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("page "), "page_id")).alias("headline"), F.col("html").alias("body"))
    return M.sync_documents(feed)


@add("b3_parse_timestamps", "select event_id, strftime(date_trunc('second', ts), '%Y-%m-%d') as day, "
     "case event_id % 8 when 0 then epoch_us(ts) // 1000000 when 1 then epoch_us(ts) // 1000000 when 2 then epoch_us(ts) // 1000000 "
     "when 3 then epoch_us(ts) // 1000000 when 7 then null else epoch_us(date_trunc('day', ts)) // 1000000 end as seconds "
     "from (select *, ts from events) where event_id % 8 <> 7 union all "
     "select event_id, null, null from events where event_id % 8 = 7")
def _(spark, sf):
    ts = F.col("ts")
    shapes = [(F.floor(F.unix_micros(ts.cast("timestamp")) / 1000) / 1000).cast("decimal(20,3)").cast("string"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
              F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.date_format(ts, "dd-MM-yyyy HH:mm:ss"), F.date_format(ts, "dd/MM/yyyy"),
              F.date_format(ts, "yyyy/MM/dd"), F.date_format(ts, "MM/dd/yy"), F.lit("hôm qua")]
    raw = F.get(F.array(*shapes), (F.col("event_id") % 8).cast("int"))
    e = table(spark, sf, "events").select("event_id", D.parse_timestamp(raw).alias("p"))
    return e.select("event_id", F.date_format("p", "yyyy-MM-dd").alias("day"), F.floor(F.unix_micros("p") / 1000000).cast("bigint").alias("seconds"))


_HOST = r"lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"
TOY_HOSTS = {"example.com": "facebook", "example.net": "tiktok", "fedex.com": "fedex"}


@add("b4_platform_of_url", f"""select page_id, case when h = 'example.com' or h like '%.example.com' then 'facebook'
  when h = 'example.net' or h like '%.example.net' then 'tiktok' end as platform from (select page_id, {_HOST} as h from pages)""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.platform_of_url("url", TOY_HOSTS).alias("platform"))


@add("b4_platform_of_source", "select doc_id, case doc_id % 4 when 0 then 'facebook' when 1 then 'youtube' when 2 then 'twitter' else 'web' end as platform from documents")
def _(spark, sf):
    d = table(spark, sf, "documents")
    source = F.get(F.array(F.lit("FB"), F.lit(None).cast("string"), F.lit("external"), F.col("source")), (F.col("doc_id") % 4).cast("int"))
    url = F.get(F.array(F.lit("https://fedex.com/"), F.lit("https://m.youtube.com/watch?v=1"), F.lit("https://x.com/a"), F.lit("https://fedex.com/x")),
                (F.col("doc_id") % 4).cast("int"))
    return d.select("doc_id", U.platform(source, url).alias("platform"))


@add("b5_domain", f"""select page_id, case page_id % 4 when 0 then regexp_replace({_HOST}, '^www\\.', '') when 1 then 'tuoitre.vn'
  when 2 then 'threads.net' else null end as domain from pages""")
def _(spark, sf):
    p = table(spark, sf, "pages")
    pick = lambda *values: F.get(F.array(*[F.lit(v).cast("string") if not hasattr(v, "alias") else v for v in values]), (F.col("page_id") % 4).cast("int"))
    return p.select("page_id", U.domain(pick(F.col("url"), "/local/path", None, "https:///x"), pick(None, "Báo Tuổi Trẻ", None, "unknown"),
                                        pick(None, None, "threads", "zalo"), pick(None, None, None, "me")).alias("domain"))


@add("b6_engagement", """select event_id, case when event_id % 2 = 0 then cast(floor(value) as bigint) else 7 end as likes, null::bigint as shares,
  cast(json_extract(props, '$.k') as bigint) as comments, user_id as views from events""")
def _(spark, sf):
    e = table(spark, sf, "events")
    raw = e.select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("value").cast("string")).otherwise(F.lit("n/a")).alias("likes"),
                   F.lit("7").alias("reaction_count"), F.get_json_object("props", "$.k").alias("reply_count"), F.col("user_id").alias("play_count"))
    return raw.select("event_id", *[c.alias(n) for n, c in N.engagement(raw).items()])


@add("b7_account_name", r"""select page_id, nullif(regexp_extract(replace(url, 'example', 'tiktok'), 'tiktok\.(?:com|net)/([^/?]+)', 1), '') as account,
  case when page_id % 3 = 0 then 'page' when page_id > 100 then 'page' end as account_type from pages""")
def _(spark, sf):
    p = table(spark, sf, "pages").withColumn("u", F.replace(F.col("url"), F.lit("example"), F.lit("tiktok")))
    return p.select(
        "page_id", U.account_name("u", F.lit("tiktok"), {"tiktok": r"tiktok\.(?:com|net)/([^/?]+)"}).alias("account"),
        U.account_type(F.when(F.col("page_id") % 3 == 0, F.lit("FanPage")), F.col("page_id") * 10, F.lit("facebook")).alias("account_type"))


@add("b8_platform_rules", """select event_id, case user_id % 4 when 0 then 'video' when 1 then 'tweet' when 2 then 'photo' else 'status' end as post_type from events""")
def _(spark, sf):
    e = table(spark, sf, "events")
    platform = F.get(F.array(F.lit("tiktok"), F.lit("twitter"), F.lit("facebook"), F.lit("facebook")), (F.col("user_id") % 4).cast("int"))
    return e.select("event_id", N.post_type(platform, F.lit(None).cast("string"), F.col("user_id") % 4 == 2, F.lit(False)).alias("post_type"))


@add("b9_province", """select n_nationkey, case when n_nationkey = 3 then 'Hà Nội' else 'Nation ' || n_nationkey end as province from nation""")
def _(spark, sf):
    n = table(spark, sf, "nation")
    return n.select("n_nationkey", U.province(F.replace(F.col("n_name"), F.lit("_"), F.lit(" ")), {"nation 3": "Hà Nội"}).alias("province"))


@add("b10_split_tags", "select p_partkey, replace(trim(p_name), ' ', '|') || '|tag' as tags from part")
def _(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.array_join(U.split_tags(F.concat(F.lit(" ,"), "p_name", F.lit(", tag  "))), "|").alias("tags"))


def _raw(spark, sf, kind, host, content, meta):
    schema = M.raw_schema(kind)
    wanted = {f.name: f.dataType for f in schema["meta_data"].dataType.fields}
    d = table(spark, sf, "documents")
    nested = F.struct(*[(meta[n].cast(t) if n in meta else F.lit(None).cast(t)).alias(n) for n, t in wanted.items()])
    return d.select(
        F.concat(F.lit(f"https://www.{host}/"), F.col("source"), F.lit("/"), F.col("doc_id")).alias("url"), F.lit(None).cast("string").alias("title"),
        F.col("doc_id").alias("id"), content.alias("content"), F.lit(kind).alias("data_type"), F.lit(1704067200.0).alias("created_at"),
        F.lit(1704067200.0).alias("updated_at"), F.lit(None).cast("string").alias("published_at"), nested.alias("meta_data"))


def _facebook(spark, sf):
    return _raw(spark, sf, "facebook", "facebook.com", F.col("text"), {
        "reactions": F.create_map(F.lit("like"), F.col("doc_id"), F.lit("love"), F.lit(2).cast("bigint")), "reshare_count": F.col("doc_id") % 5,
        "comments_count": F.col("n_chars"), "timestamp": F.lit(1704067200) + F.col("doc_id") * 3600,
        "author": F.struct(F.col("source").alias("id"), F.col("source").alias("name"), F.lit(None).cast("string").alias("url"),
                           F.lit(None).cast("string").alias("profile_picture_url"))})


def _tiktok(spark, sf):
    return _raw(spark, sf, "tiktok", "tiktok.com/@me", F.concat("text", F.lit(" created by someone")), {
        "views_text": F.concat(F.col("doc_id").cast("string"), F.lit(".5K")), "thumbnail_url": F.col("source"), "username": F.col("source")})


def _threads(spark, sf):
    return _raw(spark, sf, "threads", "threads.net/@me", F.concat("text", F.lit(" Translate ")), {
        "likes": F.col("doc_id"), "replies": F.col("n_chars"), "reposts": F.lit(3), "shares": F.col("doc_id") % 7, "time": F.lit("11/28/25")})


def _newspaper(spark, sf):
    return _raw(spark, sf, "newspaper", "baohungyen.vn", F.col("text"), {
        "publish_date": F.when(F.col("doc_id") % 3 == 0, F.date_format(X.published(), "dd/MM/yyyy")),
        "published_at": F.when(F.col("doc_id") % 3 == 1, F.date_format(X.published(), "dd-MM-yyyy HH:mm:ss")), "author": F.col("source"),
        "tags": F.lit("a, b,,c"), "type_newspaper": F.col("lang")})


_KEEP_LONG = f"length({S.strip('text')}) >= 10"
_INGEST_TITLE = """trim(regexp_replace(regexp_replace(regexp_replace({t}, '<[^>]+>', '', 'g'), '""" + S.WS + """+', ' ', 'g'),
  '[^\\p{{L}}\\p{{N}}_ .,!?;:\\-''"()@#]', '', 'g'))"""


def _ingest(text):
    return _INGEST_TITLE.replace("{{", "{").replace("}}", "}").replace("{t}", text)


@add("b11_union_of_sources", f"""select t.source_type, count(*) as n, min(id) as low from documents d,
  (values ('facebook'), ('tiktok'), ('threads'), ('newspaper')) t(source_type), lateral (select cast(doc_id as varchar) as id)
  where {_KEEP_LONG} or (t.source_type in ('tiktok_') ) group by 1""")
def _(spark, sf):
    raw = {"facebook": _facebook(spark, sf), "tiktok": _tiktok(spark, sf), "threads": _threads(spark, sf), "newspaper": _newspaper(spark, sf)}
    return M.map_sources(raw).groupBy("source_type").agg(F.count(F.lit(1)).alias("n"), F.min("post_id").alias("low"))


@add("b11a_facebook", f"""select doc_id as id, nullif({_ingest(S.title())}, '') as title, doc_id + 2 as likes, doc_id % 5 as shares, n_chars as comments,
  'facebook.com' as domain, strftime(timestamp '2024-01-01' + to_hours(doc_id), '%Y-%m-%d %H') as published from documents where {_KEEP_LONG}""")
def _(spark, sf):
    return M.facebook(_facebook(spark, sf)).select(
        F.col("post_id").cast("bigint").alias("id"), "title", F.col("likes_count").alias("likes"), F.col("shares_count").alias("shares"),
        F.col("comments_count").alias("comments"), "domain", F.date_format("published_at", "yyyy-MM-dd HH").alias("published"))


@add("b11b_tiktok", f"""select doc_id as id, doc_id * 1000 + 500 as views, source as account_name, {_ingest('text')} as content from documents where {_KEEP_LONG}""")
def _(spark, sf):
    return M.tiktok(_tiktok(spark, sf)).select(
        F.col("post_id").cast("bigint").alias("id"), F.col("views_count").alias("views"), "account_name", "content")


@add("b11c_threads", f"""select doc_id as id, doc_id as likes, doc_id % 7 + 3 as shares, n_chars as comments, 'me' as account_name, '2025-11-28' as published,
  nullif({_ingest(S.title())}, '') as title from documents where {_KEEP_LONG}""")
def _(spark, sf):
    return M.threads(_threads(spark, sf)).select(
        F.col("post_id").cast("bigint").alias("id"), F.col("likes_count").alias("likes"), F.col("shares_count").alias("shares"),
        F.col("comments_count").alias("comments"), "account_name", F.date_format("published_at", "yyyy-MM-dd").alias("published"), "title")


@add("b11d_newspaper", f"""select doc_id as id, case when doc_id % 3 < 2 then strftime(timestamp '2024-01-01' + to_days(cast(doc_id % 30 as int)), '%Y-%m-%d') end as published,
  lang as category, 'a|b|c' as tags, source as account_name from documents where {_KEEP_LONG}""")
def _(spark, sf):
    return M.newspaper(_newspaper(spark, sf)).select(
        F.col("post_id").cast("bigint").alias("id"), F.date_format("published_at", "yyyy-MM-dd").alias("published"), "category",
        F.array_join("tags", "|").alias("tags"), "account_name")


_ERRORS = f"""with n as ({_NORMALIZED}), v as (select *, list_filter([case when url is null then 'Missing URL' end,
  case when coalesce(length(content), 0) < 10 then 'Content too short or missing' end, case when views < 0 then 'Negative views count' end],
  lambda e: e is not null) as errors from n)"""


@add("b12_batch_statistics", _ERRORS + """, k as (select category, author || doc_id % 40 as key, count(*) as n, min_by(errors, doc_id) as errors from v group by all)
  select category, cast(sum(n) as bigint) as total, cast(count(*) filter (len(errors) = 0) as bigint) as success,
    cast(sum(n) - count(*) filter (len(errors) = 0) as bigint) as failed,
    array_to_string(list_sort(list_distinct(flatten(list(errors))))[1:3], '|') as error_sample from k group by 1""")
def _(spark, sf):
    v = N.validate(N.normalize_documents(_raw_documents(spark, sf), keep=["doc_id"]))
    keyed = v.withColumn("key", F.concat("author", (F.col("doc_id") % 40).cast("string")))
    out = N.batch_statistics(keyed, "key", ["doc_id"], by="category")
    return out.withColumn("error_sample", F.array_join("error_sample", "|"))


@add("b13_validate", _ERRORS + " select doc_id, array_to_string(errors, '|') as errors, len(errors) = 0 as is_valid from v")
def _(spark, sf):
    v = N.validate(N.normalize_documents(_raw_documents(spark, sf), keep=["doc_id"]))
    return v.select("doc_id", F.array_join("errors", "|").alias("errors"), "is_valid")


@add("b14_engagement_rate", """select o_orderkey, round((o_custkey + o_orderkey + 1) / nullif(case when o_orderkey % 5 = 0 then 0 else o_orderkey % 97 + 1 end, 0), 6) as rate from orders""")
def _(spark, sf):
    views = F.when(F.col("o_orderkey") % 5 == 0, F.lit(0)).otherwise(F.col("o_orderkey") % 97 + 1)
    return table(spark, sf, "orders").select(
        "o_orderkey", F.round(N.engagement_rate(F.col("o_custkey"), F.col("o_orderkey"), F.lit(1), views), 6).alias("rate"))


@add("b15_curated_posts", "select doc_id as original_id, lang as type_newspaper, source as author, '0' as n_statistics, 1 as is_featured, 'newspaper' as data_type from documents")
def _(spark, sf):
    return M.curated_posts(_newspaper(spark, sf)).select(
        "original_id", "type_newspaper", "author", F.size("statistics").cast("string").alias("n_statistics"), "is_featured", "data_type")


@add("b16_article_texts", f"""select doc_id, substring(text, 1, 200) as content_snippet, source,
  md5(case when trim(text) = '' then {S.title()} when {S.title()} is null then text else {S.title()} || chr(10) || text end) as digest from documents""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", F.col("text").alias("content"), X.T.headline("text").alias("title"))
    return N.article_texts(d).select("doc_id", "content_snippet", "source", F.md5("training_text").alias("digest"))
