"""Example queries of scans, loads, exports and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.ranking import first_per_key
from ..session import shared_folder
from ..sources import files as S, html as H, mappers as M, merge as L
from ..sources.store import KeyedTable
from .registry import Registry, table

REGISTRY = Registry()
add = REGISTRY.add


@add("a1_envelope_scan", "select doc_id as id, 'https://' || source || '.vn/' || doc_id as url, text as content, 'newspaper' as data_type from documents")
def _(spark, sf):
    """documents written as envelope files of at most 50 records, then scanned back."""
    d = table(spark, sf, "documents").select(
        F.floor(F.col("doc_id") / 50).alias("file"),
        F.struct(F.concat(F.lit("https://"), "source", F.lit(".vn/"), "doc_id").alias("url"), F.col("doc_id").alias("id"),
                 F.col("text").alias("content")).alias("record"))
    folder = S.shared_folder(spark, "envelopes")
    files = d.groupBy("file").agg(F.collect_list("record").alias("records"))
    files.select(F.lit("newspaper").alias("envelope_type"), "records").write.json(folder)
    record = M.raw_schema("newspaper")
    return S.read_envelopes(spark, folder, record, lines=True).select("id", "url", "content", F.lit("newspaper").alias("data_type"))


@add("a2_merge_raw_first_wins", """select md5(text) as url, min_by(doc_id, [source, lpad(cast(doc_id as varchar), 12, '0')]) as doc_id
  from documents group by 1""")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.md5("text").alias("url"), "source", "doc_id")
    return S.merge_first_wins(d, "url", ["source", F.lpad(F.col("doc_id").cast("string"), 12, "0")]).select("url", "doc_id")


@add("a2_merge_report", """with f as (select md5(text) as url, min_by(source, [source, lpad(cast(doc_id as varchar), 12, '0')]) as source from documents group by 1),
  k as (select source, count(*) as kept from f group by 1), t as (select source, count(*) as total from documents group by 1)
  select source, total, coalesce(kept, 0) as kept, total - coalesce(kept, 0) as duplicates from t left join k using (source)""")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.md5("text").alias("url"), "source", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("pos"))
    return S.merge_report(d, "url", ["source", "pos"], "source")


@add("a3_latest_snapshot", """select event_id, user_id, cast(ts as date) as snapshot from events
  qualify cast(ts as date) = max(cast(ts as date)) over (partition by user_id)""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.to_date("ts").alias("snapshot"))
    return S.latest_snapshot(e, "user_id", "snapshot")


@add("a4_safe_casts", """select event_id, case when event_type = 'error' then null else value end as amount,
  case when event_type = 'error' then null else cast(json_extract(props, '$.k') as int) end as k,
  case when event_type = 'view' then null else cast(ts as date) end as day from events""")
def _(spark, sf):
    e = table(spark, sf, "events")
    raw = e.select(
        "event_id", F.when(F.col("event_type") == "error", F.lit("  ")).otherwise(F.col("value").cast("string")).alias("amount"),
        F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.get_json_object("props", "$.k")).alias("k"),
        F.when(F.col("event_type") == "view", F.lit("")).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("day"))
    return S.safe_casts(raw, {"amount": "double", "k": "int", "day": "date"})


@add("a6_write_processed", "select source as source_type, count(*) as n from documents where length(text) >= 100 group by 1")
def _(spark, sf):
    d = table(spark, sf, "documents").withColumn("source_type", F.col("source"))
    folder = S.shared_folder(spark, "processed")
    S.write_processed(d, folder, valid=F.length("text") >= 100)
    return spark.read.parquet(folder).groupBy("source_type").agg(F.count(F.lit(1)).alias("n"))


_LOAD_SQL = """with o as (select md5(text) as url, min(doc_id) as id, min_by(source, doc_id) as source, min_by(lang, doc_id) as lang
    from documents where doc_id % 2 = 0 group by 1),
  n as (select md5(text) as url, min(doc_id) as id, min_by(case when doc_id % 3 = 0 then null else source end, doc_id) as source0,
    arg_min_null(case when doc_id % 3 = 0 then null else source end, doc_id) as source, min_by(lang, doc_id) as lang
    from documents where doc_id % 2 = 1 group by 1) """


@add("a7_keyed_load_update", _LOAD_SQL + """select coalesce(o.url, n.url) as url, coalesce(n.id, o.id) as id, coalesce(n.source, o.source) as source,
  coalesce(n.lang, o.lang) as lang, case when o.url is not null and n.url is not null then 'updated' when o.url is null then 'inserted' else 'kept' end as action
  from o full join n on o.url = n.url""")
def _(spark, sf):
    old, new = _halves(spark, sf)
    return L.keyed_load(old, new, ["url"], "update")


@add("a7_keyed_load_skip", _LOAD_SQL + """select coalesce(o.url, n.url) as url, coalesce(o.id, n.id) as id,
  case when o.url is not null then o.source else n.source end as source, coalesce(o.lang, n.lang) as lang,
  case when o.url is not null and n.url is not null then 'skipped' when o.url is null then 'inserted' else 'kept' end as action
  from o full join n on o.url = n.url""")
def _(spark, sf):
    old, new = _halves(spark, sf)
    return L.keyed_load(old, new, ["url"], "skip")


@add("a7_bucketed_load", _LOAD_SQL + """select coalesce(o.url, n.url) as url, coalesce(n.id, o.id) as id, coalesce(n.source, o.source) as source, coalesce(n.lang, o.lang) as lang
  from o full join n on o.url = n.url""")
def _(spark, sf):
    old, new = _halves(spark, sf)
    stored = KeyedTable(shared_folder(spark, "keyed"), ("url",), 16)
    stored.create(old)
    stored.load(new)
    return stored.read(spark)


def _halves(spark, sf):
    d = table(spark, sf, "documents").select(F.md5("text").alias("url"), F.col("doc_id").alias("id"), "source", "lang")
    old = d.filter(F.col("id") % 2 == 0)
    new = d.filter(F.col("id") % 2 == 1).withColumn("source", F.when(F.col("id") % 3 != 0, F.col("source")))
    return first_per_key(old, ["url"], ["id"]), first_per_key(new, ["url"], ["id"])


@add("a8_export_newest", "select doc_id, source, n_chars from documents where text is not null order by n_chars desc, doc_id limit 100")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return S.export_newest(d, ["text"], "n_chars", "doc_id", 100).select("doc_id", "source", "n_chars")


@add("a9_page_main_text")
def _(spark, sf):
    return H.extract_main_text(table(spark, sf, "pages"), "page_id", "html")


@add("a10_listing", """select o_orderkey, o_totalprice, count(*) over () as total, cast(ceil(count(*) over () / 20.0) as bigint) as total_pages
  from orders where o_orderstatus = 'F' order by o_orderdate desc, o_orderkey limit 20 offset 40""")
def _(spark, sf):
    o = table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F")
    return S.listing(o, [F.desc("o_orderdate"), F.col("o_orderkey")], page=3, size=20).select(
        "o_orderkey", "o_totalprice", "total", "total_pages")


@add("a11_bulk_import", """with i as (select md5(text) as url, doc_id from documents where doc_id % 2 = 1),
  v as (select * from i where doc_id % 5 <> 0), o as (select distinct md5(text) as url from documents where doc_id % 2 = 0),
  c as (select count(distinct url) as n from v where url not in (select url from o))
  select (select count(*) from i) as total, c.n as created, (select count(*) from v) - c.n as skipped,
    (select count(*) from i where doc_id % 5 = 0) as errors from c""")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.md5("text").alias("url"), "doc_id")
    incoming = d.filter(F.col("doc_id") % 2 == 1).withColumn("url", F.when(F.col("doc_id") % 5 != 0, F.col("url")))
    return L.import_report(d.filter(F.col("doc_id") % 2 == 0), incoming, ["url"], ["doc_id"], required=["url"])
