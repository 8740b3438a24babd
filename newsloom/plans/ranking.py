"""Example queries of ranks, shares, running budgets and top-k."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import dates as D, text as T
from ..operators import panel as P, ranking as R, search as Q
from . import fixtures as X, sqlparts as S
from .marts import flat_list
from .registry import Registry, table

REGISTRY = Registry()
add = REGISTRY.add

_DAYS = f"with {S.MENTIONS}, c as (select cast(published_at as date) as day, topic_id, count(*) as n, count(*) filter (sentiment_group = 'negative') as neg from mentions group by all)"


def _days(spark, sf):
    m = X.mentions(spark, sf)
    return m.groupBy(D.day("published_at").alias("day"), "topic_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("sentiment_group") == "negative").alias("neg"))


@add("h1_rank_in_period", _DAYS + " select day, topic_id, n, row_number() over (partition by day order by n desc, topic_id) as rank from c qualify rank <= 5")
def _(spark, sf):
    return R.top_k_per_group(_days(spark, sf).select("day", "topic_id", "n"), ["day"], [F.desc("n"), F.col("topic_id")], 5)


@add("h2_overall_rank", """with t as (select c_custkey % 700 as k, count(*) as n from customer group by 1), r as (select *, row_number() over (order by n desc, k) as rank from t)
  select c_custkey, rank from customer join r on c_custkey % 700 = k""")
def _(spark, sf):
    c = table(spark, sf, "customer").withColumn("k", F.col("c_custkey") % 700)
    totals = c.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    ranked = R.overall_rank(totals, [F.desc("n"), F.col("k")])
    return c.join(ranked, "k").select("c_custkey", "rank")


@add("h3_rank_in_platform", "select user_id, event_type, count(*) as n, row_number() over (partition by event_type order by count(*) desc, user_id) as rank from events group by user_id, event_type")
def _(spark, sf):
    counts = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return R.overall_rank(counts, [F.desc("n"), F.col("user_id")], group=["event_type"])


@add("h4_several_ranks", _DAYS + """ select day, topic_id, row_number() over (partition by day order by n desc, topic_id) as by_mention,
  row_number() over (partition by day order by neg desc, topic_id) as by_negative, row_number() over (partition by day order by neg / n desc, topic_id) as by_share from c""")
def _(spark, sf):
    w = lambda *o: F.row_number().over(Window.partitionBy("day").orderBy(*o, "topic_id")).cast("bigint")
    return _days(spark, sf).select("day", "topic_id", w(F.desc("n")).alias("by_mention"), w(F.desc("neg")).alias("by_negative"),
                                   w((F.col("neg") / F.col("n")).desc()).alias("by_share"))


@add("h5_latest_per_key", """with p as (select o_custkey, cast(year(o_orderdate) as int) as year, case when o_orderkey % 4 = 0 then null else cast(quarter(o_orderdate) as int) end as quarter, max(o_orderkey) as k from orders group by all)
  select o_custkey, year, quarter, k from p qualify row_number() over (partition by o_custkey order by year desc, quarter desc nulls first) = 1""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    p = o.groupBy("o_custkey", F.year("o_orderdate").alias("year"), F.when(F.col("o_orderkey") % 4 != 0, F.quarter("o_orderdate")).alias("quarter")).agg(F.max("o_orderkey").alias("k"))
    return P.latest_per_key(p, ["o_custkey"]).select("o_custkey", "year", "quarter", "k")


@add("h6_previous_period_change", f"""with {X.PANEL_SQL}, l as (select *, lag(actual_value) over (partition by province order by year, month) as prev from panel)
  select province, year, month, round((actual_value - prev) / prev * 100, 2) as change_prev_period from l""")
def _(spark, sf):
    return P.fill_changes(X.panel(spark, sf), ["province"], ["year", "month"], year_change=None).select("province", "year", "month", "change_prev_period")


@add("h7_share_of_total", "select c_mktsegment, count(*) as n, round(count(*) / sum(count(*)) over () * 100, 4) as share from customer group by 1")
def _(spark, sf):
    c = table(spark, sf, "customer")
    counts = c.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).withColumn("_t", c.agg(F.count(F.lit(1)).alias("t")).scalar())
    return counts.select("c_mktsegment", "n", F.round(F.col("n") / F.col("_t") * 100, 4).alias("share"))


@add("h8_running_budget", """with t as (select source, doc_id, n_chars, sum(n_chars) over (partition by source order by n_chars % 997 desc, doc_id rows unbounded preceding) as used from documents)
  select source, doc_id, n_chars, cast(used as bigint) as used from t where used <= 6000""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", "n_chars", (F.col("n_chars") % 997).alias("score"))
    return Q.within_budget(d, ["source"], [F.desc("score"), F.col("doc_id")], "n_chars", 6000).select("source", "doc_id", "n_chars", "used")


@add("i1_top_k", "select doc_id, n_chars from documents order by n_chars desc, doc_id limit 25")
def _(spark, sf):
    return R.top_k(table(spark, sf, "documents").select("doc_id", "n_chars"), 25, F.desc("n_chars"), F.col("doc_id"))


@add("i2_nested_top_k", """with c as (select event_type, user_id, count(*) as n from events group by all), r as (select *, row_number() over (partition by event_type order by n desc, user_id) as r from c)
  select event_type, string_agg(user_id || '=' || n, '|' order by r) as top from r where r <= 10 group by 1""")
def _(spark, sf):
    counts = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    top = R.nested_top_k(counts, ["event_type"], [F.desc("n"), F.col("user_id")], ["user_id", "n"], 10, "t")
    return top.select("event_type", flat_list("t", "user_id", "n").alias("top"))


@add("i3_boolean_order", "select doc_id from documents order by contains(text, 'the') desc, lang = 'de' desc, contains(text, 'un') asc, n_chars desc, doc_id limit 50")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return d.orderBy(F.col("text").contains("the").desc(), (F.col("lang") == "de").desc(), F.col("text").contains("un").asc(),
                     F.desc("n_chars"), "doc_id").select("doc_id").limit(50)


@add("i4_greedy_spacing", """with recursive d as (select lang, source, doc_id // 200 as block, n_chars, row_number() over (partition by lang, source, doc_id // 200 order by doc_id) as k from documents),
  r(lang, source, block, k, kept) as (select distinct lang, source, block, 0::bigint, []::bigint[] from d union all
    select r.lang, r.source, r.block, r.k + 1, case when len(r.kept) < 2 and len(list_filter(r.kept, lambda p: abs(p - d.n_chars) < 400)) = 0 then list_append(r.kept, d.n_chars) else r.kept end
    from r join d on d.lang is not distinct from r.lang and d.source is not distinct from r.source and d.block = r.block and d.k = r.k + 1)
  select lang, source, block, array_to_string(last(kept order by k), '|') as kept from r group by all""")
def _(spark, sf):
    # The lengths of a source's documents, in id order, as candidate positions.
    d = table(spark, sf, "documents").groupBy("lang", "source", F.floor(F.col("doc_id") / 200).alias("block")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "n_chars"))), lambda s: s["n_chars"].cast("int")).alias("positions"))
    return d.select("lang", "source", "block", F.array_join(Q.spaced("positions", 400, 2), "|").alias("kept"))


@add("i5_sample_titles", f"""with t as (select source, {S.title()} as title, row_number() over (partition by source order by doc_id) as r from documents where text is not null)
  select source, string_agg(title, '|' order by r) as titles from t where r <= 5 group by 1""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", T.headline("text").alias("title"))
    top = R.nested_top_k(d.filter(F.col("title").isNotNull()), ["source"], [F.col("doc_id")], ["title"], 5, "t")
    return top.select("source", F.array_join(F.transform("t", lambda s: s["title"]), "|").alias("titles"))
