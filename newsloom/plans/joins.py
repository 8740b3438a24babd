"""Example queries of the joins."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import classify as C, dedup as U, panel as P, ranking as R
from . import fixtures as X
from .classify import TOY_CATEGORIES, _values, toy_categories
from .registry import Registry, table

REGISTRY = Registry()
add = REGISTRY.add


@add("f1_inner_one_to_one", "select doc_id, source, quality, toxic from documents join labels using (doc_id)")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")


@add("f2_three_way_by_day", """select cast(o_orderdate as date) as day, c_mktsegment, count(*) as n from lineitem join orders on l_orderkey = o_orderkey
  join customer on o_custkey = c_custkey where l_quantity > 25 group by all""")
def _(spark, sf):
    l, o, c = table(spark, sf, "lineitem"), table(spark, sf, "orders"), table(spark, sf, "customer")
    j = l.filter("l_quantity > 25").join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    return j.groupBy(F.to_date("o_orderdate").alias("day"), "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@add("f3_left_outer_counts", "select n_nationkey, n_name, count(c_custkey) as n from nation left join customer on n_nationkey = c_nationkey group by all")
def _(spark, sf):
    n, c = table(spark, sf, "nation"), table(spark, sf, "customer")
    counts = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    return n.join(counts, "n_nationkey", "left").select("n_nationkey", "n_name", F.coalesce("n", F.lit(0)).alias("n"))


@add("f4_left_anti", "select doc_id from documents where not exists (select 1 from labels where labels.doc_id = documents.doc_id)")
def _(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id")


@add("f5_left_semi", "select doc_id from documents where doc_id in (select doc_id from labels where quality = 1)")
def _(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels").filter("quality = 1"), "doc_id", "left_semi").select("doc_id")


@add("f6_dictionary_containment", f"""with dict(keyword) as (values {_values([(k,) for ks in TOY_CATEGORIES.values() for k in ks])})
  select doc_id, keyword from documents join dict on contains(lower(text), keyword)""")
def _(spark, sf):
    d = C._keyword_hits(table(spark, sf, "documents"), F.lower("text"), toy_categories(spark), ["category"])
    return d.select("doc_id", F.explode(F.flatten(F.transform("_hits", lambda h: h["found"]))).alias("keyword"))


@add("f7_as_of_previous", f"""with {X.PANEL_SQL}, g as (select province, year, month, case when month % 3 = 0 then null else actual_value end as actual_value from panel)
  select *, last_value(actual_value ignore nulls) over (partition by province order by year, month rows between unbounded preceding and 1 preceding) as previous from g""")
def _(spark, sf):
    p = X.panel(spark, sf).withColumn("actual_value", F.when(F.col("month") % 3 != 0, F.col("actual_value")))
    return P.previous_known(p, ["province"], ["year", "month"], "actual_value", "previous")


@add("f8_two_windows", """select user_id, count(*) filter (ts >= '2024-01-15' and ts < '2024-01-22') as current_count, count(*) filter (ts >= '2024-01-08' and ts < '2024-01-15') as previous_count
  from events where ts >= '2024-01-08' and ts < '2024-01-22' group by 1""")
def _(spark, sf):
    a, b, c = datetime(2024, 1, 8), datetime(2024, 1, 15), datetime(2024, 1, 22)
    e = table(spark, sf, "events").filter(D.within("ts", a, c))
    return P.two_windows(e, ["user_id"], D.within("ts", b, c), D.within("ts", a, b))


# Hashes that differ in a few bits of one block, made from the table's own numbers.
_F9_HASH = "(l_partkey % 5) * 1099511627776 + (l_suppkey % 4) * 16777216 + (1 << (l_linenumber % 7)) + (case when l_quantity > 25 then 65536 else 0 end)"


@add("f9_hash_groups", f"""with recursive h as (select distinct cast({_F9_HASH} as bigint) as hash from lineitem), n as (select hash, row_number() over (order by hash) as node from h),
  p as (select a.node as a, b.node as b from n a join n b on a.node < b.node and bit_count(xor(a.hash, b.hash)) < 3),
  o as (select b, list(a) as earlier, row_number() over (order by b) as k from p group by b),
  r(k, gone) as (select 0::bigint, []::bigint[] union all
    select r.k + 1, case when len(list_filter(o.earlier, lambda e: not list_contains(r.gone, e))) > 0 then list_append(r.gone, o.b) else r.gone end from r join o on o.k = r.k + 1)
  select unnest(gone) as node from (select gone from r order by k desc limit 1)""")
def _(spark, sf):
    hashes = table(spark, sf, "lineitem").select(F.expr(_F9_HASH.replace("1 << (l_linenumber % 7)", "shiftleft(1L, l_linenumber % 7)")).cast("bigint").alias("hash")).distinct()
    ranked = R.overall_rank(hashes, [F.col("hash")], "node")
    return U.simhash_drops(ranked).select("node").distinct()


@add("f9_similarity_groups")
def _(spark, sf):
    d = table(spark, sf, "documents")
    hashes = U.first_by_id(d.select(F.col("doc_id").alias("node"), "text"), [U.text_key("text")], "node")
    return U.simhash_drops(hashes.select("node", U.simhash("text").alias("hash")))


@add("f10_zip_by_position", """with e as (select l_orderkey, list(l_quantity order by l_linenumber, l_partkey, l_quantity, l_discount) as q, list(l_discount order by l_linenumber, l_partkey, l_quantity, l_discount) as d from lineitem group by 1)
  select l_orderkey, cast(unnest(range(1, len(q) + 1)) as int) as pos, unnest(q) as q, unnest(d) as d from e""")
def _(spark, sf):
    lines = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_discount")))
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(lines.alias("s"))
    g = g.select("l_orderkey", F.col("s.l_quantity").alias("q"), F.col("s.l_discount").alias("d"))
    return g.select("l_orderkey", F.posexplode(F.arrays_zip("q", "d")).alias("pos", "z")).select("l_orderkey", (F.col("pos") + 1).alias("pos"), "z.q", "z.d")


# --- Set operations ------------------------------------------------------------------------------------------------

@add("j1_union_by_name", "select doc_id, source, null as lang from documents where doc_id % 2 = 0 union all select doc_id, source, lang from documents where doc_id % 2 = 1")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return d.filter("doc_id % 2 = 0").select("doc_id", "source").unionByName(d.filter("doc_id % 2 = 1").select("lang", "source", "doc_id"), allowMissingColumns=True)


@add("j2_difference", "select doc_id, target from documents cross join (values ('a'), ('b')) t(target) except select doc_id, case when quality = 1 then 'a' else 'b' end from labels")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("target"))
    done = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, F.lit("a")).otherwise(F.lit("b")).alias("target"))
    return d.join(done, ["doc_id", "target"], "left_anti")


@add("j3_key_union_with_zero", """with a as (select user_id as k, count(*) as n from events where ts < '2024-01-16' group by 1), b as (select user_id as k, count(*) as n from events where ts >= '2024-01-16' group by 1)
  select coalesce(a.k, b.k) as k, coalesce(a.n, 0) as left_n, coalesce(b.n, 0) as right_n from a full join b on a.k = b.k""")
def _(spark, sf):
    e = table(spark, sf, "events")
    count = lambda rows, name: rows.groupBy(F.col("user_id").alias("k")).agg(F.count(F.lit(1)).alias(name))
    a = count(e.filter(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")), "left_n")
    b = count(e.filter(F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")), "right_n")
    return a.join(b, "k", "full_outer").select("k", F.coalesce("left_n", F.lit(0)).alias("left_n"), F.coalesce("right_n", F.lit(0)).alias("right_n"))


@add("j4_seen_at_least_twice", r"""with w as (select unnest(regexp_extract_all(text, '\p{Lu}\p{L}+')) as entity from documents)
  select lower(entity) as entity, count(*) as n from w group by 1 having count(*) >= 2""")
def _(spark, sf):
    found = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{Lu}\p{L}+"), F.lit(0))).alias("entity"))
    return found.groupBy(F.lower("entity").alias("entity")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
