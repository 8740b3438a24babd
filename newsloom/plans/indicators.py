"""Example queries of indicator extraction and period panels.

Report sentences are built from the order table, so the figures they hold are
known and the SQL can state them directly.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators as N, panel as P
from ..session import shared_checkpoint
from . import fixtures as X
from .registry import Registry, table

REGISTRY = Registry()
add = REGISTRY.add

_S = lambda c: F.col(c).cast("string")


def _figures(spark, sf):
    """Orders with a number a.bbb, a decimal digit d and small c."""
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", (F.col("o_custkey") % 900 + 1).alias("a"), (F.col("o_orderkey") % 1000).alias("b"), (F.col("o_orderkey") % 10).alias("d"),
                    (F.col("o_orderkey") % 19 + 1).alias("c"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0").alias("bbb"), "o_orderdate")


_FIG = "f as (select o_orderkey, o_custkey % 900 + 1 as a, o_orderkey % 1000 as b, o_orderkey % 10 as d, o_orderkey % 19 + 1 as c, o_orderdate from orders)"


@add("n1_keyword_contexts")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.regexp_replace(F.regexp_replace("text", r"\bthe\b", "GRDP đạt 5 tỷ"), r"\bun\b", "kim ngạch xuất khẩu").alias("text"))
    return N.keyword_contexts(N.route_by_keyword(d, "text", ["grdp", "export"]), "doc_id", "text")


@add("n2_values", f"""with {_FIG} select o_orderkey, case o_orderkey % 3 when 0 then a * 1000.0 + b when 1 then a * 1000.0 + d * 100 else a * 1000.0 + b + d / 10.0 end as vnd,
  case o_orderkey % 2 when 0 then a + d / 10.0 else (a + d / 10.0) * 1000 end as usd, round(case o_orderkey % 2 when 0 then 100 + c + d / 10.0 else 90 + c + d / 10.0 end, 4) as cpi from f""")
def _(spark, sf):
    k = F.col("o_orderkey")
    vnd = (F.when(k % 3 == 0, F.concat(F.lit("đạt "), _S("a"), F.lit("."), F.col("bbb"), F.lit(" tỷ đồng")))
           .when(k % 3 == 1, F.concat(F.lit("ước "), _S("a"), F.lit(","), _S("d"), F.lit(" nghìn tỷ đồng")))
           .otherwise(F.concat(F.lit("Thu "), _S("a"), F.lit("."), F.col("bbb"), F.lit(","), _S("d"), F.lit(" TỶ"))))
    usd = F.concat(_S("a"), F.lit(","), _S("d"), F.when(k % 2 == 0, F.lit(" triệu USD")).otherwise(F.lit(" tỷ USD")))
    cpi = F.when(k % 2 == 0, F.concat(F.lit("CPI bình quân tăng "), _S("c"), F.lit(","), _S("d"), F.lit("%"))).otherwise(
        F.concat(F.lit("Chỉ số giá đạt "), (F.col("c") + 90).cast("string"), F.lit(","), _S("d")))
    return _figures(spark, sf).select("o_orderkey", N.value_vnd(vnd).alias("vnd"), N.value_usd(usd).alias("usd"), F.round(N.value_cpi(cpi), 4).alias("cpi"))


@add("n3_growth", f"""with {_FIG} select o_orderkey, round(case when o_orderkey % 2 = 0 then c + d / 10.0 else -(c + d / 10.0) end, 4) as yoy,
  round(case o_orderkey % 3 when 0 then c + d / 10.0 when 1 then -cast(c as double) end, 4) as qoq, round(case when o_orderkey % 3 = 2 then -(c + d / 10.0) end, 4) as mom from f""")
def _(spark, sf):
    k = F.col("o_orderkey")
    number = F.concat(_S("c"), F.lit(","), _S("d"), F.lit("%"))
    plain = F.concat(F.when(k % 2 == 0, F.lit("TĂNG ")).otherwise(F.lit("giảm ")), number)
    against = (F.when(k % 3 == 0, F.concat(F.lit("tăng "), number, F.lit(" so với quý liền kề")))
               .when(k % 3 == 1, F.concat(F.lit("giảm "), _S("c"), F.lit("% so với quý trước")))
               .otherwise(F.concat(F.lit("giảm "), number, F.lit(" so với tháng trước"))))
    r = lambda c: F.round(c, 4)
    return _figures(spark, sf).select("o_orderkey", r(N.growth(plain)).alias("yoy"), r(N.growth(against, "quarter")).alias("qoq"), r(N.growth(against, "month")).alias("mom"))


@add("n4_forecast", f"with {_FIG} select o_orderkey, case when o_orderkey % 4 < 3 then a * 1000.0 + b end as forecast from f")
def _(spark, sf):
    amount = F.concat(_S("a"), F.lit("."), F.col("bbb"), F.lit(" tỷ đồng"))
    text = F.concat(F.get(F.array(F.lit("Dự kiến thu "), F.lit("mục tiêu năm sau là "), F.lit("chỉ tiêu giao "), F.lit("Kế hoạch đã đạt được ")), (F.col("o_orderkey") % 4).cast("int")), amount)
    return _figures(spark, sf).select("o_orderkey", N.forecast(text).alias("forecast"))


@add("n5_indicator_values", f"""with {_FIG} select o_orderkey, a * 1000.0 + b as retail, null::double as retail_growth, round(a + d / 10.0, 4) as export, round(-(c + d / 10.0), 4) as export_growth,
  round(100 + c + d / 10.0, 4) as cpi, null::double as iip, round(c + d / 10.0, 4) as iip_growth from f""")
def _(spark, sf):
    pct = F.concat(_S("c"), F.lit(","), _S("d"), F.lit("%"))
    retail = F.concat(F.lit("Tổng mức bán lẻ hàng hóa đạt "), _S("a"), F.lit("."), F.col("bbb"), F.lit(" tỷ đồng, tăng "), pct)
    export = F.concat(F.lit("Kim ngạch xuất khẩu ước đạt "), _S("a"), F.lit(","), _S("d"), F.lit(" triệu USD, giảm "), pct)
    cpi, iip = F.concat(F.lit("CPI quý I tăng "), pct), F.concat(F.lit("Chỉ số sản xuất công nghiệp (IIP) tăng "), pct)
    f = _figures(spark, sf).repartition(spark.sparkContext.defaultParallelism)
    f = f.select("o_orderkey", N.extract_indicator(retail, "retail").alias("re"), N.extract_indicator(export, "export").alias("ex"),
                 N.extract_indicator(cpi, "cpi").alias("cp"), N.extract_indicator(iip, "iip").alias("ii"))
    r = lambda c: F.round(c, 4)
    return f.select("o_orderkey", F.col("re.actual_value").alias("retail"), r("re.change_yoy").alias("retail_growth"), r("ex.actual_value").alias("export"),
                    r("ex.change_yoy").alias("export_growth"), r("cp.actual_value").alias("cpi"), F.col("ii.actual_value").alias("iip"), r("ii.change_yoy").alias("iip_growth"))


@add("n6_components", f"""with {_FIG} select o_orderkey, a * 1000.0 + b as tax_revenue, a * 1000.0 + b + 1000 as budget_target, round(c + d / 10.0, 4) as execution_rate,
  'thủy sản, gạo' as top_products, 'Nhật Bản, EU' as top_markets, round(100 - (c + d / 10.0), 4) as cpi_food from f""")
def _(spark, sf):
    pct = F.concat(_S("c"), F.lit(","), _S("d"), F.lit("%"))
    budget = F.concat(F.lit("Thu nội địa đạt "), _S("a"), F.lit("."), F.col("bbb"), F.lit(" tỷ; dự toán là "), (F.col("a") + 1).cast("string"), F.lit("."), F.col("bbb"),
                      F.lit(" tỷ, đạt "), pct, F.lit(" dự toán"))
    f = _figures(spark, sf).select(
        "o_orderkey", N.extract_components(budget, "budget").alias("b"), N.extract_components(F.concat(F.lit("Thủy sản, gạo sang Nhật Bản và EU "), _S("a")), "export").alias("e"),
        N.extract_components(F.concat(F.lit("nhóm lương thực giảm "), pct), "cpi").alias("c"))
    return f.select("o_orderkey", "b.tax_revenue", "b.budget_target", F.round("b.execution_rate", 4).alias("execution_rate"), "e.top_products", "e.top_markets",
                    F.round("c.cpi_food", 4).alias("cpi_food"))


@add("n7_range_errors", """with v as (select l_orderkey, l_linenumber, l_partkey, case l_linenumber % 3 when 0 then 'retail' when 1 then 'cpi' else 'grdp' end as ind, l_extendedprice as v, l_linenumber > 4 as yearly, l_quantity * 3 as yoy from lineitem)
  select l_orderkey, l_linenumber, l_partkey, array_to_string(list_filter([case when not (v between case ind when 'retail' then 2000 when 'cpi' then 95 else 40000 end
    and case ind when 'retail' then case when yearly then 600000 else 150000 end when 'cpi' then 120 else 250000 end) then 'value out of range' end, case when yoy > 100 then 'growth out of range' end], lambda e: e is not null), '|') as errors from v""")
def _(spark, sf):
    l = table(spark, sf, "lineitem")
    ind = F.element_at(F.array(F.lit("retail"), F.lit("cpi"), F.lit("grdp")), F.col("l_linenumber") % 3 + 1)
    e = P.range_errors(ind, F.col("l_extendedprice"), F.col("l_linenumber") > 4, F.col("l_quantity") * 3)
    return l.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(e, "|").alias("errors"))


def _reports(spark, sf):
    f = _figures(spark, sf).repartition(spark.sparkContext.defaultParallelism)
    pct = F.concat(_S("c"), F.lit(","), _S("d"), F.lit("%"))
    text = F.concat(F.lit("Báo cáo quý II năm 2024. Tổng mức bán lẻ hàng hóa đạt "), (F.col("a") % 90 + 10).cast("string"), F.lit("."), F.col("bbb"),
                    F.lit(" tỷ đồng, tăng "), pct, F.lit(". CPI bình quân tăng "), pct, F.lit("."))
    return f.select("o_orderkey", text.alias("text"), F.concat(F.lit("https://tk.vn/"), _S("o_orderkey")).alias("url"), F.lit(2024).alias("year"))


_REPORT_SQL = f"""{_FIG}, e as (select o_orderkey, i.indicator, case when i.indicator = 'retail' then (a % 90 + 10) * 1000.0 + b else 100 + c + d / 10.0 end as v, c + d / 10.0 as yoy
  from f, (values ('retail'), ('cpi')) i(indicator))"""


@add("n8_extract_panel", f"""with {_REPORT_SQL} select o_orderkey, indicator, 'quarter' as period_type, 2 as quarter, round(v, 4) as actual_value, case when indicator = 'cpi' then round(yoy, 4) end as change_yoy, date '2024-06-30' as last_updated, 'ok' as status from e""")
def _(spark, sf):
    p = N.extract_panel(_reports(spark, sf), "o_orderkey", "text", "url", "year", "Hưng Yên", indicators=["retail", "cpi"])
    return p.select("o_orderkey", "indicator", "period_type", "quarter", F.round("actual_value", 4).alias("actual_value"), F.round("change_yoy", 4).alias("change_yoy"), "last_updated", "status")


@add("n8_save_panel")
def _(spark, sf):
    # Both sides of the upsert read it, so it is extracted once.
    p = shared_checkpoint(N.extract_panel(_reports(spark, sf), "o_orderkey", "text", "url", "year", "Hưng Yên", indicators=["retail", "cpi"]))
    known = p.filter("o_orderkey % 2 = 0 and status = 'ok'").drop("errors", "status")
    return N.save_panel(known.drop("o_orderkey"), p, ["o_orderkey"]).groupBy("indicator", "action").agg(F.count(F.lit(1)).alias("n"))


_QUARTERS = """q as (select o_orderpriority as province, cast(year(o_orderdate) as int) as year, case when o_orderkey % 5 = 0 then null else cast(quarter(o_orderdate) as int) end as quarter, o_orderkey % 2 as half,
    count(*) as n, cast(sum(o_custkey) as bigint) as s from orders group by all),
  o as (select province, year, quarter, n as actual_value, case when year % 2 = 0 then s end as other from q where half = 0),
  w as (select province, year, quarter, case when year % 3 = 0 then null else n end as actual_value, s as other from q where half = 1)"""


def _quarters(spark, sf):
    o = table(spark, sf, "orders")
    q = o.groupBy(F.col("o_orderpriority").alias("province"), F.year("o_orderdate").alias("year"), F.when(F.col("o_orderkey") % 5 != 0, F.quarter("o_orderdate")).alias("quarter"),
                  (F.col("o_orderkey") % 2).alias("half")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("s"))
    keys = ["province", "year", "quarter"]
    old = q.filter("half = 0").select(*keys, F.col("n").alias("actual_value"), F.when(F.col("year") % 2 == 0, F.col("s")).alias("other"))
    new = q.filter("half = 1").select(*keys, F.when(F.col("year") % 3 != 0, F.col("n")).alias("actual_value"), F.col("s").alias("other"))
    return old, new, keys


_ON = "o.province = w.province and o.year = w.year and o.quarter is not distinct from w.quarter"
_ACTION = "case when o.province is not null and w.province is not null then 'updated' when o.province is null then 'inserted' else 'kept' end as action"
_KEYS = "coalesce(o.province, w.province) as province, coalesce(o.year, w.year) as year, coalesce(o.quarter, w.quarter) as quarter"


@add("n9_panel_upsert", f"with {_QUARTERS} select {_KEYS}, coalesce(w.actual_value, o.actual_value) as actual_value, coalesce(w.other, o.other) as other, {_ACTION} from o full join w on {_ON}")
def _(spark, sf):
    old, new, keys = _quarters(spark, sf)
    return P.upsert(old, new, keys)


@add("n10_fill_only", f"with {_QUARTERS} select {_KEYS}, coalesce(o.actual_value, w.actual_value) as actual_value, coalesce(o.other, w.other) as other, {_ACTION} from o full join w on {_ON}")
def _(spark, sf):
    old, new, keys = _quarters(spark, sf)
    return P.fill_only(old, new, keys)


@add("n11_social_values", f"""with {_FIG}, v as (select o_orderkey, unnest(['waste_management.waste_collection_rate', 'health_statistics.total_insured', 'egovernment.online_services_count', 'hdi.life_expectancy']) as field,
    unnest([c + d / 10.0, (c + d / 10.0) * 1000000, a, 60 + c]) as value from f) select o_orderkey, field, round(value, 2) as value from v""")
def _(spark, sf):
    number = F.concat(_S("c"), F.lit(","), _S("d"))
    text = F.concat(F.lit("Tỷ lệ thu gom: "), number, F.lit("%. Có "), number, F.lit(" triệu người tham gia BHYT; "), _S("a"), F.lit(" dịch vụ công trực tuyến, tuổi thọ trung bình đạt "),
                    (F.col("c") + 60).cast("string"), F.lit(" tuổi."))
    f = _figures(spark, sf).repartition(spark.sparkContext.defaultParallelism)
    f = f.select("o_orderkey", F.explode(N.social_values(text)).alias("field", "value"))
    return f.select("o_orderkey", "field", F.round("value", 2).alias("value"))


@add("n12_grdp_figures", f"""with {_FIG} select o_orderkey, 3 as quarter, (a % 90 + 10) * 1000.0 + b as actual_value, round(c + d / 10.0, 4) as change_yoy, 'Q1=' || c || '.5|Q2=' || (c + 1) || '.25' as quarters,
  (a % 90 + 20) * 1000.0 + b as grdp_nominal, c || '/11' as ranking_regional, (c + 20) || '/63' as ranking_national from f""")
def _(spark, sf):
    text = F.concat(
        F.lit("Tổng sản phẩm trên địa bàn tỉnh (GRDP) 9 tháng ước đạt "), (F.col("a") % 90 + 10).cast("string"), F.lit("."), F.col("bbb"), F.lit(" tỷ đồng, tăng "), _S("c"), F.lit(","), _S("d"),
        F.lit("% so với cùng kỳ; quý I tăng "), _S("c"), F.lit(",5%; quý II tăng "), (F.col("c") + 1).cast("string"), F.lit(",25%. Theo giá hiện hành "), (F.col("a") % 90 + 20).cast("string"), F.lit("."),
        F.col("bbb"), F.lit(" tỷ đồng, xếp thứ "), _S("c"), F.lit("/11 vùng, xếp thứ "), (F.col("c") + 20).cast("string"), F.lit("/63 cả nước"))
    g = _figures(spark, sf).select("o_orderkey", N.grdp_figures(text, 2025).alias("g"))
    quarters = F.array_join(F.transform(F.array_sort(F.map_entries("g.quarterly_breakdown")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "|")
    return g.select("o_orderkey", "g.quarter", "g.actual_value", F.round("g.change_yoy", 4).alias("change_yoy"), quarters.alias("quarters"), "g.grdp_nominal", "g.ranking_regional", "g.ranking_national")


@add("n13_fill_changes", f"""with {X.PANEL_SQL}, l as (select *, lag(actual_value) over (partition by province order by year, month) as prev,
    lag(actual_value) over (partition by province, month order by year) as last_year, lag(year) over (partition by province, month order by year) as py from panel)
  select province, year, month, round((actual_value - prev) / prev * 100, 2) as change_prev_period, case when py = year - 1 then round((actual_value - last_year) / last_year * 100, 2) end as change_yoy from l""")
def _(spark, sf):
    return P.fill_changes(X.panel(spark, sf), ["province"], ["year", "month"]).select("province", "year", "month", "change_prev_period", "change_yoy")


@add("n14_coverage", """with s as (select distinct cast(ts as date) as day, event_type from events),
  x as (select day, n.name, s2.event_type is not null as have from (select distinct day from s where event_type in ('click', 'error', 'view', 'purchase')) d cross join (values (1, 'error'), (2, 'view'), (3, 'purchase'), (4, 'click'), (5, 'refund')) n(i, name) left join s s2 using (day) where false)
  select day, array_to_string(list_filter(['error', 'view', 'purchase', 'click', 'refund'], lambda n: list_contains(seen, n)), '|') as available,
    array_to_string(list_filter(['error', 'view', 'purchase', 'click', 'refund'], lambda n: not list_contains(seen, n)), '|') as missing, len(seen) / 5.0 as share
  from (select day, list(event_type) as seen from s where event_type in ('error', 'view', 'purchase', 'click') group by 1)""")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.to_date("ts").alias("day"), "event_type")
    c = P.coverage(e, ["day"], "event_type", ["error", "view", "purchase", "click", "refund"])
    return c.select("day", F.array_join("available", "|").alias("available"), F.array_join("missing", "|").alias("missing"), "share")


@add("n15_incomplete", """with p as (select o_orderkey, max(case when l_returnflag = 'A' then l_quantity end) as a, max(case when l_returnflag = 'R' then l_quantity end) as r from orders left join lineitem on o_orderkey = l_orderkey group by 1)
  select o_orderkey, array_to_string(list_filter([case when a is null then 'a' end, case when r is null then 'r' end], lambda x: x is not null), '|') as missing from p where a is null or r is null""")
def _(spark, sf):
    o, l = table(spark, sf, "orders").select("o_orderkey"), table(spark, sf, "lineitem")
    flags = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max(F.when(F.col("l_returnflag") == "A", F.col("l_quantity"))).alias("a"), F.max(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("r"))
    return P.incomplete(o.join(flags, "o_orderkey", "left"), ["a", "r"]).select("o_orderkey", F.array_join("missing", "|").alias("missing"))


@add("n16_panel_page", f"with {X.PANEL_SQL} select province, year, month, actual_value, (select count(*) from panel where province = 'ASIA') as total from panel where province = 'ASIA' order by year desc, month desc limit 12 offset 12")
def _(spark, sf):
    return P.panel_page(X.panel(spark, sf), ["province"], 2, 12, province="ASIA").select("province", "year", "month", "actual_value", "total")


def _sensors(spark, sf):
    e = table(spark, sf, "events")
    cell = lambda v: F.struct(v.cast("string").alias("v"))
    return e.select(
        "event_id", F.col("user_id").alias("province"), F.when(F.col("event_type") == "error", F.lit("-")).otherwise(F.col("value").cast("string")).alias("aqi"),
        F.struct(F.concat(F.lit("st"), "user_id").alias("name")).alias("city"),
        F.create_map(F.lit("pm25"), cell(F.col("value")), F.lit("no2"), cell(F.lit("-"))).alias("iaqi"),
        F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso")).alias("time"))


@add("n17_flatten_sensors", """with s as (select user_id as province, case when event_type = 'error' then null else value end as aqi_score, value as pm25, null::double as no2, cast(quarter(ts) as int) as quarter, cast(ts as date) as day from events)
  select province, day, quarter, count(*) as n, round(sum(aqi_score), 3) as aqi, round(sum(pm25), 3) as pm25, count(no2) as no2,
    sum(case when aqi_score < 50 then 100 when aqi_score < 100 then 70 when aqi_score < 150 then 40 when aqi_score is not null then 20 end) as good from s group by all""")
def _(spark, sf):
    s = N.flatten_sensors(_sensors(spark, sf))
    return s.groupBy("province", F.to_date("measured_at").alias("day"), "quarter").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("aqi_score"), 3).alias("aqi"), F.round(F.sum("pm25"), 3).alias("pm25"), F.count("no2").alias("no2"), F.sum("good_days_pct").alias("good"))


@add("n18_explode_forecasts", """with d as (select o_custkey as province, o_orderkey, cast(o_orderdate as date) as day, o_totalprice as avg from orders where o_orderdate > '1998-01-01')
  select province, day, avg as pm25, case when o_orderkey % 2 = 0 then avg / 2 end as pm10, cast(quarter(day) as int) as quarter from d where province % 7 <> 0""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    cell = lambda v: F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), v.cast("double").alias("avg"))
    daily = F.create_map(F.lit("pm25"), F.array(cell(F.col("o_totalprice"))), F.lit("pm10"),
                         F.when(F.col("o_orderkey") % 2 == 0, F.array(cell(F.col("o_totalprice") / 2))).otherwise(F.array().cast("array<struct<day:string,avg:double>>")),
                         *[x for p in ("no2", "so2", "co", "o3") for x in (F.lit(p), F.array().cast("array<struct<day:string,avg:double>>"))])
    messages = o.select(F.col("o_custkey").alias("province"), F.struct(daily.alias("daily")).alias("forecast"))
    known = o.filter("o_custkey % 7 = 0").select(F.col("o_custkey").alias("province"), F.to_date("o_orderdate").alias("day"))
    return N.explode_forecasts(messages, "1998-01-01", known).select("province", "day", "pm25", "pm10", "quarter")


@add("n19_cadre_figures", f"with {_FIG} select o_orderkey, (a % 90 + 2) * 1000 + b as total_authorized, a * 1000 + b as provincial_level, c * 1000 + b as commune_level, a as contract_workers from f")
def _(spark, sf):
    notes = F.array(F.concat((F.col("a") % 90 + 2).cast("string"), F.lit("."), F.col("bbb"), F.lit(" biên chế")),
                    F.concat(_S("a"), F.lit("."), F.col("bbb"), F.lit(" biên chế cho các sở, ban, ngành")),
                    F.concat(_S("c"), F.lit("."), F.col("bbb"), F.lit(" biên chế cho UBND các xã, phường")), F.concat(_S("a"), F.lit(" lao động hợp đồng")))
    # The commune note also names a committee ("ban"), so the provincial figure is taken from the last note that fits.
    return _figures(spark, sf).select("o_orderkey", N.cadre_figures(notes).alias("c")).select("o_orderkey", "c.*")
