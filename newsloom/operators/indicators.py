"""Numeric indicators from text. Pattern tables are data; matching stays in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates as D, numbers as N, text as X
from ..functions.columns import ColumnLike, col, contained, let, settled, strings
from ..functions.matches import folded, may_match
from ..resources import indicator_patterns as P
from . import panel as Q


def _read(text: ColumnLike, body: Callable[[Column], Column]) -> Column:
    """``body`` of a text that is made once and folded once: struct(text, low)."""
    return let(F.struct(col(text).alias("text"), folded(text).alias("low")), body)


def _group(t: Column, pattern: str, i: int) -> Column:
    """Captured group of the first match; empty when there is no match or the group is empty."""
    return F.regexp_extract(t["text"], pattern, i)


def _found(t: Column, pattern: str, i: int, body: Callable[[Column], Column]) -> Column:
    """``body`` of a group that no match leaves empty; NULL without a match. Texts without the pattern's literals are not searched."""
    return F.when(may_match(t["low"], pattern, fold=True), let(_group(t, pattern, i), lambda g: F.when(g != "", body(g))))


def _joined(t: Column, pattern: str, groups: int, first: Column | None = None) -> Column:
    """Digit groups of a number with thousands separators as one number."""
    rest = [_group(t, pattern, i) for i in range(2, groups + 1)]
    return F.concat(_group(t, pattern, 1) if first is None else first, *rest).try_cast("double")


def _decimal(t: Column, pattern: str, first: Column | None = None) -> Column:
    """Whole and decimal digits in two groups; a missing decimal part is 0."""
    return F.concat(_group(t, pattern, 1) if first is None else first, F.lit("."), _group(t, pattern, 2)).try_cast("double")


# Amounts in billion dong: (pattern, how to read the groups), first match wins (fixed values).
VND = [
    (r"(\d{1,3})[.,](\d{3})\s*tỷ\s*(?:đồng)?", "thousands"),
    (r"đạt\s+(\d{1,3})[.,](\d{3})\s*tỷ", "thousands"),
    (r"(\d+)[.,](\d+)\s*nghìn\s*tỷ", "decimal x 1000"),
    (r"(\d{1,3})[.,](\d{3})\s*tỷ", "thousands"),
    (r"(\d{1,3})[.,](\d{3})[.,](\d+)\s*tỷ", "thousands and decimals"),
]
# Amounts in million dollars (fixed values).
USD = [(r"(\d+)[.,]?(\d*)\s*triệu\s*(?:USD|đô la)", "decimal"), (r"(\d+)[.,](\d+)\s*tỷ\s*USD", "decimal x 1000")]
# Price index (fixed values).
CPI = [(r"(?:CPI|chỉ số giá).*?(?:bình quân)?.*?tăng\s+(\d+)[.,](\d+)\s*%", "decimal + 100"), (r"(?:CPI|chỉ số giá).*?đạt\s+(\d+)[.,](\d+)", "decimal")]


def _first(t: Column, rules: Sequence[tuple[str, str]]) -> Column:
    def value(p: str, how: str, g: Column) -> Column:
        if how == "thousands":
            return _joined(t, p, 2, g)
        if how == "thousands and decimals":
            return F.concat(g, _group(t, p, 2), F.lit("."), _group(t, p, 3)).try_cast("double")
        number = _decimal(t, p, g)
        return {"decimal": number, "decimal x 1000": number * 1000, "decimal + 100": number + 100}[how]

    return F.coalesce(*[_found(t, p, 1, lambda g, p=p, how=how: value(p, how, g)) for p, how in ((P.full(pattern), how) for pattern, how in rules)])


def value_vnd(text: ColumnLike) -> Column:
    return _read(text, lambda t: _first(t, VND))


def value_usd(text: ColumnLike) -> Column:
    return _read(text, lambda t: _first(t, USD))


def value_cpi(text: ColumnLike) -> Column:
    return _read(text, lambda t: _first(t, CPI))


def growth(text: ColumnLike, against: str | None = None) -> Column:
    """Signed percentage: with ``against`` (quarter, month) the change to the period before, else the plain one."""
    return _read(text, lambda t: _growth(t, against))


def _growth(t: Column, against: str | None = None) -> Column:
    if against:
        unit = {"quarter": "quý", "month": "tháng"}[against]
        tails = [(rf"\s*so với {unit} trước", True), (rf"\s*so với {unit} liền kề", False)]
    else:
        tails = [("", True)]
    values = []
    decimal = lambda p: _found(t, p, 1, lambda g: _decimal(t, p, g))
    for tail, whole in tails:
        for word, sign in (("tăng", 1), ("giảm", -1)):
            values.append(decimal(P.full(rf"{word}\s+(\d+)[.,](\d+)\s*%{tail}")) * sign)
            if whole:
                values.append(_found(t, P.full(rf"{word}\s+(\d+)\s*%{tail}"), 1, lambda g: g.try_cast("double")) * sign)
    if not against:
        values.append(decimal(P.full(r"tăng\s*trưởng.*?(\d+)[.,](\d+)\s*%")))
    return F.coalesce(*values)


# Announced amounts (fixed values).
FORECASTS = [
    r"(?:dự báo|dự kiến|kế hoạch)(?!.*(?:đạt|thực hiện)).*?{vnd}",
    r"mục tiêu.*?{vnd}",
    r"chỉ tiêu.*?{vnd}",
    r"năm (?:sau|\d{4}).*?(?:dự báo|dự kiến|kế hoạch).*?{vnd}",
]
REALISED = r"(?iU)(?:ước đạt|thực hiện|đã đạt|đạt được)"


def forecast(text: ColumnLike) -> Column:
    """Announced amount; matches that speak of a realised one do not count."""
    return _read(text, _forecast)


def _forecast(t: Column) -> Column:
    patterns = [P.full(p) for p in FORECASTS]
    return F.coalesce(*[_found(t, p, 0, lambda hit, p=p: F.when(~hit.rlike(REALISED), _joined(t, p, 3))) for p in patterns])


def _matched(t: Column, pattern: str, kind: str, veto: Sequence[str]) -> dict[str, Column]:
    """Values of one pattern by result field; NULL where it does not match or is vetoed."""
    p = P.full(pattern)
    forbidden = "|".join(re.escape(w) for w in veto)

    def accepted(read: Callable[[Column], Column]) -> Column:
        """The match is taken once; it is read only when no veto word is in it."""
        def body(hit: Column) -> Column:
            return F.when(~hit.rlike(forbidden), read(hit)) if forbidden else read(hit)
        return _found(t, p, 0, lambda found: let(F.lower(found), body))

    if kind == "value_split":
        return {"actual_value": accepted(lambda _: _joined(t, p, 2 if "{vnds}" in pattern else 3))}
    if kind == "value_usd":
        return {"actual_value": accepted(lambda _: N.decimal_comma(_group(t, p, 1)))}
    if kind == "growth":
        return {"change_yoy": accepted(lambda hit: N.decimal_comma(_group(t, p, 1)) * F.when(hit.contains("giảm"), F.lit(-1.0)).otherwise(F.lit(1.0)))}
    if kind == "cpi_growth":
        return {"actual_value": accepted(lambda _: _decimal(t, p) + 100), "change_yoy": accepted(lambda _: _decimal(t, p))}
    return {"actual_value": accepted(lambda _: _decimal(t, p))}


def extract_indicator(text: ColumnLike, indicator: str) -> Column:
    """struct of values of one indicator: the last matching pattern counts, generic patterns fill in."""
    return _read(text, lambda t: _extracted(t, indicator))


def _extracted(t: Column, indicator: str) -> Column:
    found: dict[str, list[Column]] = {"actual_value": [], "change_yoy": []}
    for pattern, kind in P.INDICATORS[indicator]:
        for field, value in _matched(t, pattern, kind, P.VETO_WORDS.get(indicator, ())).items():
            found[field].append(value)
    last = lambda vs: F.coalesce(*reversed(vs), F.lit(None).cast("double"))
    qoq, mom = _growth(t, "quarter"), _growth(t, "month")
    ahead = F.lit(None).cast("double") if indicator in P.GROWTH_ONLY else _forecast(t)
    if indicator == "cpi":
        generic = _first(t, CPI)
    elif indicator in ("export", "investment"):
        generic = _first(t, USD)
    elif indicator in P.GROWTH_ONLY:
        generic = None
    else:
        generic = _first(t, VND)

    def filled(v: Column) -> Column:
        # Zero counts as "nothing found", as it does for the values themselves.
        empty = (F.coalesce(v["value"], F.lit(0.0)) == 0) & (F.coalesce(v["yoy"], F.lit(0.0)) == 0)
        return F.struct(
            (v["value"] if generic is None else F.when(empty, generic).otherwise(v["value"])).alias("actual_value"),
            F.when(empty, _growth(t)).otherwise(v["yoy"]).alias("change_yoy"), v["qoq"].alias("change_qoq"), v["mom"].alias("change_mom"),
            F.coalesce(v["mom"], v["qoq"]).alias("change_prev_period"), v["ahead"].alias("forecast_value"))

    return let(F.struct(last(found["actual_value"]).alias("value"), last(found["change_yoy"]).alias("yoy"), qoq.alias("qoq"), mom.alias("mom"),
                        ahead.alias("ahead")), filled)


def extract_components(text: ColumnLike, indicator: str) -> Column:
    """struct of the component figures of an indicator."""
    return _read(text, lambda t: _components(t, indicator))


def _components(t: Column, indicator: str) -> Column:
    fields = []
    for name, kind, patterns in P.COMPONENTS.get(indicator, []):
        values = []
        for pattern in patterns:
            p = P.full(pattern)
            if kind == "value_split":
                values.append(_found(t, p, 1, lambda g, p=p: _joined(t, p, 3, g)))
            elif kind == "index":
                down = lambda p: F.when(F.lower(_group(t, p, 0)).contains("giảm"), F.lit(-1.0)).otherwise(F.lit(1.0))
                values.append(_found(t, p, 1, lambda g, p=p: 100 + N.decimal_comma(g) * down(p)))
            else:
                values.append(_found(t, p, 1, N.decimal_comma))
        fields.append(F.coalesce(*values).alias(name))
    if indicator == "export":
        top = lambda c, names: F.nullif(F.array_join(F.slice(contained(c, strings(names)), 1, 5), ", "), F.lit(""))
        fields += [top(F.lower(t["text"]), P.EXPORT_PRODUCTS).alias("top_products"), top(t["text"], P.EXPORT_MARKETS).alias("top_markets")]
    return F.struct(*fields)


def social_values(text: ColumnLike, indicator: str | None = None) -> Column:
    """map of field to value of the social patterns that match; a unit group scales the figure."""
    def listed(t: Column) -> Column:
        entries = []
        for name, field, pattern in P.SOCIAL:
            if indicator in (None, name):
                p = P.full(pattern)
                scaled = pattern.count("(") - pattern.count("(?") - pattern.count(r"\(") > 1
                unit = F.nullif(_group(t, p, 2), F.lit("")) if scaled else F.lit(None).cast("string")
                value = _found(t, p, 1, lambda g, unit=unit: let(unit, lambda u: N.number_with_unit(g, u)))
                entries.append(F.struct(F.lit(f"{name}.{field}").alias("field"), value.alias("value")))
        return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))

    return _read(F.replace(col(text), F.lit(" "), F.lit(" ")), listed)


def grdp_figures(text: ColumnLike, year: int) -> Column:
    """struct of the regional product: period, value, growth, growth per quarter, nominal value, ranks."""
    return _read(F.lower(col(text)), lambda lowered: _regional(lowered, year))


def _regional(lowered: Column, year: int) -> Column:
    t = lowered["text"]
    decimal = lambda p: _found(lowered, p, 1, lambda g: _decimal(lowered, p, g))
    amount = lambda p: _found(lowered, p, 1, lambda g: _joined(lowered, p, 2, g))
    low = lambda p: "(?U)" + p
    amounts = [r"grdp.*?ước\s*đạt.*?(\d{2,3})[.,](\d{3})\s*tỷ", r"tổng sản phẩm.*?ước\s*đạt.*?(\d{2,3})[.,](\d{3})\s*tỷ",
               r"grdp.*?đạt.*?(\d{2,3})[.,](\d{3})\s*tỷ", r"tổng sản phẩm.*?đạt.*?(\d{2,3})[.,](\d{3})\s*tỷ"]
    rates = [r"grdp.*?tăng\s*(\d+)[.,](\d+)\s*%", r"tổng sản phẩm.*?tăng\s*(\d+)[.,](\d+)\s*%", r"tăng\s*(\d+)[.,](\d+)\s*%.*?(?:so với|cùng kỳ)"]
    nominal = [r"giá hiện hành.*?(\d{2,3})[.,](\d{3})\s*tỷ", r"quy mô kinh tế.*?(\d{2,3})[.,](\d{3})\s*tỷ"]
    has = lambda *words: F.size(contained(t, strings(words))) > 0
    quarter = F.when(has("9 tháng", "9 thang"), F.lit(3)).when(has("6 tháng", "6 thang"), F.lit(2)).when(has("3 tháng", "quý i", "quy i"), F.lit(1))
    per_quarter = []
    for q, roman in enumerate(("i", "ii", "iii", "iv"), 1):
        value = F.coalesce(decimal(low(rf"quý\s*{roman}\s*tăng\s*(\d+)[.,](\d+)\s*%")), decimal(low(rf"quy\s*{roman}\s*tang\s*(\d+)[.,](\d+)\s*%")))
        per_quarter.append(F.struct(F.lit(f"Q{q}").alias("quarter"), value.alias("growth")))
    ranks = F.regexp_extract_all(t, F.lit(low(r"xếp thứ\s*(\d+[/\s]\d+)")), F.lit(1))
    rank = lambda i: F.regexp_replace(F.get(ranks, F.lit(i)), r"\s", "/")
    rate = F.coalesce(*[decimal(low(p)) for p in rates])
    return F.struct(
        F.lit(year).alias("year"), quarter.alias("quarter"), F.when(quarter.isNull(), F.lit("year")).otherwise(F.lit("quarter")).alias("period_type"),
        F.coalesce(*[amount(low(p)) for p in amounts]).alias("actual_value"), rate.alias("change_yoy"), rate.alias("change_prev_period"),
        F.map_from_entries(F.filter(F.array(*per_quarter), lambda e: e["growth"].isNotNull())).alias("quarterly_breakdown"),
        F.coalesce(*[amount(low(p)) for p in nominal]).alias("grdp_nominal"), rank(0).alias("ranking_regional"), rank(1).alias("ranking_national"))


def grdp_warnings(value: Column, yoy: Column) -> Column:
    """Messages for implausible or missing figures of the regional product."""
    return F.array_compact(F.array(
        F.when(~yoy.between(-10, 20), F.lit("growth out of range")), F.when(yoy.between(-10, 0) & (yoy < 0), F.lit("negative growth")),
        F.when(~value.between(40000, 500000), F.lit("value out of range")),
        F.when((F.coalesce(value, F.lit(0.0)) == 0) & (F.coalesce(yoy, F.lit(0.0)) == 0), F.lit("no data"))))


# --- Contexts ------------------------------------------------------------------------------------------------------

FIGURE = r"[0-9]+[.,]?[0-9]*\s*(?:tỷ|triệu|%|nghìn)"


def _words_of(table: dict[str, list[str]], indicator: Column) -> Column:
    """The words that a table has for the row's indicator; none where it has no entry."""
    entries = F.create_map(*[x for name, words in table.items() for x in (F.lit(name), strings(words))])
    return F.coalesce(F.try_element_at(entries, indicator), F.array().cast("array<string>"))


def _places(low: Column, word: Column) -> Column:
    """0-based starts of a word, from the lengths of the pieces between its occurrences."""
    def walk(pieces: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, p: F.struct((acc["at"] + F.length(p) + F.length(word)).alias("at"), F.array_append(acc["out"], acc["at"] + F.length(p)).alias("out"))
        return F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), begin, step, lambda acc: acc["out"])

    # Most words of the table are in no given text; only the others are worth a split.
    return F.when(low.contains(word), let(F.split(low, F.concat(F.lit("\\Q"), word, F.lit("\\E")), -1), walk)).otherwise(F.array().cast("array<int>"))


def contexts_of(text: ColumnLike, indicator: ColumnLike, year: ColumnLike | None = None, reach: int = 800, gap: int = 400, keep: int = 2, cut: int = 1200) -> Column:
    """array<struct(position, context)>: passages around the keywords of the row's indicator, best first.

    A passage reaches ``reach`` characters to both sides of a keyword. First come those with a priority word, then those
    of the year, without a word of detail, without a month (retail and budget), with more figures, and the earlier ones.
    Passages whose keywords are closer than ``gap`` to a better one are passed over; ``keep`` stay, cut to ``cut``
    characters. A text without a keyword has none.
    """
    name, low = col(indicator), F.lower(col(text))
    when = col(year).cast("string") if year is not None else F.lit(None).cast("string")

    def passage(at: Column, word: Column) -> Column:
        start = F.greatest(at - reach, F.lit(0))
        return let(F.substring(col(text), start + 1, at + F.length(word) + reach - start), lambda c: let(described(c), lambda d: ranked(d, at, c)))

    def described(context: Column) -> Column:
        return let(F.lower(context), lambda lowered: rules(context, lowered))

    def rules(context: Column, lowered: Column) -> Column:
        any_of = lambda words: F.exists(words, lambda w: lowered.contains(w))
        told = when.isNotNull()
        of_year = told & (context.contains(F.concat(F.lit("năm "), when)) | context.contains(F.concat(F.lit("Năm "), when))
                          | context.contains("cả năm") | context.contains("Quý"))
        by_month = told & name.isin(*P.BY_YEAR_ONLY) & F.exists(strings(P.MONTH_NAMES), lambda m: context.contains(m))
        return F.struct(
            (~any_of(_words_of(P.PRIORITY_WORDS, name))).alias("plain"), (~F.coalesce(of_year, F.lit(False))).alias("other_year"),
            any_of(_words_of(P.DETAIL_WORDS, name)).alias("detail"), F.coalesce(by_month, F.lit(False)).alias("month"),
            (-F.regexp_count(context, F.lit(FIGURE))).alias("figures"))

    def ranked(d: Column, at: Column, context: Column) -> Column:
        return F.struct(*[d[f].alias(f) for f in ("plain", "other_year", "detail", "month", "figures")], at.alias("position"), context.alias("context"))

    words = _words_of(P.KEYWORDS, name)
    # Around any keyword of a text within reach lies the whole text, which is described once.
    whole = lambda l: let(F.flatten(F.transform(words, lambda w: _places(l, w))), lambda places: F.when(F.size(places) > 0, let(
        rules(col(text), l), lambda d: F.transform(places, lambda at: ranked(d, at, col(text))))))
    parts = lambda l: F.flatten(F.transform(words, lambda w: F.transform(_places(l, w), lambda at: passage(at, w))))
    kind = "array<struct<plain:boolean,other_year:boolean,detail:boolean,month:boolean,figures:int,position:int,context:string>>"
    every = let(low, lambda l: F.coalesce(F.when(F.char_length(col(text)) <= reach, whole(l)).otherwise(parts(l)), F.array().cast(kind)))
    empty = F.array().cast("array<struct<position:int,context:string>>")
    apart = lambda kept, p: (F.size(kept) < keep) & ~F.exists(kept, lambda k: F.abs(k["position"] - p["position"]) < gap)
    chosen = lambda kept, p: F.when(apart(kept, p), F.array_append(kept, F.struct(p["position"].alias("position"), F.substring(p["context"], 1, cut).alias("context")))).otherwise(kept)
    return F.aggregate(F.array_sort(every), empty, chosen)


def keyword_contexts(docs: DataFrame, key: str, text: str, indicator: str = "indicator", year: str | None = None, **options: int) -> DataFrame:
    """(key, indicator, rank, position, context) of each row of document and indicator; see :func:`contexts_of`."""
    when = F.col(year) if year else F.lit(None).cast("int")
    rows = docs.select(key, F.col(indicator).alias("indicator"), F.col(text).alias("_text"), when.alias("_year"))
    found = rows.select(key, "indicator", F.posexplode(contexts_of("_text", "indicator", "_year", **options)).alias("at", "c"))
    return found.select(key, "indicator", (F.col("at") + 1).alias("rank"), "c.position", "c.context")


def route_by_keyword(docs: DataFrame, text: str, indicators: Sequence[str] | None = None) -> DataFrame:
    """One row per document and indicator with a keyword in the text."""
    names = list(indicators or P.KEYWORDS)
    low = F.lower(F.col(text))
    hit = lambda name: F.when(F.size(contained(low, strings(P.KEYWORDS[name]))) > 0, F.lit(name))
    return docs.withColumn("indicator", F.explode(F.array_compact(F.array(*[hit(n) for n in names]))))


def extract_panel(docs: DataFrame, key: str, text: str, source: str, year: str, province: str, quarter: str | None = None, month: str | None = None,
                  indicators: Sequence[str] | None = None) -> DataFrame:
    """Route, find contexts, extract from the best one that has a figure, else from the whole text, validate, place in a period.

    One row per document and routed indicator with ``status`` ok, invalid or empty and the messages.
    """
    names = list(indicators or [n for n in P.KEYWORDS if n != "grdp"])
    none = F.lit(None).cast("int")
    body = docs.select(F.col(key).alias("_id"), X.normalize_numbers_text(text).alias("_text"), F.col(source).alias("data_source"), F.col(year).cast("int").alias("year"),
                       (F.col(quarter).cast("int") if quarter else none).alias("_quarter"), (F.col(month).cast("int") if month else none).alias("month"))
    rows = settled(route_by_keyword(body, "_text", names), "_c", F.transform(contexts_of("_text", "indicator", "year"), lambda c: c["context"]))
    rows = rows.filter(F.size("_c") > 0).withColumn("context", F.get("_c", 0)).withColumn("_second", F.get("_c", 1))

    def values(where: str, only: Sequence[str]) -> Column:
        """Only the patterns of the row's own indicator are evaluated."""
        out = F.lit(None)
        for n in only:
            out = F.when(F.col("indicator") == n, extract_indicator(where, n)).otherwise(out)
        return out

    rows = settled(rows, "_u", values("context", names))
    blank = lambda c: (F.coalesce(F.col(f"{c}.actual_value"), F.lit(0.0)) == 0) & (F.coalesce(F.col(f"{c}.change_yoy"), F.lit(0.0)) == 0)
    rows = settled(rows, "_v", F.when(blank("_u") & F.col("_second").isNotNull(), values("_second", names)).otherwise(F.col("_u")))
    retry = [n for n in names if n not in P.GROWTH_ONLY]
    rows = settled(rows, "_w", F.when(blank("_v") & F.col("indicator").isin(*retry), values("_text", retry)).otherwise(F.col("_v")))
    rows = rows.withColumn("quarter", F.coalesce("_quarter", N.last_quarter_in("context")))
    period = F.when(F.col("month").isNotNull(), F.lit("month")).when(F.col("quarter").isNotNull(), F.lit("quarter")).otherwise(F.lit("year"))
    out = rows.select(
        F.col("_id").alias(key), "indicator", F.lit(province).alias("province"), "year", "quarter", "month", period.alias("period_type"), "_w.*",
        D.end_of_period("year", "quarter", "month").alias("last_updated"), F.lit("official").alias("data_status"), "data_source")
    empty = (F.coalesce("actual_value", F.lit(0.0)) == 0) & (F.coalesce("change_yoy", F.lit(0.0)) == 0)
    errors = Q.range_errors(F.col("indicator"), F.nullif(F.col("actual_value"), F.lit(0.0)), F.col("period_type") == "year", F.col("change_yoy"))
    return out.withColumn("errors", errors).withColumn(
        "status", F.when(empty, F.lit("empty")).when(F.size("errors") > 0, F.lit("invalid")).otherwise(F.lit("ok")))


INDICATOR_KEYS = ["indicator", "province", "year", "quarter", "month", "data_source"]


def save_panel(panel: DataFrame, extracted: DataFrame, order: Sequence[str]) -> DataFrame:
    """Valid rows upserted into the panel."""
    rows = extracted.filter("status = 'ok'").drop("errors", "status")
    return Q.upsert(panel, rows, INDICATOR_KEYS, order)


# --- Sensors and metadata ------------------------------------------------------------------------------------------

POLLUTANTS = ["pm25", "pm10", "no2", "so2", "co", "o3"]


def good_days(aqi: ColumnLike) -> Column:
    a = col(aqi)
    return F.when(a < 50, F.lit(100.0)).when(a < 100, F.lit(70.0)).when(a < 150, F.lit(40.0)).when(a.isNotNull(), F.lit(20.0))


def flatten_sensors(messages: DataFrame, province: str = "province") -> DataFrame:
    """Station messages as one row of pollutants with the period; ``-`` and unreadable values become NULL."""
    when = D.parse_timestamp("time.iso", formats=[])
    aqi = F.trim(F.col("aqi").cast("string")).try_cast("double")
    value = lambda p: F.trim(F.try_element_at("iaqi", F.lit(p))["v"].cast("string")).try_cast("double").alias(p)
    return messages.select(
        province, F.coalesce("city.name", F.lit("Unknown")).alias("station"), when.alias("measured_at"), F.year(when).alias("year"),
        F.quarter(when).alias("quarter"), F.month(when).alias("month"), aqi.alias("aqi_score"), *[value(p) for p in POLLUTANTS],
        good_days(aqi).alias("good_days_pct"), F.lit("official").alias("data_status"))


def explode_forecasts(messages: DataFrame, today: str, existing: DataFrame | None = None, province: str = "province") -> DataFrame:
    """One row per future day of the daily forecasts, pollutants zipped by position; known days are skipped."""
    daily = lambda p: F.try_element_at("forecast.daily", F.lit(p))
    zipped = messages.select(province, F.explode(F.arrays_zip(*[daily(p).alias(p) for p in POLLUTANTS])).alias("z"))
    day = F.col("z.pm25.day").try_cast("date")
    rows = zipped.select(
        province, day.alias("day"), F.year(day).alias("year"), F.quarter(day).alias("quarter"), F.month(day).alias("month"),
        F.col("z.pm25.avg").alias("aqi_score"), *[F.col(f"z.{p}.avg").alias(p) for p in POLLUTANTS], F.lit("forecast").alias("data_status"))
    rows = rows.filter(F.col("day") > F.lit(today).cast("date"))
    return rows.join(existing.select(province, "day"), [province, "day"], "left_anti") if existing is not None else rows


def cadre_figures(statistics: ColumnLike) -> Column:
    """struct(total_authorized, provincial_level, commune_level, contract_workers) from a list of notes; the last note counts."""
    def number(s: Column) -> Column:
        return F.regexp_replace(F.regexp_extract(s, r"(\d+[.,]?\d*)", 1), "[.,]", "").try_cast("bigint")

    def last(condition) -> Column:
        hits = F.filter(F.transform(col(statistics), lambda s: F.when(condition(F.lower(s), number(s)), number(s))), lambda v: v.isNotNull())
        return F.try_element_at(hits, F.lit(-1))

    posts = lambda s: s.contains("biên chế")
    any_of = lambda s, *words: F.exists(strings(words), lambda w: s.contains(w))
    return F.struct(
        last(lambda s, n: posts(s) & ~any_of(s, "sở", "xã", "phường") & (n > 1000)).alias("total_authorized"),
        last(lambda s, n: posts(s) & any_of(s, "sở", "ban", "ngành", "cấp tỉnh") & (n > 0)).alias("provincial_level"),
        last(lambda s, n: posts(s) & any_of(s, "xã", "phường") & (n > 0)).alias("commune_level"),
        last(lambda s, n: s.contains("hợp đồng") & (n > 0)).alias("contract_workers"))
