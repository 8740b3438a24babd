"""Example queries of the text, date and number functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D, numbers as N, text as T
from ..operators import entities as E
from . import sqlparts as S
from .registry import Registry, table

REGISTRY = Registry()
add = REGISTRY.add

# Toy abbreviation table over the invented words of the test texts.
TOY_ABBREVIATIONS = {"the": "định", "la": "le petit", "und": "and"}
TOY_STOPWORDS = ["the", "of", "and", "la", "le", "und", "der", "el"]


def _abbreviations_sql(text: str) -> str:
    cases = " ".join(f"when lower(w) = '{k}' then '{v}'" for k, v in TOY_ABBREVIATIONS.items())
    return f"array_to_string(list_transform({S.tokens(text)}, lambda w: case {cases} else w end), ' ')"


_NW = r"[^\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_KEEP = r"[^\p{L}\p{N}_\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_SPC = S.WS[1:-1]


def _standard_sql() -> str:
    t = "nfc_normalize(text)"
    t = S.rx(S.rx(t, "&[a-zA-Z]+;"), r"&#\d+;")
    t = S.rx(t, f"https?://{_NW}+", "")
    t = S.rx(t, f"{_NW}+@{_NW}+", "")
    t = S.rx(t, rf"[\p{{Nd}}{_SPC}().\-]{{10,}}", "")
    t = S.rx(t, _KEEP + r".,!?;:\-]")
    t = f"lower({_abbreviations_sql(t)})"
    return S.squeeze(t)


@add("c1_clean_standard", f"select doc_id, {_standard_sql()} as clean from documents")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.clean_standard("text", squash_repeats=False, abbreviations=TOY_ABBREVIATIONS).alias("clean"))


@add("c1_clean_standard_full")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.clean_standard("text").alias("clean"))


def _enhanced_sql(source: str = "text") -> str:
    t = f"nfc_normalize({source})"
    t = S.rx(S.rx(t, "<[^>]+>"), r"(?s)<!--.*?-->")
    for p in ("&[a-zA-Z]+;", r"&#\d+;", "&#x[0-9a-fA-F]+;"):
        t = S.rx(t, p)
    t = S.rx(S.rx(t, f"https?://{_NW}+", ""), rf"www\.{_NW}+", "")
    t = S.rx(t, rf"{_NW}+@{_NW}+\.{_NW}+", "")
    sep = rf"[-.{_SPC}]?"
    t = S.rx(t, rf"[+]?[(]?[0-9]{{1,4}}[)]?{sep}[(]?[0-9]{{1,4}}[)]?{sep}[0-9]{{1,9}}", "")
    t = S.rx(t, _KEEP + r".,!?;:\-()]")
    t = S.squeeze(t)
    return (f"array_to_string(list_filter({S.tokens(t)}, lambda w: length(w) >= 2 "
            f"and not list_contains({S.strings(TOY_STOPWORDS)}, lower(w))), ' ')")


@add("c2_clean_enhanced", f"select doc_id, {_enhanced_sql()} as clean from documents")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.clean_enhanced("text", remove_stopwords=True, squash_repeats=False,
                                               stopwords=TOY_STOPWORDS).alias("clean"))


@add("c2_clean_enhanced_pages", f"select page_id, {_enhanced_sql('html')} as clean from pages")
def _(spark, sf):
    d = table(spark, sf, "pages")
    return d.select("page_id", T.clean_enhanced("html", remove_stopwords=True, squash_repeats=False,
                                                stopwords=TOY_STOPWORDS).alias("clean"))


@add("c3_clean_for_topics", f"""select doc_id, array_to_string(list_filter({S.tokens(_standard_sql())},
  lambda w: length(w) > 2 and not list_contains({S.strings(TOY_STOPWORDS)}, w)), ' ') as clean from documents""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.clean_for_topics("text", TOY_STOPWORDS, squash_repeats=False,
                                                 abbreviations=TOY_ABBREVIATIONS).alias("clean"))


def _ingest_sql(source: str) -> str:
    keep = _KEEP + r""".,!?;:\-''"()@#]"""
    return f"trim({S.rx(S.rx(S.rx(source, '<[^>]+>', ''), S.WS + '+'), keep, '')})"


@add("c4_clean_ingest", f"select page_id, {_ingest_sql('html')} as clean from pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.clean_ingest("html").alias("clean"))


@add("c5_normalize_numbers_text",
     f"""select doc_id, {S.strip(S.rx(S.rx("text", S.WS + "+"), r"[\x{200B}-\x{200D}\x{FEFF}]", ""))} as clean
         from documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normalize_numbers_text("text").alias("clean"))


@add("c6_expand_abbreviations", f"select doc_id, {_abbreviations_sql('text')} as expanded from documents")
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", T.expand_abbreviations("text", TOY_ABBREVIATIONS).alias("expanded"))


@add("c7_fix_diacritics", "select doc_id, text || ' người thời hòa' as fixed from documents")
def _(spark, sf):
    typo = F.concat(F.col("text"), F.lit(" Ngươì thơì hoà"))
    return table(spark, sf, "documents").select("doc_id", T.fix_diacritics(typo).alias("fixed"))


_SENTENCES = (f"list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda s: {S.strip('s')}), "
              "lambda s: length(s) >= 10)")


@add("c8_sentences", f"select doc_id, len({_SENTENCES}) as n, array_to_string({_SENTENCES}, '|') as parts from documents")
def _(spark, sf):
    s = T.sentences("text")
    return table(spark, sf, "documents").select(
        "doc_id", F.size(s).cast("bigint").alias("n"), F.array_join(s, "|").alias("parts"))


@add("c9_sentences_with_numbers", rf"""select doc_id, array_to_string(list_filter(
  string_split_regex(text, '[.!?]{S.WS}+'),
  lambda s: regexp_matches(s, '(?i)\d+[.,]?\d*{S.WS}*(?:tỷ|triệu|nghìn|%|USD|VND)')), '|') as parts from documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.sentences_with_numbers("text"), "|").alias("parts"))


@add("c10_numbers_and_dates", r"""select doc_id,
  array_to_string(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', 'x', 'g'), '\b\d+(?:[.,]\d+)?\b'), '|') as numbers,
  array_to_string(regexp_extract_all(text, '\d{1,2}/\d{1,2}/\d{4}') || regexp_extract_all(text, '\d{1,2}-\d{1,2}-\d{4}')
   || regexp_extract_all(text, '\d{4}-\d{1,2}-\d{1,2}')
   || regexp_extract_all(text, '(?i)ngày \d{1,2} tháng \d{1,2} năm \d{4}'), '|') as dates from documents""")
def _(spark, sf):
    ascii_only = F.regexp_replace("text", r"[^\x00-\x7F]", "x")
    return table(spark, sf, "documents").select(
        "doc_id", F.array_join(T.numbers(ascii_only), "|").alias("numbers"), F.array_join(T.dates("text"), "|").alias("dates"))


@add("c11_counts", f"""select doc_id, cast(len({S.tokens('text')}) as bigint) as words, length(text) as chars,
  length(replace(text, ' ', '')) as chars_no_space from documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", T.word_count("text").cast("bigint").alias("words"),
        T.char_count("text", spaces=True).cast("bigint").alias("chars"),
        T.char_count("text").cast("bigint").alias("chars_no_space"))


_WORDS = S.words("text", TOY_STOPWORDS)


@add("c12_words", f"select doc_id, array_to_string({_WORDS}, ' ') as tokens from documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.words("text", TOY_STOPWORDS), " ").alias("tokens"))


@add("c13_phrases", f"""with w as (select doc_id, {_WORDS} as a from documents)
  select doc_id, cast(len(p) as bigint) as n, md5(array_to_string(p, '|')) as digest
  from (select doc_id, a || {S.grams('a', 2, 40)} || {S.grams('a', 3, 50)} as p from w)""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.words("text", TOY_STOPWORDS).alias("a"))
    return d.select("doc_id", T.phrases("a").alias("p")).select(
        "doc_id", F.size("p").cast("bigint").alias("n"), F.md5(F.array_join("p", "|")).alias("digest"))


# Test texts hold few hashtags, so capitalised words are marked as such first.
@add("c14_hashtags", r"""select doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(
  lower(regexp_replace(text, '([A-Z]\p{L}+)', '#\1', 'g')), '#([\p{L}\p{N}_]+)', 1))), ' ') as tags from documents""")
def _(spark, sf):
    marked = F.regexp_replace("text", r"([A-Z]\p{L}+)", "#$1")
    return table(spark, sf, "documents").select(
        "doc_id", F.array_join(F.array_sort(T.hashtags(marked)), " ").alias("tags"))


@add("c15_entities")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice").repartition(spark.sparkContext.defaultParallelism)
    text = F.concat(F.lit("Ông Nguyễn Văn An, tỉnh Hưng Yên, ngày "), F.date_format("o_orderdate", "dd/MM/yyyy"),
                    F.lit(", chi "), F.floor("o_totalprice").cast("string"), F.lit(" triệu đồng tại hà nội"))
    return E.extract_entities(o.select(F.col("o_orderkey").alias("id"), text.alias("text")), "id", "text", offsets=True)


@add("c15_entities_dates_and_money", r"""with t as (select o_orderkey as id, 'Ngày ' || strftime(o_orderdate, '%d/%m/%Y') as d,
  strftime(o_orderdate, '%d/%m/%Y') as d2, cast(floor(o_totalprice) as bigint) || ' triệu' as m from orders)
  select id, 'DATE' as type, d as entity from t union all select id, 'DATE', d2 from t
  union all select id, 'MONEY', m from t union all select id, 'MONEY', m || ' đồng' from t""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    text = F.concat(F.lit("Ngày "), F.date_format("o_orderdate", "dd/MM/yyyy"),
                    F.lit(" chi "), F.floor("o_totalprice").cast("string"), F.lit(" triệu đồng"))
    return E.extract_entities(o.select(F.col("o_orderkey").alias("id"), text.alias("text")), "id", "text").select(
        "id", "type", "entity")


@add("c16_entity_summary", r"""with e as (
  select 'DATE' as type, strftime(o_orderdate, '%d/%m/%Y') as entity from orders
  union all select 'MONEY', cast(floor(o_totalprice / 10000) as bigint) || ' triệu' from orders
  union all select 'MONEY', cast(floor(o_totalprice / 10000) as bigint) || ' triệu đồng' from orders),
  c as (select type, entity, count(*) as n from e group by all),
  r as (select *, row_number() over (partition by type order by n desc, entity) as rank,
               sum(n) over (partition by type) as type_total from c)
  select type, entity, n, cast(rank as bigint) as rank, cast(type_total as bigint) as type_total from r where rank <= 5""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    text = F.concat(F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" chi "),
                    F.floor(F.col("o_totalprice") / 10000).cast("string"), F.lit(" triệu đồng"))
    found = E.extract_entities(o.select(F.col("o_orderkey").alias("id"), text.alias("text")), "id", "text")
    return E.entity_summary(found, top_n=5)


@add("c17_strip_boilerplate", f"""select doc_id, {S.rx(S.rx(S.rx(S.rx("'Created by ' || text",
     "(?i)created by.*?with", ''), f'#{S.WORD}+', ''), f'http{_NW}+', ''), f'(?i)translate{S.WS}+{S.WORD}+', '')} as clean
  from documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", T.strip_boilerplate(F.concat(F.lit("Created by "), F.col("text"))).alias("clean"))


_SHAPES = [r"(?i)\n\d+\.?\s+\p{L}[\p{L}\s]+", r"(?i)\n[IVX]+\.?\s+\p{L}[\p{L}\s]+", r"(?i)\n[a-z]\)\s+\p{L}[\p{L}\s]+"]
_HEADS = " union all ".join(
    f"""select doc_id, b, {i} as shape, hits[k] as hit, list_sum(list_transform(pieces[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0) as place
  from (select *, unnest(range(1, len(hits) + 1)) as k from (select doc_id, b, regexp_extract_all(b, '{p}') as hits, string_split_regex(b, '{p}') as pieces from t))"""
    for i, p in enumerate(_SHAPES))


@add("c18_sections", rf"""with t as (select doc_id, chr(10) || 'I. Mo dau' || chr(10) || regexp_replace(text, '\n(\p{{Lu}})', chr(10) || '1. \1', 'g') as b from documents), h as ({_HEADS}),
  o as (select *, row_number() over w as section, lead(place) over w as next from h window w as (partition by doc_id order by place, shape))
  select doc_id, section::int as section, {S.strip('hit')} as title, place::int as start, coalesce(next, length(b))::int as "end", substring(b, place::int + 1, (coalesce(next, length(b)) - place)::int) as content from o""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    numbered = F.regexp_replace("text", r"\n(\p{Lu})", "\n1. $1")
    return E.sections(d.select("doc_id", F.concat(F.lit("\nI. Mo dau\n"), numbered).alias("text")), "doc_id", "text")


@add("c19_periods", """with d as (select cast(ts as date) as d, count(*) as n from events group by 1)
  select d as day, n, cast(date_trunc('week', d) as date) as week_start, cast(date_trunc('week', d) + interval 6 day as date) as week_end,
    cast(date_trunc('month', d) as date) as month_start, last_day(d) as month_end, strftime(d, '%d/%m/%Y') as day_label,
    'Tuần ' || weekofyear(d) || '/' || year(date_trunc('week', d)) as week_label, 'Tháng ' || month(d) || '/' || year(d) as month_label,
    cast(date_trunc('week', d) - interval 7 day as date) as previous_week from d""")
def _(spark, sf):
    d = table(spark, sf, "events").groupBy(D.day("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w, m = D.period_start("day", "weekly"), D.period_start("day", "monthly")
    return d.select("day", "n", w.alias("week_start"), D.period_end(w, "weekly").alias("week_end"), m.alias("month_start"),
                    D.period_end(m, "monthly").alias("month_end"), D.period_label("day", "daily").alias("day_label"),
                    D.period_label(w, "weekly").alias("week_label"), D.period_label(m, "monthly").alias("month_label"),
                    F.date_sub(w, 7).alias("previous_week"))


@add("c20_end_of_period", """select o_orderkey, last_day(o_orderdate) as month_end,
  last_day(make_date(year(o_orderdate), quarter(o_orderdate) * 3, 1)) as quarter_end,
  make_date(year(o_orderdate), 12, 31) as year_end from orders""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    y, q, m, none = F.year("o_orderdate"), F.quarter("o_orderdate"), F.month("o_orderdate"), F.lit(None).cast("int")
    return o.select("o_orderkey", D.end_of_period(y, q, m).alias("month_end"), D.end_of_period(y, q, none).alias("quarter_end"),
                    D.end_of_period(y, none, none).alias("year_end"))


@add("c21_epoch_and_offsets", """select event_id, epoch_us(ts) // 1000000 as seconds,
  strftime(ts + interval 37 day, '%Y-%m-%d %H:%M:%S') as plus_month_week,
  strftime(ts - interval 365 day, '%Y-%m-%d %H:%M:%S') as minus_year from events""")
def _(spark, sf):
    fmt = "yyyy-MM-dd HH:mm:ss"
    return table(spark, sf, "events").select(
        "event_id", F.floor(D.epoch_seconds("ts")).cast("bigint").alias("seconds"),
        F.date_format(D.shift("ts", days=7, months=1), fmt).alias("plus_month_week"),
        F.date_format(D.shift("ts", years=-1), fmt).alias("minus_year"))


@add("c22_tidy_phrase", "select p_partkey, p_name as phrase from part")
def _(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", T.tidy_phrase(F.concat(F.lit("của_"), F.col("p_name"), F.lit("  và "))).alias("phrase"))


@add("c23_periods_in_text", """select o_orderkey, cast(year(o_orderdate) as int) as year, cast(quarter(o_orderdate) as int) as quarter,
  cast(month(o_orderdate) as int) as month, cast(quarter(o_orderdate) as int) as last_quarter,
  case when o_orderkey % 2 = 0 then cast(month(o_orderdate) as int) end as title_month,
  case when o_orderkey % 2 = 1 then cast(quarter(o_orderdate) as int) end as title_quarter from orders""")
def _(spark, sf):
    y, m = F.year("o_orderdate").cast("string"), F.month("o_orderdate").cast("string")
    roman = F.element_at(F.array(*[F.lit(x) for x in ("I", "II", "III", "IV")]), F.quarter("o_orderdate"))
    year4 = F.lpad(y, 4, "0")
    # Orders before 2000 are moved by a century, years are read as 20xx.
    shifted = F.when(F.col("o_orderdate") < "2000-01-01", F.concat(F.lit("20"), F.substring(year4, 3, 2))).otherwise(year4)
    text = F.concat(F.lit("Báo cáo quý I, Quý "), roman, F.lit(" tháng "), m, F.lit(" năm "), shifted)
    title = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Tháng "), m)).otherwise(F.concat(F.lit("Quý "), roman))
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", text.alias("text"), title.alias("title"), y.alias("y"))
    back = F.when(F.col("o_orderdate") < "2000-01-01", N.year_in("text") - 100).otherwise(N.year_in("text"))
    t = N.period_of_title("title", 2024)
    quarter_text = F.regexp_replace("text", "^Báo cáo quý I, ", "")
    return o.select("o_orderkey", back.alias("year"), N.quarter_in(quarter_text).alias("quarter"), N.month_in("text").alias("month"),
                    N.last_quarter_in("text").alias("last_quarter"), t.month.alias("title_month"), t.quarter.alias("title_quarter"))


@add("c24_number_with_unit", """select l_orderkey, l_linenumber, count(*) as n,
  round(sum(l_quantity * case l_linenumber % 4 when 0 then 1000 when 1 then 1000000 when 2 then 1000000000 else 1 end), 2) as amount,
  cast(sum(cast(floor(l_quantity * 10) as bigint) * 100) as bigint) as views from lineitem group by all""")
def _(spark, sf):
    unit = F.element_at(F.array(F.lit("nghìn"), F.lit(" Triệu"), F.lit("tỷ"), F.lit("người")), (F.col("l_linenumber") % 4) + 1)
    text = F.replace(F.col("l_quantity").cast("string"), F.lit("."), F.lit(","))
    views = F.concat(F.col("l_quantity").cast("decimal(10,1)").cast("string"), F.lit("k"))
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(N.number_with_unit(text, unit)), 2).alias("amount"),
        F.sum(N.view_count(views)).alias("views"))
