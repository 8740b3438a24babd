"""Example queries of emotion, category, field and topic classification.

The test texts are invented words, so toy dictionaries over frequent ones stand
in for the default Vietnamese dictionaries.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify as C
from ..resources import lexicon as L
from . import sqlparts as S
from .registry import Registry, table

REGISTRY = Registry()
add = REGISTRY.add

TOY_TERMS = {"joy": ["tion", "in the", "le la"], "trust": ["and", "eau", "of the"], "anger": ["er", "that", "und der"],
             "fear": ["sch", "the", "der die"], "calm": ["ouen", "ción"]}
TOY_EMOTIONS = {"joy": ("positive", 1.0), "trust": ("positive", 1.2), "anger": ("negative", 1.3), "fear": ("negative", 1.0), "calm": ("neutral", 0.5)}
TOY_MODIFIERS = {"intensifiers": ["of", "le", "die"], "diminishers": ["to", "la", "el"], "negations": ["is", "un", "und"]}
TOY_CATEGORIES = {"law": ["of the", "and", "der"], "school": ["the", "tion", "le la"], "health": ["sch", "eau", "in the that"]}
TOY_FIELDS = {"economy": ["the", "of the", "la"], "culture": ["and", "der", "le", "un"], "sport": ["in", "is", "und", "el"]}


def toy_lexicon(spark):
    return L.emotion_table(spark, TOY_TERMS, TOY_EMOTIONS)


def toy_categories(spark):
    return L.category_table(spark, TOY_CATEGORIES)


def toy_fields(spark):
    return spark.createDataFrame([(i, f, k) for i, (f, k) in enumerate(TOY_FIELDS.items())], "rank int, field string, keywords array<string>")


def _values(rows):
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


_M = TOY_MODIFIERS
EMOTION_SQL = f"""lex(rank, emotion, grp, weight) as (values {_values([(i, e, g, w) for i, (e, (g, w)) in enumerate(TOY_EMOTIONS.items())])}),
  terms(emotion, term) as (values {_values([(e, t) for e, ts in TOY_TERMS.items() for t in ts])}),
  low as (select doc_id, lower(text) as t, {S.tokens('lower(text)')} as w from documents),
  tok as (select doc_id, unnest(w) as tok, unnest(list_concat([null], w[1:len(w)-1])) as prev from low where len(w) > 0),
  fac as (select doc_id, tok, case when list_contains({S.strings(_M['negations'])}, prev) then -0.5
     when list_contains({S.strings(_M['intensifiers'])}, prev) then 1.5 when list_contains({S.strings(_M['diminishers'])}, prev) then 0.7 else 1.0 end as f from tok),
  single as (select doc_id, emotion, sum(cast(f as double)) as s from fac join terms on contains(tok, term) and not contains(term, ' ') group by all),
  phrase as (select doc_id, emotion, count(*) * 1.5 as s from low join terms on contains(t, term) and contains(term, ' ') group by all),
  score as (select d.doc_id, lex.rank, lex.emotion, lex.grp,
     greatest(0, cast(weight as double) * (coalesce(single.s, 0) + coalesce(phrase.s, 0))) as score from documents d cross join lex
     left join single on single.doc_id = d.doc_id and single.emotion = lex.emotion
     left join phrase on phrase.doc_id = d.doc_id and phrase.emotion = lex.emotion),
  agg as (select doc_id, sum(score) as total, max(score) as best, arg_min(emotion, rank) filter (score = m) as emotion, arg_min(grp, rank) filter (score = m) as grp
     from (select *, max(score) over (partition by doc_id) as m from score) group by 1),
  verdict as (select doc_id, case when total > 0 and best >= 0.5 then emotion else 'trung_lập' end as emotion,
     case when total > 0 and best >= 0.5 then grp else 'neutral' end as sentiment_group,
     case when total > 0 then least(0.95, 0.4 + best / (total + 0.01 + 0.1) * 0.6) else 0.6 end as confidence, total from agg)"""


@add("e1_emotion_scores", f"with {EMOTION_SQL} select doc_id, emotion, round(score, 3) as score from score")
def _(spark, sf):
    d = C.emotion_scores(table(spark, sf, "documents"), "text", toy_lexicon(spark), **TOY_MODIFIERS)
    return d.select("doc_id", F.explode("scores").alias("s")).select("doc_id", "s.emotion", F.round("s.score", 3).alias("score"))


@add("e1a_emotion_verdict", f"""with {EMOTION_SQL} select v.doc_id, emotion, sentiment_group, round(confidence, 4) as confidence,
  round((select sum(round(case when v.total > 0 then score / (v.total + 0.01) else 0 end, 4)) from score s where s.doc_id = v.doc_id), 2) as score_sum from verdict v""")
def _(spark, sf):
    d = C.analyze_emotion(table(spark, sf, "documents"), "text", toy_lexicon(spark), **TOY_MODIFIERS)
    total = F.aggregate(F.map_values("emotion_scores"), F.lit(0.0), lambda a, v: a + v)
    return d.select("doc_id", "emotion", "sentiment_group", "confidence", F.round(total, 2).alias("score_sum"))


@add("e1_emotion_default_lexicon")
def _(spark, sf):
    d = table(spark, sf, "documents").withColumn("text", F.concat("text", F.lit(" rất vui mừng, không sợ hãi")))
    return C.analyze_emotion(d, "text").select("doc_id", "emotion", "sentiment_group", "confidence")


@add("e1b_emotion_group", """select event_id, case event_type when 'error' then 'negative' when 'purchase' then 'positive' when 'signup' then 'positive' else 'neutral' end as grp from events""")
def _(spark, sf):
    groups = {"error": "negative", "purchase": "positive", "signup": "positive", "click": "neutral", "view": "neutral"}
    return table(spark, sf, "events").select("event_id", C.emotion_group("event_type", groups).alias("grp"))


CATEGORY_SQL = f"""dict(rank, category, keyword, weight) as (values {_values([(i, c, k, len(k.split())) for i, (c, ks) in enumerate(TOY_CATEGORIES.items()) for k in ks])}),
  hit as (select doc_id, rank, category, sum(weight) as score, count(*) as n from documents join dict on contains(lower(lang || ' ' || text), keyword) group by all),
  best as (select doc_id, arg_max(category, [score, -rank]) as category, max(score) as score, sum(score) as total, arg_max(n, [score, -rank]) as n from hit group by 1),
  category as (select d.doc_id, coalesce(category, 'khac') as category, case when score is null then 0.5 else least(0.95, 0.3 + score / 10.0 * 0.65) end as confidence,
    coalesce(n, 0) as matched from documents d left join best using (doc_id))"""


@add("e2_category", f"with {CATEGORY_SQL} select doc_id, category, round(confidence, 4) as confidence, cast(matched as int) as matched from category")
def _(spark, sf):
    d = C.classify_category(table(spark, sf, "documents"), "text", "lang", toy_categories(spark))
    return d.select("doc_id", "category", F.col("category_confidence").alias("confidence"), F.size("matched_keywords").alias("matched"))


_PADDED = "' ' || " + S.squeeze(S.rx("lower(text)", r"[^\p{L}\p{N}_\s]")) + " || ' '"
_FIELD_VALUES = _values([(i, f, k) for i, (f, ks) in enumerate(TOY_FIELDS.items()) for k in ks])
FIELD_SQL = f"""dict(rank, field, keyword) as (values {_FIELD_VALUES}), pad as (select doc_id, {_PADDED} as t from documents),
  hit as (select doc_id, rank, field, count(*) as n from pad join dict on contains(t, ' ' || keyword || ' ') group by all),
  field as (select doc_id, arg_max(field, [n, -rank]) as field, least(1.0, max(n) / 5.0) as confidence from hit group by 1)"""


@add("e3_field", f"with {FIELD_SQL} select doc_id, field, confidence from field")
def _(spark, sf):
    return C.classify_field(table(spark, sf, "documents"), ["text"], toy_fields(spark)).select("doc_id", "field", "confidence")


@add("e4_classify_new", f"""with {FIELD_SQL} select field, 'keyword' as method, count(*) as n from field
  where doc_id not in (select doc_id from labels) group by 1""")
def _(spark, sf):
    new = C.classify_new(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id", ["text"], toy_fields(spark))
    return new.groupBy("field", "method").agg(F.count(F.lit(1)).alias("n"))


def toy_topics(spark, sf=None):
    rows = [(1, "one", ["the", "OF the", "tion"], ["zzz"], 0.4, 0.6, 0.4, True), (2, "two", ["le", "la", "eau", "ción"], ["the"], 0.5, 0.5, 0.3, True),
            (3, "three", ["und"], [], 1.0, 1.0, 0.2, False), (4, "four", ["qqqq", "der", "die", "sch"], ["und der"], 0.7, 0.3, 0.5, True)]
    topics = spark.createDataFrame(rows, "topic_id int, name string, keywords array<string>, negative_keywords array<string>, "
                                   "keywords_weight double, example_weight double, min_confidence double, is_active boolean")
    if sf is None:
        return topics
    vectors = C.topic_vectors(table(spark, sf, "embeddings").withColumnRenamed("label", "topic_id"), "topic_id", "embedding")
    return topics.join(vectors, "topic_id", "left")


_TOPICS = """topics(topic_id, kw, neg, wk, we, low) as (values (1, ['the', 'of the', 'tion'], ['zzz'], 0.4, 0.6, 0.4),
  (2, ['le', 'la', 'eau', 'ción'], ['the'], 0.5, 0.5, 0.3), (4, ['qqqq', 'der', 'die', 'sch'], ['und der'], 0.7, 0.3, 0.5))"""
_KEYWORD = "len(list_filter(kw, lambda k: contains(lower(text), k))) / cast(len(kw) as double)"
_NEG = "case when len(list_filter(neg, lambda k: contains(lower(text), k))) > 0 then 0.3 else 1.0 end"


@add("e5_topic_keyword_score", f"""with {_TOPICS} select doc_id, topic_id, round({_KEYWORD}, 4) as keyword_score,
  round({_KEYWORD} * {_NEG}, 4) as confidence, {_KEYWORD} * {_NEG} >= low as is_accepted from documents cross join topics""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return C.classify_topics(d, "text", toy_topics(spark), "keyword").select("doc_id", "topic_id", "keyword_score", "confidence", "is_accepted")


_VECTORS = """unit as (select vec_id, label, list_transform(embedding, lambda v: cast(v as double) / sqrt(list_sum(list_transform(embedding, lambda u: cast(u as double) * u)))) as u from embeddings),
  cell as (select label, unnest(range(1, 65)) as pos, unnest(u) as v from unit),
  mean as (select label, list(m order by pos) as tv from (select label, pos, avg(v) as m from cell group by all) group by 1)"""


@add("e6_topic_vectors", f"""with {_VECTORS} select vec_id, mean.label as topic_id, round(greatest(0, least(1, list_dot_product(u, tv))), 4) as score
  from unit cross join mean""")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    topics = C.topic_vectors(e, "label", "embedding").select(F.col("label").alias("rank"), "topic_vector")
    rows = C.attach_table(e, topics, "t", 2000).select("vec_id", "embedding", F.explode("t").alias("t"))
    return rows.select("vec_id", F.col("t.rank").alias("topic_id"), F.round(C.embedding_score("embedding", F.col("t.topic_vector")), 4).alias("score"))


_HYBRID = f"""with {_TOPICS}, {_VECTORS}, s as (select doc_id, topic_id, low, wk, we, {_KEYWORD} as k, {_NEG} as f,
    greatest(0, least(1, list_dot_product(u, tv))) as e from documents join unit on doc_id = vec_id cross join topics join mean on label_ = topic_id),
  r as (select doc_id, topic_id, low, k, case when k < 0.05 then 0 else e end as e, f * case when k < 0.05 then 0 else (wk * k + we * e) / (wk + we) end as c from s)""".replace(
    "join mean on label_ = topic_id", "join mean on mean.label = topic_id")


@add("e7_topic_hybrid", _HYBRID + """ select doc_id, topic_id, round(k, 4) as keyword_score, round(e, 4) as embedding_score,
  round(c, 4) as confidence, c >= low as is_accepted from r""")
def _(spark, sf):
    return _hybrid(spark, sf).select("doc_id", "topic_id", "keyword_score", "embedding_score", "confidence", "is_accepted")


def _hybrid(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    return C.classify_topics(d.select("doc_id", "text", "embedding"), "text", toy_topics(spark, sf), "hybrid", "embedding")


@add("e8_save_assignments", _HYBRID + """, old as (select doc_id, 1 as topic_id, 0.5 as confidence, 'manual' as method from documents where doc_id % 3 = 0),
  new as (select doc_id, topic_id, round(c, 4) as confidence, 'hybrid' as method from r where c >= low)
  select coalesce(n.doc_id, o.doc_id) as doc_id, coalesce(n.topic_id, o.topic_id) as topic_id, coalesce(n.confidence, o.confidence) as confidence,
    coalesce(n.method, o.method) as method, case when n.doc_id is null then 'kept' when o.doc_id is null then 'inserted' else 'updated' end as action
  from old o full join new n on o.doc_id = n.doc_id and o.topic_id = n.topic_id""")
def _(spark, sf):
    old = table(spark, sf, "documents").filter("doc_id % 3 = 0").select(
        "doc_id", F.lit(1).alias("topic_id"), F.lit(0.5).alias("confidence"), F.lit("manual").alias("method"))
    return C.save_assignments(old, _hybrid(spark, sf), "doc_id")


@add("e8_topic_counts", _HYBRID + """ select t.topic_id, count(r.doc_id) as article_count from (select * from (values (1), (2), (3), (4)) v(topic_id)) t
  left join r on r.topic_id = t.topic_id and c >= low group by 1""")
def _(spark, sf):
    accepted = _hybrid(spark, sf).filter("is_accepted")
    return C.topic_counts(accepted, toy_topics(spark)).select("topic_id", "article_count")


@add("e9_route_labels", f"""with dict(rank, category, keyword) as (values {_values([(i, c, k) for i, (c, ks) in enumerate(TOY_CATEGORIES.items()) for k in ks])}),
  hit as (select distinct doc_id, rank, category from documents join dict on contains(lower(text), keyword))
  select d.doc_id, coalesce(string_agg(category, '|' order by rank), '') as labels from documents d left join hit using (doc_id) group by 1""")
def _(spark, sf):
    d = C.route_labels(table(spark, sf, "documents"), F.lower("text"), toy_categories(spark))
    return d.select("doc_id", F.array_join("labels", "|").alias("labels"))


_ROUTES = [(0, "grdp", ["src1"], ["Eau"], ["the", "of"]), (1, "cpi", ["src3"], [], ["la", "le", "un"]), (2, "fdi", [], ["ouen"], ["der", "und"])]


@add("e10_route_indicators", f"""with d as (select doc_id, 'https://' || source || '/' as u, lower({S.title()}) as h, lower({S.title()} || ' ' || substring(text, 1, 500)) as s from documents),
  r(rank, indicator, up, tp, kw) as (values (0, 'grdp', ['src1'], ['eau'], ['the', 'of']), (1, 'cpi', ['src3'], []::varchar[], ['la', 'le', 'un']), (2, 'fdi', []::varchar[], ['ouen'], ['der', 'und'])),
  m as (select doc_id, rank, indicator, len(list_filter(up, lambda p: contains(u, p))) + len(list_filter(tp, lambda p: contains(h, p))) > 0 as pat,
    len(list_filter(kw, lambda k: contains(s, k))) >= 2 as kwd from d cross join r),
  a as (select *, bool_or(pat) over (partition by doc_id) as any_pat from m)
  select doc_id, coalesce(string_agg(indicator, '|' order by rank) filter (case when any_pat then pat else kwd end), '') as indicators from a group by 1""")
def _(spark, sf):
    rules = spark.createDataFrame([(r, i, u, [t.lower() for t in ts], k) for r, i, u, ts, k in _ROUTES],
                                  "rank int, indicator string, url_patterns array<string>, title_patterns array<string>, keywords array<string>")
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("https://"), "source", F.lit("/")).alias("url"),
                                             T.headline("text").alias("title"), "text")
    out = C.route_indicators(d, "title", "text", "url", rules)
    return out.select("doc_id", F.array_join("indicators", "|").alias("indicators"))


@add("e11_sentiment_facts", f"""with {EMOTION_SQL}, a as (select doc_id, arg_min(t, [-c, t]) as topic_id from
    (select doc_id, quality as t, 0.5 as c from labels union all select doc_id, 2 + toxic, 0.5 + toxic * 0.1 from labels) group by 1)
  select doc_id, emotion, sentiment_group, topic_id from verdict left join a using (doc_id)""")
def _(spark, sf):
    l = table(spark, sf, "labels")
    links = l.select("doc_id", F.col("quality").alias("topic_id"), F.lit(0.5).alias("confidence")).unionByName(
        l.select("doc_id", (F.col("toxic") + 2).alias("topic_id"), (F.col("toxic") * 0.1 + 0.5).alias("confidence")))
    facts = C.sentiment_facts(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", links, toy_lexicon(spark), **TOY_MODIFIERS)
    return facts.select("doc_id", "emotion", "sentiment_group", "topic_id")


_E12 = ["medical", "education", "transportation", "environment", "policy", "security", "management", "politics", "society", "unknown"]


@add("e12_category_fields", """with m(i, field) as (values (0, 'y_te'), (1, 'giao_duc'), (2, 'ha_tang_giao_thong'), (3, 'moi_truong'), (4, 'an_sinh_xa_hoi'), (5, 'an_ninh_trat_tu'), (6, 'hanh_chinh_cong'), (7, 'xay_dung_dang'),
  (8, 'van_hoa_the_thao'), (9, 'other')) select field, count(*) as n from documents join m on doc_id % 10 = i group by 1""")
def _(spark, sf):
    d = table(spark, sf, "documents").withColumn("category", F.get(F.array(*[F.lit(c) for c in _E12]), (F.col("doc_id") % 10).cast("int")))
    return C.category_fields(d, "category")


@add("e13_split_by_length", "select doc_id, length(text) < 200 as is_short, length(text) > 100 as is_trainable from documents")
def _(spark, sf):
    return C.split_by_length(table(spark, sf, "documents"), "text").select("doc_id", "is_short", "is_trainable")


@add("e14_enrichment_candidates", """with a as (select doc_id, n_chars, n_chars > 2000 as forced, doc_id % 101 as score from documents where n_chars >= 500),
  r as (select *, row_number() over (order by forced desc, score desc, doc_id) as position, count(*) over () as n, count(*) filter (forced) over () as f from a)
  select doc_id, forced, position from r where position <= f + ceil((n - f) * 0.3) and position * 0.5 <= 200""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars", (F.col("doc_id") % 101).alias("score"))
    out = C.enrichment_candidates(d, "doc_id", "n_chars", "score", F.col("n_chars") > 2000, "balanced", 0.5, 200)
    return out.select("doc_id", "forced", "position")
