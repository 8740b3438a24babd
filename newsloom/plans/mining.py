"""Example queries of key phrases and entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import marts as M, mining as K
from . import sqlparts as S
from .registry import Registry, table

REGISTRY = Registry()
add = REGISTRY.add

STOP = ["the", "of", "and", "la", "le", "und", "der", "el", "de", "in", "to", "is"]
TOY_ENTITIES = ["tion on", "eau eaux", "that in", "de la"]


def _tok(text: str, stop=STOP) -> str:
    return rf"list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: not list_contains({S.strings(stop)}, w))"


def _counts(source: str, tok: str, low: int, high: int, key: str = "doc_id") -> str:
    parts = " || ".join(["a"] * (low == 1) + [S.grams("a", n) for n in range(max(low, 2), high + 1)])
    return f"""w as (select {key}, {tok} as a from {source}), g as (select {key}, unnest({parts}) as term from w),
  dc as (select {key}, term, count(*) as c from g group by all), N as (select cast(count(*) as double) as n from {source}),
  t as (select term, sum(c) as tf, count(*) as df from dc group by 1 having count(*) >= 2 and count(*) <= 0.8 * (select n from N))"""


@add("k1_tfidf_phrases", f"""with {_counts('documents', _tok('text'), 2, 3)}, v as (select term, ln((1 + n) / (1 + df)) + 1 as idf from t, N order by tf desc, term limit 500),
  x as (select doc_id, term, c * idf as w from dc join v using (term)), nn as (select doc_id, sqrt(sum(w * w)) as norm from x group by 1),
  s as (select term, sum(w / norm) / (select n from N) as score from x join nn using (doc_id) group by 1),
  b as (select term, score * case when len(list_filter({S.strings(TOY_ENTITIES)}, lambda e: contains(term, e))) > 0 then 3 else 1 end as score,
    case when len(list_filter({S.strings(TOY_ENTITIES)}, lambda e: contains(term, e))) > 0 then 'entity' else 'phrase' end as type from s where length(term) > 2)
  select term as phrase, round(score, 4) as score, type from b order by round(b.score, 9) desc, term limit 50""")
def _(spark, sf):
    return K.tfidf_phrases(table(spark, sf, "documents"), "doc_id", "text", stopwords=STOP, entities=TOY_ENTITIES)


_LABELLED = "ld as (select doc_id, text, quality as label from documents join labels using (doc_id))"
_CT = f"""with {_LABELLED}, {_counts('ld', _tok('text'), 1, 3)}, sz as (select label, count(*) as size from ld group by 1),
  cc as (select label, term, sum(c) as c from dc join ld using (doc_id) group by all),
  s as (select cc.label, cc.term, cc.c / size * ln((select n from N) / (df + 1)) as score from cc join t using (term) join sz using (label))"""


@add("k2_class_tfidf", _CT + """, b as (select term, greatest(max(score), 0) as score from s group by 1 order by 2 desc, 1 limit 50)
  select term as phrase, round(score, 4) as score, 'ctfidf' as type from b where length(term) > 2""")
def _(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return K.class_tfidf_phrases(docs, "text", "quality", stopwords=STOP)


@add("k3_count_phrases", f"""with {_counts('documents', _tok('text'), 2, 3)} select term as phrase, cast(tf as bigint) as count, 'count' as type from t order by tf desc, term limit 50""")
def _(spark, sf):
    return K.count_phrases(table(spark, sf, "documents"), "text", stopwords=STOP)


@add("k4_corpus_phrases", f"""with {_counts('documents', _tok('text', ['zzzz']), 2, 3)}, v as (select term from t order by tf desc, term limit 200),
  f as (select term, count(*) as n from v join documents on contains(lower(text), term) group by 1 order by 2 desc, 1 limit 80)
  select term as phrase, n as count, round(n / (select n from N), 6) as weight from f""")
def _(spark, sf):
    p = K.corpus_phrases(table(spark, sf, "documents"), "text", clean=lambda c: F.col(c))
    return p.select("phrase", "count", F.round("weight", 6).alias("weight"))


@add("k4_corpus_phrases_cleaned")
def _(spark, sf):
    return K.corpus_phrases(table(spark, sf, "documents"), "text")


@add("k5_entity_counts", f"select entity, count(*) as count from documents, (select unnest({S.strings(TOY_ENTITIES + ['the', 'ción'])}) as entity) where contains(lower(text), entity) group by 1")
def _(spark, sf):
    return K.entity_counts(table(spark, sf, "documents"), "text", TOY_ENTITIES + ["the", "ción"])


@add("k5_protect_entities", "select doc_id, replace(replace(replace(lower(text), 'of the', '__entity0__'), 'de la', '__entity1__'), 'the', '__entity2__') as protected, lower(text) as restored from documents")
def _(spark, sf):
    names = ["the", "de la", "of the"]
    d = table(spark, sf, "documents").select("doc_id", K.protect_entities("text", names).alias("protected"))
    return d.select("doc_id", "protected", K.restore_entities("protected", names).alias("restored"))


@add("k6_bag_of_words", f"""with w as (select doc_id, unnest({S.words('text', STOP)}) as term from documents), c as (select doc_id, term, count(*) as n from w group by all),
  v as (select term from c group by 1 having count(*) >= 3 and count(*) <= 0.85 * (select count(*) from documents))
  select doc_id, cast(sum(n) as bigint) as terms, count(*) as kinds from c semi join v using (term) group by 1""")
def _(spark, sf):
    bag = K.bag_of_words(table(spark, sf, "documents"), "doc_id", "text", lambda c: T.words(c, STOP), 3, 0.85)
    return bag.groupBy("doc_id").agg(F.sum("count").alias("terms"), F.count(F.lit(1)).alias("kinds"))


@add("k7_keyword_counts", f"with w as (select unnest({S.words('text', STOP, 3, 10000)}) as word from documents) select word, count(*) as count from w group by 1 order by 2 desc, 1 limit 50")
def _(spark, sf):
    return M.keyword_counts(table(spark, sf, "documents"), "text", 50, STOP)
