"""Queries of this subpackage over the given tables."""

from __future__ import annotations

from newsloom.plans.registry import Registry

REGISTRY = Registry()
add = REGISTRY.add

_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP4_SQL = f"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) as w from documents),
x as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as s from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d)),
f as (select s, min(doc_id) as first from x group by s),
c as (select distinct doc_id, unnest(range(i, i + 50)) as k from x join f using (s) where first < doc_id),
u as (select doc_id, unnest(w) as v, unnest(range(1, len(w) + 1)) as k from d),
t as (select doc_id, count(*) as n, string_agg(v, ' ' order by k) as kept from u anti join c using (doc_id, k) group by doc_id)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join t using (doc_id)"""

_OP6_SQL = f"""with recursive d as (select doc_id, regexp_extract_all({_LOW}, {_SPACED}) as w from documents),
g as (select distinct doc_id, md5(array_to_string(w[i:i + 4], ' ')) as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from g group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as m from g a join g b on a.s = b.s and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * m >= 75 * (x.n + y.n - m)),
e as (select a, b from l union all select b, a from l),
r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a)
select doc_id, coalesce(n, 0)::bigint as n_shingles, least(doc_id, coalesce((select min(b) from r where a = doc_id), doc_id)) as component_id from d left join n using (doc_id)"""

_OP8_SQL = f"""with i as (select item_id::varchar as item, regexp_extract_all({_LOW}, {_ALNUM}) as w from benchmark),
iw as (select distinct item, least(13, len(w)) as n, array_to_string(w[k:k + least(13, len(w)) - 1], ' ') as s
  from (select item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as k from i where len(w) > 0)),
d as (select doc_id, regexp_extract_all({_LOW}, {_ALNUM}) as w from documents),
x as (select doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') as s from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from d, (select distinct n from iw))),
h as (select doc_id, n, k, item from x join iw using (n, s)),
c as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(k, k + n)) as j from h) group by 1),
t as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from h group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit > 0 and 20 * n_hit >= len(w), false) as contaminated from d left join c using (doc_id) left join t using (doc_id)"""


@add("op10_secret_scan")
def op10_secret_scan(spark, sf_dir):
    from newsloom.llm import secrets
    from newsloom.llm.common import read

    return secrets.report(read(spark, sf_dir, "documents"))


@add("op2_token_counts")
def op2_token_counts(spark, sf_dir):
    import public_tokenizers
    from newsloom.llm import token_counts
    from newsloom.llm.common import read

    return token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@add("op7_shard_placement")
def op7_shard_placement(spark, sf_dir):
    from newsloom.llm import sharding
    from newsloom.llm.common import read

    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    return sharding.place(docs, "doc_id", [f"shard-{i:03d}" for i in range(128)]).select("doc_id", "slot", "shard")


@add("op8_decontamination", _OP8_SQL)
def op8_decontamination(spark, sf_dir):
    from newsloom.llm import decontamination
    from newsloom.llm.common import read

    return decontamination.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@add("op3_language_id")
def op3_language_id(spark, sf_dir):
    from newsloom.llm import language
    from newsloom.llm.common import read

    return language.label(read(spark, sf_dir, "documents"))


@add("op5_curve_packing")
def op5_curve_packing(spark, sf_dir):
    import public_tokenizers
    from newsloom.llm import packing
    from newsloom.llm.common import read

    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def _op1_sql() -> str:
    from newsloom.llm import spotsigs

    common = "[" + ", ".join(f"'{a}'" for a in spotsigs.ANCHORS) + "]"

    def signatures(text: str) -> str:
        words = rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+')"
        chain = (f"substr(md5(array_to_string([w[i]] || list_filter(w[i+1:i+{spotsigs.REACH}], lambda x: not list_contains({common}, x))"
                 f"[1:{spotsigs.CHAIN}], ' ')), 1, {spotsigs.DIGITS})")
        places = f"case when list_has_any(w, {common}) then list_filter(range(1, len(w) + 1), lambda i: list_contains({common}, w[i])) else range(1, len(w) + 1) end"
        return f"(select list_sort(list_distinct(list_transform({places}, lambda i: {chain}))) from (select {words} as w))"

    like = ("case when len({a}) = 0 and len({b}) = 0 then 1.0 when len({a}) = 0 or len({b}) = 0 then 0.0 else len(list_intersect({a}, {b}))::double "
            "/ (len({a}) + len({b}) - len(list_intersect({a}, {b}))) end::double")
    return f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
n as (select *, coalesce(lead(text) over (order by doc_id), first_value(text) over (order by doc_id)) as next from d),
e as (select *, left(text, length(text) - length(text) // 2) || left(next, length(text) // 2) as edited from n),
s as (select *, {signatures('text')} as a, {signatures('edited')} as b, {signatures('next')} as c from e)
select doc_id, length(text)::bigint as n_chars, sha256(edited) as edited_sha256, array_to_string(a, ' ') as fingerprint,
  array_to_string(b, ' ') as edited_fingerprint, {like.format(a='a', b='b')} as near_edited, {like.format(a='a', b='c')} as near_next
from s"""


@add("op1_spotsigs", _op1_sql())
def op1_spotsigs(spark, sf_dir):
    from newsloom.llm import spotsigs
    from newsloom.llm.common import read

    return spotsigs.edit_report(read(spark, sf_dir, "documents"))


@add("op4_repeated_phrases", _OP4_SQL)
def op4_repeated_phrases(spark, sf_dir):
    from newsloom.llm import phrases
    from newsloom.llm.common import read

    return phrases.strip_repeats(read(spark, sf_dir, "documents"))


@add("op9_suffix_repeats")
def op9_suffix_repeats(spark, sf_dir):
    from newsloom.llm import suffixes
    from newsloom.llm.common import read

    return suffixes.strip_repeats(read(spark, sf_dir, "documents"))


@add("op6_token_groups", _OP6_SQL)
def op6_token_groups(spark, sf_dir):
    from newsloom.llm import token_groups
    from newsloom.llm.common import read

    return token_groups.near_classes(read(spark, sf_dir, "documents"))


@add("op12_byte_bpe")
def op12_byte_bpe(spark, sf_dir):
    import public_tokenizers
    from newsloom.llm import byte_bpe
    from newsloom.llm.common import read

    return byte_bpe.report(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@add("op13_whitening")
def op13_whitening(spark, sf_dir):
    from newsloom.llm import whitening
    from newsloom.llm.common import read

    return whitening.whiten(read(spark, sf_dir, "embeddings"))


@add("op11_dialogues")
def op11_dialogues(spark, sf_dir):
    from newsloom.llm import dialogues
    from newsloom.llm.common import read

    return dialogues.report(read(spark, sf_dir, "conversations"))
