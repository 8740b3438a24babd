"""Fragments of the comparison SQL shared by several queries."""

WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_WS = WS.replace("[", "[^", 1).replace(r"\s", r"\s", 1)
WORD = r"[\p{L}\p{N}_]"


def rx(text: str, pattern: str, by: str = " ") -> str:
    return f"regexp_replace({text}, '{pattern}', '{by}', 'g')"


def squeeze(text: str) -> str:
    return f"trim({rx(text, WS + '+')})"


def strip(text: str) -> str:
    return rx(text, f"^{WS}+|{WS}+$", "")


def tokens(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{WS}+'), lambda w: length(w) > 0)"


def words(text: str, stop: list[str], low: int = 2, high: int = 30) -> str:
    return (f"list_filter(regexp_extract_all(lower({text}), '\\p{{L}}+'), "
            f"lambda w: length(w) between {low} and {high} and not list_contains({strings(stop)}, w))")


def strings(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def grams(items: str, n: int, cap: int | None = None) -> str:
    parts = " || ' ' || ".join(f"{items}[i+{k}]" if k else f"{items}[i]" for k in range(n))
    out = f"list_transform(range(1, greatest(len({items})-{n - 2}, 1)), lambda i: {parts})"
    return f"list_filter({out}, lambda g: length(g) <= {cap})" if cap else out


def title(text: str = "text", limit: int = 100) -> str:
    return f"case when length({text}) > {limit} then substring({text}, 1, {limit}) || '...' else {text} end"


# The mention fact over `events`, as mention_fact() builds it.
MENTIONS = """mentions as (
  select event_id as article_id, ts as published_at, user_id % 10 as topic_id, 'topic ' || (user_id % 10) as topic_name,
         'site' || user_id || '.vn' as source_domain, event_type as emotion, props as title,
         case event_type when 'error' then 'negative' when 'purchase' then 'positive' when 'signup' then 'positive'
              else 'neutral' end as sentiment_group
  from events)"""

# The article table over `documents` and `labels`, as articles() builds it.
ARTICLES = """articles as (
  select d.doc_id as article_id, d.source as domain, d.text as content,
         case when length(d.text) > 100 then substring(d.text, 1, 100) || '...' else d.text end as title,
         timestamp '2024-01-01' + to_days(cast(d.doc_id % 30 as int)) as published_at,
         case when l.toxic = 1 then 'negative' when l.quality = 1 then 'positive' else 'neutral' end as sentiment_group,
         d.doc_id % 7 as topic_id
  from documents d left join labels l using (doc_id))"""
