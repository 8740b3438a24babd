"""Text functions: cleaning chains, tokens, n-grams, sentences (column to column)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from unicodedata import normalize

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from ..resources import words as W
from .columns import ColumnLike, col, let, literal_map, strings

# Java's \s, \w and case folding are ASCII-only without these flags.
SPACE = r"(?U)\s+"


def replace(c: ColumnLike, pattern: str, replacement: str = " ") -> Column:
    return F.regexp_replace(col(c), F.lit(pattern), F.lit(replacement))


def squeeze(c: ColumnLike) -> Column:
    """Collapse whitespace runs to one blank and trim."""
    return F.trim(replace(c, SPACE, " "))


@F.arrow_udf(T.StringType())
def _nfc(texts: pa.Array) -> pa.Array:
    """Texts become strings only some at a time, so that a worker holds little beside its batch."""
    def composed(part: pa.Array) -> pa.Array:
        return pa.array([None if t is None else normalize("NFC", t) for t in part.to_pylist()], pa.string())

    return pa.concat_arrays([composed(texts.slice(at, 100)) for at in range(0, len(texts), 100)] or [pa.array([], pa.string())])


def nfc(c: ColumnLike) -> Column:
    """Canonical composition; the only cleaning step Spark has no function for."""
    return _nfc(col(c))


def drop_entities(c: ColumnLike, hexadecimal: bool = False) -> Column:
    out = replace(replace(c, r"&[a-zA-Z]+;"), r"&#\d+;")
    return replace(out, r"&#x[0-9a-fA-F]+;") if hexadecimal else out


def collapse_repeats(c: ColumnLike, at_least: int) -> Column:
    """Runs of ``at_least`` or more equal characters become two."""
    return replace(c, rf"(.)\1{{{at_least - 1},}}", "$1$1")


def fix_diacritics(c: ColumnLike, fixes: Mapping[str, str] | None = None) -> Column:
    out = col(c)
    for wrong, right in (fixes or W.DIACRITIC_FIXES).items():
        out = replace(out, rf"(?iU)\b{wrong}\b", right)
    return out


def tokens(c: ColumnLike) -> Column:
    """Whitespace tokens, blanks dropped."""
    return F.filter(F.split(col(c), SPACE), lambda w: F.length(w) > 0)


def expand_abbreviations(c: ColumnLike, table: Mapping[str, str] | None = None) -> Column:
    """Replace whole tokens found in the table; other tokens keep their case."""
    mapping = literal_map(table or W.ABBREVIATIONS)
    return F.array_join(
        F.transform(tokens(c), lambda w: F.coalesce(F.try_element_at(mapping, F.lower(w)), w)), " ")


def clean_standard(c: ColumnLike, deep: bool = True, compose: bool = True, squash_repeats: bool = True,
                   abbreviations: Mapping[str, str] | None = None) -> Column:
    """Standard chain: compose, entities, urls, emails, phones, symbols, spelling, abbreviations, case."""
    out = nfc(c) if compose else col(c)
    out = drop_entities(out)
    out = replace(out, r"(?U)https?://\S+", "")
    out = replace(out, r"(?U)\S+@\S+", "")
    out = replace(out, r"(?U)[\d\s().\-]{10,}", "")
    out = replace(out, r"(?U)[^\p{L}\p{N}_\s.,!?;:\-]")
    if deep:
        out = F.lower(expand_abbreviations(fix_diacritics(out), abbreviations))
    out = replace(out, SPACE)
    if squash_repeats:
        out = collapse_repeats(out, 4)
    return F.coalesce(F.trim(out), F.lit(""))


def clean_enhanced(c: ColumnLike, remove_stopwords: bool = False, min_word_length: int = 2, compose: bool = True,
                   squash_repeats: bool = True, stopwords: Iterable[str] | None = None) -> Column:
    """Configurable chain: adds tags, hex entities, ``www.``, short words and stopwords."""
    out = nfc(c) if compose else col(c)
    out = replace(replace(out, r"<[^>]+>"), r"(?s)<!--.*?-->")
    out = drop_entities(out, hexadecimal=True)
    out = replace(replace(out, r"(?U)https?://\S+", ""), r"(?U)www\.\S+", "")
    out = replace(out, r"(?U)\S+@\S+\.\S+", "")
    out = replace(out, r"(?U)[+]?[(]?[0-9]{1,4}[)]?[-\s.]?[(]?[0-9]{1,4}[)]?[-\s.]?[0-9]{1,9}", "")
    out = replace(out, r"(?U)[^\p{L}\p{N}_\s.,!?;:\-()]")
    out = replace(out, SPACE)
    if squash_repeats:
        out = collapse_repeats(out, 3)
    kept = tokens(out)
    if min_word_length > 1:
        kept = F.filter(kept, lambda w: F.length(w) >= min_word_length)
    if remove_stopwords:
        stop = strings(stopwords or sorted(set(W.ENHANCED_STOPWORDS)))
        kept = F.filter(kept, lambda w: ~F.array_contains(stop, F.lower(w)))
    return F.coalesce(F.array_join(kept, " "), F.lit(""))


def clean_for_topics(c: ColumnLike, stopwords: Iterable[str] | None = None, **options: object) -> Column:
    """Standard chain, then stopwords and words of at most two characters dropped."""
    stop = strings(stopwords or W.CLEANER_STOPWORDS)
    kept = F.filter(tokens(clean_standard(c, **options)),
                    lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))
    return F.array_join(kept, " ")


def clean_ingest(c: ColumnLike) -> Column:
    """Ingest chain: tags out, whitespace squeezed, symbols other than basic punctuation out."""
    out = replace(replace(c, r"<[^>]+>", ""), SPACE)
    return F.coalesce(F.trim(replace(out, r"""(?U)[^\p{L}\p{N}_\s.,!?;:\-'"()@#]""", "")), F.lit(""))


def normalize_numbers_text(c: ColumnLike) -> Column:
    """Whitespace and zero-width tidy-up that leaves every digit and separator alone."""
    return strip(replace(replace(c, SPACE), r"[\u200B\u200C\u200D\uFEFF]", ""))


def strip_boilerplate(c: ColumnLike, credit: str = r"(?iU)created by.*?with") -> Column:
    """Credits, hashtags, links and translation notes out."""
    out = replace(c, credit, "")
    out = replace(out, r"(?U)#[\p{L}\p{N}_]+", "")
    out = replace(out, r"(?U)http\S+", "")
    return replace(out, r"(?iU)translate\s+[\p{L}\p{N}_]+", "")


def sentences(c: ColumnLike, min_length: int = 10) -> Column:
    parts = F.transform(F.split(col(c), r"[.!?]+"), lambda s: strip(s))
    return F.filter(parts, lambda s: F.length(s) >= min_length)


def strip(c: ColumnLike) -> Column:
    """Trim every kind of whitespace at both ends."""
    return replace(c, r"(?U)^\s+|\s+$", "")


# A figure with its unit (fixed value).
NUMBER_UNIT = r"(?iU)\d+[.,]?\d*\s*(?:tỷ|triệu|nghìn|%|USD|VND)"


def sentences_with_numbers(c: ColumnLike, pattern: str = NUMBER_UNIT) -> Column:
    return F.filter(F.split(col(c), r"(?U)[.!?]\s+"), lambda s: s.rlike(pattern))


def numbers(c: ColumnLike) -> Column:
    return F.regexp_extract_all(col(c), F.lit(r"(?U)\b\d+(?:[.,]\d+)?\b"), F.lit(0))


# Date shapes, in output order (fixed values).
DATE_PATTERNS = [
    r"\d{1,2}/\d{1,2}/\d{4}",
    r"\d{1,2}-\d{1,2}-\d{4}",
    r"\d{4}-\d{1,2}-\d{1,2}",
    r"(?i)ngày \d{1,2} tháng \d{1,2} năm \d{4}",
]


def dates(c: ColumnLike) -> Column:
    return F.concat(*[F.regexp_extract_all(col(c), F.lit(p), F.lit(0)) for p in DATE_PATTERNS])


def word_count(c: ColumnLike) -> Column:
    return F.size(tokens(c))


def char_count(c: ColumnLike, spaces: bool = False) -> Column:
    return F.length(col(c) if spaces else F.replace(col(c), F.lit(" "), F.lit("")))


def words(c: ColumnLike, stopwords: Iterable[str] | None = None, min_length: int = 2, max_length: int | None = 30) -> Column:
    """Letter runs of the lower-cased text without stopwords, by length (``max_length`` None: any)."""
    stop = strings(sorted(set(W.TOKENIZER_STOPWORDS if stopwords is None else stopwords)))
    return F.filter(
        F.regexp_extract_all(F.lower(col(c)), F.lit(r"\p{L}+"), F.lit(0)),
        lambda w: (F.length(w) >= min_length if max_length is None else F.length(w).between(min_length, max_length)) & ~F.array_contains(stop, w))


def ngrams(items: ColumnLike, n: int, max_length: int | None = None) -> Column:
    """Consecutive ``n`` items joined by a blank."""
    def over(a: Column) -> Column:
        grams = F.when(
            F.size(a) >= n,
            F.transform(F.sequence(F.lit(1), F.size(a) - (n - 1)), lambda i: F.array_join(F.slice(a, i, n), " ")),
        ).otherwise(F.array().cast("array<string>"))
        return F.filter(grams, lambda g: F.length(g) <= max_length) if max_length else grams

    return let(col(items), over)


def phrases(items: ColumnLike, low: int = 1, high: int = 3, caps: Mapping[int, int] | None = None) -> Column:
    """All ``low``- to ``high``-grams; by default bigrams up to 40 and trigrams up to 50 characters."""
    caps = {2: 40, 3: 50} if caps is None else caps
    return let(col(items), lambda a: F.concat(
        *[a if n == 1 else ngrams(a, n, caps.get(n)) for n in range(low, high + 1)]))


def term_runs(items: ColumnLike) -> Column:
    """array<struct<term, count>> of an array's distinct non-NULL items, counted inside the row: equal items lie side by side once sorted."""
    def runs(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda i, j: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, j + 1), n) - i).alias("count"))))

    return let(F.sort_array(F.array_compact(col(items))), lambda s: F.when(F.size(s) > 0, runs(s)))


def hashtags(c: ColumnLike) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(col(c)), F.lit(r"#([\p{L}\p{N}_]+)"), F.lit(1)))


def tidy_phrase(c: ColumnLike, edge_words: Iterable[str] | None = None) -> Column:
    """Underscores to blanks, then one stopword cut from the front and one from the back."""
    edge = "|".join(edge_words or W.PHRASE_EDGE_WORDS)
    return F.trim(replace(squeeze(replace(c, "_", " ")), rf"(?iU)^(?:{edge})\s+|\s+(?:{edge})$", ""))


def match_text(c: ColumnLike) -> Column:
    """Lower case, punctuation to blanks, squeezed: the form whole-word matching compares."""
    return squeeze(replace(F.lower(col(c)), r"(?U)[^\p{L}\p{N}_\s]"))


def headline(c: ColumnLike, limit: int = 100) -> Column:
    """First ``limit`` characters, with an ellipsis when something was cut."""
    t = col(c)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("..."))).otherwise(t)


def occurrences(text: ColumnLike, term: str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    t = col(text)
    return ((F.length(t) - F.length(F.replace(t, F.lit(term), F.lit("")))) / len(term)).cast("int")
