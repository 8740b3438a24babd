"""Recall, gating, scoring and packing of articles for a question about a place and a period."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import dates as D, text as X
from ..functions.columns import ColumnLike, col, let, settled
from ..sources.files import listing
from .ranking import running_total, top_k

# Search terms after the place and the year, gate words and scoring words (fixed values).
TERMS = ["GRDP", "tổng sản phẩm", "tăng trưởng", "kinh tế", "GDP", "quy mô", "phát triển", "bình quân", "công nghiệp", "nông nghiệp",
         "dịch vụ", "xuất khẩu", "thu hút đầu tư"]
DOMAIN_WORDS = ["grdp", "gdp", "tổng sản phẩm", "tăng trưởng", "tỷ đồng", "nghìn tỷ", "triệu đồng", "phát triển kinh tế",
                "thu hút đầu tư", "xuất khẩu", "công nghiệp", "nông nghiệp"]
SCORE_WORDS = ["grdp", "tăng trưởng", "tỷ đồng", "phát triển"]
HAS_NUMBER = r"(?U)\d+[.,]?\d*\s*tỷ|\d+[.,]?\d*%|\d+[.,]?\d*\s*triệu"


def search_terms(place: str, year: int, quarter: int | None = None, terms: Sequence[str] = TERMS) -> list[str]:
    out = [place, f"năm {year}", *terms]
    return out + [f"quý {quarter}", f"Q{quarter}", f"{quarter} tháng đầu năm"] if quarter else out


def _any(text: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def recall(articles: DataFrame, terms: Sequence[str], year: int, k: int, title: str = "title", content: str = "content",
           published: str = "published_at", key: str = "article_id", first_terms: int = 5) -> DataFrame:
    """Articles of year - 1 to year + 1 with any of the first terms; longest, then newest first."""
    low = F.lower(F.concat_ws("\n", title, content))
    rows = articles.filter(D.within(published, datetime(year - 1, 1, 1), datetime(year + 2, 1, 1)))
    # Bound once: the text is lower-cased once per row and not once per term.
    rows = rows.filter(let(low, lambda t: _any(t, [w.lower() for w in terms[:first_terms]])))
    return top_k(rows, 3 * k, F.length(content).desc(), F.desc(published), F.col(key))


def gate(articles: DataFrame, place: str, year: int, title: str = "title", content: str = "content",
         domain_words: Sequence[str] = DOMAIN_WORDS) -> DataFrame:
    """Articles that name the place, the year (or the one before) and a domain word."""
    low = F.lower(F.concat_ws(" ", title, content))
    return articles.filter(let(low, lambda t: t.contains(place.lower()) & _any(t, [str(year), f"năm {year - 1}"]) & _any(t, domain_words)))


def relevance(articles: DataFrame, place: str, year: int, quarter: int | None = None, title: str = "title", content: str = "content",
              published: str = "published_at", words: Sequence[str] = SCORE_WORDS, long_text: int = 2000) -> DataFrame:
    """Adds ``score`` and ``has_numbers``."""
    low = F.col("_low")
    when = lambda condition, points: F.when(F.coalesce(condition, F.lit(False)), F.lit(points)).otherwise(F.lit(0.0))
    score = when(F.lower(title).contains(place.lower()), 2.0) + when(low.contains(f"năm {year}"), 3.0)
    if quarter:
        score = score + when(low.contains(f"quý {quarter}"), 2.0)
    for w in words:
        score = score + X.occurrences(low, w) * 0.5
    middle = F.lit(datetime(year, 6, 30)).cast("date")
    score = score + when(F.length(content) > long_text, 1.0) + when(F.abs(F.datediff(F.to_date(published), middle)) < 180, 1.0)
    return (articles.withColumn("_low", F.lower(F.concat_ws(" ", title, content))).withColumn("score", score)
            .withColumn("has_numbers", low.rlike(HAS_NUMBER)).drop("_low"))


def rank_by_relevance(scored: DataFrame, k: int, key: str = "article_id") -> DataFrame:
    return top_k(scored, k, F.desc("score"), F.desc("has_numbers"), F.col(key))


def hybrid_search(articles: DataFrame, place: str, year: int, quarter: int | None = None, k: int = 10, **names: str) -> DataFrame:
    """Recall, gate, score and rank."""
    key = names.get("key", "article_id")
    part = {n: names[n] for n in ("title", "content") if n in names}
    dated = {**part, **({"published": names["published"]} if "published" in names else {})}
    found = recall(articles, search_terms(place, year, quarter), year, k, key=key, **dated)
    return rank_by_relevance(relevance(gate(found, place, year, **part), place, year, quarter, **dated), k, key)


def within_budget(rows: DataFrame, group: Sequence[str], order: Sequence[Column], size: str, limit: int | float) -> DataFrame:
    """Best rows per group while their summed size stays within the limit; stops at the first overflow."""
    return running_total(rows, size, order, "used", group).filter(F.col("used") <= limit)


def context_snippet(content: ColumnLike, head: int = 1500, tail: int = 500) -> Column:
    """Opening and close of a long text, the whole of a short one."""
    c = col(content)
    return F.when(F.length(c) > head + tail, F.concat(F.substring(c, 1, head), F.lit("..."), F.right(c, F.lit(tail)))).otherwise(F.substring(c, 1, head))


def pack_context(ranked: DataFrame, max_tokens: int = 6000, top: int = 5, key: str = "article_id", title: str = "title", content: str = "content",
                 published: str = "published_at", url: str | None = None) -> DataFrame:
    """The best articles as numbered snippets, until the character budget (three per token) is spent.

    Cutting each text to its opening and close is the feature; only ``top`` rows are numbered.
    """
    best = top_k(ranked, top, F.desc("score"), F.desc("has_numbers"), F.col(key))
    w = Window.orderBy(F.desc("score"), F.desc("has_numbers"), key)
    numbered = best.withColumn("position", F.row_number().over(w).cast("bigint"))
    link = F.coalesce(F.col(url), F.lit("N/A")) if url else F.lit("N/A")
    snippet = F.concat(
        F.lit("\n[Nguồn "), F.col("position").cast("string"), F.lit("] "), F.coalesce(F.col(title), F.lit("")), F.lit("\nURL: "), link, F.lit("\nNgày: "),
        F.coalesce(F.date_format(published, "dd/MM/yyyy"), F.lit("N/A")), F.lit("\nRelevance Score: "), F.format_string("%.2f", F.col("score")),
        F.lit("\n\n"), context_snippet(content), F.lit("\n\n---\n"))
    sized = numbered.withColumn("snippet", snippet).withColumn("_size", F.length("snippet"))
    used = F.sum("_size").over(Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    return sized.withColumn("used", used).filter(F.col("used") <= max_tokens * 3).drop("_size")


def spaced(positions: ColumnLike, distance: int, keep: int) -> Column:
    """Walk an ordered position array and keep those far enough from every kept one, at most ``keep``."""
    start = F.array().cast("array<int>")
    far = lambda kept, p: (F.size(kept) < keep) & ~F.exists(kept, lambda k: F.abs(k - p) < distance)
    return F.aggregate(col(positions), start, lambda kept, p: F.when(far(kept, p), F.concat(kept, F.array(p))).otherwise(kept))


def listing_search(posts: DataFrame, text: str, order: Sequence[Column], page: int = 1, size: int = 20, title: str = "title",
                   content: str = "content", **facets: object) -> DataFrame:
    """Case-insensitive search in title or content with facet filters, paged."""
    rows = posts.filter(F.lower(title).contains(text.lower()) | F.lower(content).contains(text.lower()))
    for name, wanted in facets.items():
        rows = rows.filter(F.col(name) == F.lit(wanted))
    return listing(rows, order, page, size)


def topic_articles(articles: DataFrame, assignments: DataFrame, key: str, topic: int, min_confidence: float, page: int = 1, size: int = 20) -> DataFrame:
    """Articles of a topic above a confidence, most confident first."""
    links = assignments.filter((F.col("topic_id") == topic) & (F.col("confidence") >= min_confidence)).select(key, "confidence")
    return listing(articles.join(links, key), [F.desc("confidence"), F.col(key)], page, size)


def bm25(docs: DataFrame, key: str, tokens: Column, terms: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of the documents that hold any term.

    Term counts stay inside the row; the corpus statistics are one small
    aggregate over the same scan.
    """
    names = list(dict.fromkeys(terms))

    def occurrences(ts: Column, word: str) -> Column:
        return F.size(F.filter(ts, lambda t: t == word))

    counted = settled(docs.select(key, tokens.alias("ts")), "c", let(F.col("ts"), lambda ts: F.struct(
        F.size(ts).alias("n"), *[occurrences(ts, w).alias(f"t{i}") for i, w in enumerate(names)]))).select(key, "c.*")
    stats = counted.agg(F.count(F.lit(1)).alias("N"), F.avg("n").alias("avg"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(names))])
    corpus = stats.select(F.struct("*").alias("s")).scalar()
    rows = counted.withColumn("s", corpus)
    score = F.lit(0.0)
    for i in range(len(names)):
        tf, df = F.col(f"t{i}"), F.col("s")[f"d{i}"]
        idf = F.log(1 + (F.col("s")["N"] - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / F.col("s")["avg"]))
    return rows.select(key, score.alias("score")).filter("score > 0")
