"""Dictionary and vector classification of texts.

Small dictionaries reach every row as one array (size checked, see ``attach_table``), so no text is shuffled or copied per
keyword; large ones meet the texts by grams (``containment``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from ..functions.columns import ColumnLike, attach_table, col, contained, contained_words, in_blocks, let, lookup, settled, sum_array
from ..resources import lexicon as L
from ..session import shared_checkpoint
from ..sources.merge import keyed_load
from .containment import contained_terms
from .ranking import first_per_key, overall_rank


# --- Emotion -------------------------------------------------------------------------------------------------------

def _emotion_score(text: Column, marked: Column, entry: Column) -> Column:
    """Score of one emotion: phrases once, single terms once per token that contains them."""
    phrase_hits = F.size(F.filter(entry["phrases"], lambda p: text.contains(p)))
    present = F.filter(entry["words"], lambda w: text.contains(w))
    per_word = F.transform(present, lambda w: F.aggregate(
        marked, F.lit(0.0), lambda acc, m: acc + F.when(m["token"].contains(w), m["factor"]).otherwise(F.lit(0.0))))
    raw = (F.lit(1.5) * phrase_hits + sum_array(per_word)) * entry["weight"]
    return F.greatest(F.lit(0.0), raw)


def marked_tokens(text: ColumnLike, intensifiers: Sequence[str] = L.INTENSIFIERS, diminishers: Sequence[str] = L.DIMINISHERS,
                  negations: Sequence[str] = L.NEGATIONS) -> Column:
    """Tokens with the factor their predecessor gives them: 1.5, 0.7, -0.5 or 1."""
    def factor(previous: Column) -> Column:
        return (F.when(previous.isin(*negations), F.lit(-0.5)).when(previous.isin(*intensifiers), F.lit(1.5))
                .when(previous.isin(*diminishers), F.lit(0.7)).otherwise(F.lit(1.0)))

    return let(X.tokens(col(text)), lambda ws: F.transform(ws, lambda w, i: F.struct(
        w.alias("token"), F.coalesce(factor(F.get(ws, i - 1)), F.lit(1.0)).alias("factor"))))


def emotion_scores(docs: DataFrame, text: str, lexicon: DataFrame, output: str = "scores", **modifiers: Sequence[str]) -> DataFrame:
    """Adds array<struct(rank, emotion, group, score)> in lexicon order."""
    out = attach_table(docs, lexicon.select("rank", "emotion", "group", "weight", "words", "phrases"), "_lex", 500)
    scored = let(F.lower(col(text)), lambda t: let(marked_tokens(t, **modifiers), lambda m: F.transform("_lex", lambda e: F.struct(
        e["rank"].alias("rank"), e["emotion"].alias("emotion"), e["group"].alias("group"), _emotion_score(t, m, e).alias("score")))))
    return settled(out, output, scored).drop("_lex")


def emotion_verdict(docs: DataFrame, scores: str = "scores", neutral: str = "trung_lập", neutral_group: str = "neutral") -> DataFrame:
    """Adds emotion, sentiment_group, confidence and the normalised ``emotion_scores`` map."""
    best = F.element_at(F.array_sort(scores, lambda a, b: F.when(a["score"] != b["score"], F.signum(b["score"] - a["score"]))
                                     .otherwise(F.signum(a["rank"] - b["rank"])).cast("int")), 1)
    out = docs.withColumn("_best", best).withColumn(
        "_sum", F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + s["score"])).withColumn("_total", F.col("_sum") + 0.01)
    found, strong = F.col("_sum") > 0, F.col("_best.score") >= 0.5
    norm = F.map_from_entries(F.transform(scores, lambda s: F.struct(
        s["emotion"], F.when(found, F.round(s["score"] / F.col("_total"), 4)).otherwise(F.lit(0.0)))))
    sure = F.least(F.lit(0.95), F.lit(0.4) + F.col("_best.score") / (F.col("_total") + 0.1) * 0.6)
    return (out.withColumn("emotion", F.when(found & strong, F.col("_best.emotion")).otherwise(F.lit(neutral)))
            .withColumn("sentiment_group", F.when(found & strong, F.col("_best.group")).otherwise(F.lit(neutral_group)))
            .withColumn("confidence", F.when(found, F.round(sure, 4)).otherwise(F.lit(0.6)))
            .withColumn("emotion_scores", norm).drop("_best", "_sum", "_total"))


def analyze_emotion(docs: DataFrame, text: str, lexicon: DataFrame | None = None, **modifiers: Sequence[str]) -> DataFrame:
    table = lexicon if lexicon is not None else L.emotion_table(docs.sparkSession)
    return emotion_verdict(emotion_scores(docs, text, table, "scores", **modifiers), "scores").drop("scores")


def emotion_group(emotion: ColumnLike, groups: dict[str, str] | None = None) -> Column:
    return lookup(groups or {e: g for e, (g, _) in L.EMOTIONS.items()}, emotion)


# --- Category, field, routing --------------------------------------------------------------------------------------

#: Tables up to so many entries and keywords travel to the texts as one array; larger ones meet them by grams, with the same hits.
ARRAY_ENTRIES, ARRAY_KEYWORDS = 2000, 5000


def _fits(table: DataFrame) -> bool:
    size = table.limit(ARRAY_ENTRIES + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("keywords")), F.lit(0)).alias("k")).first()
    return size["n"] <= ARRAY_ENTRIES and size["k"] <= ARRAY_KEYWORDS


def _keyword_hits(docs: DataFrame, text: Column, table: DataFrame, names: Sequence[str], whole_words: bool = False) -> DataFrame:
    """Adds ``_hits``: array of the table's entries with the keywords found in the text.

    Of a large table only entries with a keyword in the text are listed.
    """
    if not _fits(table):
        return _large_keyword_hits(docs, text, table, names, whole_words)
    out = attach_table(docs, table.select("rank", *names, "keywords"), "_dict", ARRAY_ENTRIES)
    find = contained_words if whole_words else contained
    # The text is bound first, so it is prepared once per row and not once per entry.
    hits = let(text, lambda t: F.transform("_dict", lambda e: F.struct(
        e["rank"].alias("rank"), *[e[n].alias(n) for n in names], F.size(e["keywords"]).alias("size"),
        find(t, e["keywords"]).alias("found"))))
    return settled(out, "_hits", hits).drop("_dict")


def _large_keyword_hits(docs: DataFrame, text: Column, table: DataFrame, names: Sequence[str], whole_words: bool) -> DataFrame:
    """As :func:`_keyword_hits`, for dictionaries of any size: keywords meet the texts by their rarest grams."""
    rows = shared_checkpoint(docs.withColumn("_row", F.monotonically_increasing_id()).withColumn("_body", text))
    blank = F.lit(" ") if whole_words else F.lit("")
    entries = table.select("rank", *names, F.size("keywords").alias("size"), F.posexplode("keywords").alias("place", "keyword")).withColumn(
        "term", F.concat(blank, F.col("keyword"), blank))
    pairs = contained_terms(rows, "_row", "_body", entries.select("term")).select("_row", F.explode("found").alias("term"))
    found = pairs.join(entries, "term").groupBy("_row", "rank", *names, "size").agg(F.sort_array(F.collect_list(F.struct("place", "keyword"))).alias("f"))
    entry = F.struct("rank", *names, "size", F.transform("f", lambda x: x["keyword"]).alias("found"))
    hits = found.groupBy("_row").agg(F.sort_array(F.collect_list(entry)).alias("_hits"))
    joined = rows.join(hits, "_row", "left").drop("_row", "_body")
    return joined.withColumn("_hits", F.coalesce("_hits", F.array().cast(hits.schema["_hits"].dataType)))


def _best_by(hits: str, score) -> Column:
    """Entry with the highest score, the smallest rank among equals."""
    ranked = F.transform(hits, lambda h: F.struct(score(h).alias("score"), (-h["rank"]).alias("order"), h.alias("hit")))
    return F.array_max(ranked)


def classify_category(docs: DataFrame, content: str, title: str | None = None, table: DataFrame | None = None,
                      other: str = "khac", matches: int = 10) -> DataFrame:
    """Adds category, category_confidence, matched_keywords and all_scores: a keyword counts its words, once."""
    text = F.lower(F.concat_ws(" ", *[F.col(c) for c in (title, content) if c]))
    out = _keyword_hits(docs, text, table if table is not None else L.category_table(docs.sparkSession), ["category"])
    weight = lambda h: sum_array(F.transform(h["found"], lambda k: F.size(F.split(k, " ")).cast("double")))
    out = out.withColumn("_best", _best_by("_hits", weight)).withColumn(
        "_total", F.aggregate(F.transform("_hits", weight), F.lit(0.01), lambda a, v: a + v))
    found = F.coalesce(F.col("_best.score") > 0, F.lit(False))
    scores = F.map_from_entries(F.transform("_hits", lambda h: F.struct(h["category"], F.round(weight(h) / F.col("_total"), 4))))
    return (out.withColumn("category", F.when(found, F.col("_best.hit.category")).otherwise(F.lit(other)))
            .withColumn("category_confidence", F.when(found, F.round(F.least(F.lit(0.95), F.lit(0.3) + F.col("_best.score") / 10 * 0.65), 4)).otherwise(F.lit(0.5)))
            .withColumn("matched_keywords", F.when(found, F.slice(F.col("_best.hit.found"), 1, matches)).otherwise(F.array().cast("array<string>")))
            .withColumn("all_scores", F.when(found, scores)).drop("_hits", "_best", "_total"))


def classify_field(docs: DataFrame, texts: Sequence[str], fields: DataFrame) -> DataFrame:
    """Rows with a field: most whole-word keywords win, then the smallest order; unmatched rows are left out.

    ``fields`` has (rank, field, keywords) with keywords in ``match_text`` form.
    """
    padded = F.concat(F.lit(" "), X.match_text(F.concat_ws(" ", *texts)), F.lit(" "))
    out = _keyword_hits(docs, padded, fields, ["field"], whole_words=True)
    out = out.withColumn("_best", _best_by("_hits", lambda h: F.size(h["found"]))).filter(F.col("_best.score") > 0)
    return (out.withColumn("field", F.col("_best.hit.field"))
            .withColumn("confidence", F.least(F.lit(1.0), F.col("_best.score") / 5.0))
            .withColumn("matched_keywords", F.col("_best.hit.found")).withColumn("method", F.lit("keyword")).drop("_hits", "_best"))


def classify_new(docs: DataFrame, done: DataFrame, key: str, texts: Sequence[str], fields: DataFrame, force: bool = False) -> DataFrame:
    """Field classification of the documents not classified yet (all with ``force``)."""
    return classify_field(docs if force else docs.join(done.select(key).distinct(), key, "left_anti"), texts, fields)


def route_labels(docs: DataFrame, text: Column, table: DataFrame, label: str = "category") -> DataFrame:
    """Adds ``labels``: every label with at least one keyword in the text, in rank order."""
    out = _keyword_hits(docs, text, table, [label])
    return out.withColumn("labels", F.transform(F.filter("_hits", lambda h: F.size(h["found"]) > 0), lambda h: h[label])).drop("_hits")


def route_indicators(docs: DataFrame, title: str, content: str, url: str, table: DataFrame, min_keywords: int = 2,
                     lead: int = 500) -> DataFrame:
    """Adds ``indicators``: by url or title pattern; where none fits, by two keywords in the title and lead.

    ``table`` has (rank, indicator, url_patterns, title_patterns, keywords), lower case. The lead of 500
    characters is part of the rule, not a shortcut.
    """
    low_url, low_title = F.lower(F.coalesce(F.col(url), F.lit(""))), F.lower(F.coalesce(F.col(title), F.lit("")))
    sample = F.lower(F.concat_ws(" ", F.coalesce(F.col(title), F.lit("")), F.substring(F.coalesce(F.col(content), F.lit("")), 1, lead)))
    out = attach_table(docs, table.select("rank", "indicator", "url_patterns", "title_patterns", "keywords"), "_dict", 500)
    by_pattern = let(F.struct(low_url.alias("u"), low_title.alias("h")), lambda d: F.filter(
        "_dict", lambda e: F.exists(e["url_patterns"], lambda p: d["u"].contains(p)) | F.exists(e["title_patterns"], lambda p: d["h"].contains(p))))
    by_keyword = let(sample, lambda s: F.filter(
        "_dict", lambda e: F.size(F.filter(e["keywords"], lambda k: s.contains(k))) >= min_keywords))
    out = out.withColumn("_p", by_pattern)
    chosen = F.when(F.size("_p") > 0, F.col("_p")).otherwise(by_keyword)
    return (out.withColumn("indicators", F.transform(chosen, lambda e: e["indicator"]))
            .withColumn("confidence", F.when(F.size("indicators") > 0, F.lit(0.9)).otherwise(F.lit(0.0)))
            .drop("_p", "_dict"))


# --- Custom topics -------------------------------------------------------------------------------------------------

def topic_vectors(samples: DataFrame, topic: str, vector: str) -> DataFrame:
    """Mean of the normalised sample vectors of each topic, from exploded positions (partial sums per task)."""
    norm = F.sqrt(F.aggregate(F.transform(vector, lambda v: v.cast("double") * v), F.lit(0.0), lambda a, v: a + v))
    cells = samples.select(topic, norm.alias("n"), F.posexplode(vector).alias("pos", "v"))
    means = cells.groupBy(topic, "pos").agg(F.avg(F.col("v") / F.col("n")).alias("m"))
    return means.groupBy(topic).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("topic_vector"))


def dot(a: ColumnLike, b: ColumnLike) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def embedding_score(vector: ColumnLike, topic_vector: ColumnLike) -> Column:
    """Cosine of a text vector with a topic vector, cut to [0, 1]; the text vector is normalised here."""
    v = col(vector)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(v, topic_vector) / F.sqrt(dot(v, v))))


#: Topics that travel as one array.
TOPICS = 2000


def classify_topics(docs: DataFrame, text: str, topics: DataFrame, method: str = "hybrid", vector: str | None = None,
                    min_confidence: float | None = None) -> DataFrame:
    """One row per document and active topic with keyword, embedding and final score.

    ``topics``: (topic_id, name, keywords, negative_keywords, keywords_weight, example_weight, min_confidence,
    is_active[, topic_vector]). The topic table travels as one checked array, a larger one
    as several, each with a scan of its own; a row is emitted per topic only after its score is known.
    """
    blocks = in_blocks(topics, "topic_id", TOPICS)
    if len(blocks) > 1:
        return reduce(DataFrame.unionByName, [classify_topics(docs, text, b, method, vector, min_confidence) for b in blocks])
    if method not in ("keyword", "embedding", "hybrid"):
        raise ValueError(f"unknown method {method!r}")
    active = topics.filter("is_active")
    if "topic_vector" not in topics.columns:
        active = active.withColumn("topic_vector", F.lit(None).cast("array<double>"))
    table = active.select(F.col("topic_id").alias("rank"), "topic_id", "name", "keywords", "negative_keywords", "keywords_weight",
                          "example_weight", "min_confidence", "topic_vector")
    out = attach_table(docs, table, "_topics", TOPICS)
    vec = F.col(vector) if vector else F.lit(None).cast("array<double>")

    def score(body: Column, t: Column) -> Column:
        hits = lambda words: F.size(F.filter(words, lambda k: body.contains(F.lower(k))))
        n = F.size(t["keywords"])
        keyword = F.when(n > 0, hits(t["keywords"]) / n).otherwise(F.lit(0.0))
        return F.struct(t["topic_id"].alias("topic_id"), t["name"].alias("name"), keyword.alias("keyword"),
                        (hits(t["negative_keywords"]) > 0).alias("negative"), t["keywords_weight"].alias("kw"),
                        t["example_weight"].alias("ew"), t["min_confidence"].alias("low"), t["topic_vector"].alias("tv"))

    scores = let(F.lower(F.col(text)), lambda body: F.transform("_topics", lambda t: score(body, t)))
    rows = (out.select(*docs.columns, F.explode(scores).alias("s")).select(*docs.columns, "s.*")
            .withColumn("_far", F.lit(method == "hybrid") & (F.col("keyword") < 0.05)))
    near = F.coalesce(embedding_score(vec, F.col("tv")), F.lit(0.0))
    embedding = F.lit(None).cast("double") if method == "keyword" else F.when(F.col("_far"), F.lit(0.0)).otherwise(near)
    rows = rows.withColumn("embedding", embedding)
    mixed = (F.col("kw") * F.col("keyword") + F.col("ew") * F.col("embedding")) / (F.col("kw") + F.col("ew"))
    final = {"keyword": F.col("keyword"), "embedding": F.col("embedding"),
             "hybrid": F.when(F.col("_far"), F.lit(0.0)).otherwise(mixed)}[method]
    rows = rows.withColumn("confidence", final * F.when(F.col("negative"), F.lit(0.3)).otherwise(F.lit(1.0)))
    floor = F.lit(min_confidence) if min_confidence is not None else F.col("low")
    return rows.select(
        *docs.columns, "topic_id", F.col("name").alias("topic_name"), F.round("keyword", 4).alias("keyword_score"),
        F.round("embedding", 4).alias("embedding_score"), (F.col("confidence") >= floor).alias("is_accepted"),
        F.round("confidence", 4).alias("confidence"), F.lit(method).alias("method"))


def save_assignments(existing: DataFrame, scored: DataFrame, key: str) -> DataFrame:
    """Accepted assignments upserted on (document, topic)."""
    accepted = scored.filter("is_accepted").select(key, "topic_id", "confidence", "method")
    return keyed_load(existing, accepted, [key, "topic_id"], "update")


def topic_counts(assignments: DataFrame, topics: DataFrame) -> DataFrame:
    """Articles per topic, zero included."""
    counts = assignments.groupBy("topic_id").agg(F.count(F.lit(1)).alias("article_count"))
    return topics.select("topic_id", "name").join(counts, "topic_id", "left").withColumn(
        "article_count", F.coalesce("article_count", F.lit(0)))


def primary_topic(assignments: DataFrame, key: str) -> DataFrame:
    """Most confident topic per document, the smallest id among equals."""
    return first_per_key(assignments.select(key, "topic_id", "confidence"), [key], [-F.col("confidence"), F.col("topic_id")])


def sentiment_facts(articles: DataFrame, key: str, text: str, assignments: DataFrame, lexicon: DataFrame | None = None,
                    **modifiers: Sequence[str]) -> DataFrame:
    """Article columns with emotion, group, confidence, scores and the primary topic (NULL when there is none)."""
    scored = analyze_emotion(articles, text, lexicon, **modifiers)
    return scored.join(primary_topic(assignments, key).select(key, "topic_id"), key, "left")


def split_by_length(articles: DataFrame, text: str, short: int = 200, trainable: int = 100) -> DataFrame:
    """Adds ``is_short`` (< 200 characters) and ``is_trainable`` (> 100)."""
    n = F.length(F.col(text))
    return articles.withColumn("is_short", F.coalesce(n < short, F.lit(True))).withColumn("is_trainable", F.coalesce(n > trainable, F.lit(False)))


# Share of candidates taken per priority (fixed values).
PRIORITY_SHARE = {"high": 0.10, "balanced": 0.30, "low": 0.80}


def enrichment_candidates(articles: DataFrame, key: str, length: str, score: str, forced: Column, priority: str = "balanced",
                          cost_per_item: float = 1.0, budget: float | None = None, min_length: int = 500) -> DataFrame:
    """Forced candidates and the best share of the rest, best first, until the budget is spent.

    The cut-off rank comes from counts, not from sorting everything in one task.
    """
    able = articles.filter(F.col(length) >= min_length).withColumn("forced", F.coalesce(forced, F.lit(False)))
    order = [F.desc("forced"), F.desc(score), F.col(key)]
    counts = able.agg(F.count_if("forced").alias("f"), F.count(F.lit(1)).alias("n"))
    share = PRIORITY_SHARE[priority]
    take = counts.select((F.col("f") + F.ceil((F.col("n") - F.col("f")) * share)).alias("k")).scalar()
    # Only keys and scores are sorted; the chosen rows are looked up afterwards.
    ranked = overall_rank(able.select(key, "forced", score), order, "position").select(key, "position")
    chosen = able.join(ranked.filter(F.col("position") <= take), key)
    if budget is not None:
        chosen = chosen.filter(F.col("position") * cost_per_item <= budget)
    return chosen


def category_fields(docs: DataFrame, category: str, fields: dict[str, str] | None = None, other: str = "other") -> DataFrame:
    """Documents per field of their category."""
    field = F.coalesce(lookup(fields or L.CATEGORY_FIELDS, category), F.lit(other))
    return docs.groupBy(field.alias("field")).agg(F.count(F.lit(1)).alias("n"))
