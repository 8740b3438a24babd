"""Dictionaries, searches and counts beyond the sizes that one array or one task can hold."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.operators import classify as C, containment, dedup as D, topics as L, vectors as V

WORDS = [a + b + c for a in "bdgklmnprst" for b in ("a", "e", "i", "o", "u", "ươ") for c in ("n", "ng", "t", "m", "")]


def texts(seed, count, size=60):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, size)))) for i in range(count)]


def test_many_terms(spark):
    """200 000 terms: the same hits as looking each of them up in each text."""
    rng = random.Random(2)
    terms = list({" ".join(rng.choices(WORDS, k=rng.randint(1, 3))) for _ in range(260_000)} | {"a", "ng", "tan", "", "ươ"})[:200_000] + ["a", "ng", "ươ", "", None]
    docs = texts(3, 60) + [(900, None), (901, ""), (902, "a"), (903, "ban " * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r["doc_id"]: sorted(r["found"]) for r in containment.contained_terms(df, "doc_id", "text", spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    distinct = {t for t in terms if t}
    assert found == {i: hit for i, t in docs if t and (hit := sorted(k for k in distinct if k in t))}
    assert containment.contained_terms(df, "doc_id", "text", spark.createDataFrame([("",)], "term string")).count() == 0


@pytest.mark.parametrize("whole", [False, True])
def test_large_tables_hit_like_small_ones(spark, monkeypatch, whole):
    rng = random.Random(4)
    table = spark.createDataFrame([(i, f"c{i % 50}", rng.sample(WORDS, 3) + ["b n", "zzz"]) for i in range(400)], "rank int, category string, keywords array<string>")
    docs = spark.createDataFrame(texts(5, 80) + [(900, None)], "doc_id long, text string")
    text = F.concat(F.lit(" "), F.col("text"), F.lit(" ")) if whole else F.lower("text")

    def hits():
        rows = C._keyword_hits(docs, text, table, ["category"], whole).collect()
        return {r["doc_id"]: [tuple(h) for h in r["_hits"] or [] if h["found"]] for r in rows}

    small = hits()
    monkeypatch.setattr(C, "ARRAY_ENTRIES", 10)
    assert hits() == small


def test_more_categories_than_an_array_holds(spark):
    """6 000 entries with 120 000 keywords."""
    rng = random.Random(6)
    words = [f"{a} {b}" for a in WORDS for b in WORDS]
    entries = [(i, f"c{i}", rng.sample(words, 20)) for i in range(6000)]
    docs = texts(7, 40, 20)
    table = spark.createDataFrame(entries, "rank int, category string, keywords array<string>")
    got = C.classify_category(spark.createDataFrame(docs, "doc_id long, text string"), "text", table=table).collect()
    assert len(got) == len(docs)
    for r in got:
        weight = {c: 2 * sum(k in r["text"] for k in ks) for _, c, ks in entries}
        best = max(weight.values())
        assert r["category"] == (next(c for _, c, _ in entries if weight[c] == best) if best else "khac")


def test_more_topics_than_an_array_holds(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, f"t{i}", rng.sample(WORDS, 3), rng.sample(WORDS, 1), 0.5, 0.5, 0.2, True, [rng.random() for _ in range(4)]) for i in range(40)]
    topics = spark.createDataFrame(rows, """topic_id int, name string, keywords array<string>, negative_keywords array<string>, keywords_weight double,
        example_weight double, min_confidence double, is_active boolean, topic_vector array<double>""")
    docs = spark.createDataFrame([(i, t, [rng.random() for _ in range(4)]) for i, t in texts(9, 20)], "doc_id long, text string, v array<double>")
    whole = sorted(map(str, C.classify_topics(docs, "text", topics, vector="v").collect()))
    pairs = sorted(map(str, L.merge_suggestions(topics, "topic_id", "topic_vector", 0.8, "keywords").collect()))
    monkeypatch.setattr(C, "TOPICS", 15)
    monkeypatch.setattr(L, "TOPICS", 15)
    assert sorted(map(str, C.classify_topics(docs, "text", topics, vector="v").collect())) == whole
    assert sorted(map(str, L.merge_suggestions(topics, "topic_id", "topic_vector", 0.8, "keywords").collect())) == pairs and pairs


def clustered(seed, count, dims=16, centres=12):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (centres, dims))
    m = middle[rng.integers(0, centres, count)] + rng.normal(0, 0.4, (count, dims))
    m[50:60] = m[40]  # equal vectors
    return m


def plain_nearest(m, asked, k):
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = np.round(unit[asked] @ unit.T, 12)
    return {q: [int(i) for i in np.lexsort((np.arange(len(m)), -row))[:k]] for q, row in zip(asked, near, strict=True)}


VECTOR = "id long, v array<double>"


@pytest.mark.parametrize("held", [7, 20_000])
def test_exact_search(spark, monkeypatch, held):
    monkeypatch.setattr(V, "QUERIES", held)
    monkeypatch.setattr(V, "BLOCK", 64)
    m = clustered(1, 1500)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(m)]
    odd = [(9001, None), (9002, []), (9003, [0.0] * 16), (9004, [float("nan")] * 16), (None, rows[0][1]), (9005, [None] * 16)]
    df = spark.createDataFrame(rows + odd, VECTOR)
    asked = df.filter("id % 20 = 0 or id > 9000")
    found = V.nearest(df, "id", "v", asked, "id", "v", 5).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query"], r["rank"])):
        got.setdefault(r["query"], []).append(r["id"])
    assert got == plain_nearest(m, list(range(0, 1500, 20)), 5)
    assert V.nearest(df, "id", "v", asked.limit(0), "id", "v").count() == 0 and V.nearest(df.limit(0), "id", "v", asked, "id", "v").count() == 0


def test_index_search(spark):
    m = clustered(2, 4000)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], VECTOR)
    asked = df.filter("id % 20 = 0")
    exact = V.nearest(df, "id", "v", asked, "id", "v")
    index = V.build_index(df, "id", "v", 24)
    assert sum(len(r["keys"]) // 8 for r in index.blocks.collect()) == 4000
    few = V.recall(exact, V.search_index(index, asked, "id", "v", probes=6), "id").first()
    assert few["queries"] == 200 and few["recall"] >= 0.9
    every = V.search_index(index, asked, "id", "v", probes=24)
    assert {tuple(r) for r in every.select("query", "id", "rank").collect()} == {tuple(r) for r in exact.select("query", "id", "rank").collect()}


def test_similar_texts_at_the_threshold(spark):
    """Edits around the threshold, hot groups of copies and templates, against the sequential rule."""
    rng = random.Random(11)
    base = [" ".join(rng.choices(WORDS, k=80)) for _ in range(6)]
    rows = []
    for i in range(240):
        text = list(rng.choice(base[:2] if i % 3 else base))
        for _ in range(rng.randint(0, 9)):
            text[rng.randrange(len(text))] = rng.choice("xyz ")
        rows.append((i, "".join(text)))
    kept = []
    for i, t in rows:
        if not any(D.gram_ratio(t, dict(rows)[j]) >= 0.9 for j in kept):
            kept.append(i)
    got = {r["id"] for r in D.drop_similar(spark.createDataFrame(rows, "id long, content string"), "id").collect()}
    assert got == set(kept) and len(kept) < 240


def test_topics_against_their_model(spark):
    """Assignment, outliers, transform of new rows, mapping and session record, from the fitted matrices alone."""
    from datetime import datetime

    m = clustered(5, 600, centres=6)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], VECTOR)
    sizes = [r["count"] for r in L.assign_topics(L.fit_topics(df, "v", topics=9, dims=4, min_topic_size=1), df, "v").groupBy("topic_id").count().collect()]
    least = sorted(sizes)[len(sizes) // 2]
    model = L.fit_topics(df, "v", topics=9, dims=4, min_topic_size=least, min_probability=0.3)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    reduced = unit @ model.pipeline.stages[1].pc.toArray()
    centres = np.array(L._centers(model.pipeline))
    near = reduced @ centres.T / np.outer(np.linalg.norm(reduced, axis=1), np.linalg.norm(centres, axis=1))
    cluster = near.argmax(1)
    assert model.topics == [c for c in range(len(centres)) if (cluster == c).sum() >= least] and len(model.topics) < len(centres)
    chance = near.max(1).clip(0, 1)
    want = {i: (int(c) if c in model.topics and p >= 0.3 else -1, p) for i, (c, p) in enumerate(zip(cluster, chance, strict=True))}
    assigned = L.assign_topics(model, df, "v")
    got = {r["id"]: (r["topic_id"], r["probability"]) for r in assigned.collect()}
    assert {i: t for i, (t, _) in got.items()} == {i: t for i, (t, _) in want.items()}
    assert all(abs(got[i][1] - p) < 1e-9 for i, (_, p) in want.items())
    fresh = {r["id"]: r["topic_id"] for r in L.transform_new(model, df, df.filter("id < 300"), "id", "v").collect()}
    assert fresh == {i: t for i, (t, _) in want.items() if i >= 300 and t != -1}
    mapped = {tuple(r) for r in L.document_topics(assigned, "id", "s").collect()}
    assert {(i, t) for i, t, _, _ in mapped} == {(i, t) for i, (t, _) in want.items()}
    session = L.training_session(assigned, "s", datetime(2024, 1, 1), 40).first()
    topics = [t for t, _ in want.values()]
    assert (session["num_documents"], session["num_topics"], session["num_outliers"]) == (600, len(set(topics) - {-1}), topics.count(-1))


def test_stored_postings(spark, tmp_path):
    """The scan's scores, exact best lists that skip blocks, and only the terms' buckets read."""
    from newsloom.functions import text as T
    from newsloom.operators import search as S
    from newsloom.operators.postings import Postings

    rng = random.Random(13)
    common = ["va", "la", "cua"]
    docs = [(i, " ".join(rng.choices(WORDS, k=rng.choice([5, 40, 300])) + rng.choices(common, k=rng.randint(0, 30)) + ["hiem"] * (i % 97 == 0) * rng.randint(1, 3))) for i in range(1500)]
    docs += [(9000, ""), (9001, None)]
    df = spark.createDataFrame(docs, "id long, t string")
    tokens = T.words("t", [], 1, None)
    index = Postings(str(tmp_path / "index"), 16)
    index.build(df.filter("t is not null"), "id", tokens)
    for terms in (["hiem", "va"], ["la"], ["hiem"], ["không có"], ["va", "va", "cua", "hiem"]):
        want = {r["id"]: r["score"] for r in S.bm25(df.filter("t is not null"), "id", tokens, terms).collect()}
        got = {r["doc"]: r["score"] for r in index.scores(spark, terms).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - s) < 1e-9 for i, s in want.items())
        best = sorted(((round(s, 12), i) for i, s in want.items()), key=lambda x: (-x[0], x[1]))[:7]
        assert sorted((r["doc"] for r in index.top(spark, terms, 7).collect()), key=str) == sorted((i for _, i in best), key=str)
    plan = index._of(spark, "postings", ["hiem"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "PartitionFilters: [bucket" in plan


@pytest.mark.parametrize("threshold", [0.85, 0.9])
def test_recall_of_hyperplanes(spark, threshold):
    """Nine of ten pairs at or above the threshold share a bucket, most of them being close to it."""
    rng = np.random.default_rng(17)
    base = rng.normal(0, 1, (150, 64))
    m = np.concatenate([base, *(base + rng.normal(0, s, base.shape) for s in (0.3, 0.45, 0.55, 0.6))])
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = np.argwhere(np.triu(unit @ unit.T >= threshold, 1))
    buckets = {}
    for r in D.hyperplane_groups(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], VECTOR), "id", "v", 64).collect():
        buckets.setdefault(r["node"], set()).add(r["bucket"])
    met = sum(not buckets[a].isdisjoint(buckets[b]) for a, b in near.tolist())
    assert len(near) > 300 and met >= 0.9 * len(near)
