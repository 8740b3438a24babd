"""Fingerprints, near-duplicate classes and the two removers of repeats, against brute-force versions."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from newsloom.llm import anchored, arrowtext, components, phrases, spotsigs, suffixes, token_groups

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [(900, None), (901, ""), (902, "a b"), (903, " " * 50), (904, "A  B"), (905, "x" * 3000)]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shuffled_texts(seed, count=200, size=60, alphabet="abcdefghij", extra="abcxyzé"):
    rng = random.Random(seed)
    base = [[rng.choice(alphabet) for _ in range(size)] for _ in range(4)]
    out = []
    for i in range(count):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(extra)
        if rng.random() < 0.4:
            w += [rng.choice("pq") for _ in range(rng.randint(0, 30))] + rng.choice(base)
        if rng.random() < 0.1:
            w = ["a"] * rng.randint(1, 2 * size)
        out.append((i, w))
    rng.shuffle(out)
    return out


def plain_phrases(docs, length):
    first, cut = {}, [(i, WORD.findall(t or "")) for i, t in docs]
    for i, w in cut:
        for k in range(len(w) - length + 1):
            x = tuple(w[k:k + length])
            first[x] = min(first.get(x, i), i)
    out = {}
    for i, w in cut:
        covered = [False] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k:k + length])] < i:
                covered[k:k + length] = [True] * length
        rest = " ".join(x for x, c in zip(w, covered, strict=True) if not c)
        out[i] = (len(w), sum(covered), hashlib.sha256(rest.encode()).hexdigest())
    return out


def plain_suffixes(docs, length):
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        covered = [False] * len(b)
        for k in range(len(b) - length + 1):
            if b[k:k + length] in seen:
                covered[k:k + length] = [True] * length
            seen.add(b[k:k + length])
        runs = sum(c and not (k and covered[k - 1]) for k, c in enumerate(covered))
        out[i] = (len(b), sum(covered), runs, hashlib.sha256(bytes(x for x, c in zip(b, covered, strict=True) if not c)).hexdigest())
    return out


def plain_classes(docs):
    sets = {}
    for i, t in docs:
        w = WORD.findall(lowered(t))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n) and root(i) != root(j):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def by_id(df):
    return {r["doc_id"]: tuple(r)[1:] for r in df.collect()}


def given(spark, sf="sf0.001"):
    df = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    return df, [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize(("length", "gram"), [(10, 4), (5, 1)])
def test_phrases(spark, length, gram):
    docs = [(i, " ".join(w)) for i, w in shuffled_texts(5)] + EDGE
    assert by_id(phrases.strip_repeats(spark.createDataFrame(docs, SCHEMA), length, gram)) == plain_phrases(docs, length)


def test_phrases_given(spark):
    df, docs = given(spark)
    assert by_id(phrases.strip_repeats(df)) == plain_phrases(docs, 50)


@pytest.mark.parametrize(("length", "gram"), [(12, 5), (6, 1)])
def test_suffixes(spark, length, gram):
    docs = [(i, "".join(w)) for i, w in shuffled_texts(6)] + EDGE[:5]
    assert by_id(suffixes.strip_repeats(spark.createDataFrame(docs, SCHEMA), length, gram)) == plain_suffixes(docs, length)


def test_suffixes_given(spark):
    df, docs = given(spark)
    assert by_id(suffixes.strip_repeats(df)) == plain_suffixes(docs, 100)


def test_hot_windows_give_the_same(spark, monkeypatch):
    docs = [(i, "".join(w)) for i, w in shuffled_texts(8)]
    df = spark.createDataFrame(docs, SCHEMA)
    rule = anchored.Rule("bytes", 12, 5, True, hot=0)
    rows = anchored.rows_of(df, "doc_id", "text")
    found = anchored.search(rows, rule)
    assert not [r for r in found.collect() if 0 in r["hot"]]
    assert by_id(suffixes.strip_repeats(df, 12, 5, hot=0)) == plain_suffixes(docs, 12)


def test_maximal_repeats_against_all_substrings():
    rng = random.Random(2)
    for _ in range(20):
        strings = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 14))) for _ in range(6)]
        data = np.frombuffer("".join(strings).encode(), np.uint8)
        bounds = np.cumsum([0, *map(len, strings)])
        array = suffixes.EnhancedArray(data, bounds, 3)
        got = set()
        for size, first, last in array.maximal_repeats(3):
            places = frozenset(array.order[first:last + 1].tolist())
            texts = {data[p:p + size].tobytes() for p in places}
            assert len(texts) == 1
            got.add((texts.pop(), places))
        want = set()
        for text in {s[a:b] for s in strings for a in range(len(s)) for b in range(a + 3, len(s) + 1)}:
            spots = [(k, a) for k, s in enumerate(strings) for a in range(len(s) - len(text) + 1) if s.startswith(text, a)]
            left = {strings[k][a - 1] if a else (k, a) for k, a in spots}
            right = {strings[k][a + len(text)] if a + len(text) < len(strings[k]) else (k, a) for k, a in spots}
            if len(spots) > 1 and len(left) > 1 and len(right) > 1:
                want.add((text.encode(), frozenset(int(bounds[k]) + a for k, a in spots)))
        assert got == want


@pytest.mark.parametrize("long_row", [64, 4])
def test_classes(spark, long_row):
    rng = random.Random(9)
    docs = []
    for i, w in shuffled_texts(9, 300, 40, ["ak", "bl", "cm", "dn", "eo", "fk", "gl"], "abcxyz"):
        w = w[:rng.randint(0, 40)] if rng.random() < 0.3 else w
        docs.append((i, " ".join(["A"] * rng.randint(1, 9) if rng.random() < 0.1 else w)))
    docs += EDGE
    assert by_id(token_groups.near_classes(spark.createDataFrame(docs, SCHEMA), long_row=long_row)) == plain_classes(docs)


def test_classes_given(spark):
    df, docs = given(spark)
    assert by_id(token_groups.near_classes(df)) == plain_classes(docs)


def test_keep_one(spark):
    w = " ".join(f"w{i}" for i in range(40))
    rows = [(3, w, "x"), (1, w, "y"), (1, w, "y"), (None, w + " z", "n"), (7, "other words in this text here", "k"), (8, None, "e"), (9, "", "e")]
    kept = token_groups.keep_one(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted((r["doc_id"], r["lang"]) for r in kept.collect()) == [(1, "y"), (7, "k"), (8, "e"), (9, "e")]


def test_roots(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    up = {x: x for p in links for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if root(a) != root(b):
            up[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["node"]: r["root"] for r in components.roots(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for p in links if p[0] != p[1] for x in p}
    assert components.roots(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("make", [phrases.strip_repeats, suffixes.strip_repeats, token_groups.near_classes, spotsigs.edit_report])
def test_odd_rows(spark, make):
    schema = "doc_id long, text string, mark string, n long, class string, fp string, h string"
    extra = ("m", 1, "c", "f", "h")
    long = "word " * 400
    rows = [(4, long, *extra), (4, long, *extra), (4, "other", *extra), (None, long, *extra), (None, None, None, None, None, None, None)]
    got = [tuple(r) for r in make(spark.createDataFrame(rows, schema)).collect()]
    assert len(got) == 5 and sorted(r[0] is None for r in got) == [False] * 3 + [True] * 2
    assert make(spark.createDataFrame([], schema)).count() == 0


def test_words_and_grams():
    import pyarrow as pa

    texts = ["the  Cat\tsat", "", "the", "cat", " x ", "Thecat é"]
    chunk = next(arrowtext.chunks(pa.array(texts)))
    w = arrowtext.words(chunk, lower=True)
    found = [bytes(chunk.data[a:b]).decode().lower() for a, b in zip(w.starts, w.ends, strict=True)]
    assert found == [x for t in texts for x in t.lower().split()]
    assert len(set(w.hashes.tolist())) == len(set(found))
    values = np.arange(50).astype(np.uint64)
    for k in range(1, 20):
        g = arrowtext.grams(np.concatenate([values, values]), k)
        assert len(g) == 101 - k and (g[:50 - k] == g[50:100 - k]).all() and len(set(g.tolist())) == min(50, len(g))


def test_near_pairs(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(200)] + ["the", "and"] * 20
    base = [[rng.choice(vocabulary) for _ in range(80)] for _ in range(10)]
    docs = []
    for i in range(60):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(80)] = "new"
        docs.append((i, " ".join(w)))
    docs += [(100, None), (101, "")]
    df = spark.createDataFrame(docs, SCHEMA)
    sets = {r["doc_id"]: set(r["s"]) for r in df.select("doc_id", spotsigs.signatures(df["text"]).alias("s")).collect() if r["s"]}
    kinds = {}
    for i in sorted(sets):
        kinds.setdefault(frozenset(sets[i]), i)
    ids = sorted(kinds.values())
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in ids for b in ids if a < b and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}
    got = {(r["a"], r["b"]): r["likeness"] for r in spotsigs.near_pairs(df, 0.75).collect()}
    assert got == pytest.approx(want) and want


def test_members_of_a_long_row_are_compared_in_bounded_cells(spark):
    rng = np.random.default_rng(8)
    n = rng.integers(30, 130, 900)
    left = np.maximum(n - rng.integers(0, 33, 900), 1)
    left[:300] = np.ceil(n[:300] * 0.8)  # a template makes up four fifths: two such sets can't be alike through it
    base = rng.random((6, 4000)).argsort(1)
    sets = [np.unique(arrowtext.mixed((base[rng.integers(6)][:k] + 1).astype(np.uint64))) for k in n]
    rows = [(1 if i < 800 else 2, i, int(n[i]), int(left[i]), token_groups.sketch(sets[i]), i % 37) for i in range(900)]
    members = spark.createDataFrame([r[:4] for r in rows], "row long, a long, n long, left long")
    root = spark.createDataFrame([(r[1], r[5]) for r in rows if r[1] != r[5]], "node long, root long")
    survey = spark.createDataFrame([(r[1], r[2], r[4]) for r in rows], "key long, n long, sketch binary")
    want = set()
    for x, y in itertools.combinations(rows, 2):
        d = int(np.bitwise_count(np.frombuffer(x[4], np.uint64) ^ np.frombuffer(y[4], np.uint64)).sum())
        alike = 100 * min(x[2], y[2]) >= 75 * max(x[2], y[2]) and 175 * min(x[3], y[3]) >= 75 * (x[2] + y[2]) and 175 * d <= 25 * (x[2] + y[2])
        if x[0] == y[0] and x[5] != y[5] and alike:
            want.add((x[1], y[1]))
    assert len(want) > 100
    for block in (50, 1000):
        assert {tuple(r) for r in token_groups._across(members, root, survey, block).collect()} == want
    cells = token_groups._across_cells(members, root, 50).groupBy("row", "band", "part", "seat").count().collect()
    assert max(r["count"] for r in cells) < 200
    light = members.where("a < 300")
    assert token_groups._across_cells(light, root).isEmpty()
