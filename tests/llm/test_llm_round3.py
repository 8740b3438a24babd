"""Conversation repair, byte-level BPE and whitening against brute-force versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from newsloom.llm import byte_bpe, dialogues, whitening

TALK = "conv_id long, turn long, role string, text string"


def plain_repair(rows):
    """Spec by a forward pass that keeps the least (cost, audit) of each state."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        own = convs[conv]
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, fault = role or (" " if role is None else ""), " " if text is None else text, zlib.crc32(key.encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        own += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    follows, names = {"": "u", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[0] for r in own if r[0] is not None]
        pairs = list(itertools.pairwise((r[1] or "?")[0] for r in own))
        best = {"": (0, "", ())}

        def inserted(best):
            best = dict(best)
            for _ in range(3):
                for state, (cost, audit, said) in list(best.items()):
                    to = follows[state]
                    new = (cost + 3, audit + "I", (*said, (names[to], "")))
                    if to not in best or new < best[to]:
                        best[to] = new
            return best

        for (_, role, text), fault in zip(own, faults, strict=True):
            best, after = inserted(best), {}
            late = 3 if fault == "t" else 0
            for state, (cost, audit, said) in best.items():
                to = follows[state]
                moves = [(state, (cost + 4, audit + "D", said))]
                if fault not in ("b", "d"):
                    moves.append((to, (cost + 3 + late, audit + "R", (*said, (names[to], text)))))
                    if role[:1] and (role[0] == to or (role[0] == "s" and state == "")):
                        moves.append((role[0], (cost + late, audit + "K", (*said, (role, text)))))
                for to, new in moves:
                    if to not in after or new[:2] < after[to][:2]:
                        after[to] = new
            best = after
        cost, audit, said = min((v for s, v in inserted(best).items() if s in ("", "a")), key=lambda v: v[:2])
        text = "\n".join(f"{r}:{t}" for r, t in said)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
            sum(a + b not in ("su", "ua", "au") for a, b in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def talks(seed, count=300, longest=30):
    rng = random.Random(seed)
    rows = []
    for c in range(count):
        for t in range(rng.randint(1, longest)):
            text = rng.choice(["Yes.", "No!", "why", "  ", "", "a b.", "Ok. \n", "x?\t", "…", "Same.", None, "long " * 30])
            rows.append((c, rng.choice([t, t, t, rng.randint(0, 9), None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), text))
    return rows


def said(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("piece", [3, 512])
def test_repair(spark, monkeypatch, piece):
    rows = talks(1) + [(None, 1, "user", "Hi."), (None, None, None, None), (7000, None, "user", ".")] + [(9000, t, "user", f"{t}") for t in range(900)]
    want = plain_repair(rows)
    assert said(dialogues.report(spark.createDataFrame(rows, TALK))) == want
    if piece == 3:  # the cost pass in pieces, in this process
        monkeypatch.setattr(dialogues, "PIECE", piece)
        rng = np.random.default_rng(2)
        ends = np.cumsum(rng.integers(0, 40, 60))
        initial, must, late = rng.integers(0, 4, ends[-1]), rng.random(ends[-1]) < 0.3, rng.random(ends[-1]) < 0.3
        late &= ~must
        cut = dialogues.audits(initial, must, late, ends)
        monkeypatch.setattr(dialogues, "PIECE", 512)
        whole = dialogues.audits(initial, must, late, ends)
        assert (cut[0] == whole[0]).all() and cut[1] == whole[1]


def test_repair_given(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert said(dialogues.report(df)) == plain_repair([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_repair_edges(spark):
    assert dialogues.report(spark.createDataFrame([], TALK)).collect() == []
    rows = [(1, t, "user", "Same.") for t in range(4)] * 3 + [(2, 1, "user", "x" * 3_000_000)] + [(4, t, None, None) for t in range(30)]
    odd = spark.createDataFrame(rows, TALK).selectExpr("*", "1 as key", "2 as part", "'x' as fault", "3 as cost")
    assert said(dialogues.report(odd)) == plain_repair(rows)
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:5".encode()) % 20 == 0)
    only = said(dialogues.report(spark.createDataFrame([(dropped, 5, "user", "Hi.")], TALK)))
    assert only == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def plain_ids(texts):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.ranks_of(RANKS), special_tokens={})
    return [own.encode_ordinary(t) for t in texts]


def encoded_rows(docs):
    texts = [t or "" for _, t in docs]
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return sorted((i, len(ids), digest(np.array(ids, "<u4").tobytes()), digest(t.encode()))
                  for (i, _), t, ids in zip(docs, texts, plain_ids(texts), strict=True))


def test_bpe(spark):
    rng = random.Random(3)
    odd = ["՘֋₏", "a⃝ \U00011de0\U00011de1", "don't we'll I'VE", "  two  spaces ", "\x1c\x1d", "日本語 テキスト", "🙂🙃", "\r\n\n\t", "<|endoftext|>"]
    docs = [(1, None), (2, ""), (2, ""), (3, "x" * 30_000), (4, " " * 5000), (5, "ab " * 100_000), (5, "ab " * 10)]
    docs += [(100 + i, "".join(rng.choice([*odd, " ", "word", "Zahl 12", "'s", "_-"]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as chunk", "2 as ids", "3 as decoded", "'a' as body")
    assert sorted(map(tuple, byte_bpe.report(df, RANKS, PATTERN).collect())) == encoded_rows(docs)


def test_bpe_pattern():
    """Characters on which Unicode versions differ, and some of all others, have the classes that the library gives them."""
    import tiktoken

    rules = byte_bpe.rules_of(PATTERN)
    some = [chr(c) for c in range(0, 0x110000, 37) if not 0xD800 <= c <= 0xDFFF]
    split = byte_bpe.Splitter(rules)
    whole = tiktoken.Encoding("w", pat_str=r"[\s\S]+", mergeable_ranks=byte_bpe.ranks_of(RANKS), special_tokens={})
    for chars in (list(rules.odd)[::7], some):
        text = "".join(f"{c}a1{c}1 {c}" for c in chars)
        assert [i for word in split(text) for i in whole.encode_ordinary(word)] == plain_ids([text])[0]


def test_bpe_given_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CHUNK", 20_000)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [tuple(r) for r in df.select("doc_id", "text").collect()]
    made = byte_bpe.report(df.repartition(5), RANKS, PATTERN)
    assert sorted(map(tuple, made.collect())) == encoded_rows(docs)
    one = byte_bpe.report(df, RANKS, PATTERN)
    one.collect()
    assert "ReusedExchange" in one._jdf.queryExecution().executedPlan().toString()
    assert byte_bpe.report(df.limit(0), RANKS, PATTERN).collect() == []


def test_bpe_decode(spark):
    table = spark.createDataFrame([(0, bytearray(b"a")), (7, bytearray(b"bc"))], "id long, bytes binary")
    ids = spark.createDataFrame([(1, bytearray(np.array([7, 0, 7], "<u4").tobytes())), (2, None), (3, bytearray())], "k int, ids binary")
    assert {r["k"]: r["decoded"] for r in byte_bpe.decode(ids, table).collect()} == {1: b"bcabc", 2: None, 3: b""}
    wrong = spark.createDataFrame([(1, bytearray(np.array([3], "<u4").tobytes()))], "k int, ids binary")
    with pytest.raises(Exception, match="no entry"):
        byte_bpe.decode(wrong, table).collect()


VECTORS = "vec_id long, embedding array<float>"


def check_whitened(df, rows, components=32):
    rows = [(i, v) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    x = np.floor(np.array([v for _, v in rows], np.float32).astype(float) * 64).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    c = (n * x - sums) / n
    v = c.T @ c / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > 1e-12 * values[0]).sum()))
    found = list(map(tuple, df.collect()))
    deviation = ((n * x - sums) ** 2).sum(1).tolist()
    keys = [(i, d) for (i, _), d in zip(rows, deviation, strict=True)]
    assert Counter((r[0], r[3], r[1]) for r in found) == Counter((*key, c) for key in keys for c in range(1, k + 1))
    assert {r[2] for r in found} == {n}
    row = {key: r for r, key in enumerate(keys)}
    got, explained = np.zeros((n, k)), np.zeros(k)
    for r in found:
        got[row[r[0], r[3]], r[1] - 1], explained[r[1] - 1] = r[4], r[5]
    once = sorted(set(row.values()))
    want, got = (c @ vectors[:, :k] / np.sqrt(values[:k]))[once], got[once]
    gaps = np.abs(np.subtract.outer(values[:k], values)) + np.eye(k, len(values)) * values[0]
    clear = gaps.min(1) > 1e-6 * values[0]
    assert clear.any()
    assert np.abs(want * np.sign((want * got).sum(0)) - got)[:, clear].max() < 1e-7
    assert np.allclose(explained, values[:k] / v.trace(), rtol=1e-9)
    assert max(r[6] for r in found) < 1e-7


def test_whitening_given(spark, monkeypatch):
    monkeypatch.setattr(whitening, "TOGETHER", 3)
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    check_whitened(whitening.whiten(df.repartition(7)), [tuple(r) for r in df.select("vec_id", "embedding").collect()])


@pytest.mark.parametrize(("size", "count", "tail"), [(3, 50, 1.0), (100, 600, 0.97), (64, 20, 1.0), (80, 3000, 1e-3)])
def test_whitening(spark, size, count, tail):
    """Few dimensions, a flat spectrum, fewer vectors than dimensions, a steep spectrum; rows that don't count."""
    rng = np.random.default_rng(size)
    x = rng.normal(0, 1, (count, size)) * np.maximum(tail ** np.arange(size), 0.05) * 4
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x.astype(np.float32))]
    rows += [(None, rows[0][1]), (5, rows[1][1]), (5, rows[1][1]), (-1, None), (-2, [None] * size), (-3, [float("nan")] + [0.0] * (size - 1)),
             (-4, [float("-inf")] * size), (-5, [])]
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 as n", "'x' as component", "2 as size", "3 as data")
    check_whitened(whitening.whiten(df), rows)


def test_whitening_without_variance(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [0.5] * 40)] * 3, [(1, None)]):
        made = whitening.whiten(spark.createDataFrame(rows, VECTORS))
        assert made.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and made.collect() == []


def test_whitening_lengths(spark):
    with pytest.raises(Exception, match="different lengths"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], VECTORS))


def test_secrets_over_blocks(spark):
    """Long candidates, walked in blocks, and windows that end at their edges."""
    from newsloom.llm import secrets
    from test_llm_streams import base_spans, high_spans

    rng = random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
    texts = []
    for size in (20, 255, 256, 257, 492, 493, 494, 700, 1500):
        runs = ["".join(rng.choice(letters if rng.random() < 0.5 else rng.choice(["ab", "0a", "x"])) for _ in range(rng.randint(5, 60))) for _ in range(size // 20 + 1)]
        texts += ["é" + "".join(runs)[:size] + " x", "".join(rng.choice("0123456789abcdef") for _ in range(size))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.report(df).collect():
        found = sorted(base_spans(texts[r["doc_id"]]) + high_spans(texts[r["doc_id"]]))
        assert r["spans"] == ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)
    for r in secrets.redact(df).collect():
        text, at, out = texts[r["doc_id"]], 0, []
        for a, _, b, _ in sorted(base_spans(text) + high_spans(text)):
            if a >= at:
                out += [text[at:a], "[SECRET]"]
            at = max(at, b)
        assert r["text"] == "".join([*out, text[at:]])


def test_secrets_linear(spark):
    """A megabyte of one random string, and a hundred thousand matches in one text."""
    import time

    from newsloom.llm import secrets

    rng = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    blob = "".join(rng.choices(letters, k=1_000_000))
    many = " ".join(f"token=abc{i:06d} ü" for i in range(100_000))
    path = "a/" * 400_000
    df = spark.createDataFrame([(1, blob), (2, many), (3, path)], "doc_id long, text string")
    secrets.report(df.limit(0)).collect()
    began = time.time()
    rows = {r["doc_id"]: r for r in secrets.report(df).collect()}
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert time.time() - began < 60
    assert rows[2]["n_assign"] == 100_000 and rows[3]["spans"] == "" and rows[1]["spans"].startswith("high:")
    assert masked[2] == " ".join(["[SECRET] ü"] * 100_000) and masked[3] == path and len(masked[1]) < 100_000


def test_keep_one_leaves_rows_without_shingles(spark):
    from newsloom.llm import token_groups

    rows = [(1, "x"), (1, "x"), (2, ""), (2, ""), (3, "y")]
    kept = token_groups.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect())) == [(1, "x"), (2, ""), (2, ""), (3, "y")]


def test_letterless_texts_have_no_language(spark):
    from newsloom.llm import language

    words = {"en": "the thing that here", "de": "und der schöne Tag"}
    rows = [(i, f"{words[lang]} {words[lang][i % 9:]}", lang) for i in range(120) for lang in words]
    docs = spark.createDataFrame([*rows, (500, "² ½ 12 ³", None), (501, None, "en"), (502, "", None)], "doc_id long, text string, lang string")
    network = language.fit(docs)
    found = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, network).collect()}
    assert found[500] == found[501] == found[502] == "und" and found[3] != "und"
    assert {500, 501, 502}.isdisjoint(r["doc_id"] for r in language.keep_known(docs, network).collect())


@pytest.mark.parametrize("length", [300, 400, 1000])
def test_long_runs(spark, length):
    from newsloom.llm import phrases, suffixes
    from test_llm_search import by_id, plain_phrases, plain_suffixes

    rng = random.Random(length)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(3000)) for _ in range(2)]
    docs = [(i, f"{rng.random()}{rng.choice(base)[rng.randint(0, 500):rng.randint(1500, 3000)]}{rng.random()}") for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert by_id(suffixes.strip_repeats(df, length=length)) == plain_suffixes(docs, length)
    words = [(i, " ".join(t)) for i, t in docs]
    assert by_id(phrases.strip_repeats(spark.createDataFrame(words, "doc_id long, text string"), length)) == plain_phrases(words, length)
