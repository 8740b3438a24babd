"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton accepts every run of words of every item. Documents stream their words through it; the length of the
longest match that ends at each word tells whether a window of an item ends there.

Items of more than a block's words are dealt out to blocks by hash. The hash of a window tells which blocks hold it, so
a text goes only to the blocks whose windows it may hold, and each block has an automaton of its own. Hits of all blocks
are united by text before they are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from newsloom.llm import arrowtext, token_groups
from newsloom.llm.arrowtext import U64
from newsloom.llm.common import checkpointed, keyed_texts, shuffle_partitions

WINDOW = 13
#: Bound of the words of one automaton.
BLOCK_WORDS = 250_000
#: Bytes of text that one task streams through one block's automaton, about.
_SALT_BYTES = 32_000_000


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int) -> None:
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._grow(last, w)
        #: per state: the items whose window is the state's string of ``window`` words
        self.windows: dict[int, set[str]] = {}
        whole: dict[int, list[tuple[int, str]]] = {}
        for name, words in items:
            state = 0
            for i, w in enumerate(words):
                state = self.next[state][w]
                if i >= window - 1:
                    self.windows.setdefault(self.shortened(state), set()).add(name)
            if 0 < len(words) < window:
                whole.setdefault(state, []).append((len(words), name))
        #: per state: the short items that end there, through all its suffixes
        self.short: list[tuple] = [()] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.short[s] = (*whole.get(s, ()), *self.short[self.link[s]])

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state for p's string and w where q also stands for longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        self.link[q] = twin
        return twin

    def _grow(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w, self.next[last][w])
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w, self.next[p][w])
        return new

    def shortened(self, state: int) -> int:
        """The state of the last ``window`` words of a state's string."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def matches(self, words: list[int]) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, one past the last, items) of every window that occurs in ``words``."""
        state = size = 0
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if w not in self.next[state]:
                state = size = 0
                continue
            state, size = self.next[state][w], size + 1
            if size >= self.window:
                yield i + 1 - self.window, i + 1, self.windows[self.shortened(state)]
            for n, name in self.short[state]:
                if n <= size:
                    yield i + 1 - n, i + 1, {name}


class Benchmark:
    """The automaton of the items, with the words and pairs of words that it knows."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int = WINDOW) -> None:
        hashed = [h for _, h in items]
        self.words = np.unique(np.concatenate([*hashed, np.zeros(0, np.uint64)]))
        numbered = [(name, np.searchsorted(self.words, h)) for name, h in items if len(h)]
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *[x[:-1] * len(self.words) + x[1:] for _, x in numbered]]))
        self.least = min([window, *[len(x) for _, x in numbered]])
        self.automaton = Automaton([(name, x.tolist()) for name, x in numbered], window)

    def runs(self, w: arrowtext.Words) -> Iterator[tuple[int, list[int]]]:
        """(first word, numbers of the words) of the stretches that can hold a window: neighbours that some item has."""
        n = len(self.words)
        if not n or not len(w.hashes):
            return
        at = np.minimum(np.searchsorted(self.words, w.hashes), n - 1)
        known = self.words[at] == w.hashes
        pair = at[:-1] * n + at[1:]
        linked = known[:-1] & known[1:]
        inner = w.bounds[1:-1]
        linked[inner[(inner > 0) & (inner < len(known))] - 1] = False
        if len(self.pairs):
            maybe = np.flatnonzero(linked)
            linked[maybe] = self.pairs[np.minimum(np.searchsorted(self.pairs, pair[maybe]), len(self.pairs) - 1)] == pair[maybe]
        else:
            linked[:] = False
        alone = np.concatenate([[False], linked, [False]])
        starts = np.flatnonzero(known & ~alone[:-1])
        ends = np.flatnonzero(known & ~alone[1:]) + 1
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True) if self.least <= 1 else zip(
                *(x[ends - starts >= self.least].tolist() for x in (starts, ends)), strict=True):
            yield a, at[a:b].tolist()


def _hits(texts: arrowtext.Texts, benchmark: Benchmark) -> tuple[arrowtext.Words, np.ndarray, dict[int, set[str]]]:
    """(words, which of them are hit, items by row) of a chunk."""
    w = arrowtext.words(texts, arrowtext.ALNUM, lower=True)
    hit = np.zeros(len(w.hashes), bool)
    found: dict[int, set[str]] = {}
    for first, run in benchmark.runs(w):
        row = int(np.searchsorted(w.bounds, first, "right")) - 1
        for a, b, names in benchmark.automaton.matches(run):
            hit[first + a:first + b] = True
            found.setdefault(row, set()).update(names)
    return w, hit, found


def _per_row(w: arrowtext.Words, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, hit words) of each row."""
    total = np.concatenate([[0], np.cumsum(hit)])
    return np.diff(w.bounds), total[w.bounds[1:]] - total[w.bounds[:-1]]


def _given(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    return items.select(F.coalesce(items[item_id].cast("string"), F.lit("")).alias("id"), F.coalesce(items[item_text], F.lit("")).alias("text"))


def _few(given: DataFrame, block: int) -> list[tuple[str, np.ndarray]] | None:
    """Names and words of the items if they fit one block (a word takes two bytes with its end), otherwise None."""
    if (given.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > 2 * block:
        return None
    items = sorted({(r["id"], r["text"]) for r in given.collect()})
    hashed: list[np.ndarray] = []
    for texts in arrowtext.chunks(pa.array([t for _, t in items], pa.large_string())):
        w = arrowtext.words(texts, arrowtext.ALNUM, lower=True)
        hashed += [w.hashes[a:b] for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
    return [(name, h) for (name, _), h in zip(items, hashed, strict=True)]


def _pieces(given: DataFrame, window: int, block: int) -> DataFrame:
    """(block, name, words) of the items; each block has at most ``block`` words.

    A long item is cut into pieces that overlap by a window less one word, so each of its windows lies in one piece.
    """
    most = max(block // 8, 2 * window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in arrowtext.chunks(batch.column(1)):
                w = arrowtext.words(texts, arrowtext.ALNUM, lower=True)
                rows, packed = [], []
                for r, (a, b) in enumerate(zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True)):
                    for x in range(a, max(b - window, a) + 1 if b > a else a, most - window + 1):
                        rows.append(texts.first_row + r)
                        packed.append(w.hashes[x:min(x + most, b)].astype("<u8").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(packed, pa.binary())], ["name", "words"])

    pieces = checkpointed(given.select("id", "text").mapInArrow(cut, "name string, words binary").distinct())
    n = (F.octet_length("words") / 8).cast("long")
    blocks = 2 * -(-(pieces.agg(F.sum(n)).first()[0] or 1) // block)
    while True:
        dealt = pieces.withColumn("block", F.pmod(F.xxhash64("name", "words"), F.lit(blocks)))
        largest = dealt.groupBy("block").agg(F.sum(n).alias("n")).agg(F.max("n")).first()[0] or 0
        if largest <= max(block, most):
            return dealt
        blocks *= 2


def _windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """One hash for each run of ``length`` words."""
    return arrowtext.mixed(arrowtext.grams(hashes, length) + U64(length))


def _bits_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return token_groups._bit_of(h), token_groups._bit_of(arrowtext.mixed(h))


def _item_windows(pieces: DataFrame, window: int) -> DataFrame:
    """(block, gram, length, first bit, second bit) of the windows of the items."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = np.frombuffer(packed.as_buffer(), "<u8")
                size = min(window, len(words))
                h = np.unique(_windows(words, size))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(h), v), pa.int64()) for v in (block, size)] + [pa.array(v, pa.int64()) for v in (h.view(np.int64), *_bits_of(h))],
                    ["block", "length", "gram", "bit1", "bit2"])

    return checkpointed(pieces.select("block", "words").mapInArrow(made, "block long, length long, gram long, bit1 long, bit2 long").dropDuplicates(["block", "gram"]))


def _text_key(text: Column) -> list[Column]:
    """128 bits that name a text."""
    return [F.xxhash64(text), F.xxhash64(F.lit(13), text)]


def _surveyed(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, text key, number of words, and those hashes of windows that a filter of bounded size does not exclude."""
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())
    bits = token_groups._flat(token_groups._collected_bits(windows.select(F.explode(F.array("bit1", "bit2")).alias("bit"))))
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in arrowtext.chunks(batch.column(3)):
                w = arrowtext.words(texts, arrowtext.ALNUM, lower=True)
                row_of = w.rows()
                found = [np.zeros((0, 2), np.int64)]
                for length in lengths:
                    h = _windows(w.hashes, length)
                    at = np.flatnonzero(arrowtext.in_one_row(w.bounds, len(w.hashes), length))
                    for bit in range(2):
                        at = at[token_groups._is_set(shared.value, _bits_of(h[at])[bit])]
                    found.append(np.stack([row_of[at], h[at].view(np.int64)], 1))
                every = np.unique(np.concatenate(found), axis=0)
                ends = np.searchsorted(every[:, 0], np.arange(texts.rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(texts.first_row, texts.rows) for i in range(3)), pa.array(np.diff(w.bounds), pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(every[:, 1], pa.int64()))], ["doc_id", "k1", "k2", "n_words", "grams"])

    return checkpointed(rows.select("doc_id", "k1", "k2", "text").mapInArrow(survey, "doc_id long, k1 long, k2 long, n_words long, grams array<long>"))


_RUN = "struct<start:long,stop:long,first:long,last:long>"


def _judged(rows: DataFrame, given: DataFrame, window: int, block: int) -> tuple[DataFrame, DataFrame]:
    """The survey of all rows, and (k1, k2, n_words, n_hit, items, spans) of the texts that are hit. No table is collected."""
    pieces = _pieces(given, window, block)
    windows = _item_windows(pieces, window)
    survey = _surveyed(rows, windows)
    met = survey.select("k1", "k2", F.explode("grams").alias("gram")).distinct().join(windows.select("gram", "block"), "gram").select("k1", "k2", "block").distinct()
    met = checkpointed(met)
    bit = F.pmod("k1", F.lit(token_groups._FILTER_BITS))
    wanted = rows.sparkSession.sparkContext.broadcast(token_groups._flat(token_groups._collected_bits(met.select(bit.alias("bit")))))

    def caught(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(token_groups._is_set(wanted.value, batch.column(3).to_numpy()), pa.bool_()))

    texts = rows.select("k1", "k2", "text", bit.alias("bit")).mapInArrow(caught, "k1 long, k2 long, text string, bit long").drop("bit")
    routed = checkpointed(met.join(texts.dropDuplicates(["k1", "k2"]), ["k1", "k2"]))
    salts = routed.groupBy("block").agg((F.sum(F.octet_length("text")) / _SALT_BYTES).cast("int").alias("last"))
    mine = routed.join(salts, "block").select("block", F.pmod("k2", F.col("last") + 1).alias("salt"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("name"),
                                              F.lit(None).cast("binary").alias("words"), "k1", "k2", "text")
    heads = pieces.join(salts, "block").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last").cast("long"))).alias("salt"), F.lit(0).alias("kind"), "name", "words",
                                               F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit("").alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, benchmark = None, [], None
        for batch in batches:
            at = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            cuts = [i for i in range(len(at)) if i == 0 or at[i] != at[i - 1]] + [len(at)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(a, b - a)
                if at[a][:2] != place:
                    place, held, benchmark = at[a][:2], [], None
                if at[a][2] == 0:
                    held += [(n, np.frombuffer(p.as_buffer(), "<u8").copy()) for n, p in zip(part.column(3).to_pylist(), part.column(4), strict=True)]
                    continue
                if benchmark is None:
                    benchmark, held = Benchmark(held, window), []
                for texts in arrowtext.chunks(part.column(7)):
                    w, hit, found = _hits(texts, benchmark)
                    rows = sorted(found)
                    runs = [[{"start": x, "stop": y, "first": f, "last": t} for x, y, f, t in _runs(texts, w, hit, r)] for r in rows]
                    k1, k2 = (part.column(i).take(pa.array([texts.first_row + r for r in rows], pa.int64())) for i in (5, 6))
                    yield pa.RecordBatch.from_arrays(
                        [k1, k2, pa.array([int(w.bounds[r + 1] - w.bounds[r]) for r in rows], pa.int64()), pa.array([sorted(found[r]) for r in rows], pa.list_(pa.string())),
                         pa.array(runs, pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "stop", "first", "last")])))], ["k1", "k2", "n_words", "items", "runs"])

    streamed = heads.unionByName(mine).repartition(shuffle_partitions(rows.sparkSession), "block", "salt").sortWithinPartitions("block", "salt", "kind")
    hits = streamed.mapInArrow(judge, f"k1 long, k2 long, n_words long, items array<string>, runs array<{_RUN}>")
    united = hits.groupBy("k1", "k2", "n_words").agg(F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("runs")).alias("runs"))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit, spans = [], []
            for runs in batch.column(4).to_pylist():
                kept: list[dict] = []
                for r in sorted(runs, key=lambda r: r["start"]):
                    if kept and r["start"] <= kept[-1]["stop"]:
                        if r["stop"] > kept[-1]["stop"]:
                            kept[-1] |= {"stop": r["stop"], "last": r["last"]}
                    else:
                        kept.append(r)
                n_hit.append(sum(r["stop"] - r["start"] for r in kept))
                spans.append([{"start": r["first"], "stop": r["last"]} for r in kept])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(n_hit, pa.int64()), pa.array([sorted(set(i)) for i in batch.column(3).to_pylist()], pa.list_(pa.string())), pa.array(spans, _SPANS)],
                ["k1", "k2", "n_words", "n_hit", "items", "spans"])

    return survey, united.mapInArrow(unite, "k1 long, k2 long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,stop:long>>")


def _runs(texts: arrowtext.Texts, w: arrowtext.Words, hit: np.ndarray, row: int) -> Iterator[tuple[int, int, int, int]]:
    """(first word, one past the last, first byte, one past the last) in the row, of every run of hit words."""
    a, b = w.bounds[row], w.bounds[row + 1]
    step = np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]]))
    base = texts.bounds[row]
    for x, y in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True):
        yield int(x), int(y), int(w.starts[a + x] - base), int(w.ends[a + y - 1] - base)


_SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,stop:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
            item_id: str = "item_id", item_text: str = "text", block: int = BLOCK_WORDS) -> DataFrame:
    """Per row: doc_id, n_words, n_hit (words inside an occurring window), the items, and the spans hit in bytes.

    Windows are ``window`` consecutive words of an item, or all words of a shorter one. Words are compared by 64-bit
    hashes against the items' vocabulary. Null and empty texts have no words and no hits; items without words match
    nothing; an item listed twice counts once; equal rows each give a row; extra columns are left out. An empty table
    gives an empty result. Items that fit a block go to every worker; more of them are dealt out to blocks of ``block`` words.
    """
    given, rows = _given(items, item_id, item_text), keyed_texts(docs, id_col, text_col)
    if (few := _few(given, block)) is None:
        one, two = _text_key(F.col("text"))
        survey, hits = _judged(rows.select("*", one.alias("k1"), two.alias("k2")), given, window, block)
        return survey.select("doc_id", "k1", "k2", "n_words").join(hits.drop("n_words"), ["k1", "k2"], "left").select(
            "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            F.coalesce("spans", F.array().cast("array<struct<start:long,stop:long>>")).alias("spans"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark = Benchmark(few, window)
        for batch in batches:
            ids = batch.column(0)
            for texts in arrowtext.chunks(batch.column(1)):
                w, hit, found = _hits(texts, benchmark)
                n_words, n_hit = _per_row(w, hit)
                spans: list[list[dict]] = [[] for _ in range(texts.rows)]
                for row in found:
                    spans[row] = [{"start": f, "stop": t} for _, _, f, t in _runs(texts, w, hit, row)]
                yield pa.RecordBatch.from_arrays([
                    ids.slice(texts.first_row, texts.rows), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                    pa.array([sorted(found.get(r, ())) for r in range(texts.rows)], pa.list_(pa.string())), pa.array(spans, _SPANS),
                ], ["doc_id", "n_words", "n_hit", "items", "spans"])

    return rows.mapInArrow(stream, _SCHEMA)


#: A document is contaminated if one word in so many lies in a window of the benchmark.
SHARE = 20


def keep_clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
               block: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated. Null texts are clean.

    Nothing is shuffled where the items fit a block; otherwise only hashes and the texts that hold windows are.
    """
    given, place = _given(items, item_id, item_text), docs.columns.index(text_col)
    if (few := _few(given, block)) is None:
        one, two = _text_key(F.coalesce(docs[text_col].cast("string"), F.lit("")))
        rows = docs.select(F.lit(0).cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), one.alias("k1"), two.alias("k2"))
        hits = _judged(rows, given, window, block)[1]
        gone = checkpointed(hits.where(contaminated()).select(F.col("k1").alias("doc_id"), F.col("k2").alias("mark")))
        return token_groups._without(docs, gone, one, two)

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark = Benchmark(few, window)
        for batch in batches:
            for texts in arrowtext.chunks(pc.fill_null(batch.column(place), "")):
                w, hit, _ = _hits(texts, benchmark)
                n_words, n_hit = _per_row(w, hit)
                clean = (n_hit == 0) | (SHARE * n_hit < n_words)
                yield batch.slice(texts.first_row, texts.rows).filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(screen, docs.schema)


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words", share: int = SHARE):
    """At least one word in ``share`` lies in a window of the benchmark."""
    return (F.col(n_hit) > 0) & (F.lit(share) * F.col(n_hit) >= F.col(n_words))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Digest of :func:`matches` per document."""
    return matches(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the byte spans."""
    kept, at = [], 0
    for start, stop in spans:
        kept.append(text[at:start])
        at = stop
    return b"".join([*kept, text[at:]])
