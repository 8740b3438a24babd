"""Secret scans: fixed patterns, and windows of high entropy over candidate strings.

Plain column expressions; no Python runs on the executors.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.functions.columns import let
from newsloom.llm.common import joined, keyed_texts

# The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "high"]

#: Windows of this many characters are scored.
WINDOW = 20
#: Candidate strings of each character class and the bits a character from which a window is suspicious.
CLASSES = {"hex": ("0123456789abcdefABCDEF", 3.2), "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 4.0)}
#: Candidates that match one of these are no secrets: paths, plain words, numbers, uuids and placeholders.
ALLOWED = [
    r"^[A-Za-z]+$", r"^[0-9]+$", r"^(?:[A-Za-z]++[/_=-]++)++[A-Za-z]*$", r"(?i)example|placeholder|changeme|dummy|xxxxx",
    r"^(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$",
]
_UNIT = 1_000_000
#: Characters of a string that are walked at a time, and numbers of a running sum.
BLOCK, STEPS = 256, 64


def _weights(window: int) -> list[int]:
    """c * log2(c) in millionths of a bit, so that sums are exact."""
    return [0, *(round(c * math.log2(c) * _UNIT) for c in range(1, window + 1))]


def _running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Running sum or maximum of an int array from 0 on, in blocks, so that the lists that grow stay short.

    ``values`` is read again for each block: it must be bound (see :func:`let`).
    """
    blocks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / STEPS).cast("int"))
    part = lambda b: F.slice(values, b * STEPS + 1, STEPS)

    def listed(items: Column, first: Column, after: bool) -> Column:
        return F.aggregate(
            items, F.struct(first.alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, v: let(merge(acc["at"], v), lambda m: F.struct(m.alias("at"), F.concat(acc["out"], F.array(m if after else acc["at"])).alias("out"))),
            lambda acc: acc["out"])

    totals = F.transform(blocks, lambda b: F.aggregate(part(b), F.lit(0), merge))
    return let(listed(totals, F.lit(0), False), lambda firsts: F.flatten(F.transform(blocks, lambda b: listed(part(b), F.get(firsts, b), True))))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _placed(text: Column, pattern: str, group: int = 0) -> Column:
    """Matches of a pattern as structs (at, to, hit): code points, end exclusive.

    The pieces between matches and the matches alternate, so running lengths give the places.
    """
    def walk(hits: Column) -> Column:
        lengths = F.flatten(F.zip_with(
            hits, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), lambda h, p: F.array(F.char_length(p), F.char_length(h))))
        places = let(lengths, lambda v: _running(v, _sum))
        return let(places, lambda ends: F.transform(hits, lambda h, i: F.struct(F.get(ends, 2 * i).alias("at"), F.get(ends, 2 * i + 1).alias("to"), h.alias("hit"))))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, walk(hits)).otherwise(
        F.array().cast("array<struct<at:int,to:int,hit:string>>")))


def _spans(kind: str, found: Column) -> Column:
    """Sortable structs (at, rank, to, kind)."""
    return F.transform(found, lambda m: F.struct(
        m["at"].alias("at"), F.lit(KINDS.index(kind)).alias("rank"), m["to"].alias("to"), F.lit(kind).alias("kind")))


def _high_runs(hit: Column, at: Column, alphabet: str, bits: float, window: int) -> Column:
    """Unions of the windows of ``hit`` with at least ``bits`` bits a character, as structs (at, to) in places of the text.

    The counts of the characters (one digit each in a string) move with the window: one goes up, one goes down, and the sum
    of c * log2(c) changes by the two steps of its weight. Entropy is log2(window) - sum / window. A long string is walked in
    blocks that overlap by a window less one.
    """
    weights = F.array(*[F.lit(w).cast("long") for w in _weights(window)])
    most = math.floor((math.log2(window) - bits) * window * _UNIT)
    step = BLOCK - window + 1
    zero, runs = "0" * len(alphabet), "array<struct<at:int,to:int>>"
    number = lambda counts, c: F.ascii(F.substring(counts, c, F.lit(1))) - 48
    weight = lambda n: F.element_at(weights, n + 1)
    counted = lambda counts, c, n: F.overlay(counts, F.char(n + 48), c, F.lit(1))
    run = lambda a, b: F.array(F.struct(a.alias("at"), b.alias("to")))

    def move(part: Column, acc: Column, i: Column) -> Column:
        def entered(state: Column) -> Column:
            c = F.get(part, i)
            return let(number(state["counts"], c), lambda n: let(state["sum"] - weight(n) + weight(n + 1), lambda total: scored(counted(state["counts"], c, n + 1), total)))

        def scored(counts: Column, total: Column) -> Column:
            start = i - (window - 1)
            hot = (start >= 0) & (total <= most)
            goes_on = acc["to"] >= start
            return F.struct(
                counts.alias("counts"), total.alias("sum"), F.when(hot & ~goes_on, start).otherwise(acc["at"]).alias("at"),
                F.when(hot, start + window).otherwise(acc["to"]).alias("to"),
                F.when(hot & ~goes_on & (acc["to"] >= 0), F.concat(acc["runs"], run(acc["at"], acc["to"]))).otherwise(acc["runs"]).alias("runs"))

        def left(c: Column) -> Column:
            return let(number(acc["counts"], c), lambda n: F.struct(
                counted(acc["counts"], c, n - 1).alias("counts"), (acc["sum"] - weight(n) + weight(n - 1)).alias("sum")))

        same = F.struct(acc["counts"].alias("counts"), acc["sum"].alias("sum"))
        return let(F.when(i >= window, left(F.get(part, i - window))).otherwise(same), entered)

    def of_block(codes: Column, b: Column) -> Column:
        found = let(F.slice(codes, b * step + 1, F.lit(BLOCK)), lambda part: F.aggregate(
            F.sequence(F.lit(0), F.size(part) - 1),
            F.struct(F.lit(zero).alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("at"), F.lit(-1).alias("to"), F.array().cast(runs).alias("runs")),
            lambda acc, i: move(part, acc, i),
            lambda acc: F.when(acc["to"] >= 0, F.concat(acc["runs"], run(acc["at"], acc["to"]))).otherwise(acc["runs"])))
        return F.transform(found, lambda r: F.struct((r["at"] + b * step + at).alias("at"), (r["to"] + b * step + at).alias("to")))

    def merged(found: Column) -> Column:
        firsts = F.filter(found, lambda r, i: (i == 0) | (r["at"] > F.get(found, i - 1)["to"]))
        lasts = F.filter(found, lambda r, i: (i == F.size(found) - 1) | (F.get(found, i + 1)["at"] > r["to"]))
        return F.zip_with(firsts, lasts, lambda a, b: F.struct(a["at"].alias("at"), b["to"].alias("to")))

    codes = F.transform(F.regexp_extract_all(hit, F.lit("."), F.lit(0)), lambda c: F.instr(F.lit(alphabet), c))
    return let(codes, lambda v: let(F.flatten(F.transform(
        F.sequence(F.lit(0), F.floor((F.size(v) - window) / step).cast("int")), lambda b: of_block(v, b))), merged))


def spans_of(text: Column, window: int = WINDOW, allowed: list[str] | None = None) -> Column:
    """All spans of a text as structs (at, rank, to, kind), by place, then kind."""
    assign = F.filter(_placed(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["hit"], ASSIGN, 2)) >= 6)
    candidates = rf"[A-Za-z0-9+/_=-]{{{window},}}"
    rules = ALLOWED if allowed is None else allowed
    kept = lambda m: ~F.greatest(F.lit(False), F.lit(False), *[m["hit"].rlike(r) for r in rules])
    hex_chars, hex_bits = CLASSES["hex"]
    all_chars, all_bits = CLASSES["base64"]
    high = F.flatten(F.transform(
        F.filter(_placed(text, candidates), kept),
        lambda m: F.when(m["hit"].rlike(r"^[0-9a-fA-F]+$"), _high_runs(m["hit"], m["at"], hex_chars, hex_bits, window))
        .otherwise(_high_runs(m["hit"], m["at"], all_chars, all_bits, window))))
    return F.array_sort(F.concat(
        _spans("assign", assign), _spans("access", _placed(text, ACCESS)), _spans("hex", _placed(text, HEX)), _spans("high", high)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, allowed: list[str] | None = None) -> DataFrame:
    """One row per document: its id and ``found``, all spans as structs (at, rank, to, kind) in order.

    Kinds ``assign``, ``access`` and ``hex`` are the base patterns. ``high`` spans are unions of windows whose Shannon
    entropy reaches the bound of their character class, in candidate strings that no allow-list pattern names.
    Null and empty texts have no span; equal rows each give a row; extra columns are left out. Whole texts are read.
    """
    # a one-element generator keeps later projections from scanning the text again
    return keyed_texts(docs, id_col, text_col).select("doc_id", F.explode(F.array(spans_of(F.col("text"), window, allowed))).alias("found"))


def _said(spans: Column) -> Column:
    return joined(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["at"], s["to"])))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and spans of each document; see :func:`scan`."""
    found = F.col("found")
    count = lambda kind: F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
    return scan(docs, id_col, text_col).select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_said(F.filter(found, lambda s: s["kind"] != "high")), 256).alias("base_sha256"),
        _said(found).alias("spans"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The documents with every column, each span of the text (overlaps united) replaced by ``mark``.

    Rows stay, null texts stay null, texts without a span stay as they are.
    """
    text = docs[text_col]
    packed = docs.select(F.struct(*docs.columns).alias("row"), text.alias("text"), F.explode(F.array(spans_of(F.coalesce(text, F.lit(""))))).alias("found"))
    text, found = F.col("text"), F.col("found")

    def between(blocks: Column, a: Column, b: Column) -> Column:
        """Code points a to b from blocks of the text, so that no piece walks the text from its start."""
        first, last = F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int")
        block = lambda i: F.coalesce(F.get(blocks, i), F.lit(""))
        head, tail = F.substring(block(first), a % BLOCK + 1, F.lit(BLOCK)), F.substring(block(last), F.lit(1), b % BLOCK)
        return F.when(b <= a, F.lit("")).when(first == last, F.substring(block(first), a % BLOCK + 1, b - a)).otherwise(
            F.concat(head, F.array_join(F.slice(blocks, first + 2, last - first - 1), ""), tail))

    def masked(ends: Column, blocks: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0))
        pieces = F.filter(F.transform(found, lambda s, i: F.struct(before(i).alias("a"), s["at"].alias("b"))), lambda p: p["b"] >= p["a"])
        kept = F.transform(pieces, lambda p: between(blocks, p["a"], p["b"]))
        return F.array_join(F.concat(kept, F.array(between(blocks, F.get(ends, F.size(ends) - 1), F.char_length(text)))), mark)

    ends = let(F.transform(found, lambda s: s["to"]), lambda v: _running(v, lambda a, b: F.greatest(a, b)))
    cut = let(ends, lambda e: let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), lambda blocks: masked(e, blocks)))
    clean = F.when(text.isNull() | (F.size(found) == 0), text).otherwise(cut)
    return packed.select(*[clean.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
