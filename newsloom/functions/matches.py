"""Places of regular-expression matches, in time linear in the text and the matches.

Spark's functions give the matches of a pattern and the pieces between them, but not where they lie. Pieces and matches
alternate, so running sums of their lengths tell the places. Arguments that are read several times are bound by ``let``.
"""

from __future__ import annotations

import re
from functools import cache, reduce

from pyspark.sql import Column, functions as F

from .columns import ColumnLike, col, let

#: Numbers of a running sum that grow one list, and code points of a block of text.
STEP, BLOCK = 64, 256


def running_sum(values: Column) -> Column:
    """Running sum of a bound array of ints, in blocks, so that the lists that grow stay short."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / STEP).cast("int"))
    part = lambda b: F.slice(values, b * STEP + 1, STEP)

    def listed(items: Column, first: Column, after: bool) -> Column:
        return F.aggregate(
            items, F.struct(first.alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.concat(acc["out"], F.array(acc["at"] + v if after else acc["at"])).alias("out")),
            lambda acc: acc["out"])

    totals = F.transform(blocks, lambda b: F.aggregate(part(b), F.lit(0), lambda a, v: a + v))
    return let(listed(totals, F.lit(0), False), lambda firsts: F.flatten(F.transform(blocks, lambda b: listed(part(b), F.get(firsts, b), True))))


def placed(text: Column, pattern: str) -> Column:
    """array<struct(at, to, hit)> of the matches of a pattern that matches no empty string: code points from 0, end exclusive."""
    def walk(hits: Column) -> Column:
        lengths = F.flatten(F.zip_with(
            hits, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), lambda h, p: F.array(F.char_length(p), F.char_length(h))))
        ends = let(lengths, running_sum)
        return let(ends, lambda e: F.transform(hits, lambda h, i: F.struct(F.get(e, 2 * i).alias("at"), F.get(e, 2 * i + 1).alias("to"), h.alias("hit"))))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, walk(hits)).otherwise(
        F.array().cast("array<struct<at:int,to:int,hit:string>>")))


def blocks_of(text: Column) -> Column:
    """The text in blocks of ``BLOCK`` code points, for :func:`between`."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def between(blocks: Column, a: Column, b: Column) -> Column:
    """Code points a to b of a text given by its (bound) blocks; no piece walks the text from its start."""
    first, last = F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int")
    block = lambda i: F.coalesce(F.get(blocks, i), F.lit(""))
    head, tail = F.substring(block(first), a % BLOCK + 1, F.lit(BLOCK)), F.substring(block(last), F.lit(1), b % BLOCK)
    return F.when(b <= a, F.lit("")).when(first == last, F.substring(block(first), a % BLOCK + 1, b - a)).otherwise(
        F.concat(head, F.array_join(F.slice(blocks, first + 2, last - first - 1), ""), tail))


#: Parts of a pattern that say nothing of literals: classes, escapes and points; a repeated or optional character; an innermost group.
_ANY = re.compile(r"\[(?:\\.|[^\]\\])*\]|\\p\{\w+\}|\\.|\.")
_TIMES = r"(?:[?*+]|\{\d+(?:,\d*)?\})[?+]?"
_REPEATED = re.compile(rf"[^()|]{_TIMES}")
_GROUP = re.compile("\\((\\?(?:[:!=]|<[!=]))?([^()]*)\\)(\1)?")


@cache
def literals_of(pattern: str) -> tuple[tuple[str, ...], ...]:
    """Literals without which a pattern matches nowhere: of each tuple one must occur. None where alternatives are open at the top."""
    listed: list[tuple[str, ...]] = []
    runs = lambda s: [r for r in re.split("[\0\ue000-\uf8ff]", s) if r]

    def group(m: re.Match) -> str:
        kind, body, times = m.groups()
        if times or kind not in (None, "?:"):
            return "\0"
        if "|" not in body:
            return body
        longest = [max(runs(a), key=len, default="") for a in body.split("|")]
        if not all(longest):
            return "\0"
        listed.append(tuple(longest))
        return chr(0xE000 + len(listed) - 1)

    rest = _ANY.sub("\0", re.sub(r"^\(\?[a-zA-Z]+\)", "", pattern))
    rest = _REPEATED.sub("\0", re.sub(rf"\){_TIMES}", ")\1", rest))
    while (flat := _GROUP.sub(group, rest, count=1)) != rest:
        rest = flat
    if re.search(r"[|()]", rest):
        return ()
    return tuple([(r,) for r in runs(rest)] + [listed[ord(c) - 0xE000] for c in rest if "\ue000" <= c <= "\uf8ff"])


def folded(text: ColumnLike) -> Column:
    """Lower-cased text in which the letters that case-insensitive patterns take for i and s are these letters."""
    return F.lower(F.translate(col(text), "\u0130\u0131\u017f", "iis"))


def may_match(text: Column, pattern: str, fold: bool = False) -> Column:
    """Whether a (bound) text holds the literals of a pattern; with ``fold`` both are case-folded. Cheap, and true wherever the pattern matches."""
    lists = [tuple(dict.fromkeys(w.lower() if fold else w for w in words)) for words in literals_of(pattern)]
    # A longer literal tells more; alternatives that hold a shorter one are told by that.
    lists = [tuple(w for w in words if not any(v != w and v in w for v in words)) for words in lists]
    checks = [reduce(lambda a, b: a | b, [text.contains(w) for w in words]) for words in sorted(set(lists), key=lambda ws: (len(ws), -min(map(len, ws))))]
    return reduce(lambda a, b: a & b, checks) if checks else F.lit(True)
