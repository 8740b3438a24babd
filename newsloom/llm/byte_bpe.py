"""Byte-level BPE over whole tables: every distinct word is encoded once, and ids come back to their places.

Texts are cut into pre-tokens. A chunk of texts keeps its pre-tokens by position as places in its own list of words, and
only these lists travel: each word goes to the part of its hash, is encoded there once for all chunks, and its ids return
to the chunks that asked, where documents are put together by position. Decoding joins ids with the table of token bytes.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, cached_property
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.llm.common import keyed_texts, parts_for

#: Characters of text in a chunk; a longer text is a chunk of its own.
CHUNK = 8_000_000
#: Ids or bytes that are put together at a time.
BLOCK = 1_000_000
#: Bytes of words and ids that a task remembers; beyond that it forgets them and may encode a word again.
MEMO = 256_000_000
#: Entries of a vocabulary that may be broadcast.
MOST_TOKENS = 2_000_000

# Letters, numbers and other characters of plain texts, for which the library's classes are these.
_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9"
_PLAIN = re.compile(r"[\t\n\r -~¡§«¶·»¿€–—‘’‚“”„…ªµºÀ-ÖØ-öø-ɏ]*")
_PLAIN_WORDS = re.compile(rf" ?[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+")
_PLAIN_RULE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ranks_of(path: str) -> dict[bytes, int]:
    """Token bytes and their ids, as a rank file lists them."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


@dataclass(frozen=True)
class Rules:
    """A pattern, the same with the library's own letters and numbers written out, and the characters for which they differ."""

    pattern: str
    explicit: str
    odd: str


@cache
def rules_of(pattern: str) -> Rules:
    """The encoding library and this process may know different Unicode versions; the library's classes hold."""
    import regex
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF)
    single = {bytes([b]): b for b in range(256)}
    explicit, odd = pattern, set()
    for name in ("L", "N"):
        found = bytes(tiktoken.Encoding(name, pat_str=rf"\p{{{name}}}", mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode()
        odd |= set(found) ^ set(regex.findall(rf"\p{{{name}}}", every))
        codes = np.fromiter(map(ord, found), np.int64)
        cuts = np.flatnonzero(np.diff(codes) > 1)
        own = "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in zip(codes[np.append(0, cuts + 1)], codes[np.append(cuts, len(codes) - 1)], strict=True))
        explicit = re.sub(rf"\[([^\]]*)\\p\{{{name}\}}", lambda m, r=own: f"[{m[1]}{r}", explicit)
        explicit = explicit.replace(rf"\p{{{name}}}", f"[{own}]")
    return Rules(pattern, explicit, "".join(sorted(odd)))


class Splitter:
    """Pre-tokens of a text as the library's own pattern gives them: by ranges for plain texts, by the pattern for others."""

    def __init__(self, rules: Rules) -> None:
        import regex

        self.rules, self.odd = rules, frozenset(rules.odd)
        self.usual = regex.compile(rules.pattern).findall
        self.plain = _PLAIN.fullmatch if rules.pattern == _PLAIN_RULE else lambda text: None

    @cached_property
    def every(self) -> Callable[[str], list[str]]:
        import regex

        return regex.compile(self.rules.explicit).findall

    def __call__(self, text: str) -> list[str]:
        if self.plain(text):
            return _PLAIN_WORDS.findall(text)
        return self.usual(text) if self.odd.isdisjoint(text) else self.every(text)


def squeezed(values: np.ndarray) -> bytes:
    """Unsigned numbers by byte planes, compressed."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(values) or int(values.max()) < 1 << 8 * w)
    planes = np.ascontiguousarray(values.astype(f"<u{width}")).view(np.uint8).reshape(-1, width).T
    return bytes([width]) + len(values).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(planes.tobytes(), asbytes=True)


def stretched(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    raw = pa.Codec("zstd").decompress(data[9:], n * width, asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(f"<u{width}").ravel().astype(np.int64)


def bundled(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def unbundled(data: bytes) -> list[bytes]:
    found, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at:at + 8], "little")
        found.append(data[at + 8:at + 8 + size])
        at += 8 + size
    return found


def strung(words: list[bytes]) -> bytes:
    """Byte strings as one: the sizes, then the bytes."""
    return bundled(squeezed(np.fromiter(map(len, words), np.int64, len(words))), pa.Codec("zstd", compression_level=1).compress(b"".join(words), asbytes=True))


def unstrung(data: bytes) -> list[bytes]:
    sizes, packed = unbundled(data)
    ends = np.cumsum(stretched(sizes)).tolist()
    raw = pa.Codec("zstd").decompress(packed, ends[-1], asbytes=True) if ends and ends[-1] else b""
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def gathered(starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``starts``, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]


def blocks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes come to about ``most``, one row at least."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Consecutive byte runs as an Arrow column."""
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _cut(rules: Rules, parts: int):
    """Chunks of texts: a row with the documents of each, and a row of words for each part that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(rules)
        chunk = TaskContext.get().partitionId() << 32

        def rows() -> pa.RecordBatch:
            nonlocal chunk
            chunk += 1
            raw = [w.encode() for w in words]
            part_of = np.fromiter(map(zlib.crc32, raw), np.int64, len(raw)) % parts
            order = np.argsort(part_of, kind="stable")
            cuts = np.flatnonzero(np.diff(part_of[order])) + 1
            groups = np.split(order, cuts) if len(order) else []
            held = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], ["doc_id"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held.schema) as writer:
                writer.write_batch(held)
            docs = bundled(sink.getvalue().to_pybytes(), squeezed(np.array([len(p) for p in places])), squeezed(np.concatenate(places)), squeezed(part_of))
            n = len(groups)
            return pa.RecordBatch.from_arrays([
                pa.array([chunk, *(int(part_of[g[0]]) for g in groups)], pa.int64()), pa.array([chunk] * (n + 1), pa.int64()),
                pa.array([True] + [False] * n), pa.array([docs, *(strung([raw[i] for i in g.tolist()]) for g in groups)], pa.binary()),
            ], ["at", "chunk", "held", "body"])

        ids, places, words, size = [], [], defaultdict(count().__next__), 0
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                if ids and size + len(text) > CHUNK:
                    yield rows()
                    ids, places, words, size = [], [], defaultdict(count().__next__), 0
                found = split(text)
                ids.append(batch.column(0)[i].as_py())
                places.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)))
                size += len(text)
        if ids:
            yield rows()

    return run


#: Encoders that a worker has built.
_ENCODERS: dict = {}


def _encode_words(ranks: Broadcast):
    """Ids of the words of each row; a word that many chunks ask for is encoded once."""
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        if key not in _ENCODERS:
            _ENCODERS[key] = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks.value, special_tokens={})
        whole = _ENCODERS[key]
        memo: dict[bytes, np.ndarray] = {}
        held = 0
        for batch in batches:
            for i in range(batch.num_rows):
                words = unstrung(batch.column(2)[i].as_py())
                if held > MEMO:
                    memo, held = {}, 0
                new = [w for w in words if w not in memo]
                for w, ids in zip(new, map(whole.encode_ordinary, [w.decode() for w in new]), strict=True):
                    memo[w] = np.array(ids, np.uint32)
                    held += len(w) + 4 * len(ids) + 250
                found = [memo[w] for w in words]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([squeezed(np.fromiter(map(len, found), np.int64, len(found)))], pa.binary()),
                    pa.array([squeezed(np.concatenate(found))], pa.binary()),
                ], ["part", "chunk", "sizes", "ids"])

    return run


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a chunk from the ids of its words, by position."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, *arrays = unbundled(batch.column(1)[i].as_py())
            counts, places, part_of = map(stretched, arrays)
            doc_ids = pa.ipc.open_stream(ids).read_all().column(0).combine_chunks()
            answers = sorted(batch.column(2)[i].as_py() or [], key=lambda a: a["part"])
            in_parts = [stretched(a["sizes"]) for a in answers]
            if [(a["part"], len(s)) for a, s in zip(answers, in_parts, strict=True)] != list(zip(*(x.tolist() for x in np.unique(part_of, return_counts=True)), strict=True)):
                raise ValueError("a chunk was cut anew with other rows; give documents from a table or a checkpoint")
            order = np.argsort(part_of, kind="stable")
            sizes, starts = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
            if len(order):
                flat_sizes = np.concatenate(in_parts)
                sizes[order], starts[order] = flat_sizes, np.cumsum(flat_sizes) - flat_sizes
                flat = np.concatenate([stretched(a["ids"]) for a in answers]).astype("<u4")
            else:
                flat = np.zeros(0, "<u4")
            ends = np.cumsum(counts)
            firsts = ends - np.diff(np.append(0, ends))
            for a, b in blocks(ends - firsts, BLOCK):
                own = places[firsts[a]:ends[b - 1]]
                ids = gathered(starts[own], sizes[own], flat)
                at = np.append(0, np.cumsum(sizes[own]))[ends[a:b] - firsts[a]]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(a, b - a), pa.array(np.diff(np.append(0, at)), pa.int64()), binaries(ids.view(np.uint8), 4 * at)], ["doc_id", "n_tokens", "ids"])


def encode(docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit) of each row's whole text.

    Each match of ``pattern`` is merged on its own by the ranks; there are no special tokens. A null or empty text has no
    ids. Repeated rows each give a row, extra columns are left out, an empty table gives none. Text between matches has no
    token. Two shuffles: chunks' documents and words (each word once a chunk, so that a frequent word is no hot key), then
    the words' ids; the first is read twice. A task holds a chunk, or a memo of bounded size.
    """
    parts = parts_for(docs)
    ranks = docs.sparkSession.sparkContext.broadcast(_bounded(ranks_of(ranks_file)))
    cut = keyed_texts(docs, id_col, text_col).mapInArrow(
        _cut(rules_of(pattern), parts), "at long, chunk long, held boolean, body binary").repartition(parts, "at")

    def side(held: bool) -> DataFrame:
        """Rows of one kind. A generator, unlike a filter, is not moved below the shuffle, and all columns are used: both sides read the same shuffle."""
        return cut.select("at", "chunk", F.explode(F.when(F.col("held") == held, F.array("body"))).alias("body"))

    answers = (side(False).mapInArrow(_encode_words(ranks), "part long, chunk long, sizes binary, ids binary").repartition(parts, "chunk")
               .groupBy("chunk").agg(F.collect_list(F.struct("part", "sizes", "ids")).alias("answers")).withColumnRenamed("chunk", "asker"))
    held = side(True)
    return (held.join(answers.hint("merge"), held["at"] == answers["asker"], "left").select("chunk", "body", "answers")
            .mapInArrow(_assemble, "doc_id long, n_tokens long, ids binary"))


def _bounded(ranks: dict[bytes, int]) -> dict[bytes, int]:
    if len(ranks) > MOST_TOKENS:
        raise ValueError(f"a vocabulary of {len(ranks)} tokens is too large to broadcast")
    return ranks


def token_table(spark: SparkSession, ranks_file: str) -> DataFrame:
    """The table of token ids and their bytes."""
    ranks = ranks_of(ranks_file)
    return spark.createDataFrame(pa.table({"id": pa.array(ranks.values(), pa.int64()), "bytes": pa.array(ranks.keys(), pa.binary())}))


def decode(encoded: DataFrame, tokens: DataFrame, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the bytes of the ids in order.

    ``tokens`` (id, bytes; at most ``MOST_TOKENS`` rows, which is checked) is broadcast. Null ids stay null; an id that the
    table lacks ends the job. A column ``decoded`` of the input is replaced.
    """
    rows = tokens.select("id", "bytes").limit(MOST_TOKENS + 1).collect()
    _bounded(dict.fromkeys(r["id"] for r in rows))
    sizes = np.full(max((r["id"] for r in rows), default=-1) + 1, -1, np.int64)
    by_id = sorted((r["id"], bytes(r["bytes"])) for r in rows)
    sizes[[i for i, _ in by_id]] = [len(b) for _, b in by_id]
    table = encoded.sparkSession.sparkContext.broadcast((sizes, np.frombuffer(b"".join(b for _, b in by_id), np.uint8)))
    kept = [c for c in encoded.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, flat = table.value
        starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
        for batch in batches:
            column = batch.column(kept.index(ids_col))
            lengths = np.array(pa.compute.fill_null(pa.compute.binary_length(column), 0), np.int64) // 4
            for a, b in blocks(lengths, BLOCK):
                part = column.slice(a, b - a)
                ids = np.frombuffer(b"".join(x or b"" for x in part.to_pylist()), "<u4").astype(np.int64)
                if len(ids) and (int(ids.max()) >= len(sizes) or int(sizes[ids].min()) < 0):
                    raise ValueError("an id has no entry in the token table")
                ends = np.append(0, np.cumsum(sizes[ids]))[np.cumsum(lengths[a:b])]
                made = binaries(gathered(starts[ids], sizes[ids], flat), ends)
                made = pa.compute.if_else(part.is_valid(), made, pa.scalar(None, pa.binary()))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), made], [*kept, "decoded"])

    fields = [f for f in encoded.schema.fields if f.name != "decoded"]
    schema = type(encoded.schema)(fields).add("decoded", "binary")
    return encoded.select(*kept).mapInArrow(run, schema)


def report(docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row; see :func:`encode` and :func:`decode`."""
    decoded = decode(encode(docs, ranks_file, pattern, id_col, text_col), token_table(docs.sparkSession, ranks_file))
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
