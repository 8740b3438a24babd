"""Packing of token sequences along a space-filling curve.

Each document becomes a hashed vector of its tokens that is projected to a few dimensions; its place on the Hilbert
curve through them is its sort key. Documents are range-sorted by the key and laid end to end along the curve, so that
a sequence holds neighbours.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from newsloom.llm.common import checkpointed, keyed_texts, null_first, shuffle_partitions

LENGTH = 1024
END = 0
DIMENSIONS, BITS = 4, 12

# Characters on which the libraries' pre-token patterns agree; texts with others go to the tokenizer itself.
_PLAIN = re.compile(r"[\t\n\r -~¡§«¶·»¿€–—‘’‚“”„…ªµºÀ-ÖØ-öø-ɏ]*")
# Fixed value: the public byte-level pre-token pattern.
_PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones for themselves, others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokens:
    """Token ids of texts by one tokenizer file, without special tokens added.

    Ids of plain texts are merged by rank, which is the file's own order of merges (checked when it is loaded) and the
    faster engine; texts that hold a special string or an unusual character are encoded by the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary, alphabet = model["vocab"], byte_alphabet()
        if any(vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] != len(alphabet) + i for i, m in enumerate(model["merges"])):
            raise ValueError("ids do not follow the order of merges; this vocabulary has no ranks")
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocabulary.items() if token not in self.special}
        self.ranked = tiktoken.Encoding("ranks", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        plain = [_PLAIN.fullmatch(t) is not None and not any(s in t for s in self.special) for t in texts]
        odd = iter(self.tokenizer.encode_batch([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        return [np.array(self.ranked.encode_ordinary(t) if p else next(odd).ids, np.uint32) for t, p in zip(texts, plain, strict=True)]


def projection(size: int, dimensions: int = DIMENSIONS, seed: int = 11) -> np.ndarray:
    """A fixed random direction for each hashed token."""
    return np.random.default_rng(seed).normal(0, 1, (size, dimensions))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of unsigned coordinates below 2**bits."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: list[np.ndarray], directions: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Curve place of each document: its hashed vector of token counts, projected and squeezed to 0..1."""
    points = np.zeros((len(ids), directions.shape[1]))
    for i, own in enumerate(ids):
        if len(own):
            points[i] = np.bincount(own % len(directions), minlength=len(directions)) @ directions / len(own)
    unit = np.tanh(3.0 * points)  # bounded, so that no corpus statistics are needed
    return hilbert(np.minimum((unit + 1) / 2 * (1 << bits), (1 << bits) - 1).astype(np.int64), bits)


def tokenized(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, curve (sort key), ids (16-bit or 32-bit little-endian, with the end id 0) and wide (which of the two)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(tokenizer_file)
        directions = projection(4096)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = tokens(part.column(1).to_pylist())
                keys = curve_keys(ids, directions)
                arrays = [np.append(a, np.uint32(END)) for a in ids]
                wide = [bool(a.max() > 0xFFFF) for a in arrays]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(keys, pa.int64()),
                    pa.array([a.astype("<u4" if w else "<u2").tobytes() for a, w in zip(arrays, wide, strict=True)], pa.binary()),
                    pa.array(wide, pa.bool_()),
                ], ["doc_id", "curve", "ids", "wide"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(encode, "doc_id long, curve long, ids binary, wide boolean")


def pieces(sizes: np.ndarray, length: int = LENGTH) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of documents laid end to end.

    Full sequences follow one another; the rest of fewer than ``length`` tokens is cut into sequences of falling powers
    of two, which need no padding.
    """
    total = int(sizes.sum())
    ends = [*range(length, total + 1, length)]
    rest, at = total % length, total - total % length
    for b in range(length.bit_length() - 1, -1, -1):
        if rest >> b & 1:
            at += 1 << b
            ends.append(at)
    document, used, begin = 0, 0, 0
    for sequence, end in enumerate(ends):
        at = begin
        while at < end:
            n = min(int(sizes[document]) - used, end - at)
            yield document, used, n, sequence, at - begin
            at, used = at + n, used + n
            if used == sizes[document]:
                document, used = document + 1, 0
        begin = end


def pack(docs: DataFrame, tokenizer_file: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document ends with token id 0; a null or empty text is that token alone. Equal keys are ordered by doc_id,
    then ids; repeated rows are packed as often as they occur; extra columns are left out. Each range of the sorted
    documents is packed by one task that holds one batch and less than one sequence; its tail is cut into powers of two.
    """
    stored = checkpointed(tokenized(docs, tokenizer_file, id_col, text_col))  # the range bounds read it once more
    order = [F.col("curve"), null_first(F.col("doc_id")), F.col("ids")]
    ranged = stored.repartitionByRange(shuffle_partitions(docs.sparkSession), *order[:2]).sortWithinPartitions(*order)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        waiting: list[tuple[int | None, np.ndarray, int]] = []  # document, its ids that are not placed, its place

        def place(whole: bool) -> tuple[pa.RecordBatch, list]:
            nonlocal sequence
            sizes = np.array([len(ids) - used for _, ids, used in waiting], np.int64)
            total = int(sizes.sum())
            last = total if whole else total - total % length
            out: list[list] = [[] for _ in names]
            highest, rest = -1, list(waiting)
            done = 0
            for d, start, n, s, offset in pieces(sizes, length):
                if done + n > last:
                    break
                done += n
                doc, ids, used = waiting[d]
                part = ids[used + start:used + start + n]
                for column, value in zip(out, (doc, used + start, n, zlib.crc32(part.astype("<u4").tobytes()), len(ids), sequence + s, offset), strict=True):
                    column.append(value)
                highest = s
                rest[d] = (doc, ids, used + start + n)
            sequence += highest + 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names), [w for w in rest if w[2] < len(w[1])]

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for doc, ids, wide in zip(*(part.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                    waiting.append((doc, np.frombuffer(ids, "<u4" if wide else "<u2"), 0))
                made, waiting = place(False)
                yield made
        if waiting:
            yield place(True)[0]

    return ranged.mapInArrow(lay, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
