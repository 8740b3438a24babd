"""Substring de-duplication of word runs with Aho-Corasick automata.

Anchors find the runs that may recur (see :mod:`anchored`); window hashes confirm which recur and in which document
first. The confirmed passages of each shard of documents are compiled into one automaton, and every document of the
shard streams through it: each occurrence of a passage that began in a document with a smaller id is removed.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsloom.llm import anchored, arrowtext
from newsloom.llm.common import shuffle_partitions

WINDOW = 50
GRAM = 10
#: Bytes of the texts of one shard; a longer text is a shard of its own.
SHARD = 2_000_000


def _confirmed(docs: DataFrame, found: DataFrame, rule: anchored.Rule) -> DataFrame:
    """Spans of the windows around open anchors that begin in an earlier document."""
    parts = shuffle_partitions(docs.sparkSession)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            blobs = anchored.WindowBlobs(parts)
            for texts in arrowtext.chunks(batch.column(2)):
                m = anchored.Measured(texts, rule.unit)
                for r in range(texts.rows):
                    row = texts.first_row + r
                    pos, left, right, _, _ = anchored.unpacked(batch.column(3)[row].as_py(), ("<u4", rule.extent, rule.extent, "<u8", "u1"))
                    count = np.maximum(left + right + rule.gram - rule.length + 1, 0)
                    starts = np.unique(np.repeat(pos - left, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
                    at = starts + m.bounds[r]
                    blobs.add(m.ranges(at, at + rule.length), row, starts)
            if out := blobs.rows(ids, marks):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*out, strict=True))], blobs.names)

    packed = anchored.open_anchors(docs, found).mapInArrow(windows, anchored._WINDOWS)
    return packed.repartitionById(parts, F.col("part")).mapInArrow(lambda b: anchored.first_windows(b, rule), anchored.SPANS)


def _letters(numbers: np.ndarray) -> str:
    """Numbers as characters, one each (surrogates left out)."""
    return (numbers + np.where(numbers >= 0xD800, 0x800, 0)).astype("<u4").tobytes().decode("utf-32-le")


class PhraseAutomaton:
    """Passages with the document that holds them first, as one automaton over words."""

    def __init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.first: dict[str, int] = {}

    def add(self, passage: str, first: int) -> None:
        if passage not in self.first or first < self.first[passage]:
            self.first[passage] = first
            self.automaton.add_word(passage, (len(passage), first))

    def covered(self, text: str, doc: int) -> np.ndarray | None:
        """Which words lie in an occurrence of a passage from a document before ``doc``; None without any."""
        if not self.first:
            return None
        if self.automaton.kind != 3:  # not compiled yet
            self.automaton.make_automaton()
        step = None
        for end, (size, first) in self.automaton.iter(text):
            if first < doc:
                if step is None:
                    step = np.zeros(len(text) + 1, np.int64)
                step[end + 1 - size] += 1
                step[end + 1] -= 1
        return None if step is None else np.cumsum(step[:-1]) > 0


def strip_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and ``kept``, the text, if asked for) of every row.

    Removed is every word covered by a run of ``window`` words that also starts in a document with a smaller id, judged
    on the input. Null and empty texts have no words; rows with equal id and text count as one document and give equal
    rows; of rows with an equal id and other texts none is smaller. Null ids are the smallest. Extra columns are left out.
    """
    rule = anchored.Rule("words", window, gram, inside=False)
    rows = anchored.rows_of(docs, id_col, text_col)
    found = anchored.search(rows, rule)
    spanned = anchored.with_spans(rows, found, _confirmed(rows, found, rule))
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for texts in arrowtext.chunks(batch.column(2), SHARD):
                w = arrowtext.words(texts)
                letters = _letters(np.unique(w.hashes, return_inverse=True)[1])
                own = [letters[a:b] for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
                phrases = PhraseAutomaton()
                for r in range(texts.rows):
                    if (cell := batch.column(3)[texts.first_row + r]).is_valid:
                        for start, stop, first in zip(*anchored.united(*anchored.unpacked(cell.as_py(), ("<u4", "<u4", "<i8"))), strict=True):
                            phrases.add(own[r][start:stop], int(first))
                removed, digests, kept = [], [], []
                for r in range(texts.rows):
                    found_words = texts.of_row(r).split()
                    covered = phrases.covered(own[r], ids[texts.first_row + r].as_py())
                    rest = b" ".join(found_words if covered is None else itertools.compress(found_words, ~covered))
                    removed.append(0 if covered is None else int(covered.sum()))
                    digests.append(hashlib.sha256(rest).hexdigest())
                    kept.append(rest.decode("utf-8", "replace") if with_text else None)
                arrays = [anchored.null_id(ids.slice(texts.first_row, texts.rows)), pa.array(np.diff(w.bounds), pa.int64()), pa.array(removed, pa.int64()), pa.array(digests)]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(kept, pa.string())] * with_text, names)

    return spanned.mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
