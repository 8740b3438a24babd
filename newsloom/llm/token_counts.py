"""Token counts of whole texts with a sentencepiece vocabulary.

The vocabulary of the model never joins across a word mark: no piece has the mark after another character. So a
text falls into units (word marks, then what follows up to the next mark) that are merged on their own, and the count
of a text is the sum over its units. Units that are themselves a piece which encodes as one token (proved once for
the whole vocabulary) count 1 without a merge; only the other units are merged, each distinct one once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsloom.llm.common import keyed_texts

MARK = "▁"
_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Merged units that a worker keeps; the memo is emptied beyond that, which changes no result.
MEMO = 200_000


class UnitCounter:
    """Counts tokens with one loaded model."""

    def __init__(self, model_file: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=model_file)
        self.single = whole_tokens(self.model)
        self.memo: dict[str, int] = {}

    def _merged(self, units: list[str]) -> None:
        if len(self.memo) + len(units) > MEMO:
            self.memo = {}
        # a unit begins with the mark that the model puts before a text by itself
        self.memo.update(zip(units, map(len, self.model.encode([u[1:].replace(MARK, " ") for u in units], num_threads=1)), strict=True))

    def __call__(self, texts: list[str]) -> list[int]:
        cut = [Counter(units(t)) for t in texts]
        new = list({u for c in cut for u in c if u not in self.single and u not in self.memo})
        if new:
            self._merged(new)
        single, memo = self.single, self.memo
        missing = {u for c in cut for u in c if u not in single and u not in memo}
        if missing:  # the memo was emptied for the new ones
            new = list(missing)
            self.memo.update(zip(new, map(len, self.model.encode([u[1:].replace(MARK, " ") for u in new], num_threads=1)), strict=True))
            memo = self.memo
        return [sum(n if u in single else n * memo[u] for u, n in c.items()) for c in cut]


def units(text: str) -> list[str]:
    """The text as the model sees it, with a mark before it and marks for spaces, cut before each run of marks."""
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " " or MARK in text:
        return _UNIT.findall(MARK + text.replace(" ", MARK))
    return [MARK + w for w in text.split(" ")]


def whole_tokens(model) -> frozenset[str]:
    """Pieces that begin with one mark and encode alone as exactly one token.

    Raises where the model does not allow counting by units.
    """
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
        raise ValueError("the vocabulary joins across words; texts cannot be counted by units")
    if model.encode("  a b") != model.encode(f"{MARK}{MARK}a{MARK}b") or model.encode("a´") == model.encode("a ́"):
        raise ValueError("the model normalises texts; they cannot be counted by units")
    tried = [p for p in pieces if re.fullmatch(f"{MARK}[^{MARK}]+", p)]
    alone = model.encode([p[1:] for p in tried], num_threads=1)
    found = {p for p, ids in zip(tried, alone, strict=True) if len(ids) == 1}
    if len(model.encode("a ")) != len(model.encode("a")) + 1:
        raise ValueError("a mark at the end of a text is no token of its own")
    return frozenset(found | {MARK})  # the mark alone: only at the end of a text, where it stays one token


_COUNTERS: dict[str, UnitCounter] = {}


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens) of each row.

    Counts are those of the model's own encoding without begin and end tokens; its default leaves special strings of a
    text as ordinary text. A null text is empty and has 0 tokens. Repeated rows each give a row; extra columns are
    left out. Nothing is shuffled; a worker holds one batch, the vocabulary and a bounded memo.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_file not in _COUNTERS:
            _COUNTERS[model_file] = UnitCounter(model_file)
        counter = _COUNTERS[model_file]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(2).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(counter(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    texts = keyed_texts(docs, id_col, text_col)
    counted = texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text").mapInArrow(
        count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
