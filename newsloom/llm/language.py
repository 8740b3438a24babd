"""Language of texts by a bidirectional gated recurrent network over bytes.

The network reads a segment (a word with the blank before it, cut after SEGMENT bytes) from both ends and labels every
position; a document's probabilities pool the log probabilities of all positions of all its segments. Equal segments
give equal labels, so each distinct segment of a batch is read once and weighted by its count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Bytes of a segment at most; longer words are read in several segments.
SEGMENT = 24
#: Labelled documents of each language that are drawn for training (expected), and distinct segments of each language at most.
SAMPLE_DOCS = 300
SAMPLE_SEGMENTS = 6_000
HIDDEN = 16
UNKNOWN = "und"
#: Segment scores that a worker keeps; the memo is emptied beyond that, which changes no result.
MEMO = 250_000
_PAD = 256


def segments(text: str) -> list[bytes]:
    """The text's words as bytes, each with a blank before it; long ones cut."""
    out = []
    for word in text.lower().split():
        b = b" " + word.encode("utf-8", "replace")
        if len(b) <= SEGMENT:
            out.append(b)
        else:
            out.extend(b[i:i + SEGMENT] for i in range(0, len(b), SEGMENT))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


def padded(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes by step and segment, lengths); steps after the end hold _PAD."""
    lengths = np.array([len(b) for b in batch], np.int64)
    steps = np.full((int(lengths.max()), len(batch)), _PAD, np.int64)
    flat = np.frombuffer(b"".join(batch), np.uint8)
    column = np.repeat(np.arange(len(batch)), lengths)
    steps[np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths), column] = flat
    return steps, lengths


@dataclass
class Network:
    """Two gated recurrent layers (forward, backward) over bytes and one softmax layer at each position."""

    classes: list[str]
    hidden: int = HIDDEN
    seed: int = 7
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.weights:
            return
        rng, h, k = np.random.default_rng(self.seed), self.hidden, len(self.classes)
        for d in "fb":
            self.weights[f"x{d}"] = rng.normal(0, 0.3, (_PAD + 1, 3 * h)).astype(np.float32)
            self.weights[f"u{d}"] = rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)).astype(np.float32)
            self.weights[f"c{d}"] = np.zeros(h, np.float32)
        self.weights["o"] = rng.normal(0, 0.2, (2 * h, k)).astype(np.float32)
        self.weights["p"] = np.zeros(k, np.float32)

    def _pass(self, steps: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (step, segment, hidden); a padded step carries the state on."""
        h, (n, b) = self.hidden, steps.shape
        x, u, c = self.weights[f"x{d}"], self.weights[f"u{d}"], self.weights[f"c{d}"]
        state = np.zeros((b, h), np.float32)
        states = np.empty((n, b, h), np.float32)
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            gx, gu = x[steps[t]], state @ u
            gates = _sigmoid(gx[:, :2 * h] + gu[:, :2 * h])
            z, r = gates[:, :h], gates[:, h:]
            inner = gu[:, 2 * h:] + c
            new = np.tanh(gx[:, 2 * h:] + r * inner)
            on = (steps[t] != _PAD)[:, None]
            if keep is not None:
                keep.append((t, state, z, r, inner, new, on))
            state = np.where(on, new + z * (state - new), state)
            states[t] = state
        return states

    def labels(self, steps: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(both layers' states, log probabilities of each class) at every position."""
        kf, kb = keep or (None, None)
        both = np.concatenate([self._pass(steps, "f", kf), self._pass(steps, "b", kb)], axis=2)
        y = both @ self.weights["o"] + self.weights["p"]
        y -= y.max(axis=2, keepdims=True)
        return both, y - np.log(np.exp(y).sum(axis=2, keepdims=True))

    def _states(self, steps: np.ndarray, d: str) -> np.ndarray:
        """As :meth:`_pass` for segments of one length: no padding, the work done in place, segments along the last axis."""
        h, (n, b) = self.hidden, steps.shape
        x, u, c = (np.ascontiguousarray(self.weights[f"{k}{d}"].T) for k in "xuc")
        x[:2 * h] *= 0.5  # a sigmoid is half of a tanh of the half, and a half
        u[:2 * h] *= 0.5
        c = c[:, None]
        states = np.empty((n, h, b), np.float32)
        state = np.zeros((h, b), np.float32)
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            gx, gu = x[:, steps[t]], u @ state
            gates, new, inner = gx[:2 * h], gx[2 * h:], gu[2 * h:]
            gates += gu[:2 * h]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            inner += c
            inner *= gates[h:]
            new += inner
            np.tanh(new, out=new)
            np.subtract(state, new, out=states[t])
            states[t] *= gates[:h]
            states[t] += new
            state = states[t]
        return states

    def scores(self, batch: list[bytes], at_once: int = 1024) -> np.ndarray:
        """Sum of the positions' log probabilities for each segment and class."""
        h, out = self.hidden, np.zeros((len(batch), len(self.classes)), np.float32)
        lengths = np.array([len(b) for b in batch])
        order = np.argsort(lengths, kind="stable")
        forward, backward = (np.ascontiguousarray(w.T) for w in (self.weights["o"][:h], self.weights["o"][h:]))
        for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
            for i in range(0, len(group), at_once):
                own = group[i:i + at_once]
                steps = np.ascontiguousarray(np.frombuffer(b"".join([batch[j] for j in own]), np.uint8).reshape(len(own), -1).T).astype(np.intp)
                y = forward @ self._states(steps, "f")
                y += backward @ self._states(steps, "b")
                y += self.weights["p"][:, None]
                y -= y.max(axis=1, keepdims=True)
                out[own] = (y.sum(axis=0) - np.log(np.exp(y).sum(axis=1)).sum(axis=0)).T
        return out

    def gradients(self, steps: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss (mean over positions) and its gradients, by backpropagation through time."""
        h, w = self.hidden, self.weights
        kept: tuple[list, list] = ([], [])
        both, y = self.labels(steps, kept)
        share = (steps != _PAD) * weight[None, :]
        share = (share / share.sum()).astype(np.float32)
        loss = -float((np.take_along_axis(y, target[None, :, None].repeat(len(steps), 0), 2)[:, :, 0] * share).sum())
        dy = np.exp(y)
        dy[:, np.arange(len(target)), target] -= 1.0
        dy *= share[:, :, None]
        g = {name: np.zeros_like(v) for name, v in w.items()}
        flat = dy.reshape(-1, dy.shape[2])
        g["o"], g["p"] = both.reshape(-1, 2 * h).T @ flat, flat.sum(axis=0)
        dboth = dy @ w["o"].T
        for d, part, own in (("f", 0, kept[0]), ("b", h, kept[1])):
            carried = np.zeros((steps.shape[1], h), np.float32)
            for t, before, z, r, inner, new, on in reversed(own):
                total = carried + dboth[t, :, part:part + h]
                live = np.where(on, total, 0)
                dnew = live * (1 - z) * (1 - new * new)
                dz = live * (before - new) * z * (1 - z)
                dr = dnew * inner * r * (1 - r)
                gx = np.concatenate([dz, dr, dnew], axis=1)
                gu = np.concatenate([dz, dr, dnew * r], axis=1)
                np.add.at(g[f"x{d}"], steps[t], gx)
                g[f"u{d}"] += before.T @ gu
                g[f"c{d}"] += (dnew * r).sum(axis=0)
                carried = np.where(on, live * z, total) + gu @ w[f"u{d}"].T
        return loss, g

    def train(self, examples: list[bytes], target: np.ndarray, weight: np.ndarray, updates: int = 600, at_once: int = 256, rate: float = 0.01) -> None:
        """About ``updates`` steps of Adam over batches of segments of like length, in an order fixed by the seed."""
        rng = np.random.default_rng(self.seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        n = 0
        rounds = -(-updates * at_once // max(len(examples), at_once))
        for turn in range(rounds):
            order = rng.permutation(len(examples))
            order = order[np.argsort([len(examples[i]) // 4 for i in order], kind="stable")]
            blocks = [order[i:i + at_once] for i in range(0, len(order), at_once)]
            for b in rng.permutation(len(blocks)):
                own = blocks[b]
                steps, _ = padded([examples[i] for i in own])
                _, g = self.gradients(steps, target[own], weight[own])
                n += 1
                now = rate * (1 - turn / rounds)
                for k, v in self.weights.items():
                    first[k] = 0.9 * first[k] + 0.1 * g[k]
                    second[k] = 0.99 * second[k] + 0.01 * g[k] ** 2
                    v -= now * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.99**n)) + 1e-7)


def held_out(id_col: Column) -> Column:
    """Documents that never serve training: crc32 of the id as text leaves 2 modulo 4."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_DOCS,
           per_language_segments: int = SAMPLE_SEGMENTS) -> list[tuple[str, str, int]]:
    """(language, segment, count) of about ``per_language`` whole labelled documents of each language.

    A hash of the row draws the documents at a rate of its language, so every language gives as many whatever its share.
    Documents held out, without text or without label give none. The bound keeps what reaches the driver fixed.
    """
    labelled = docs.where(~held_out(docs[id_col]) & docs[lang_col].isNotNull() & docs[text_col].isNotNull()).select(
        docs[lang_col].cast("string").alias("lang"), docs[text_col].alias("text"), F.xxhash64(docs[id_col], docs[text_col]).alias("draw"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    rate = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, per_language / n))])
    chosen = labelled.where(F.pmod(F.col("draw"), F.lit(1_000_003)) < F.try_element_at(rate, F.col("lang")) * 1_000_003)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.update((lang, s) for s in segments(text))
            yield pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.binary()), pa.array(list(found.values()), pa.int64()),
            ], ["lang", "segment", "n"])

    total = chosen.select("lang", "text").mapInArrow(cut, "lang string, segment binary, n long").groupBy("lang", "segment").agg(F.sum("n").alias("n"))
    ranked = total.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), F.xxhash64("segment"), "segment")))
    return sorted((r["lang"], bytes(r["segment"]), r["n"]) for r in ranked.where(F.col("rank") <= per_language_segments).collect())


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network trained on :func:`sample`; None where no document is labelled."""
    found = sample(docs, id_col, text_col, lang_col)
    if not found:
        return None
    classes = sorted({lang for lang, _, _ in found})
    target = np.array([classes.index(lang) for lang, _, _ in found])
    weight = np.sqrt(np.array([n for _, _, n in found], np.float64))
    share = np.bincount(target, weights=weight, minlength=len(classes))
    network = Network(classes)
    network.train([s for _, s, _ in found], target, (weight / share[target]).astype(np.float32) * len(found) / len(classes))
    return network


class Reader:
    """Applies a network to texts and remembers segments."""

    def __init__(self, network: Network) -> None:
        self.network = network
        self.place: dict[bytes, int] = {}
        self.known = np.zeros((MEMO, len(network.classes) + 1), np.float32)

    def _learn(self, wanted: set[bytes]) -> None:
        if len(self.place) + len(wanted) > len(self.known):
            self.place = {}
            if len(wanted) > len(self.known):
                self.known = np.zeros((len(wanted), self.known.shape[1]), np.float32)
            new = sorted(wanted)
        else:
            new = sorted(wanted - self.place.keys())
        if new:
            at = len(self.place)
            self.known[at:at + len(new), :-1] = self.network.scores(new)
            self.known[at:at + len(new), -1] = [len(s) for s in new]
            self.place.update(zip(new, range(at, at + len(new)), strict=True))

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        cut = [Counter(segments(t)) if t and any(map(str.isalpha, t)) else None for t in texts]
        self._learn({s for c in cut if c for s in c})
        names, scores = [], []
        for c in cut:
            if not c:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            times = np.fromiter(c.values(), np.float64, len(c))
            total = times @ self.known[np.fromiter(map(self.place.__getitem__, c), np.int64, len(c))]
            length = total[-1]
            pooled = total[:-1] / max(length, 1) * min(length, 60)  # neighbouring positions are no independent witnesses
            p = np.exp(pooled - pooled.max())
            p /= p.sum()
            best = int(p.argmax())
            names.append(self.network.classes[best])
            scores.append(float(p[best]))
        return names, scores


def predict(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row from its whole text alone.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. Ties go to the first language
    in order; equal texts get equal rows; extra columns are left out.
    """
    classes, hidden, weights = (network.classes, network.hidden, network.weights) if network else ([], HIDDEN, {})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Network(classes, hidden, weights=weights)) if classes else None
        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                part = batch.slice(at, 400)
                names, scores = reader(part.column(2).to_pylist()) if reader else ([UNKNOWN] * part.num_rows, [0.0] * part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    own = docs.select(docs[id_col].cast("long").alias("doc_id"), held_out(docs[id_col]).alias("held_out"), docs[text_col].alias("text"))
    return own.mapInArrow(read, "doc_id long, held_out boolean, lang_pred string, score double")


def label(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fits on the labelled rows of ``docs`` and predicts all of them; see :func:`fit` and :func:`predict`."""
    return predict(docs, fit(docs, id_col, text_col, lang_col), id_col, text_col)


#: Documents whose language is less sure than this are rejected, as are those without one.
LEAST_SCORE = 0.4


def keep_known(docs: DataFrame, network: Network | None, text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs``, all columns, whose predicted language is known with a score of ``least`` or more.

    Rows with null text or no letter go; repeated rows stay repeated. Nothing is shuffled.
    """
    classes, hidden, weights = (network.classes, network.hidden, network.weights) if network else ([], HIDDEN, {})
    place = docs.columns.index(text_col)

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Network(classes, hidden, weights=weights)) if classes else None
        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                part = batch.slice(at, 400)
                names, scores = reader(part.column(place).to_pylist()) if reader else ([UNKNOWN] * part.num_rows, [0.0] * part.num_rows)
                yield part.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(screen, docs.schema)
