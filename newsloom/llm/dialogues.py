"""Repair of conversations whose turns are damaged: the cheapest edits that give well-formed roles.

Roles must read ``(s?(ua)+)?``: nothing, or an optional system turn and then pairs of user and assistant. States say what
came last: 0 nothing, 1 system, 2 user, 3 assistant. Edits of a row are Keep, Rerole and Delete; Inserts stand between
rows. A backward cost pass tells which arcs lie on cheapest paths. Their nodes are ranked by the first 1, 2, 4, ... letters
of their audits, with pointers that jump as far; ranks and pointers give the least of the cheapest audits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from newsloom.llm.common import parts_for

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: State after a turn of the role that may follow; a system turn may be kept at the start only.
FOLLOWS = np.array([2, 2, 3, 2])
ROLE = {2: "user", 3: "assistant"}
#: State after keeping a turn with initial s, u, a or another one; -1 where it cannot stay.
KEPT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: Cost from each state when no row is left: inserts up to a finished pair.
LAST = np.array([0, 2 * INSERT, INSERT, 0])
LEGAL = np.array([[0, 1, 0, 0], [0, 0, 1, 0], [0, 1, 0, 0], [0, 0, 0, 0]], bool)
NEVER = 1 << 60
#: Rows of a conversation that the cost pass takes one after the other; longer ones are cut into such pieces.
PIECE = 512
#: Rows whose conversations are ranked together.
TOGETHER = 50_000


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: the damage that crc32 of ``conv_id:turn`` gives each row; a dropped row is ``gone``.

    Null roles and texts are one space, as are null ids and turns in that key.
    """
    space = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space(rows["conv_id"]), F.lit(":"), space(rows["turn"]))) % 20
    told = rows.select(
        rows["conv_id"].cast("long").alias("conv_id"), rows["turn"].cast("long").alias("turn"), space(rows["role"]).alias("role"),
        space(rows["text"]).alias("text"), fault.alias("fault"))
    fault, text = F.col("fault"), F.col("text")
    return told.select(
        "conv_id", "turn", F.when(fault == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (fault == 0).alias("gone"), F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def costs(initial: np.ndarray, must: np.ndarray, late: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Least cost to the end from each (row, state), and from the place after the last row of each conversation.

    ``ends`` are the ends of the conversations. Places are rows shifted by one for each conversation before them.
    """
    firsts = np.append(0, ends[:-1])
    lengths = ends - firsts
    counts = np.maximum(1, -(-lengths // PIECE))
    owner = np.repeat(np.arange(len(ends)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = firsts[owner] + number * PIECE
    size = np.minimum(begin + PIECE, ends[owner]) - begin
    place = begin + owner

    def before(row: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Costs before rows from the costs after them; ``after`` has a state in its last axis."""
        kept = KEPT[:, initial[row]].T
        extra = np.where(late[row], TRUNCATED, 0)
        shape = (len(row),) + (1,) * (after.ndim - 2)
        cost = after + DELETE
        stay = ~must[row]
        extra, stay = extra.reshape(*shape, 1), stay.reshape(*shape, 1)
        kept = np.broadcast_to(kept.reshape(*shape, 4), after.shape)
        cost = np.where(stay & (kept >= 0), np.minimum(cost, np.take_along_axis(after, np.maximum(kept, 0), -1) + KEEP + extra), cost)
        cost = np.where(stay, np.minimum(cost, after[..., FOLLOWS] + REROLE + extra), cost)
        pair = np.minimum(cost[..., 2:], cost[..., :1:-1] + INSERT)  # inserts lead from 2 to 3 and back
        return np.concatenate([np.minimum(cost[..., :2], pair[..., :1] + INSERT), pair], -1)

    def through(pieces: np.ndarray, after: np.ndarray, out: np.ndarray | None) -> np.ndarray:
        """Costs before each piece; ``out`` takes those before each of its rows."""
        order = pieces[np.argsort(-size[pieces], kind="stable")]
        at = np.argsort(np.argsort(-size[pieces], kind="stable"))
        value = after[np.argsort(at)].copy()
        sizes = -size[order]
        for k in range(int(size[pieces].max(initial=0))):
            live = int(np.searchsorted(sizes, -k, "left"))
            row = begin[order[:live]] + size[order[:live]] - 1 - k
            value[:live] = before(row, value[:live])
            if out is not None:
                out[place[order[:live]] + size[order[:live]] - 1 - k] = value[:live]
        return value[at]

    after = np.tile(LAST, (len(owner), 1))
    inner = np.flatnonzero(counts[owner] > 1)
    if len(inner):  # what each piece does to costs from each state, then piece by piece from the end
        unit = np.full((4, 4), NEVER)
        np.fill_diagonal(unit, 0)
        moves = np.zeros((len(owner), 4, 4), np.int64)
        moves[inner] = through(inner, np.broadcast_to(unit, (len(inner), 4, 4)), None)
        for back in range(1, int(counts.max())):
            now = np.flatnonzero(number == counts[owner] - 1 - back)
            later = now + 1
            after[now] = np.minimum((moves[later] + after[later][:, :, None]).min(1), NEVER)
    out = np.zeros((int(ends[-1] if len(ends) else 0) + len(ends), 4), np.int64)
    out[ends + np.arange(len(ends))] = LAST
    through(np.arange(len(owner)), after, out)
    return out


def audits(initial: np.ndarray, must: np.ndarray, late: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Cost and least cheapest audit of each conversation."""
    cost = costs(initial, must, late, ends)
    places = len(cost)
    last = np.zeros(places, bool)
    last[ends + np.arange(len(ends))] = True
    state = np.tile(np.arange(4), places)
    node = np.arange(4 * places)
    flat, at = cost.ravel(), node // 4
    row = np.minimum(at - np.searchsorted(ends + np.arange(len(ends)), at), max(len(initial) - 1, 0))
    mid = ~last[at]
    stay, extra, kept = (
        (mid & ~must[row], np.where(late[row], TRUNCATED, 0), KEPT[state, initial[row]]) if len(initial)
        else (np.zeros(len(node), bool), np.zeros(len(node), np.int64), np.full(len(node), -1)))
    after = np.minimum(at + 1, places - 1) * 4
    arcs = [  # letter, target, does it lie on a cheapest path; in the order of letters
        ("D", after + state, mid & (flat == flat[np.minimum(after + state, len(flat) - 1)] + DELETE)),
        ("I", at * 4 + FOLLOWS[state], flat == flat[at * 4 + FOLLOWS[state]] + INSERT),
        ("K", after + np.maximum(kept, 0), stay & (kept >= 0) & (flat == flat[after + np.maximum(kept, 0)] + KEEP + extra)),
        ("R", after + FOLLOWS[state], stay & (flat == flat[after + FOLLOWS[state]] + REROLE + extra)),
    ]
    # a letter leaves a node by one arc at most: the least first letter also names the target
    letter, jump = np.zeros(len(node), np.uint8), node.copy()
    for name, target, best in reversed(arcs):
        letter[best], jump[best] = ord(name), target[best]
    rank, length, jumps = letter.astype(np.int64), (letter > 0).astype(np.int64), [jump]
    starts = np.append(0, (ends + np.arange(len(ends)) + 1)[:-1]) * 4
    while len(starts):
        # the first 2k letters are the first k, then the first k from where these lead; an audit that has ended ranks first
        doubled = rank * (int(rank.max()) + 1) + rank[jump]
        longer = length + length[jump]
        if (longer == length).all():
            break
        rank, length = np.unique(doubled, return_inverse=True)[1].reshape(-1), longer
        jump = jump[jump]
        jumps.append(jump)
    # among cheapest arcs the least letter, then the least rank of the rest
    choice = np.full(len(node), np.iinfo(np.int64).max)
    width = int(rank.max(initial=0)) + 1
    for name, target, best in arcs:
        choice[best] = np.minimum(choice[best], ord(name) * width + rank[target[best]])
    sizes = length[starts]
    step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    here = np.repeat(starts, sizes)
    for j, jump in enumerate(jumps):
        here = np.where(step >> j & 1, jump[here], here)
    text = (choice[here] // width).astype(np.uint8).tobytes().decode()
    cuts = np.cumsum(sizes).tolist()
    return flat[starts], [text[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]


_FACTS = "key string, conv_id long, part int, seq long, rows binary"
_ROW = np.dtype([("turn", "<i8"), ("has_turn", "u1"), ("initial", "u1"), ("blank", "u1"), ("open", "u1"), ("digest", "S16")])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a conversation as one binary row; rows that are gone leave the conversation's id only."""
    part, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        packed = np.zeros(batch.num_rows, _ROW)
        packed["turn"], packed["has_turn"] = columns["turn"].fill_null(0).to_numpy(), np.array(columns["turn"].is_valid())
        for name in ("initial", "blank", "open"):
            packed[name] = columns[name].to_numpy(zero_copy_only=False)
        packed["digest"] = np.frombuffer(b"".join(columns["digest"].to_pylist()), "S16")
        alive = ~columns["gone"].to_numpy(zero_copy_only=False)
        keys = columns["key"].to_pylist()
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        yield pa.RecordBatch.from_arrays([
            pa.array([keys[a] for a in cuts[:-1]]), columns["conv_id"].take(pa.array(cuts[:-1])), pa.array(np.full(len(cuts) - 1, part, np.int32)),
            pa.array(np.arange(seq, seq + len(cuts) - 1)), pa.array([packed[a:b][alive[a:b]].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
        ], ["key", "conv_id", "part", "seq", "rows"])
        seq += len(cuts) - 1


_TOLD = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Facts, cost and audit of whole conversations, as many at a time as ``TOGETHER`` rows hold."""
    waiting: list[tuple[str, int | None, list[bytes]]] = []
    size = 0

    def made() -> pa.RecordBatch:
        rows = np.frombuffer(b"".join(b"".join(x[2]) for x in waiting), _ROW)
        lengths = np.array([sum(map(len, x[2])) for x in waiting]) // _ROW.itemsize
        ends = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(waiting)), lengths)
        same = owner[1:] == owner[:-1] if len(rows) else np.zeros(0, bool)
        count = lambda mask: np.bincount(owner[mask], minlength=len(waiting))
        blank = rows["blank"].astype(bool)
        halves = np.ascontiguousarray(rows["digest"]).view("<u8").reshape(-1, 2) if len(rows) else np.zeros((0, 2), np.uint64)
        order = np.lexsort((np.arange(len(rows)), halves[:, 1], halves[:, 0], owner))
        again = np.zeros(len(rows), bool)
        if len(rows):
            again[order[1:]] = (owner[order[1:]] == owner[order[:-1]]) & (halves[order[1:]] == halves[order[:-1]]).all(1)
        again &= ~blank
        late = rows["open"].astype(bool) & ~blank & ~again
        initial = rows["initial"].astype(np.int64)
        pairs = np.flatnonzero(same & ~LEGAL[initial[:-1], initial[1:]]) if len(rows) else np.zeros(0, np.int64)
        timed = np.flatnonzero(rows["has_turn"])
        own, turn = owner[timed], rows["turn"][timed]
        gaps = np.zeros(len(waiting), np.int64)
        if len(timed):  # rows are in the order of turns
            head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            tail = np.append(head[1:], len(own)) - 1
            new = np.append(True, (own[1:] != own[:-1]) | (turn[1:] != turn[:-1]))
            gaps[own[head]] = turn[tail] - turn[head] + 1 - np.add.reduceat(new.astype(np.int64), head)
        cost, said = audits(initial, blank | again, late, ends)
        numbers = [gaps, count(blank), count(again), count(late), count(pairs), cost]
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in waiting]), pa.array([x[1] for x in waiting], pa.int64()), *(pa.array(v, pa.int64()) for v in numbers), pa.array(said)],
            ["key", "conv_id", *_TOLD, "audit"])

    for batch in batches:
        for key, conv, rows in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4)), strict=True):
            if not waiting or waiting[-1][0] != key:
                if size >= TOGETHER * _ROW.itemsize:
                    yield made()
                    waiting, size = [], 0
                waiting.append((key, conv, []))
            waiting[-1][2].append(rows)
            size += len(rows)
    if waiting:
        yield made()


class Repair:
    """Applies an audit to the rows of a conversation one after the other; holds no text."""

    def __init__(self, audit: str) -> None:
        self.edits, self.state, self.hash, self.begun = iter(audit), 0, hashlib.sha256(), False

    def _say(self, role: str, text: str, state: int) -> None:
        self.hash.update(f"{chr(10) if self.begun else ''}{role}:{text}".encode())
        self.begun, self.state = True, state

    def row(self, role: str, text: str) -> None:
        for edit in self.edits:
            follows = int(FOLLOWS[self.state])
            if edit == "I":
                self._say(ROLE[follows], "", follows)
                continue
            if edit == "K":
                self._say(role, text, int(KEPT[self.state, "sua".index(role[0])]))
            elif edit == "R":
                self._say(ROLE[follows], text, follows)
            return

    def done(self) -> str:
        for _ in self.edits:  # inserts after the last row
            follows = int(FOLLOWS[self.state])
            self._say(ROLE[follows], "", follows)
        return self.hash.hexdigest()


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired conversations' hashes; the audit of each comes before its rows."""
    names = ["conv_id", *_TOLD, "audit", "repaired_sha256"]
    told: list | None = None
    repair = Repair("")

    def batch_of(rows: list[list]) -> pa.RecordBatch:
        kinds = [*[pa.int64()] * 7, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 9, kinds, strict=True)], names)

    for batch in batches:
        out = []
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("role", "text", *names[:-1])]
        for role, text, *facts in zip(*columns, strict=True):
            if facts[-1] is None:
                repair.row(role, text)
                continue
            if told is not None:
                out.append([*told, repair.done()])
            told, repair = facts, Repair(facts[-1])
        yield batch_of(out)
    if told is not None:
        yield batch_of([[*told, repair.done()]])


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of ``rows``.

    Takes rows (conv_id, turn, role, text, gone) like those of :func:`damaged`; a ``gone`` row only names its conversation.
    Rows are taken by turn, nulls first, equal turns by role and text. A null conv_id is a conversation of its own, an empty
    table gives no rows, extra columns are left out. A row's digest (md5 of role and text) stands for it in the search for
    duplicates. Rows are sorted over ranges, so that a long conversation's rows are read by many tasks; its facts, 28 bytes
    a row, then meet in one task, as its audit is one value, and its texts pass once more in order, a batch at a time, as its
    hash is one chain.
    """
    role, text = rows["role"], rows["text"]
    tail = F.rtrim(text, F.lit(" \t\n\x0b\x0c\r"))
    facts = rows.select(
        F.coalesce(rows["conv_id"].cast("string"), F.lit(" ")).alias("key"), "conv_id", "turn", role.alias("role"), text.alias("text"), "gone",
        _initial(role).alias("initial"), (F.length(tail) == 0).alias("blank"), (~tail.rlike(r"[.!?]\z")).alias("open"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"))
    parts = parts_for(rows)
    order = ["key", "turn", "role", "text"]
    packed = facts.repartitionByRange(parts, "key", "turn").sortWithinPartitions(*order).mapInArrow(_pack, _FACTS)
    judged = packed.repartition(parts, "key").sortWithinPartitions("key", "part", "seq").mapInArrow(
        _judge, "key string, conv_id long, " + ", ".join(f"{c} long" for c in _TOLD) + ", audit string")
    texts = facts.filter(~F.col("gone")).select("key", "turn", "role", "text")
    both = judged.withColumn("kind", F.lit(0)).unionByName(texts.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return both.repartition(parts, "key").sortWithinPartitions("key", "kind", *order[1:]).mapInArrow(
        _hash, "conv_id long, " + ", ".join(f"{c} long" for c in _TOLD) + ", audit string, repaired_sha256 string")


def report(conversations: DataFrame) -> DataFrame:
    """Damages ``conversations`` and repairs them; see :func:`damaged` and :func:`repair`."""
    return repair(damaged(conversations))
