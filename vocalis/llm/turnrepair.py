"""Repair of conversations whose turns are missing, empty, cut or out of order (operator 13).

A conversation is right if the initials of its roles are ``(s?(ua)+)?``. A dynamic program over its rows and the four
states of that pattern finds the cheapest edits: keep (K) a row, give it the role that is due (R), delete (D) it, or insert (I)
the turn that is due, without text. The edits of a row and the insertions before it are one macro edit. The nine macros
worth trying are the codes of ``CODES``: each ends with its only letter that is no I, so none is the beginning of
another, and strings of codes compare as the lists of the codes' places in that order do. So the program keeps no strings: a state of a layer (a row)
has a cost and the rank of its string among those of the layer, ranks of the next layer follow from (rank of the parent, code), and
the way back goes over parents. Costs are kept relative to the layer's least and states that can no longer win are left out, so there
are few different layers, and steps between them are remembered.

Rows are dealt by ranges of conversation, turn, role and text, so a conversation of any size spreads over many tasks, and are gathered in
pieces of at most ``PIECE_ROWS`` rows or ``PIECE_CHARS`` characters and one row. A conversation within one piece is repaired at once. Of others each piece is
summed up by a table of costs and ranks from every state to every state; tables are combined in order, the rank of a combination
is that of (rank of the first, rank of the second), and each piece is then repaired between the states that turn out. Only summaries, one
for each piece, of a conversation meet in one task, and its repaired texts for the hash.

Nulls in role and text are one space. A null conversation is one of its own, null turns come first. Rows of one turn are ordered by role and text.
Repeated rows are duplicates. A conversation of which no row is left has zeros, no edits and the hash of
an empty string. An empty table gives none; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalis.llm.workspace import Workspace, partitions

PIECE_ROWS = 4096
PIECE_CHARS = 4 << 20
SPACE = "\t\n\v\f\r "
#: The pattern's states: nothing yet, after a system, a user and an assistant turn.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
#: What is inserted or given as a role in each state, and where that leads.
DUE = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
AFTER = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Insertions that are needed for the pattern's end.
TAIL = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
#: Macro edits: a row's edit behind the insertions before it, in ascending order.
CODES = ["D", "ID", "IID", "IIK", "IIR", "IK", "IR", "K", "R"]
#: A state that costs so much more than another can't be on a cheapest way: from any state a few edits lead to where it could lead.
HOPELESS = 16

#: Cost above the row's least and rank of the string, for each state that can be reached; a row of it for each state at the beginning.
Layer = tuple[tuple[tuple[int, int] | None, ...], ...]


def _keeps(state: int, initial: str) -> int | None:
    """The state after a kept row, if it may be kept."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


@lru_cache(maxsize=None)
def _macros(initial: str, fault: str) -> tuple[dict[int, tuple[int, int]], ...]:
    """For each state the states that a row's macros lead to, with the least cost and code."""
    out = []
    for state in STATES:
        best: dict[int, tuple[int, int]] = {}
        for inserts in range(3):
            at = state
            for _ in range(inserts):
                at = AFTER[at]
            ways = [("D", at, DELETE)]
            if fault in ("", "truncated"):
                more = TRUNCATED if fault else 0
                ways.append(("R", AFTER[at], REROLE + more))
                if (kept := _keeps(at, initial)) is not None:
                    ways.append(("K", kept, more))
            for letter, to, cost in ways:
                way = (inserts * INSERT + cost, CODES.index("I" * inserts + letter))
                best[to] = min(best.get(to, way), way)
        out.append(best)
    return tuple(out)


def _ranked(rows: list[dict[int, tuple]]) -> tuple[Layer, tuple[int, ...]]:
    """A layer out of (cost, order, ...) for each beginning and state, and the least cost for each beginning."""
    least = [min((w[0] for w in row.values()), default=0) for row in rows]
    rows = [{s: w for s, w in row.items() if w[0] <= low + HOPELESS} for row, low in zip(rows, least, strict=True)]
    rank = {order: i for i, order in enumerate(sorted({w[1] for row in rows for w in row.values()}))}
    return tuple(tuple((row[s][0] - low, rank[row[s][1]]) if s in row else None for s in STATES) for row, low in zip(rows, least, strict=True)), tuple(least)


@lru_cache(maxsize=50_000)
def _step(layer: Layer, initial: str, fault: str) -> tuple[Layer, tuple[int, ...], tuple[dict[int, tuple[int, int]], ...]]:
    """The next layer, what its costs are above, and (parent, code) of each state."""
    moves, rows, parents = _macros(initial, fault), [], []
    for row in layer:
        best: dict[int, tuple] = {}
        for state, held in enumerate(row):
            if held is None:
                continue
            for to, (cost, code) in moves[state].items():
                way = (held[0] + cost, (held[1], code), state)
                best[to] = min(best.get(to, way), way)
        rows.append(best)
        parents.append({to: (w[2], w[1][1]) for to, w in best.items()})
    return *_ranked(rows), tuple(parents)


def _first(beginnings: tuple[int, ...]) -> Layer:
    return tuple(tuple((0, 0) if s == b else None for s in STATES) for b in beginnings)


def summary(rows: list[tuple[str, str]]) -> tuple[list[list[int | None]], list[list[int | None]]]:
    """Costs and ranks of the cheapest edits of rows (initial, fault) from each state to each."""
    layer, base = _first(tuple(STATES)), [0] * 4
    for initial, fault in rows:
        layer, more, _ = _step(layer, initial, fault)
        base = [b + m for b, m in zip(base, more, strict=True)]
    return [[None if w is None else b + w[0] for w in row] for row, b in zip(layer, base, strict=True)], [[None if w is None else w[1] for w in row] for row in layer]


def edits(rows: list[tuple[str, str]], begin: int = START, end: int | None = None) -> tuple[list[str], int, int]:
    """The macro of each row on the cheapest way from ``begin`` to ``end`` (None: to the pattern's end), the last state and the cost without the tail."""
    layer, base, back = _first((begin,)), 0, []
    for initial, fault in rows:
        layer, more, parents = _step(layer, initial, fault)
        base += more[0]
        back.append(parents[0])
    if end is None:
        end = min((s for s in STATES if layer[0][s] is not None), key=lambda s: (layer[0][s][0] + INSERT * TAIL[s], layer[0][s][1]))
    cost, state, out = base + layer[0][end][0], end, []
    for parents in reversed(back):
        state, code = parents[state]
        out.append(CODES[code])
    return out[::-1], end, cost


@dataclass
class Combined:
    """Summaries in order: the cheapest way from the start to each state, and each summary's parents."""

    layer: Layer
    base: int
    parents: list[dict[int, int]]

    @classmethod
    def new(cls) -> Combined:
        return cls(_first((START,)), 0, [])

    def add(self, costs: list[list[int | None]], ranks: list[list[int | None]]) -> None:
        best: dict[int, tuple] = {}
        for state, held in enumerate(self.layer[0]):
            for to in STATES if held is not None else ():
                if costs[state][to] is not None:
                    way = (held[0] + costs[state][to], (held[1], ranks[state][to]), state)
                    best[to] = min(best.get(to, way), way)
        self.layer, (more,) = _ranked([best])
        self.base += more
        self.parents.append({to: w[2] for to, w in best.items()})

    def way(self) -> tuple[list[tuple[int, int]], int]:
        """States before and after each summary on the cheapest way to the pattern's end, and its cost."""
        row = self.layer[0]
        state = min((s for s in STATES if row[s] is not None), key=lambda s: (row[s][0] + INSERT * TAIL[s], row[s][1]))
        cost, out = self.base + row[state][0] + INSERT * TAIL[state], []
        for parents in reversed(self.parents):
            out.append((parents[state], state))
            state = parents[state]
        return out[::-1], cost


def _digest(role: str, text: str) -> bytes:
    return xxhash.xxh3_128_digest(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"))


def faults(roles: list[str], texts: list[str], seen: set[bytes]) -> list[str]:
    """The first fault of each row, or nothing; ``seen`` has digests of the rows before."""
    out = []
    for role, text in zip(roles, texts, strict=True):
        bare = text.strip(SPACE)
        if not bare:
            out.append("blank")
            continue
        digest = _digest(role, text)
        out.append("duplicate" if digest in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add(digest)
    return out


def _illegal(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))


def repaired(roles: list[str], texts: list[str], macros: list[str], begin: int, tail: int) -> list[dict]:
    """The turns that macros, and insertions behind the last row, leave."""
    state, out = begin, []

    def turn(role: str, text: str, to: int) -> None:
        nonlocal state
        out.append({"role": role, "text": text})
        state = to

    for role, text, macro in zip(roles, texts, macros, strict=True):
        for letter in macro:
            if letter == "I":
                turn(DUE[state], "", AFTER[state])
            elif letter == "R":
                turn(DUE[state], text, AFTER[state])
            elif letter == "K":
                turn(role, text, _keeps(state, role[:1]))
    for _ in range(tail):
        turn(DUE[state], "", AFTER[state])
    return out


def _hashed(turns: list[dict], sha, first: bool) -> None:
    for t in turns:
        sha.update(("" if first else "\n").encode() + f"{t['role']}:{t['text']}".encode("utf-8", "surrogatepass"))
        first = False


def damage_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, turn, role, text, gone`` of a table of turns after damage that a checksum of conversation and turn deals out; dropped rows stay, with ``gone``."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv_col).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), blank))
    kind, role, text = F.crc32(key.cast("binary")) % 20, F.coalesce(role_col, blank), F.coalesce(text_col, blank)
    hurt = rows.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return hurt.drop("copy")


def _gather(rows: DataFrame, n: int, piece_rows: int) -> DataFrame:
    """Rows in pieces ``part, seq, conv, edge, turns, roles, texts``, in order of part and seq; a conversation that may have several has ``edge`` in all."""
    order = ["conv", "turn", "role", "text"]
    kind = dict(rows.dtypes)["conv"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, first, several = TaskContext.get().partitionId(), 0, True, False
        conv, turns, roles, texts, chars, begun = None, [], [], [], 0, False
        conv_type = None

        def piece(edge: bool) -> pa.RecordBatch:
            nonlocal turns, roles, texts, chars, seq
            columns = [pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([conv], conv_type), pa.array([edge]), pa.array([turns], pa.list_(pa.int64())), pa.array([roles], pa.list_(pa.string())), pa.array([texts], pa.list_(pa.string()))]
            turns, roles, texts, chars, seq = [], [], [], 0, seq + 1
            return pa.RecordBatch.from_arrays(columns, names=["part", "seq", "conv", "edge", "turns", "roles", "texts"])

        for batch in batches:
            conv_type = batch.schema.field(0).type
            for c, turn, role, text, gone in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if not begun or c != conv:
                    if begun:
                        yield piece(first or several)
                        first = False
                    conv, begun, several = c, True, False
                if len(turns) >= piece_rows or chars >= PIECE_CHARS:
                    several = True
                    yield piece(True)
                if not gone:
                    turns.append(turn)
                    roles.append(role)
                    texts.append(text)
                    chars += len(role) + len(text)
        if begun:
            yield piece(True)

    dealt = rows.select(*order, "gone").repartitionByRange(n, *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, f"part int, seq long, conv {kind}, edge boolean, turns array<long>, roles array<string>, texts array<string>")


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
TURNS = "array<struct<role:string,text:string>>"


def _counts(turns: list[int | None], roles: list[str], found: list[str]) -> list[int]:
    known = [t for t in turns if t is not None]
    return [max(known) - min(known) + 1 - len(set(known)) if known else 0, *(found.count(x) for x in ("blank", "duplicate", "truncated")), _illegal(roles)]


@dataclass
class Repair:
    """``report``: a row for each conversation (``conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``);
    ``turns``: the repaired turns (``conv, part, seq, turns``), in order of part and seq."""

    report: DataFrame
    turns: DataFrame


def repair_conversations(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> Repair:
    """Repair conversations given as rows ``conv, turn, role, text, gone`` (rows that are gone only tell that there is a conversation)."""
    spark = rows.sparkSession
    space, n = Workspace(spark, "turns"), partitions(spark)
    kind = dict(rows.dtypes)["conv"]
    pieces = space.table(_gather(rows, n, piece_rows), "pieces")

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for turns, roles, texts in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True):
                found = faults(roles, texts, set())
                macros, end, cost = edits([(r[:1], f) for r, f in zip(roles, found, strict=True)])
                left, sha = repaired(roles, texts, macros, START, TAIL[end]), hashlib.sha256()
                _hashed(left, sha, True)
                out.append((*_counts(turns, roles, found), cost + INSERT * TAIL[end], "".join(macros) + "I" * TAIL[end], sha.hexdigest(), left))
            if out:
                columns = list(zip(*out, strict=True))
                turn_type = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
                arrays = [*batch.columns[:3], *(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.string()), pa.array(columns[7], pa.string()), pa.array(columns[8], turn_type)]
                yield pa.RecordBatch.from_arrays(arrays, names=["conv", "part", "seq", *COUNTS, "audit", "repaired_sha256", "left"])

    closed = pieces.filter("not edge").select("conv", "part", "seq", "turns", "roles", "texts")
    counted = ", ".join(f"{c} long" for c in COUNTS)
    closed = space.table(closed.mapInArrow(alone, f"conv {kind}, part int, seq long, {counted}, audit string, repaired_sha256 string, left {TURNS}"), "closed")
    report, turns = _across(pieces.filter("edge"), kind, space, n)
    return Repair(closed.select("conv", *COUNTS, "audit", "repaired_sha256").unionByName(report), closed.select("conv", "part", "seq", F.col("left").alias("turns")).unionByName(turns))


def _across(pieces: DataFrame, kind: str, space: Workspace, n: int) -> tuple[DataFrame, DataFrame]:
    """Report and turns of conversations that have several pieces."""
    # a string that tells conversations apart, the null one too
    group = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("null")).alias("group")
    pieces = pieces.select(group, "part", "seq", "conv", "turns", "roles", "texts")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (roles, texts) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                some = list({_digest(r, t) for r, t in zip(roles, texts, strict=True) if t.strip(SPACE)})
                at = pa.array([i] * len(some), pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(3)), pa.array(some, pa.binary())], names=["group", "part", "seq", "digest"])

    # each piece names a row once, however often it has it
    told = space.table(pieces.select("group", "part", "seq", "roles", "texts").mapInArrow(digests, "group string, part int, seq long, digest binary"), "told")
    first = told.groupBy("group", "digest").agg(F.min(F.struct("part", "seq")).alias("first"), F.max(F.struct("part", "seq")).alias("last")).filter("first < last").drop("last")
    before = told.join(first, ["group", "digest"]).filter(F.struct("part", "seq") > F.col("first")).groupBy("part", "seq").agg(F.collect_list("digest").alias("before"))
    open_ = space.table(pieces.join(before, ["part", "seq"], "left").select("group", "part", "seq", "conv", "turns", "roles", "texts", "before"), "open")

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for turns, roles, texts, before in zip(*(batch.column(i).to_pylist() for i in range(3, 7)), strict=True):
                found = faults(roles, texts, set(before or ()))
                costs, ranks = summary([(r[:1], f) for r, f in zip(roles, found, strict=True)])
                known = [t for t in turns if t is not None]
                span = [min(known), max(known), len(set(known))] if known else [None, None, 0]
                out.append((sum(costs, []), sum(ranks, []), [*_counts(turns, roles, found)[1:], *span], [r[:1] for r in roles[:1] + roles[-1:]]))
            if out:
                c = list(zip(*out, strict=True))
                arrays = [*batch.columns[:3], *(pa.array(x, pa.list_(pa.int64())) for x in c[:3]), pa.array(c[3], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["group", "part", "seq", "costs", "ranks", "counts", "ends"])

    summed = open_.select("group", "part", "seq", "turns", "roles", "texts", "before").mapInArrow(summaries, "group string, part int, seq long, costs array<long>, ranks array<long>, counts array<long>, ends array<string>")

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "seq", "begin", "end", "tail", *COUNTS]

        def close() -> pa.RecordBatch:
            path, cost = combined.way()
            spans = [c for c in counts if c[4] is not None]
            # a turn may stand in two pieces that follow each other
            distinct = sum(c[6] for c in spans) - sum(a[5] == b[4] for a, b in zip(spans, spans[1:], strict=False))
            gaps = max(c[5] for c in spans) - min(c[4] for c in spans) + 1 - distinct if spans else 0
            edges = [e for e in ends if e]
            illegal = sum(c[3] for c in counts) + sum(a[-1] + b[0] not in ("su", "ua", "au") for a, b in zip(edges, edges[1:], strict=False))
            totals = [gaps, *(sum(c[i] for c in counts) for i in range(3)), illegal, cost]
            rows = [(*place, begin, end, 0, *[0] * 6) for place, (begin, end) in zip(places, path, strict=True)]
            rows[-1] = (*places[-1], *path[-1], TAIL[path[-1][1]], *totals)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i in (0, 2, 3, 4) else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], names=names)

        at, combined, places, counts, ends = None, Combined.new(), [], [], []
        for batch in batches:
            for group, part, seq, costs, ranks, count, end in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if group != at:
                    if places:
                        yield close()
                    at, combined, places, counts, ends = group, Combined.new(), [], [], []
                combined.add([costs[i : i + 4] for i in range(0, 16, 4)], [ranks[i : i + 4] for i in range(0, 16, 4)])
                places.append((part, seq))
                counts.append(count)
                ends.append(end)
        if places:
            yield close()

    counted = ", ".join(f"{c} long" for c in COUNTS)
    path = summed.repartition(n, "group").sortWithinPartitions("group", "part", "seq").mapInArrow(ways, f"part int, seq long, begin int, end int, tail int, {counted}")
    path = space.table(path, "path")

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_type = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            audits, left = [], []
            for roles, texts, before, begin, end, tail in zip(*(batch.column(i).to_pylist() for i in range(4, 10)), strict=True):
                found = faults(roles, texts, set(before or ()))
                macros, _, _ = edits([(r[:1], f) for r, f in zip(roles, found, strict=True)], begin, end)
                audits.append("".join(macros) + "I" * tail)
                left.append(repaired(roles, texts, macros, begin, tail))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *batch.columns[10:], pa.array(audits, pa.string()), pa.array(left, turn_type)], names=["group", "conv", "part", "seq", *COUNTS, "audit", "left"])

    whole = open_.join(path, ["part", "seq"]).select("group", "conv", "part", "seq", "roles", "texts", "before", "begin", "end", "tail", *COUNTS)
    mended = space.table(whole.mapInArrow(mend, f"group string, conv {kind}, part int, seq long, {counted}, audit string, left {TURNS}"), "mended")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> pa.RecordBatch:
            arrays = [pa.array([conv], conv_type), *(pa.array([x], pa.int64()) for x in totals), pa.array(["".join(audits)]), pa.array([sha.hexdigest()])]
            return pa.RecordBatch.from_arrays(arrays, names=["conv", *COUNTS, "audit", "repaired_sha256"])

        at, conv, conv_type, totals, audits, sha, first = None, None, None, [0] * 6, [], hashlib.sha256(), True
        for batch in batches:
            conv_type = batch.schema.field(1).type
            for row in range(batch.num_rows):
                group, c, *counts, audit, left = (x[row].as_py() for x in batch.columns)
                if group != at:
                    if at is not None:
                        yield close()
                    at, conv, totals, audits, sha, first = group, c, [0] * 6, [], hashlib.sha256(), True
                totals = [a + b for a, b in zip(totals, counts, strict=True)]
                audits.append(audit)
                _hashed(left, sha, first)
                first = first and not left
        if at is not None:
            yield close()

    ordered = mended.repartition(n, "group").sortWithinPartitions("group", "part", "seq").select("group", "conv", *COUNTS, "audit", "left")
    report = ordered.mapInArrow(fold, f"conv {kind}, {counted}, audit string, repaired_sha256 string")
    return report, mended.select("conv", "part", "seq", F.col("left").alias("turns"))
