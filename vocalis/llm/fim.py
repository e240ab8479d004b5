"""Fill-in-middle transformation by a parallel scan with an automaton (operator 11).

A text is cut into lines, each with its line feed, and rearranged so that a model learns to fill in the
middle: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle (psm) or ``<S>`` suffix ``<P>`` prefix ``<M>`` middle (spm). Texts that are
empty or hold one of the marks stay plain. The cuts follow from a checksum of the document's id, counted in lines.

The automaton reads bytes of UTF-8: whether a line is open, and how much of a mark has been read (the last state,
a whole mark, is never left), eight states in all. A chunk of a text tells, for each state it may be entered in, the state it is left in and the
lines that end in it. These functions compose associatively: chunks of a block first, then the blocks of a
document. That gives the lines of the document, so the cuts in lines, and lines and bytes before each chunk, so the chunks that
hold a cut; only these are read again to find its place. Texts of one chunk are entered in the first state and need no composition. Texts of
several chunks are cut and dealt out chunk by chunk, blocks have at most 256 chunks, and a document's blocks are bounded by the 2 GiB
that a text may have.

Null texts are empty. The checksum of a null id is that of no digits. Rows that repeat an id are cut each by its own
text. An empty table gives an empty one. All columns of the table stay but for those named like the ones that are added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from vocalis.llm.workspace import Workspace, fresh, partitions

CHUNK = 1 << 16
BLOCK = 256
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARK = re.compile(rb"<[PSM]>")
#: How much of a mark has been read: nothing, its first byte, its second, all of it.
MARKS = 4
#: State ``MARKS * open + mark``, where ``open`` tells that a line has begun.
STATES = 2 * MARKS

#: For each state at the beginning the state at the end and the lines that end between.
Function = tuple[list[int], list[int]]
IDENTITY: Function = list(range(STATES)), [0] * STATES


def _mark(state: int, byte: int) -> int:
    if state == 3 or (state == 2 and byte == 0x3E):
        return 3
    if byte == 0x3C:
        return 1
    return 2 if state == 1 and byte in b"PSM" else 0


def scan(chunk: bytes) -> Function:
    """The function of a chunk. After two bytes the state no longer hangs on where the chunk was entered, but for a whole mark."""
    ends, lines = [], chunk.count(b"\n")
    whole = _MARK.search(chunk) is not None
    last = 0
    for byte in chunk[-2:]:
        last = _mark(last, byte)
    for state in range(STATES):
        open_, mark = divmod(state, MARKS)
        for byte in chunk[:2]:
            mark = _mark(mark, byte)
        if mark != 3 and len(chunk) > 2:
            mark = last
        if whole:
            mark = 3
        ends.append(MARKS * (int(chunk[-1] != 0x0A) if chunk else open_) + mark)
    return ends, [lines] * STATES


def compose(first: Function, second: Function) -> Function:
    """The function of two chunks that follow each other."""
    return [second[0][s] for s in first[0]], [n + second[1][s] for n, s in zip(first[1], first[0], strict=True)]


def line_end(chunk: bytes, k: int) -> int:
    """Bytes of a chunk up to the end of its k-th line."""
    return int(np.flatnonzero(np.frombuffer(chunk, np.uint8) == 0x0A)[k - 1]) + 1


def plan(total: Function, h: list[int], rate: int, spm: int) -> tuple[int, str, int, int]:
    """Lines, form and the lines of the two cuts of a text with this function, entered in state 0."""
    end, n = total[0][0], total[1][0]
    n += end >= MARKS  # the last line has no line feed
    if not n or end % MARKS == 3 or h[2] % 100 >= rate:
        return n, "plain", 0, 0
    cuts = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    return n, "spm" if h[3] % 100 < spm else "psm", *cuts


def arrange(text: bytes, form: str, p: int, q: int) -> bytes:
    """The text in a form, with cuts at bytes p and q."""
    prefix, middle, suffix = text[:p], text[p:q], text[q:]
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    if form == "psm":
        return marks[0] + prefix + marks[1] + suffix + marks[2] + middle
    return marks[1] + suffix + marks[0] + prefix + marks[2] + middle if form == "spm" else text


def restored(output: Column | str, form: Column | str) -> Column:
    """The text that an output of a form was made of; its marks stand nowhere else in it."""
    output = F.col(output) if isinstance(output, str) else output
    form = F.col(form) if isinstance(form, str) else form

    def split(one: str, two: str, three: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, len(one) + 1, 0x7FFFFFFF)
        first = F.substring_index(body, two, 1)
        rest = F.substring(body, F.length(first) + len(two) + 1, F.length(body))
        second = F.substring_index(rest, three, 1)
        return first, second, F.substring(rest, F.length(second) + len(three) + 1, F.length(rest))

    prefix, suffix, middle = split(PREFIX, SUFFIX, MIDDLE)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = split(SUFFIX, PREFIX, MIDDLE)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def fill_in_middle(docs: DataFrame, rate: int = 100, spm: int = 50, seed: str = "7", chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text", n_col: str = "n", form_col: str = "form", prefix_col: str = "prefix_chars", middle_col: str = "middle_chars", output_col: str = "output") -> DataFrame:
    """Add to a table the lines of each text, its form, the code points of prefix and middle (null where plain) and the output."""
    spark = docs.sparkSession
    added = [n_col, form_col, prefix_col, middle_col, output_col]
    docs = docs.drop(*(c for c in docs.columns if c.lower() in [a.lower() for a in added]))
    # four numbers for each document, and two that tell its rows apart by id and text
    hex_ = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    hashes = F.array(*(F.conv(F.substring(hex_, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)))
    h_col, k1, k2 = (fresh(c, docs.columns) for c in ("fim_h", "fim_k1", "fim_k2"))
    rows = docs.withColumn(h_col, hashes)
    short = F.coalesce(F.octet_length(text_col) <= chunk, F.lit(True))
    schema = StructType([*docs.schema.fields])
    for name, kind in zip(added, (LongType(), StringType(), LongType(), LongType(), StringType()), strict=True):
        schema = schema.add(name, kind)
    at = docs.columns.index(text_col)

    def results(columns: list, names: list[str], out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        made = [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([*columns, *made[:4], made[4].cast(pa.string())], names=[*names, *added])

    def result(raw: bytes, n: int, form: str, p: int, q: int) -> tuple:
        chars = (None, None) if form == "plain" else (len(raw[:p].decode("utf-8", "replace")), len(raw[p:q].decode("utf-8", "replace")))
        return n, form, *chars, arrange(raw, form, p, q)

    def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, h in zip(batch.column(at).cast(pa.binary()).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                raw = raw or b""
                n, form, *cuts = plan(scan(raw), h, rate, spm)
                ends = [0 if not k else len(raw) if k == n else line_end(raw, k) for k in cuts]
                out.append(result(raw, n, form, *ends))
            yield results(batch.columns[:-1], batch.schema.names[:-1], out)

    keys = [F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias(k1), F.xxhash64(F.lit(11), F.col(id_col).cast("string"), F.col(text_col)).alias(k2)]
    long = rows.filter(~short).select("*", *keys)
    cuts = _distributed_cuts(long.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), F.col(h_col).alias("h"), F.col(text_col).cast("binary").alias("raw")), rate, spm, chunk, Workspace(spark, "fim"), partitions(spark))
    plan_col = fresh("fim_plan", docs.columns)
    planned = cuts.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.struct("n", "form", "p", "q").alias(plan_col))

    def planned_before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [result(raw, x["n"], x["form"], x["p"], x["q"]) for raw, x in zip(batch.column(at).cast(pa.binary()).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            yield results(batch.columns[:-1], batch.schema.names[:-1], out)

    whole = long.join(planned, [k1, k2]).select(*docs.columns, plan_col).mapInArrow(planned_before, schema)
    return rows.filter(short).mapInArrow(at_once, schema).unionByName(whole)


def _distributed_cuts(texts: DataFrame, rate: int, spm: int, chunk: int, space: Workspace, n: int) -> DataFrame:
    """``k1, k2, n, form, p, q`` of texts (k1, k2, h, raw) of any length: lines, form and the bytes before the cuts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in enumerate(batch.column(3)):
                raw = raw.as_py()
                pieces = [raw[a : a + chunk] for a in range(0, len(raw), chunk)]
                same = pa.array([i] * len(pieces), pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(same) for c in range(3)), pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary())], names=["k1", "k2", "h", "no", "raw"])

    key = "k1 long, k2 long, h array<long>"
    chunks = space.table(texts.mapInArrow(cut, f"{key}, no int, raw binary").repartition(n, "k1", "k2", "no"), "chunks")

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column(4).to_pylist()
            ends, lines = (pa.array(x, pa.list_(pa.int64())) for x in zip(*map(scan, raws), strict=True)) if raws else (pa.array([], pa.list_(pa.int64())),) * 2
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], ends, lines, pa.array(list(map(len, raws)), pa.int64())], names=["k1", "k2", "h", "no", "ends", "lines", "size"])

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column(4).to_pylist():
                f, size = IDENTITY, 0
                for x in parts:
                    f, size = compose(f, (x["ends"], x["lines"])), size + x["size"]
                out.append((*f, size))
            if out:
                ends, lines, sizes = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ends, pa.list_(pa.int64())), pa.array(lines, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], names=["k1", "k2", "h", "block", "ends", "lines", "size"])

    shape = "ends array<long>, lines array<long>, size long"
    # a row that is repeated gives the same functions
    one = chunks.mapInArrow(functions, f"{key}, no int, {shape}").dropDuplicates(["k1", "k2", "no"])
    block = F.floor(F.col("no") / BLOCK).cast("int").alias("block")
    parts = one.groupBy("k1", "k2", "h", block).agg(F.sort_array(F.collect_list(F.struct("no", "ends", "lines", "size"))).alias("parts"))
    parts = space.table(parts, "parts")
    blocks = parts.mapInArrow(composed, f"{key}, block int, {shape}")
    blocks = blocks.groupBy("k1", "k2", "h").agg(F.sort_array(F.collect_list(F.struct("block", "ends", "lines", "size"))).alias("blocks"))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, blocks in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                f, size, before = IDENTITY, 0, []
                for x in blocks:
                    before.append({"block": x["block"], "state": f[0][0], "line": f[1][0], "byte": size})
                    f, size = compose(f, (x["ends"], x["lines"])), size + x["size"]
                n, form, p, q = plan(f, h, rate, spm)
                out.append((n, form, p, q, f[1][0], size, before))
            if out:
                kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4, pa.list_(pa.struct([("block", pa.int32()), ("state", pa.int64()), ("line", pa.int64()), ("byte", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names=["k1", "k2", "n", "form", "lp", "lq", "ended", "size", "before"])

    plans = space.table(blocks.mapInArrow(entries, "k1 long, k2 long, n long, form string, lp long, lq long, ended long, size long, before array<struct<block:int,state:long,line:long,byte:long>>"), "plans")

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, (parts, before, *cuts) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(2, 6)), strict=True)):
                state, line, byte = before["state"], before["line"], before["byte"]
                for x in parts:
                    ends = x["lines"][state]
                    out += [(i, x["no"], which, k - line, byte) for which, k in enumerate(cuts) if line < k <= line + ends]
                    state, line, byte = x["ends"][state], line + ends, byte + x["size"]
            rows = pa.array([x[0] for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in range(2)), *(pa.array([x[j] for x in out], k) for j, k in ((1, pa.int32()), (2, pa.int32()), (3, pa.int64()), (4, pa.int64())))], names=["k1", "k2", "no", "which", "k", "byte"])

    entered = plans.filter("form <> 'plain'").select("k1", "k2", "lp", "lq", F.explode("before").alias("before")).withColumn("block", F.col("before.block"))
    wanted = parts.select("k1", "k2", "block", "parts").join(entered, ["k1", "k2", "block"]).select("k1", "k2", "parts", "before", "lp", "lq")
    wanted = wanted.mapInArrow(holders, "k1 long, k2 long, no int, which int, k long, byte long")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [byte + line_end(raw, k) for k, byte, raw in zip(*(batch.column(i).to_pylist() for i in range(3, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ends, pa.int64())], names=["k1", "k2", "which", "end"])

    found = chunks.select("k1", "k2", "no", "raw").join(wanted, ["k1", "k2", "no"]).select("k1", "k2", "which", "k", F.col("byte"), "raw")
    ends = found.select("k1", "k2", "which", "k", "byte", "raw").mapInArrow(places, "k1 long, k2 long, which int, end long")
    ends = ends.groupBy("k1", "k2").agg(*(F.max(F.when(F.col("which") == i, F.col("end"))).alias(c) for i, c in enumerate("pq")))

    def byte(lines: str, end: str) -> Column:
        # the last line may end with the text
        return F.when(F.col("form") == "plain", 0).when(F.col(lines) == 0, 0).when(F.col(lines) > F.col("ended"), F.col("size")).otherwise(F.col(end)).cast("long").alias(end)

    return plans.join(ends, ["k1", "k2"], "left").select("k1", "k2", "n", "form", byte("lp", "p"), byte("lq", "q"))
