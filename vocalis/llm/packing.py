"""Bounded-space online packing into fixed windows (operator 2).

Each partition keeps a fixed number of open windows. A document goes where it leaves least room;
if it fits nowhere, the fullest window is emitted. A window with more than ``slack`` free places is
first topped up with the beginning of the document at hand, so emitted windows lack at most
``slack`` ids. Documents longer than a window fill whole windows first. What is still open at a
partition's end, ``open_windows`` windows at most, goes to a second stage in which eight partitions
meet: windows are merged, and the last ids of such a group are cut at powers of two, which need no
padding.

A null or empty text is a document with the end id only. Rows with a null id are packed like others.
Repeated rows are packed each on their own. A table without rows gives no sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vocalis.llm.pretokens import LibraryEncoder, encoder, read_tokenizer
from vocalis.llm.workspace import Workspace

PIECE = "struct<doc_id:{0},start:bigint,length:bigint,doc_tokens:bigint>"
ROW = "doc_id {0}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Places documents into windows; ``emit(pieces)`` gets each window that is done."""

    def __init__(self, size: int, open_windows: int, slack: int, emit):
        self.size, self.most, self.slack, self.emit = size, open_windows, slack, emit
        self.open: list[tuple[int, list[tuple]]] = []  # room, pieces (doc_id, start, ids, doc_tokens)

    def _put(self, at: int | None, piece: tuple) -> None:
        room, pieces = self.open.pop(at) if at is not None else (self.size, [])
        room, pieces = room - len(piece[2]) // 4, [*pieces, piece]
        if room:
            self.open.append((room, pieces))
        else:
            self.emit(pieces)

    def add(self, doc_id, start: int, ids: bytes, total: int) -> None:
        whole = 4 * self.size
        while len(ids) >= whole:
            self.emit([(doc_id, start, ids[:whole], total)])
            start, ids = start + self.size, ids[whole:]
        while ids:
            n = len(ids) // 4
            best = min((i for i, w in enumerate(self.open) if w[0] >= n), key=lambda i: self.open[i][0], default=None)
            if best is not None or len(self.open) < self.most:
                return self._put(best, (doc_id, start, ids, total))
            fullest = min(range(len(self.open)), key=lambda i: self.open[i][0])
            room = self.open[fullest][0]
            if room > self.slack:
                self._put(fullest, (doc_id, start, ids[: 4 * room], total))
                start, ids = start + room, ids[4 * room :]
            else:
                self.emit(self.open.pop(fullest)[1])


def merge_leftovers(windows: list[list[tuple]], size: int, slack: int, emit) -> None:
    """Fill windows from the fullest down with the pieces of the emptiest; cut the last ids at powers of two."""
    windows = sorted(windows, key=lambda w: -sum(len(p[2]) for p in w))
    rest: list[tuple] = []
    for pieces in windows:
        if size - sum(len(p[2]) for p in pieces) // 4 <= slack:
            emit(pieces)
        else:
            rest += pieces
    left = sum(len(p[2]) for p in rest) // 4
    rest.reverse()
    while left:
        take = min(size, left) if left >= size else 1 << (left.bit_length() - 1)
        left, need, made = left - take, take, []
        while need:
            doc_id, start, ids, total = rest.pop()
            part = ids[: 4 * need]
            made.append((doc_id, start, part, total))
            need -= len(part) // 4
            if len(part) < len(ids):
                rest.append((doc_id, start + len(part) // 4, ids[len(part) :], total))
        emit(made)


class _Rows:
    """Emitted windows as columns."""

    def __init__(self, first: int):
        self.next, self.rows = first, []

    def __call__(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), total, self.next, at))
            at += n
        self.next += 1

    def take(self) -> list[list]:
        out = [list(c) for c in zip(*self.rows, strict=True)] if self.rows else [[] for _ in range(7)]
        self.rows = []
        return out


def pack_sequences(df: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 2, open_windows: int = 32, slack: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document's ids, with ``end_id`` behind them, into sequences of at most ``size``.

    Returns a row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.
    """
    spark = df.sparkSession
    content = spark.sparkContext.broadcast(read_tokenizer(tokenizer))
    id_type = df.schema[id_col].dataType.simpleString()
    end = end_id.to_bytes(4, "little")
    row = ROW.format(id_type)
    fields = f"{row}, part long, pieces array<{PIECE.format(id_type)}>, ids binary"
    target = to_arrow_schema(StructType.fromDDL(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, part = encoder(LibraryEncoder, content.value), TaskContext.get().partitionId()
        rows = _Rows(part << 32)
        packer = Packer(size, open_windows, slack, rows)

        def out(left: list | None = None) -> pa.RecordBatch:
            columns = rows.take()
            n = len(columns[0])
            if left is None:
                left, parts = [None] * n, [part] * n
            else:
                columns, parts = [c + [None] * len(left) for c in columns], [part] * (n + len(left))
                left = [None] * n + left
            pieces = [None if w is None else [{"doc_id": p[0], "start": p[1], "length": len(p[2]) // 4, "doc_tokens": p[3]} for p in w] for w in left]
            ids = [None if w is None else b"".join(p[2] for p in w) for w in left]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*columns, parts, pieces, ids], target, strict=True)], schema=target)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = model.encode(text.as_py() or "") + end
                packer.add(doc_id, 0, ids, len(ids) // 4)
                if len(rows.rows) >= 20_000:
                    yield out()
        yield out([w[1] for w in packer.open])

    space = Workspace(spark, "pack")
    first = space.table(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, fields), "first")
    names = [f.split(" ")[0] for f in row.split(", ")]
    done = first.filter("ids is null").select(*names)

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows = _Rows(((1 << 30) + int(key[0])) << 32)
        windows = []
        for pieces, ids in zip(group["pieces"], group["ids"], strict=True):
            at, window = 0, []
            for p in pieces:
                window.append((p["doc_id"], p["start"], ids[at : at + 4 * p["length"]], p["doc_tokens"]))
                at += 4 * p["length"]
            windows.append(window)
        merge_leftovers(windows, size, slack, rows)
        return pd.DataFrame(dict(zip(names, rows.take(), strict=True)))

    left = first.filter("ids is not null").withColumn("team", F.expr("part div 8")).groupBy("team").applyInPandas(merge, row)
    return done.unionByName(left)
