"""Token-id files of patched frame-of-reference blocks (operator 9).

Layout of a file, all numbers little-endian:

    magic "VTF1"
    payloads       block after block: 128 deltas to the block's minimum, packed at the block's width
    exceptions     position in the block (u8), then value (u32), for deltas wider than the width
    blocks         minimum (u32), width (u8), exceptions (u8), payload start (u64), first exception (u64)
    documents      id (i64), first token (u64), tokens (u64)
    footer         tokens, blocks, exceptions, documents, where exceptions, blocks and documents begin (u64 each), crc32 of those (u32)

A block's width is the one that holds a chosen share of its deltas (nine tenths by default); the
others go to the exception list. Files are written under a name of their own by each task attempt;
only those that a finished task reported are read, so lost or repeated tasks leave no trace.

A null or empty text is a document with the end id only. Rows with a null id are left out: they have
no place in the order. Repeated ids are kept, next to each other. A table without rows gives no files.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocalis.llm.memory import give_back
from vocalis.llm.pretokens import LibraryEncoder, encoder, read_tokenizer
from vocalis.llm.workspace import Workspace, partitions

BLOCK = 128
BLOCKS = np.dtype([("min", "<u4"), ("width", "u1"), ("extra", "u1"), ("start", "<u8"), ("first", "<u8")])
DOCS = np.dtype([("id", "<i8"), ("start", "<u8"), ("n", "<u8")])
EXTRA = np.dtype([("at", "u1"), ("value", "<u4")])
MAGIC = b"VTF1"


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.where(values == 0, 0, np.floor(np.log2(np.maximum(values, 1).astype(np.float64))).astype(np.int64) + 1)


def pack_blocks(ids: np.ndarray, share: float = 0.9) -> tuple[np.ndarray, bytes, np.ndarray]:
    """Block table, payload and exceptions of a run of ids."""
    n = -(-len(ids) // BLOCK)
    padded = np.empty(n * BLOCK, np.uint32)
    padded[: len(ids)] = ids
    if n:
        padded[len(ids) :] = ids[-1]
    grid = padded.reshape(n, BLOCK)
    table = np.zeros(n, BLOCKS)
    table["min"] = grid.min(axis=1) if n else 0
    deltas = grid - table["min"][:, None]
    if n:
        table["width"] = _widths(np.partition(deltas, int(np.ceil(share * BLOCK)) - 1, axis=1)[:, int(np.ceil(share * BLOCK)) - 1])
    width = table["width"].astype(np.int64)
    # of 32 bits none is wider
    over = deltas > np.minimum((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1), np.uint64(0xFFFFFFFF)).astype(np.uint32)[:, None]
    row, col = np.nonzero(over)
    extra = np.zeros(len(row), EXTRA)
    extra["at"], extra["value"] = col, deltas[row, col]
    table["extra"] = over.sum(axis=1)
    table["first"] = np.cumsum(table["extra"].astype(np.int64)) - table["extra"]
    sizes = width * (BLOCK // 8)
    table["start"] = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    deltas[over] = 0
    for w in np.unique(width):
        if w:
            rows = np.nonzero(width == w)[0]
            for part in np.array_split(rows, max(1, len(rows) // 4096)):
                # as bytes, of as many as the width needs; their low bits, one value behind the other
                some = deltas[part].astype("<u2" if w <= 16 else "<u4")
                bits = np.unpackbits(some.view(np.uint8).reshape(len(part), BLOCK, -1), axis=2, bitorder="little", count=w)
                packed = np.packbits(bits.reshape(len(part), -1), axis=1, bitorder="little")
                out[table["start"][part].astype(np.int64)[:, None] + np.arange(packed.shape[1])] = packed
    return table, out.tobytes(), extra


def unpack_blocks(table: np.ndarray, payload: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """The ids of whole blocks, the last one with its padding."""
    grid = np.zeros((len(table), BLOCK), np.uint32)
    width = table["width"].astype(np.int64)
    for w in np.unique(width).tolist():
        if w:
            rows = np.nonzero(width == w)[0]
            # where each value begins, and a kind that holds all bytes it lies in
            size, kind = w * BLOCK // 8, np.uint32 if w <= 25 else np.uint64
            byte, bit = np.divmod(np.arange(BLOCK) * w, 8)
            for part in np.array_split(rows, max(1, len(rows) // 4096)):
                packed = payload[table["start"][part].astype(np.int64)[:, None] + np.arange(size)].astype(kind)
                values = packed[:, byte]
                for k in range(1, (w + 14) // 8):
                    values |= packed[:, np.minimum(byte + k, size - 1)] << kind(8 * k)
                grid[part] = values >> bit.astype(kind) & kind((1 << w) - 1)
    grid[np.repeat(np.arange(len(table)), table["extra"]), extra["at"]] = extra["value"]
    return (grid + table["min"][:, None]).reshape(-1)


def encode_file(docs: list[tuple[int, bytes]], share: float = 0.9) -> bytes:
    """A file of documents, each an id and its token ids as little-endian unsigned 32-bit integers."""
    ids = np.frombuffer(b"".join(x[1] for x in docs), "<u4")
    table, payload, extra = pack_blocks(ids, share)
    index = np.zeros(len(docs), DOCS)
    index["id"] = [x[0] for x in docs]
    index["n"] = [len(x[1]) // 4 for x in docs]
    index["start"] = np.cumsum(index["n"]) - index["n"]
    at = np.cumsum([len(MAGIC) + len(payload), extra.nbytes, table.nbytes])
    footer = np.array([len(ids), len(table), len(extra), len(index), *at], "<u8").tobytes()
    return b"".join([MAGIC, payload, extra.tobytes(), table.tobytes(), index.tobytes(), footer, zlib.crc32(footer).to_bytes(4, "little")])


def decode_file(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Id, first token and token ids of each document of a file."""
    footer = data[-60:-4]
    if data[:4] != MAGIC or zlib.crc32(footer) != int.from_bytes(data[-4:], "little"):
        raise ValueError("not a token file, or a damaged one")
    tokens, blocks, extras, docs, at_extra, at_blocks, at_docs = (int(x) for x in np.frombuffer(footer, "<u8"))
    payload = np.frombuffer(data, np.uint8, at_extra - 4, 4)
    ids = unpack_blocks(np.frombuffer(data, BLOCKS, blocks, at_blocks), payload, np.frombuffer(data, EXTRA, extras, at_extra))[:tokens]
    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    for doc_id, start, n in np.frombuffer(data, DOCS, docs, at_docs).tolist():
        yield doc_id, start, bytes(raw[4 * start : 4 * (start + n)])


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_token_files(df: DataFrame, folder: str, tokenizer: str, end_id: int = 2, share: float = 0.9, file_tokens: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode documents and write them in ascending order of their ids, as files in ``folder``.

    Returns what was written, a row for each file: ``part, file, path, n_docs, n_tokens``. The parts
    are ranges of ids in order. Only reported files count; run the frame once, into a table.
    """
    spark = df.sparkSession
    content = spark.sparkContext.broadcast(read_tokenizer(tokenizer))
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, part = encoder(LibraryEncoder, content.value), TaskContext.get().partitionId()
        store, place = _store(folder)
        docs, held, made = [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, held, made
            name = f"{part:06d}-{made:05d}-{uuid.uuid4().hex}.vtf"
            store.create_dir(place, recursive=True)
            with store.open_output_stream(f"{place}/{name}") as out:
                out.write(encode_file(docs, share))
            row = {"part": [part], "file": [made], "path": [f"{folder}/{name}"], "n_docs": [len(docs)], "n_tokens": [held]}
            docs, held, made = [], 0, made + 1
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = model.encode(text.as_py() or "") + end
                docs.append((doc_id, ids))
                held += len(ids) // 4
                if held >= file_tokens:
                    yield flush()
        if docs:
            yield flush()
        give_back()

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    # texts of one id have an order too, and may stand in several parts
    order = [F.col("doc_id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    return ordered.mapInArrow(run, "part long, file long, path string, n_docs long, n_tokens long")


def read_token_files(written: DataFrame) -> DataFrame:
    """Read files back: ``doc_id, start, n_tokens, ids`` with ``start`` counted over all files in order."""
    spark = written.sparkSession
    parts = written.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row for each partition of the write, never for a document
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    inside = (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("file")) - F.col("n_tokens")).alias("file_start")
    files = written.select("part", "path", inside).join(before, "part").select("path", (F.col("part_start") + F.col("file_start")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, place = _store(path)
                with store.open_input_stream(place) as f:
                    data = f.read()
                docs = decode_file(data)
                del data
                while some := list(islice(docs, 2000)):
                    yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in some], pa.int64()), pa.array([first + d[1] for d in some], pa.int64()), pa.array([len(d[2]) // 4 for d in some], pa.int64()), pa.array([d[2] for d in some], pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
        give_back()

    return files.repartition(partitions(spark), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_file_digests(df: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files, read them back, and return ``doc_id, start, n_tokens, ids_crc32`` from what was read."""
    space = Workspace(df.sparkSession, "tokens")
    written = space.table(write_token_files(df, f"{space.path}/files", tokenizer, end_id, id_col=id_col, text_col=text_col), "written")
    return read_token_files(written).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
