"""Dropping of lines that many documents share (operator 12).

The key of a line is the line without white space of ASCII at its ends, A-Z lower-cased. Distinct keys are
hashed (64 bits and a fingerprint of 32) and counted once for each document that has them, combined before they
are shuffled. Hashes are dealt over shards of some 65536 keys; a shard's keys get a minimal perfect hash (levels of
bit arrays: a level holds the keys that are alone on their bit, the others go on to the next), which indexes an array
of fingerprints and one of counts, as narrow as the largest count allows. Documents send the hashes of
their lines to the shards and get back those that are frequent: lines themselves are not joined.

A key that takes more than one of ``hot`` line places of the whole table is one of at most ``hot`` such keys; they
are no part of a shard, but go to all tasks, which so answer for them at once. No shard gets more of one key than that.

Each row of the table is a document, rows that repeat an id or a text too. A null or empty text is one empty line, whose
key is shorter than one code point. Very long texts are one row each, as they come; of a document only its distinct
keys are sent. An empty table gives an empty one. All columns of the table stay but for those named like the three that are added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from vocalis.llm.blocks import sorted_groups
from vocalis.llm.shingles import mix
from vocalis.llm.workspace import Workspace, fresh, partitions

#: Keys of a shard, about.
SHARD_KEYS = 1 << 16
#: Levels of bit arrays; keys that are left after the last are listed.
LEVELS = 24


class ShardIndex:
    """Counts of keys behind a minimal perfect hash; a key that is not among them is told by its fingerprint."""

    def __init__(self, bits: list[np.ndarray], prints: np.ndarray, counts: np.ndarray, rest: np.ndarray):
        self.bits, self.prints, self.counts, self.rest = bits, prints, counts, rest
        ones = [np.bitwise_count(b).astype(np.int64) for b in bits]
        ends = np.cumsum([0, *(int(o.sum()) for o in ones)])
        #: Keys placed before each word of a level.
        self.before = [base + np.cumsum(o) - o for base, o in zip(ends.tolist(), ones, strict=False)]

    @staticmethod
    def _place(h: np.ndarray, level: int, words: int) -> np.ndarray:
        return (((mix(h, 200 + level) >> np.uint64(32)) * np.uint64(words * 64)) >> np.uint64(32)).astype(np.int64)

    @classmethod
    def build(cls, h: np.ndarray, prints: np.ndarray, counts: np.ndarray) -> ShardIndex:
        left, bits = np.arange(len(h)), []
        for level in range(LEVELS):
            if not len(left):
                break
            words = len(left) // 64 + 1
            place = cls._place(h[left], level, words)
            alone = np.bincount(place, minlength=words * 64) == 1
            bits.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[place]]
        narrow = np.min_scalar_type(int(counts.max(initial=0)))
        rest = np.stack([h[left].view(np.int64), prints[left].astype(np.int64), counts[left].astype(np.int64)])
        out = cls(bits, np.empty(0, np.uint32), np.empty(0, narrow), rest)
        slot = out._slots(h)
        placed = slot >= 0
        out.prints, out.counts = np.empty(len(h) - len(left), np.uint32), np.empty(len(h) - len(left), narrow)
        out.prints[slot[placed]], out.counts[slot[placed]] = prints[placed], counts[placed]
        return out

    def _slots(self, h: np.ndarray) -> np.ndarray:
        slot, left = np.full(len(h), -1), np.arange(len(h))
        for level, (bits, before) in enumerate(zip(self.bits, self.before, strict=True)):
            place = self._place(h[left], level, len(bits))
            word, bit = bits[place >> 6], (place & 63).astype(np.uint64)
            here = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            slot[left[here]] = (before[place >> 6] + below)[here]
            left = left[~here]
        return slot

    def count(self, h: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """How many documents have each key; 0 for keys that are not there."""
        slot, out = self._slots(h), np.zeros(len(h), np.int64)
        some = np.flatnonzero(slot >= 0)
        same = some[self.prints[slot[some]] == prints[some]]
        out[same] = self.counts[slot[same]]
        for key, mark, n in self.rest.T.tolist():
            out[(h.view(np.int64) == key) & (prints == mark)] = n
        return out

    def dump(self) -> bytes:
        head = [len(self.bits), len(self.prints), self.counts.itemsize, self.rest.shape[1], *map(len, self.bits)]
        return b"".join([np.array(head, np.int64).tobytes(), *(b.tobytes() for b in self.bits), self.rest.tobytes(), self.prints.tobytes(), self.counts.tobytes()])

    @classmethod
    def load(cls, raw: bytes) -> ShardIndex:
        levels, n, width, left = np.frombuffer(raw, np.int64, 4).tolist()
        sizes, at, bits = np.frombuffer(raw, np.int64, levels, 32).tolist(), 32 + 8 * levels, []
        for size in sizes:
            bits.append(np.frombuffer(raw, np.uint64, size, at))
            at += 8 * size
        rest = np.frombuffer(raw, np.int64, 3 * left, at).reshape(3, left)
        at += 24 * left
        return cls(bits, np.frombuffer(raw, np.uint32, n, at), np.frombuffer(raw, f"<u{width}", n, at + 4 * n), rest)


def line_keys(raw: bytes) -> list[bytes]:
    """The key of each line of a text in UTF-8."""
    return [x.strip() for x in raw.lower().split(b"\n")]


def distinct_keys(raw: bytes, min_chars: int) -> list[bytes]:
    """The distinct keys of a text that have so many code points."""
    return [x for x in dict.fromkeys(line_keys(raw)) if len(x) >= 4 * min_chars or len(x.decode("utf-8", "replace")) >= min_chars]


def key_hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash and a fingerprint of each key."""
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.uint32)
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").reshape(-1, 2).astype(np.uint64)
    return both[:, 0].copy(), both[:, 1].astype(np.uint32)


def _shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return (((h >> np.uint64(40)) * np.uint64(shards)) >> np.uint64(24)).astype(np.int64)


def drop_repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, hot: int = 4096, shard_keys: int = SHARD_KEYS, id_col: str = "doc_id", text_col: str = "text", lines_col: str = "n_lines", dropped_col: str = "n_dropped", kept_col: str = "kept_text") -> DataFrame:
    """Add to a table how many lines each text has, how many of them have keys of at least ``min_docs`` documents, and the text without these."""
    spark = docs.sparkSession
    space, n = Workspace(spark, "lines"), partitions(spark)
    added = [lines_col, dropped_col, kept_col]
    docs = docs.drop(*(c for c in docs.columns if c.lower() in [a.lower() for a in added]))
    # the answer for a key is the same in all documents, so rows that share this number do no harm
    row = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, prints = key_hashes([k for raw in batch.column(0).to_pylist() for k in distinct_keys(raw, min_chars)])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(prints.view(np.int32))], names=["h", "f"])

    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw")
    texts = docs.select(raw, row.alias("row"))
    counts = space.table(texts.select("raw").mapInArrow(places, "h long, f int").groupBy("h", "f").agg(F.count(F.lit(1)).alias("n")), "counts")
    keys, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # keys with more than one place of `hot`: not more than `hot` of them, whatever the table's size
    common = [tuple(r) for r in counts.filter(F.col("n") * hot > F.lit(total)).select("h", "f", "n").collect()]
    shards = -(-keys // shard_keys) or 1
    shard = F.shiftright(F.shiftrightunsigned("h", 40) * shards, 24).alias("shard")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, 1):
            index = ShardIndex.build(group.column(1).to_numpy().view(np.uint64), group.column(2).to_numpy().view(np.uint32), group.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([group.column(0).combine_chunks()[:1], pa.array([index.dump()], pa.binary())], names=["shard", "index"])

    rare = counts.filter(F.col("n") * hot <= F.lit(total)).select(shard, "h", "f", "n")
    index = space.table(rare.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(build, "shard long, index binary"), "index")

    hot_h = np.sort(np.array([h for h, _, _ in common], np.int64))
    hot_gone = {(h, f) for h, f, times in common if times >= min_docs}

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [distinct_keys(raw, min_chars) for raw in batch.column(0).to_pylist()]
            h, prints = key_hashes([k for keys in lists for k in keys])
            who = np.repeat(batch.column(1).to_numpy(), [len(x) for x in lists])
            send = np.flatnonzero(~np.isin(h.view(np.int64), hot_h))
            columns = [_shard_of(h[send], shards), who[send], h[send].view(np.int64), prints[send].view(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(len(send), pa.binary())], names=["shard", "row", "h", "f", "index"])

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            of = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]).tolist()
            for a, b in zip(starts, [*starts[1:], len(of)], strict=True):
                if of[a] != at:
                    at, held = of[a], None
                if batch.column(4)[a].is_valid:
                    held, a = ShardIndex.load(batch.column(4)[a].as_py()), a + 1
                if held is None or a == b:
                    continue
                part = batch.slice(a, b - a)
                often = pa.array(held.count(part.column(2).to_numpy().view(np.uint64), part.column(3).to_numpy().view(np.uint32)) >= min_docs)
                yield pa.RecordBatch.from_arrays([part.column(1).filter(often), part.column(2).filter(often)], names=["row", "h"])

    empty = [F.lit(None).cast(t).alias(c) for c, t in (("row", "long"), ("h", "long"), ("f", "int"))]
    probes = texts.mapInArrow(asked, "shard long, row long, h long, f int, index binary").unionByName(index.select("shard", *empty, "index"))
    hits = probes.repartition(n, "shard").sortWithinPartitions("shard", F.col("index").isNull()).mapInArrow(answers, "row long, h long")
    row_col, gone_col = fresh("line_row", docs.columns), fresh("line_gone", docs.columns)
    gone = hits.groupBy("row").agg(F.collect_set("h").alias(gone_col)).withColumnRenamed("row", row_col)
    joined = docs.join(gone, row == F.col(row_col), "left").select(*docs.columns, gone_col)
    at = docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines_of, dropped, kept = [], [], []
            for raw, gone in zip(batch.column(at).cast(pa.binary()).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                raw, gone = raw or b"", set(gone or ())
                lines, keys = raw.split(b"\n"), line_keys(raw)
                known = distinct_keys(raw, min_chars)
                h, prints = key_hashes(known)
                out = {k for k, x, f in zip(known, h.view(np.int64).tolist(), prints.view(np.int32).tolist(), strict=True) if x in gone or (x, f) in hot_gone}
                stay = [line for line, k in zip(lines, keys, strict=True) if k not in out] if out else lines
                lines_of.append(len(lines))
                dropped.append(len(lines) - len(stay))
                kept.append(b"\n".join(stay))
            columns = [pa.array(lines_of, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *added])

    schema = StructType([*docs.schema.fields])
    for name, kind in zip(added, (LongType(), LongType(), StringType()), strict=True):
        schema = schema.add(name, kind)
    return joined.mapInArrow(cut, schema)
