"""Groups of rows in a sorted partition, and the splitting of large groups into blocks.

A group larger than ``chunk`` rows is cut into chunks, and each pair of chunks is a block of its
own, so no task holds more than two chunks of a group however large it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of rows with equal first ``keys`` columns, of a partition sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows, bool)
        for k in range(keys):
            col = batch.column(k).to_numpy(zero_copy_only=False)
            same[1:] &= col[1:] == col[:-1]
            same[0] &= bool(held) and held[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py()
        starts = np.flatnonzero(~same).tolist()
        at = 0
        for s in starts:
            if s > at:
                held.append(batch.slice(at, s - at))
            if held:
                yield pa.Table.from_batches(held)
                held = []
            at = s
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: int, rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups of equal first ``keys`` columns, of a partition sorted by them; of ``rows`` rows or so, or one group."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows, bool)
        for k in range(keys):
            col = batch.column(k).to_numpy(zero_copy_only=False)
            same[1:] &= col[1:] == col[:-1]
            same[0] &= bool(held) and held[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py()
        starts = np.flatnonzero(~same)
        n += batch.num_rows
        if n < rows or not len(starts):
            held.append(batch)
            continue
        cut = int(starts[-1])
        if cut:
            held.append(batch.slice(0, cut))
        if held:
            yield pa.Table.from_batches(held)
        held = [batch.slice(cut)]
        n = held[0].num_rows
    if held:
        yield pa.Table.from_batches(held)


def deal_blocks(rows: DataFrame, keys: list[str], id_col: str, n: int, chunk: int = 256, left: str | None = None, attach: DataFrame | None = None) -> DataFrame:
    """Deal the rows of each group to the blocks of its pairs of chunks, sorted by block.

    Adds ``ca`` and ``cb``, the block, and ``side``: 0 for a row of chunk ``ca``, 1 for one of ``cb``.
    In a block with ``ca = cb`` each row comes once, with side 0. With ``left``, the name of a boolean
    column, only blocks with such rows in chunk ``ca`` are made: ``ca`` counts the chunks of those rows
    alone, ``cb`` the chunks of all rows; a group of one chunk comes once, its left rows with side 2 (both).
    ``attach`` has wide columns of each ``id_col`` (one row of an id); they follow behind the others, and only rows of blocks carry them.
    """
    counts = [F.count(F.lit(1)).alias("group_rows")] + ([F.sum(F.col(left).cast("long")).alias("left_rows")] if left else [])
    sized = rows.join(rows.groupBy(*keys).agg(*counts), keys).withColumn("nb", F.ceil(F.col("group_rows") / chunk).cast("int"))
    place = F.pmod(F.xxhash64(id_col), F.col("nb")).cast("int")
    if left is None:
        sized = sized.filter("group_rows > 1").withColumn("c", place)
        blocks = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: F.struct(F.least(j, F.col("c")).alias("ca"), F.greatest(j, F.col("c")).alias("cb"), (F.col("c") > j).cast("int").alias("side")))
        dealt = sized.select(*rows.columns, F.explode(blocks).alias("b"))
    else:
        sized = sized.withColumn("na", F.ceil(F.col("left_rows") / chunk).cast("int")).filter("na > 0")
        as_right = F.transform(F.sequence(F.lit(0), F.col("na") - 1), lambda i: F.struct(i.alias("ca"), place.alias("cb"), F.lit(1).alias("side")))
        as_left = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: F.struct(F.pmod(F.xxhash64(id_col), F.col("na")).cast("int").alias("ca"), j.alias("cb"), F.lit(0).alias("side")))
        alone = F.array(F.struct(F.lit(0).alias("ca"), F.lit(0).alias("cb"), F.when(F.col(left), 2).otherwise(1).alias("side")))
        dealt = sized.select(*rows.columns, F.explode(F.when(F.col("nb") == 1, alone).when(F.col(left), F.concat(as_left, as_right)).otherwise(as_right)).alias("b"))
    rest = [c for c in rows.columns if c not in keys]
    dealt = dealt.select(*keys, "b.ca", "b.cb", "b.side", *rest)
    if attach is not None:
        dealt = dealt.join(attach, id_col).select(*dealt.columns, *(c for c in attach.columns if c != id_col))
    order = [*keys, "ca", "cb"]
    return dealt.repartition(n, *order).sortWithinPartitions(*order)


class Forest:
    """Union-find over positions of a block; only links that join two trees are worth sending on."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True
