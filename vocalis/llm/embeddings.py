"""Near-duplicate embeddings: sign hashing in several tables, exact cosine, components (operator 10).

Equal vectors of a label are one class and stand for each other. Classes are hashed by the signs of
random projections, several bits in each of several tables; bits follow the size of the largest label
and the number of tables follows from the wanted recall at the threshold. Classes that meet in a
bucket are compared by cosine in double precision, block by block; a pair is counted only in the first
table where it meets, so links are counted without listing them, and each block sends on a spanning
forest of its links only.

Vectors without a label, null, empty or zero vectors and those with null or non-finite components link
with nothing. Vectors of different lengths do not link. A null id takes no part and is its own result
(its component is null). Rows that repeat an id are vectors of their own, with links of their own and one component. A table without rows gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalis.llm.blocks import Forest, deal_blocks, sorted_groups
from vocalis.llm.components import connected_components
from vocalis.llm.workspace import Workspace, partitions


#: Vectors of a chunk; a block of two chunks fills this number squared of doubles.
CHUNK = 1024


def table_plan(largest: int, threshold: float, recall: float, per_bucket: int = 64) -> tuple[int, int]:
    """Bits of a table and tables, for the largest label's number of vectors."""
    same = 1 - math.acos(threshold) / math.pi
    bits = max(4, math.ceil(math.log2(max(2, largest / per_bucket))))
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same**bits)))


def signs(vectors: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """Bucket of each vector in each table."""
    planes = np.random.default_rng((seed, vectors.shape[1])).standard_normal((vectors.shape[1], bits * tables))
    on = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return (on * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision, without overflow on the way."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def near_embeddings(df: DataFrame, threshold: float = 0.93, recall: float = 0.9995, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector."""
    spark = df.sparkSession
    space = Workspace(spark, "near")
    n = partitions(spark)
    v = F.col(vector_col).cast("array<double>")
    fine = F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & F.coalesce(F.size(v) > 0, F.lit(False)) & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.alias("vec"), fine.alias("fine"))
    good = rows.filter("fine").select("vec_id", "label", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(7), "vec").alias("h2"))
    classes = space.table(good.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("vec").alias("vec")).withColumn("cls", F.monotonically_increasing_id()), "classes")
    members = good.select("vec_id", "label", "h1", "h2").join(classes.select("label", "h1", "h2", "cls", "copies"), ["label", "h1", "h2"]).select("vec_id", "cls", "copies")
    largest = classes.groupBy("label").count().agg(F.max("count").alias("n")).first()["n"] or 0
    bits, tables = table_plan(largest, threshold, recall)
    # vectors travel as they came: floats stay floats, and become unit vectors where they are compared
    kind = "<f4" if df.schema[vector_col].dataType.elementType.typeName() == "float" else "<f8"

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.asarray(x, np.float64) for x in batch.column(3).to_pylist()]
            codes: list[bytes] = [b""] * len(found)
            raw = [x.astype(kind).tobytes() for x in found]
            for size in {len(x) for x in found}:
                at = [i for i, x in enumerate(found) if len(x) == size]
                c = signs(unit_rows(np.stack([found[i] for i in at])), bits, tables, seed).astype("<u4")
                for k, i in enumerate(at):
                    codes[i] = c[k].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(4), pa.array([len(x) for x in found], pa.int32()), pa.array(codes, pa.binary()), pa.array(raw, pa.binary()), pa.array([np.frombuffer(c, "<u4").tolist() for c in codes], pa.list_(pa.int64()))], names=["label", "rep", "copies", "cls", "dim", "codes", "raw", "buckets"])

    label_type = df.schema[label_col].dataType.simpleString()
    coded = space.table(classes.select("label", "rep", "copies", "vec", "cls").mapInArrow(hashed, f"label {label_type}, rep long, copies long, cls long, dim int, codes binary, raw binary, buckets array<long>"), "coded")
    placed = coded.select("label", "dim", "cls", F.posexplode("buckets").alias("t", "bucket"))
    blocks = deal_blocks(placed.select("label", "dim", "t", "bucket", "cls"), ["label", "dim", "t", "bucket"], "cls", n, CHUNK, attach=coded.select("cls", "rep", "copies", "codes", "raw"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], []]

        def take() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["node", "n", "other"])
            for c in out:
                c.clear()
            return batch

        for group in sorted_groups(batches, 6):
            t, ca, cb = (group.column(k)[0].as_py() for k in (2, 4, 5))
            side = group.column(6).to_numpy()
            cls, rep, copies = group.column(7).to_numpy(), group.column(8).to_numpy(), group.column(9).to_numpy()
            codes = np.frombuffer(b"".join(group.column(10).to_pylist()), "<u4").reshape(len(rep), tables)
            unit = unit_rows(np.frombuffer(b"".join(group.column(11).to_pylist()), kind).reshape(len(rep), -1).astype(np.float64))
            a = np.flatnonzero(side == 0)
            b = a if ca == cb else np.flatnonzero(side == 1)
            if not len(a) or not len(b):
                continue
            near = unit[a] @ unit[b].T >= threshold
            if ca == cb:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            i, j = a[i], b[j]
            new = ~(codes[i, :t] == codes[j, :t]).any(axis=1)
            i, j = i[new], j[new]
            if not len(i):
                continue
            links = np.bincount(i, copies[j], len(rep)) + np.bincount(j, copies[i], len(rep))
            for k in np.flatnonzero(links):
                for c, x in zip(out, (int(cls[k]), int(links[k]), None), strict=True):
                    c.append(x)
            forest = Forest(len(rep))
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                if forest.join(x, y):
                    for c, z in zip(out, (int(rep[x]), 0, int(rep[y])), strict=True):
                        c.append(z)
            if len(out[0]) > 20_000:
                yield take()
        yield take()

    found = space.table(blocks.mapInArrow(compare, "node long, n long, other long"), "found")
    # counts are of classes, links to components between ids
    counts = found.filter("other is null").groupBy("node").agg(F.sum("n").alias("n"))
    parts = connected_components(found.filter("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")), space)
    per_class = classes.select("cls", "rep").join(counts, F.col("cls") == F.col("node"), "left").drop("node").join(parts, F.col("rep") == F.col("node"), "left").select("cls", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "rep").alias("component"))
    linked = members.join(per_class, "cls").select("vec_id", (F.col("n") + F.col("copies") - 1).alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.filter(~F.col("fine")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
