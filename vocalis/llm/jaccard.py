"""N-gram Jaccard join by vertical partitioning (operator 7).

The n-grams of all documents have a global order (that of their hashes). Documents whose sizes are
close enough share a size class, and for a class the order is cut into fragments. Two sets with
likeness t differ in at most (1 - t) / (1 + t) of their summed sizes, D elements. Where D is small
there are D + 1 fragments, so one is free of differences; where that one may be empty the order is cut anew,
up to ``CUTS`` times (at the least sets that can link without being equal, 4 common elements and one
more, a cut fails with a chance of 1/16, so all do with less than 1e-14). Otherwise there are D fragments, and
those with two elements or more count; as many are used, of one or several cuts, as leave a linked pair a chance of less
than ``MISS`` to agree on none, hashes being random: about 55 at any size. Documents that agree on a fragment are candidates.

1. Equal sets are one class; its smallest id stands for it.
2. Each class is compared with the smallest one of every fragment it agrees on. Sizes and a parity
   sketch (whose distance never exceeds the true difference) rule out most pairs; for the others the
   overlap is counted fragment by fragment of the order and summed per pair.
3. Fragments whose classes are by then in several components are open. Their classes are compared
   with the fragment's most central ones, those that share most with the others.
4. In fragments that are still open, sketches of the classes outside the main component are held
   against those of all classes, a block of at most two chunks at once; of the pairs that may link, those
   that join two trees are counted. A fragment with such a pair that turns out not to link sends all its pairs.

Links between members of one component that steps 2 to 4 leave out change no component. A document
without words is empty and linked with nothing, a null text is empty. Rows with a null id take no part; they
come back with a null component. Rows that repeat an id and a text come back as often. A table without rows gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocalis.llm.blocks import Forest, deal_blocks, sorted_groups
from vocalis.llm.components import connected_components
from vocalis.llm.memory import tidied
from vocalis.llm.shingles import mix, shingle_set
from vocalis.llm.workspace import Workspace, partitions

SKETCH = 2048
#: Pieces of the global order in which the overlap of a pair is counted.
PIECES = 4
#: Chance that a pair of large sets agrees on no fragment.
MISS = 1e-9
#: Sets that can differ in fewer elements have a fragment for each of them and one more.
SURE = 8
#: Ways of cutting the order for such sets that have empty fragments.
CUTS = 12
#: Central classes of an open fragment.
CENTRAL = 2
#: Classes of an open fragment that a block holds on either side.
CHUNK = 2048


class Similarity:
    """The likeness asked for, a fraction of whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def differ(self, total: int) -> int:
        """The most elements in which two linked sets of this summed size can differ."""
        return total * (self.den - self.num) // (self.den + self.num)

    @cache  # noqa: B019
    def size_class(self, size: int) -> tuple[int, int]:
        """First and last size of the class."""
        low = 1
        while True:
            high = max(low, int(low * 1.37))
            if size <= high:
                return low, high
            low = high + 1

    @cache  # noqa: B019
    def fragments(self, low: int, high: int) -> tuple[int, list[int], int]:
        """How many fragments a cut of the order has for a class, how many of them are used in each cut, and how many elements these need."""
        most = self.differ(2 * high)
        if most < SURE:
            return most + 1, [most + 1] * CUTS, 1
        shared = low * self.num // self.den
        free = (1 - 1 / most) ** most
        agree = free * (1 - (1 - 1 / most) ** shared - shared / most * (1 - 1 / most) ** (shared - 1))
        used = math.ceil(math.log(MISS) / math.log(1 - agree))
        return most, [min(most, used - at) for at in range(0, used, most)], 2


def signatures(grams: np.ndarray, sim: Similarity) -> np.ndarray:
    """A number for each fragment in use of the set, in its own size class and the one above if partners may be there."""
    size = len(grams)
    low, high = sim.size_class(size)
    classes = [(low, high)]
    if size * sim.den // sim.num > high:
        classes.append(sim.size_class(high + 1))
    out = []
    for low, high in classes:
        count, cuts, least = sim.fragments(low, high)
        if count == 1:
            continue  # such sets link only if they are equal
        for seed, used in enumerate(cuts):
            h = grams if seed == 0 else np.sort(mix(grams, 100 + seed))
            part = ((h >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
            if used < count:
                part = part[: np.searchsorted(part, used)]
                h = h[: len(part)]
            if not len(part):
                continue
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            total = np.add.reduceat(mix(h, 1), starts) ^ mix(np.bitwise_xor.reduceat(mix(h, 2), starts))
            sigs = mix(total ^ mix(part[starts] + np.uint64(low) * np.uint64(1 << 24), 3 + seed))
            out.append(sigs if least == 1 else sigs[np.diff(np.r_[starts, len(part)]) >= least])
            if least == 1 and len(starts) == count:
                break  # with an empty fragment, another way of cutting has to make sure
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def sketch(grams: np.ndarray) -> bytes:
    """Parities of the set's elements, dealt over SKETCH bits."""
    return np.packbits((np.bincount((mix(grams, 9) >> np.uint64(53)).astype(np.int64), minlength=SKETCH) & 1).astype(np.uint8)).tobytes()


def _fingerprint(grams: np.ndarray) -> tuple[int, int]:
    if not len(grams):
        return 0, 0
    return int(np.add.reduce(mix(grams, 5)).astype(np.int64)), int(np.bitwise_xor.reduce(mix(grams, 6)).astype(np.int64))


def _describe(docs: DataFrame, k: int, sim: Similarity) -> DataFrame:
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, first, second, sigs, bits = [], [], [], [], []
            for text in batch.column(1):
                grams = shingle_set(text.as_py(), k)
                a, b = _fingerprint(grams)
                sizes.append(len(grams))
                first.append(a)
                second.append(b)
                sigs.append(signatures(grams, sim).view(np.int64) if len(grams) else np.empty(0, np.int64))
                bits.append(sketch(grams) if len(grams) else b"")
            ends = np.cumsum([0, *map(len, sigs)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sigs) if sigs else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), lists, pa.array(bits, pa.binary())], names=["doc_id", "n", "f1", "f2", "sigs", "bits"])

    return docs.mapInArrow(run, "doc_id long, n long, f1 long, f2 long, sigs array<long>, bits binary")


def _verify(docs: DataFrame, pairs: DataFrame, k: int, sim: Similarity, space: Workspace, name: str) -> DataFrame:
    """The pairs (a, b, na, nb) whose overlap, counted in pieces of the order and summed, is large enough."""
    n = partitions(docs.sparkSession)

    @tidied
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, segs = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                grams = shingle_set(text.as_py(), k)
                cuts = np.searchsorted(grams, [np.uint64(i * ((1 << 64) // PIECES)) for i in range(1, PIECES)])
                for i, seg in enumerate(np.split(grams, cuts)):
                    if len(seg):
                        ids.append(doc_id)
                        at.append(i)
                        segs.append(seg.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(segs, pa.binary())], names=["doc", "piece", "seg"])

    needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.join(needed, "doc_id").select("doc_id", "text").mapInArrow(pieces, "doc long, piece int, seg binary")
    cut = space.table(texts, f"{name}-pieces")

    @tidied
    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["a", "b", "partial"])

    left = pairs.select("a", "b").join(cut.select(F.col("doc").alias("a"), "piece", F.col("seg").alias("sa")), "a")
    both = left.join(cut.select(F.col("doc").alias("b"), "piece", F.col("seg").alias("sb")), ["b", "piece"]).select("a", "b", "sa", "sb")
    sums = both.mapInArrow(overlap, "a long, b long, partial long").groupBy("a", "b").agg(F.sum("partial").alias("both"))
    union = F.col("na") + F.col("nb") - F.col("both")
    linked = pairs.join(sums, ["a", "b"]).filter(F.col("both") * sim.den >= union * sim.num).select("a", "b")
    out = space.table(linked.coalesce(n), name)
    space.drop(f"{name}-pieces")
    return out


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document: components of links of likeness num/den or more."""
    spark = docs.sparkSession
    space = Workspace(spark, "jaccard")
    n = partitions(spark)
    sim = Similarity(num, den)
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = every.filter("doc_id is not null")
    raw = space.table(_describe(every, k, sim), "raw")
    # only sets that occur more than once have to learn who stands for them
    sets = space.table(raw.filter("n > 0 and doc_id is not null").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).filter("rep < last").drop("last"), "sets")
    members = space.table(raw.filter("n > 0").select("doc_id", "n", "f1", "f2").join(sets, ["n", "f1", "f2"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")).unionByName(raw.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("rep"))), "members")
    gone = members.filter("rep <> doc_id").select("doc_id").distinct()
    reps = space.table(raw.filter("n > 0 and doc_id is not null").join(gone, "doc_id", "left_anti").select("doc_id", "n", "sigs", "bits").dropDuplicates(["doc_id"]), "reps")
    space.drop("raw")
    space.drop("sets")
    space.release()

    placed = reps.select("doc_id", F.explode("sigs").alias("sig"))
    groups = space.table(placed.groupBy("sig").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("sig", "least"), "groups")
    met = space.table(placed.join(groups, "sig"), "met")
    space.drop("groups")
    space.release()

    sizes = reps.select("doc_id", "n", "bits")

    @tidied
    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            xa, xb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(len(na), -1) for c in (4, 5))
            apart = np.bitwise_count(xa ^ xb).sum(axis=1)
            ok = (np.minimum(na, nb) * den >= np.maximum(na, nb) * num) & (apart <= (na + nb) * (den - num) // (den + num))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in range(4)], names=["a", "b", "na", "nb"])

    def likely(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) whose sizes and sketches allow a link."""
        sized = pairs.join(sizes.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb")), "b").join(sizes.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa")), "a")
        return space.table(sized.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(possible, "a long, b long, na long, nb long"), f"likely-{name}")

    tested = space.table(met.filter("doc_id <> least").select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct(), "tested")
    links = _verify(named, likely(tested, "least"), k, sim, space, "links-least")
    parts = connected_components(links, space, "parts-least")

    def with_parts(rows: DataFrame) -> DataFrame:
        return rows.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("sig", "doc_id", F.coalesce("component", "doc_id").alias("comp"))

    def open_of(rows: DataFrame, name: str) -> DataFrame:
        """Rows of fragments with several components, and ``m``, how many classes the fragment has; fragments that the same classes agree on count once."""
        by_sig = rows.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m"), F.sum(F.shiftright(F.xxhash64("doc_id"), 20)).alias("who")).filter("lo < hi")
        once = space.table(by_sig.groupBy("m", "who", "lo", "hi").agg(F.min("sig").alias("sig")).select("sig", "m"), f"once-{name}")
        return space.table(rows.join(once, "sig"), f"open-{name}")

    open_ = open_of(with_parts(met), "least")
    space.drop("met")
    weight = open_.groupBy("doc_id").agg(F.sum("m").alias("w"))
    first = F.row_number().over(Window.partitionBy("sig").orderBy(F.desc("w"), "doc_id"))
    central = open_.join(weight, "doc_id").withColumn("place", first).filter(F.col("place") <= CENTRAL).groupBy("sig").agg(F.collect_list(F.struct("doc_id", "comp")).alias("central"))
    central = space.table(central, "central")
    held = open_.join(central, "sig").select("doc_id", "comp", F.explode("central").alias("c")).filter("comp <> c.comp")
    held = space.table(held.select(F.least("doc_id", "c.doc_id").alias("a"), F.greatest("doc_id", "c.doc_id").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"), "held")
    tested = tested.unionByName(held)

    def grown(new: DataFrame, name: str) -> None:
        """Take new links in; components are worked out anew if there are any."""
        nonlocal links, parts
        if not new.isEmpty():
            links = links.unionByName(new)
            parts = connected_components(links, space, f"parts-{name}")

    grown(_verify(named, likely(held, "central"), k, sim, space, "links-central"), "central")

    def compare(whole: bool):
        @tidied
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in sorted_groups(batches, 3):
                sig, side, doc, comp, size = (group.column(c).to_numpy() for c in (0, 3, 4, 5, 6))
                bits = np.frombuffer(b"".join(group.column(7).to_pylist()), np.uint64).reshape(len(doc), -1)
                a, b = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
                _, tree = np.unique(comp, return_inverse=True)
                forest = Forest(len(doc))
                found: list[tuple[np.ndarray, np.ndarray]] = []
                for i in a.tolist():
                    other = b[(comp[b] != comp[i]) & (np.minimum(size[b], size[i]) * den >= np.maximum(size[b], size[i]) * num)]
                    other = other[np.bitwise_count(bits[other] ^ bits[i]).sum(axis=1) <= (size[other] + size[i]) * (den - num) // (den + num)]
                    if not whole:
                        other = np.array([j for j in other.tolist() if forest.join(int(tree[i]), int(tree[j]))], np.int64)
                    if len(other):
                        found.append((np.full(len(other), i), other))
                if found:
                    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
                    i, j = np.where(doc[i] < doc[j], i, j), np.where(doc[i] < doc[j], j, i)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[i], doc[j], size[i], size[j], sig[i])], names=["a", "b", "na", "nb", "sig"])

        return run

    def blocks_of(rows: DataFrame, name: str, whole: bool) -> DataFrame:
        main = rows.groupBy("sig", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("sig").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"))
        dealt = deal_blocks(rows.join(main, "sig").withColumn("outside", F.col("comp") != F.col("main")).join(sizes, "doc_id").select("sig", "doc_id", "comp", "n", "bits", "outside"), ["sig"], "doc_id", n, CHUNK, left="outside")
        return space.table(dealt.mapInArrow(compare(whole), "a long, b long, na long, nb long, sig long"), name)

    def count(found: DataFrame, name: str) -> DataFrame:
        more = space.table(found.select("a", "b", "na", "nb").distinct().join(tested, ["a", "b"], "left_anti"), f"more-{name}")
        return _verify(named, more, k, sim, space, f"links-{name}")

    rows = open_of(with_parts(open_.select("sig", "doc_id")), "central")
    joins = blocks_of(rows, "joins", False)
    grown(count(joins, "joins"), "joins")
    failed = joins.join(links, ["a", "b"], "left_anti").select("sig").distinct()
    tested = tested.unionByName(joins.select("a", "b").distinct())
    rows = open_of(with_parts(rows.select("sig", "doc_id").join(failed, "sig", "left_semi")), "failed")
    grown(count(blocks_of(rows, "rest", True), "rest"), "rest")
    space.keep_only("members", "parts-")
    return members.join(parts, F.col("rep") == F.col("node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
