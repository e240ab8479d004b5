"""Who spoke when: error rates by a sweep over boundaries, and agreement of labellings."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalis.functions.udf import arrow_function
from vocalis.operators.metrics import rate


def best_mapping(seconds: dict[tuple[str, str], float]) -> dict[str, str]:
    """The one-to-one mapping of left to right labels with the largest sum (by shortest augmenting paths)."""
    left, right = (sorted({k[i] for k in seconds}) for i in range(2))
    n = max(len(left), len(right))
    cost = np.zeros((n + 1, n + 1))
    for (a, b), s in seconds.items():
        cost[left.index(a) + 1, right.index(b) + 1] = -s
    u, v, match, way = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int), np.zeros(n + 1, int)
    for row in range(1, n + 1):
        match[0], at = row, 0
        least, used = np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while True:
            used[at] = True
            i = match[at]
            free = np.flatnonzero(~used)
            reduced = cost[i, free] - u[i] - v[free]
            better = reduced < least[free]
            least[free[better]], way[free[better]] = reduced[better], at
            nearest = free[np.argmin(least[free])]
            step = least[nearest]
            u[match[used]] += step
            v[used] -= step
            least[free] -= step
            at = nearest
            if match[at] == 0:
                break
        while at:
            match[at] = match[way[at]]
            at = way[at]
    return {left[match[j] - 1]: right[j - 1] for j in range(1, n + 1) if match[j] <= len(left) and j <= len(right) and (left[match[j] - 1], right[j - 1]) in seconds}


def elementary_intervals(reference: DataFrame, system: DataFrame, file: str = "file", collar: float = 0.0, ignore_overlap: bool = False) -> DataFrame:
    """``file, seconds, ref, sys``: stretches without a boundary, with the speakers of either side in them.

    Only what lies between the first and the last second of a file's reference counts, but for ``collar`` seconds to both sides of the boundaries of
    reference segments and, with ``ignore_overlap``, stretches with several reference speakers. Segments that end before they begin
    are nothing. Boundaries of a file pass through one task in order, of which the speakers at hand are held.
    """
    ref = reference.select(F.col(file).alias("file"), "start", "end", F.col("speaker").cast("string").alias("speaker")).filter("start < end")
    span = ref.groupBy("file").agg(F.min("start").alias("lo"), F.max("end").alias("hi"))
    sys = system.select(F.col(file).alias("file"), "start", "end", F.col("speaker").cast("string").alias("speaker")).join(span, "file")
    sys = sys.select("file", F.greatest("start", "lo").alias("start"), F.least("end", "hi").alias("end"), "speaker").filter("start < end")

    def boundaries(df: DataFrame, side: int) -> DataFrame:
        return df.select("file", F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("d")))).alias("b"), F.lit(side).alias("side"), "speaker").select("file", "b.t", "side", "b.d", "speaker")

    events = boundaries(ref, 0).unionByName(boundaries(sys, 1))
    if collar > 0:
        near = ref.select("file", F.explode(F.array("start", "end")).alias("t")).select("file", (F.col("t") - collar).alias("start"), (F.col("t") + collar).alias("end"), F.lit("").alias("speaker"))
        events = events.unionByName(boundaries(near, 2))
    events = events.repartition("file").sortWithinPartitions("file", "t")
    kind = dict(ref.dtypes)["file"]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, began, held, started = None, None, [Counter(), Counter(), Counter()], False
        for batch in batches:
            out = []
            for file_, t, side, d, speaker in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not started or file_ != current:
                    current, held, started = file_, [Counter(), Counter(), Counter()], True
                elif t > began and (held[0] or held[1]) and not held[2] and not (ignore_overlap and len(held[0]) > 1):
                    out.append((file_, t - began, sorted(held[0]), sorted(held[1])))
                began = t
                held[side][speaker] += d
                if not held[side][speaker]:
                    del held[side][speaker]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = [batch.schema.field(0).type, pa.float64(), pa.list_(pa.string()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "seconds", "ref", "sys"])

    return events.mapInArrow(sweep, f"file {kind}, seconds double, ref array<string>, sys array<string>")


def diarization_report(reference: DataFrame, system: DataFrame, file: str = "file", collar: float = 0.25, ignore_overlap: bool = False) -> DataFrame:
    """For each file, and for all (a null file): scored seconds, and missed, false and confused speech and their sum in percent of them.

    A stretch with several speakers counts for each of them. Speakers of a file are mapped one to one so that most time is right.
    """
    parts = elementary_intervals(reference, system, file, collar, ignore_overlap)
    r, s = F.size("ref"), F.size("sys")
    sums = parts.groupBy("file").agg(F.sum(F.col("seconds") * r).alias("scored"), F.sum(F.col("seconds") * F.greatest(r - s, F.lit(0))).alias("missed"), F.sum(F.col("seconds") * F.greatest(s - r, F.lit(0))).alias("false"), F.sum(F.col("seconds") * F.least(r, s)).alias("both"))
    shared = parts.select("file", "seconds", F.explode("ref").alias("ref"), "sys").select("file", "seconds", "ref", F.explode("sys").alias("sys")).groupBy("file", "ref", "sys").agg(F.sum("seconds").alias("seconds"))
    kind = dict(parts.dtypes)["file"]

    def right(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        seconds = {(a, b): x for a, b, x in zip(pdf["ref"], pdf["sys"], pdf["seconds"], strict=True)}
        return pd.DataFrame({"file": [key[0]], "right": [sum(seconds[p] for p in best_mapping(seconds).items())]})

    # a group has a row for each pair of speakers of a file
    mapped = shared.groupBy("file").applyInPandas(right, f"file {kind}, right double")
    files = sums.join(mapped, sums["file"].eqNullSafe(mapped["file"]), "left").select(sums["file"], "scored", "missed", "false", (F.col("both") - F.coalesce("right", F.lit(0.0))).alias("confused"))
    every = files.agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("scored", "missed", "false", "confused"))).select(F.lit(None).cast(kind).alias("file"), "*")
    rows = files.unionByName(every)
    whole = F.col("scored")
    return rows.select("file", "scored", rate(F.col("missed"), whole).alias("miss"), rate(F.col("false"), whole).alias("false_alarm"), rate(F.col("confused"), whole).alias("confusion"), rate(F.col("missed") + F.col("false") + F.col("confused"), whole).alias("der"))


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.fromiter(map(math.lgamma, x.tolist()), float, len(x))


def expected_information(rows: list[tuple[int, int]], cols: list[tuple[int, int]], n: int) -> float:
    """The mutual information of two labellings of n things in chance order, given the sizes of their classes as (size, how many)."""
    total = 0.0
    for a, many_a in rows:
        for b, many_b in cols:
            k = np.arange(max(1, a + b - n), min(a, b) + 1, dtype=float)
            log_p = math.lgamma(a + 1) + math.lgamma(b + 1) + math.lgamma(n - a + 1) + math.lgamma(n - b + 1) - math.lgamma(n + 1) - _lgamma(k + 1) - _lgamma(a - k + 1) - _lgamma(b - k + 1) - _lgamma(n - a - b + k + 1)
            total += many_a * many_b * float(np.sum(k / n * np.log(n * k / (a * b)) * np.exp(log_p)))
    return total


@arrow_function("double")
def _expected(rows: pd.Series, cols: pd.Series, n: pd.Series) -> pd.Series:
    pairs = lambda xs: [(int(x["n"]), int(x["many"])) for x in xs]
    return pd.Series([expected_information(pairs(a), pairs(b), int(k)) for a, b, k in zip(rows, cols, n, strict=True)])


def adjusted_mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """``ami``: mutual information of two labellings beyond chance, in parts of the mean of their entropies beyond chance; nulls are a class.

    Sums run over the contingency table. Classes are put together by size, of which n things have at most the root of 2 n.
    """
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    xlogx = lambda n: n * F.log(n)
    sides = {}
    for side in "ab":
        sums = cells.groupBy(side).agg(F.sum("n").alias("n"))
        sizes = sums.groupBy("n").agg(F.count(F.lit(1)).alias("many"))
        sides[side] = sizes.agg(F.coalesce(F.sum(F.col("many") * xlogx(F.col("n").cast("double"))), F.lit(0.0)).alias(f"{side}_log"), F.array_sort(F.collect_list(F.struct("n", "many"))).alias(f"{side}_sizes"), F.coalesce(F.sum("many"), F.lit(0)).alias(f"{side}_classes"))
    both = cells.agg(F.coalesce(F.sum(xlogx(F.col("n").cast("double"))), F.lit(0.0)).alias("ab_log"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    # one row each
    x = both.join(F.broadcast(sides["a"])).join(F.broadcast(sides["b"]))
    n = F.greatest("total", F.lit(1)).cast("double")
    mutual = (F.col("ab_log") - F.col("a_log") - F.col("b_log")) / n + F.log(n)
    entropy = F.log(n) - (F.col("a_log") + F.col("b_log")) / n / 2
    x = x.select(mutual.alias("mi"), entropy.alias("h"), _expected(F.col("a_sizes"), F.col("b_sizes"), F.col("total")).alias("e"), (F.col("a_classes") == F.col("b_classes")).alias("even"), F.col("a_classes").alias("classes"), "total")
    # labellings of one class each, or of a class for each thing, agree in full
    trivial = F.col("even") & ((F.col("classes") <= 1) | (F.col("classes") == F.col("total")))
    return x.select(F.when(trivial, 1.0).otherwise(F.coalesce(F.try_divide(F.col("mi") - F.col("e"), F.col("h") - F.col("e")), F.lit(0.0))).alias("ami"))
