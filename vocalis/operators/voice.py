"""Voice segments from the scores of overlapping windows, over whole files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def smoothed_scores(df: DataFrame, keys: list[str], order: str, score: str, covering: int, how: str = "median") -> DataFrame:
    """Add ``smooth``: the score of each shift from the windows that cover it, its own and the ``covering - 1`` before it.

    ``how`` is mean or median; of an even number of windows the median is the mean of the two in the middle.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - covering, 0)
    if how == "mean":
        return df.withColumn("smooth", F.avg(score).over(w))
    if how != "median":
        raise ValueError("mean or median")
    s = F.array_sort(F.collect_list(score).over(w))
    n = F.size("ranked")
    middle = (F.get("ranked", F.floor((n - 1) / 2).cast("int")) + F.get("ranked", F.floor(n / 2).cast("int"))) / 2
    return df.withColumn("ranked", s).withColumn("smooth", middle).drop("ranked")


def _merged(segments: DataFrame, keys: list[str], gap: Column) -> DataFrame:
    """Segments joined where one begins less than ``gap`` seconds behind all before it, or not behind."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = segments.withColumn("new", F.when(reach.isNull() | ((F.col("start") > reach) & (F.col("start") - reach >= gap)), 1).otherwise(0))
    run = new.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def offline_voice_segments(df: DataFrame, keys: list[str], order: str, score: str, shift: float, onset: float = 0.5, offset: float = 0.3, pad_onset: float = 0.0, pad_offset: float = 0.0, least_on: float = 0.0, least_off: float = 0.0, speech_first: bool = True) -> DataFrame:
    """``keys, start, end`` in seconds of voiced stretches; ``order`` numbers the frames of ``shift`` seconds from 0.

    A stretch begins with a frame above ``onset`` and ends with one below ``offset`` (that one's beginning), or in the last frame. Padding widens it,
    not before 0. What touches then is one. Stretches shorter than ``least_on`` go, pauses shorter than ``least_off`` are filled; with
    ``speech_first`` in that order, else pauses first. A null score is neither above nor below.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    state = F.when(F.col(score) > onset, 1).when(F.col(score) < offset, 0)
    # a frame between the two thresholds goes on as before
    on = df.withColumn("on", F.coalesce(F.last(state, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    edges = on.withColumn("was", F.coalesce(F.lag("on").over(w), F.lit(0))).withColumn("next", F.lead("on").over(w))
    run = edges.withColumn("run", F.sum((F.col("on") > F.col("was")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    end = F.when(F.col("next").isNull(), F.col(order)).when(F.col("next") == 0, F.col(order) + 1)
    raw = run.filter("on = 1").groupBy(*keys, "run").agg(F.min(order).alias("first"), F.max(end).alias("last"))
    padded = raw.select(*keys, F.greatest(F.col("first") * shift - pad_onset, F.lit(0.0)).alias("start"), (F.col("last") * shift + pad_offset).alias("end")).filter("end > start")
    out = _merged(padded, keys, F.lit(0.0))
    long_enough = F.col("end") - F.col("start") >= least_on
    if speech_first:
        return _merged(out.filter(long_enough), keys, F.lit(least_off))
    return _merged(out, keys, F.lit(least_off)).filter(long_enough)
