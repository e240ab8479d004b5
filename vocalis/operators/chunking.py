"""Messages and chunks of signals in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlapping_chunks(n: Column, size: int, step: int, least: int | None = None) -> Column:
    """Chunks of a signal of ``n`` samples as (frame_idx, length, end_of_signal).

    Whole chunks begin every ``step`` samples; with ``least`` growing prefixes come before the first
    whole one; the last ``size`` samples close the signal, even if they repeat the last whole chunk.
    """
    empty = F.array().cast("array<struct<frame_idx:int,length:int,end_of_signal:boolean>>")

    def chunk(start: Column, length: Column, end: bool) -> Column:
        return F.struct(start.cast("int").alias("frame_idx"), length.cast("int").alias("length"), F.lit(end).alias("end_of_signal"))

    early = empty
    if least is not None:
        first = max(least, step)
        top = F.least(F.lit(size - 1), n)
        early = F.when(top >= first, F.transform(F.sequence(F.lit(first), F.greatest(top, F.lit(first)), F.lit(step)), lambda x: chunk(F.lit(0), x, False))).otherwise(empty)
    whole = F.when(n >= size, F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)), F.lit(step)), lambda k: chunk(k, F.lit(size), False))).otherwise(empty)
    return F.concat(early, whole, F.array(chunk(F.greatest(n - size, F.lit(0)), F.least(n, F.lit(size)), True)))


def frame_messages(chunks: DataFrame, keys: list[str], order: str, array: str) -> DataFrame:
    """Give chunks their first sample's index, and close each message with an empty chunk."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    framed = chunks.select(*keys, order, F.coalesce(F.sum(F.size(array)).over(before), F.lit(0)).alias("frame_idx"), F.col(array).alias("array"), F.lit(False).alias("end_of_signal"))
    end = chunks.groupBy(*keys).agg((F.max(order) + 1).alias(order), F.sum(F.size(array)).alias("frame_idx")).select(*keys, order, "frame_idx", F.array().cast(chunks.schema[array].dataType).alias("array"), F.lit(True).alias("end_of_signal"))
    return framed.unionByName(end)


def ring_mean(df: DataFrame, keys: list[str], order: str, value: str, width: int) -> DataFrame:
    """Mean over the last ``width`` frames; frames before the first count as zero."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(width - 1), 0)
    return df.withColumn("smooth", F.sum(value).over(w) / width)


def voiced_segments(df: DataFrame, keys: list[str], order: str, score: str, onset: float = 0.5, offset: float = 0.3) -> DataFrame:
    """Runs of frames between a score of ``onset`` or more and one below ``offset``."""
    w = Window.partitionBy(*keys).orderBy(order)
    state = F.when(F.col(score) >= onset, 1).when(F.col(score) < offset, 0)
    on = df.withColumn("on", F.coalesce(F.last(state, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    run = on.withColumn("new", F.when(F.col("on") != F.coalesce(F.lag("on").over(w), F.lit(0)), 1).otherwise(0)).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.filter("on = 1").groupBy(*keys, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("frames")).drop("run")
