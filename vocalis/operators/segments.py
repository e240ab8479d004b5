"""Time segments as tables: repairing, widening, merging, labelling, joining.

A segment table has key columns, ``start`` and ``end`` in seconds, and where needed ``label``; a
tie-breaking column makes the order of a key's segments definite. All comparisons of gaps are strict.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(keys: list[str], tie: str):
    return Window.partitionBy(*keys).orderBy("start", tie)


def is_valid(start: Column, end: Column) -> Column:
    return (end > start) & (start >= 0)


def check_order(df: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """Per key: are segments free of overlaps, are starts in order of the tie column."""
    w = Window.partitionBy(*keys).orderBy(tie)
    s = df.select(*keys, (F.lag("end").over(_order(keys, tie)) <= F.col("start")).alias("apart"), (F.lag("start").over(w) <= F.col("start")).alias("ordered"), is_valid(F.col("start"), F.col("end")).alias("valid"))
    return s.groupBy(*keys).agg(F.coalesce(F.bool_and("apart"), F.lit(True)).alias("non_overlapping"), F.coalesce(F.bool_and("ordered"), F.lit(True)).alias("increasing"), F.bool_and("valid").alias("all_valid"))


def fix_overlaps(df: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """Where a segment reaches into the next, both meet in the middle."""
    w = _order(keys, tie)
    before, after = F.lag("end").over(w), F.lead("start").over(w)
    start = F.when(before > F.col("start"), (before + F.col("start")) / 2).otherwise(F.col("start"))
    end = F.when(F.col("end") > after, (F.col("end") + after) / 2).otherwise(F.col("end"))
    return df.withColumns({"new_start": start, "new_end": end}).withColumns({"start": F.col("new_start"), "end": F.col("new_end")}).drop("new_start", "new_end")


def widen(df: DataFrame, by: float = 0.1) -> DataFrame:
    return df.withColumns({"start": F.greatest(F.col("start") - by, F.lit(0.0)), "end": F.col("end") + by})


def expand(df: DataFrame, keys: list[str], tie: str, by: float = 0.1) -> DataFrame:
    return fix_overlaps(widen(df, by), keys, tie)


def _islands(df: DataFrame, keys: list[str], tie: str, new: Column) -> DataFrame:
    return df.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(_order(keys, tie).rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def merge_gaps(df: DataFrame, keys: list[str], tie: str, min_gap: float = 0.2) -> DataFrame:
    """Merge segments whose gap is smaller than ``min_gap``."""
    gap = F.col("start") - F.lag("end").over(_order(keys, tie))
    return _islands(df, keys, tie, F.coalesce(~(gap < min_gap), F.lit(True))).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max_by("end", F.struct("start", tie)).alias("end")).drop("island")


def expand_and_merge(df: DataFrame, keys: list[str], tie: str, min_gap: float = 0.2, by: float = 0.1) -> DataFrame:
    return merge_gaps(expand(df, keys, tie, by), keys, tie, min_gap)


def merge_same_label(df: DataFrame, keys: list[str], tie: str, min_gap: float = 12.3) -> DataFrame:
    """Merge neighbours of one label whose gap is smaller than ``min_gap``; the end is that of the last."""
    w = _order(keys, tie)
    same = (F.lag("label").over(w) == F.col("label")) & (F.col("start") - F.lag("end").over(w) < min_gap)
    last = F.max_by("end", F.struct("start", tie))
    return _islands(df, keys, tie, F.coalesce(~same, F.lit(True))).groupBy(*keys, "island").agg(F.min("start").alias("start"), last.alias("end"), F.first("label").alias("label")).drop("island")


def expand_and_merge_labels(df: DataFrame, keys: list[str], tie: str, min_gap: float = 12.3, by: float = 0.1) -> DataFrame:
    return merge_same_label(expand(df, keys, tie, by), keys, tie, min_gap)


def merge_short(df: DataFrame, keys: list[str], tie: str, min_dur: float = 1.5) -> DataFrame:
    """Gather segments until more than ``min_dur`` is reached; what is left and shorter joins the one before.

    A greedy fold over a key's segments in order. A partition is read in order and only the open segment and
    the last one done are held, so a key may be of any size; its segments meet in one task.
    """
    rows = df.select(*keys, F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.col(tie).alias("_tie"))
    order = [*keys, F.asc_nulls_last("start"), F.asc_nulls_last("_tie"), F.asc_nulls_last("end")]
    ordered = (rows.repartition(*keys) if keys else rows.repartition(1)).sortWithinPartitions(*order).drop("_tie")
    n = len(keys)

    def longer(seg: tuple) -> bool:
        return None not in seg and seg[1] - seg[0] > min_dur

    def finish(done: tuple | None, left: tuple | None) -> list[tuple]:
        if done and left and None not in left and left[1] - left[0] < min_dur:
            return [(done[0], left[1])]
        return [s for s in (done, left) if s]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = done = left = None

        def table(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(batch.schema)], schema=batch.schema)

        for batch in batches:
            out: list[tuple] = []
            for *k, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    out += [(*key, *s) for s in finish(done, left)] if key is not None else []
                    key, done, left = k, None, None
                now = (start if left is None or left[0] is None else left[0], end)
                if longer(now):
                    out += [(*key, *done)] if done else []
                    done, left = now, None
                else:
                    left = now
            yield table(out)
        if key is not None:
            yield table([(*key, *s) for s in finish(done, left)])

    return ordered.mapInArrow(run, ordered.schema)


def letters_to_segments(df: DataFrame, keys: list[str], time_col: str, min_dur: float = 1.5, max_gap: float = 0.2, by: float = 0.1) -> DataFrame:
    """Times of letters to segments of 40 ms, merged over small gaps and to a least duration."""
    segs = df.select(*keys, F.col(time_col).alias("start"), (F.col(time_col) + 0.04).alias("end"), F.col(time_col).alias("tie"))
    merged = expand_and_merge(segs, keys, "tie", max_gap, by)
    return merge_short(merged, keys, "end", min_dur)


def sliding_windows(start: Column, end: Column, window: float = 1.5, step: float = 0.75) -> Column:
    """Starts and ends of windows over a segment; a short segment is one window, the last window is cut at the end."""
    n = F.greatest(F.lit(0), F.ceil((end - start - window) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda k: F.struct((start + k * step).alias("start"), F.least(start + k * step + window, end).alias("end")))


def repair_spans(df: DataFrame, keys: list[str], tie: str, text_col: str = "text", least: float = 0.08) -> DataFrame:
    """Spans of a recogniser: no negative starts, a least duration, no empty texts, no overlaps; texts stay with their spans."""
    start = F.greatest(F.col("start"), F.lit(0.0))
    fixed = df.withColumn("start", start).withColumn("start", F.when(F.col("end") - F.col("start") < least, F.greatest(F.col("end") - least, F.lit(0.0))).otherwise(F.col("start")))
    return fix_overlaps(fixed.filter(F.trim(text_col) != ""), keys, tie)


def place_after(df: DataFrame, keys: list[str], tie: str, dur_col: str, first: Column, gap: float) -> DataFrame:
    """Place pieces behind each other with a gap, the first at ``first``."""
    w = Window.partitionBy(*keys).orderBy(tie).rowsBetween(Window.unboundedPreceding, -1)
    start = first + F.coalesce(F.sum(F.col(dur_col) + gap).over(w), F.lit(0.0))
    return df.withColumn("start", start).withColumn("end", F.col("start") + F.col(dur_col))


def transfer_labels(segments: DataFrame, labels: DataFrame, keys: list[str], tie: str, label_tie: str, share: float = 0.6, outside: str = "OUTSIDE") -> DataFrame:
    """Give each segment the label of the first labelled span that ends after its start, if it lies inside or overlaps enough.

    After the last span's end the last span stays the candidate; a segment without duration has no share.
    A key without labelled spans has only outside segments.
    The first span that ends after a start is where the running maximum of the ends first exceeds it. So
    segments and spans are put in one order and swept once, backwards: one exchange and no range join.
    """
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy("start", label_tie))
    reach = F.max("l_end").over(Window.partitionBy(*keys).orderBy("l_pos").rowsBetween(Window.unboundedPreceding, 0))
    lab = labels.select(*keys, pos.alias("l_pos"), F.col("start").alias("l_start"), F.col("end").alias("l_end"), F.col("label").alias("l_label"))
    spans = lab.select(*keys, reach.alias("at"), F.lit(0).alias("kind"), "l_pos", F.struct("l_pos", "l_start", "l_end", "l_label").alias("span"))
    rows = segments.select(*keys, F.col("start").alias("at"), F.lit(1).alias("kind"), F.struct(*segments.columns).alias("row"))
    swept = Window.partitionBy(*keys).orderBy(F.desc("at"), F.desc("kind"), F.desc("l_pos")).rowsBetween(Window.unboundedPreceding, 0)
    found = spans.unionByName(rows, allowMissingColumns=True).withColumn("hit", F.last("span", ignorenulls=True).over(swept)).withColumn("last", F.max("span").over(Window.partitionBy(*keys)))
    c, start, end = F.coalesce("hit", "last"), F.col("row.start"), F.col("row.end")
    inside = (start >= c["l_start"]) & (end <= c["l_end"])
    share_of = F.try_divide(F.least(end, c["l_end"]) - F.greatest(start, c["l_start"]), end - start)
    return found.filter("kind = 1").select("row.*", F.when(c.isNotNull() & (inside | (share_of >= share)), c["l_label"]).otherwise(F.lit(outside)).alias("new_label"))


def _bins(df: DataFrame, widths: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each bin of the key's width that a span touches (``bin``, ``first_bin``), whichever of its ends comes first."""
    wide = df.join(widths, [df[k].eqNullSafe(widths[f"_{k}"]) for k in keys]).drop(*(f"_{k}" for k in keys))
    low, high = (F.floor(f("start", "end") / F.col("_width")) for f in (F.least, F.greatest))
    return wide.withColumn("first_bin", low).withColumn("bin", F.explode(F.sequence(low, high))).drop("_width")


def _widths(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The mean duration of each key's spans. A span then touches at most two bins more than its share of the key's time, so all of them touch at most three a span."""
    mean = F.avg(F.abs(F.col("end") - F.col("start")))
    return spans.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.greatest(mean, F.lit(1e-3)).alias("_width"))


def tokens_in_blocks(tokens: DataFrame, blocks: DataFrame, key: str, block_id: str, time_col: str = "ts", pos: str = "pos", token: str = "token") -> DataFrame:
    """The tokens of each block's time range, in order, as one text. They meet by key and time bin, not by key alone."""
    spans = blocks.select(key, F.col(block_id).alias("_block"), "start", "end").filter("end > start")
    widths = _widths(spans, [key])
    b = _bins(spans, widths, [key]).alias("b")
    t = _bins(tokens.select(key, F.col(time_col).alias("start"), F.col(time_col).alias("end"), F.col(pos).alias("p"), F.col(token).alias("w")), widths, [key]).alias("t")
    hit = b.join(t, F.col(f"b.{key}").eqNullSafe(F.col(f"t.{key}")) & (F.col("b.bin") == F.col("t.bin")) & (F.col("t.start") >= F.col("b.start")) & (F.col("t.start") < F.col("b.end")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t.p", "t.w"))), lambda x: x["w"]), " ")
    return hit.groupBy(F.col(f"b.{key}").alias(key), F.col("b._block").alias(block_id)).agg(text.alias("text"), F.count(F.lit(1)).alias("n_tokens"))


def overlap_seconds(system: DataFrame, reference: DataFrame, keys: list[str], backward: bool = False) -> DataFrame:
    """Seconds that each label of the system shares with each label of the reference.

    Segments meet by key and time bin; a pair counts in the first bin that both touch. Null keys are a key.
    Segments that do not end after they begin are nothing; with ``backward`` one that lies within a segment of the other side
    counts as it is, with no seconds or fewer.
    """
    columns = [*keys, "start", "end", "label"]
    sides = [x.select(*columns).filter("start is not null and end is not null" if backward else "end > start") for x in (system, reference)]
    widths = _widths(sides[0].unionByName(sides[1]), keys)
    s, r = _bins(sides[0], widths, keys).alias("s"), _bins(sides[1], widths, keys).alias("r")
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    hit = s.join(r, [*same, F.col("s.bin") == F.col("r.bin"), F.col("s.bin") == F.greatest("s.first_bin", "r.first_bin"), F.col("s.start") < F.col("r.end"), F.col("r.start") < F.col("s.end")])
    dur = F.least("s.end", "r.end") - F.greatest("s.start", "r.start")
    return hit.groupBy(*[F.col(f"s.{k}").alias(k) for k in keys], F.col("s.label").alias("sys_label"), F.col("r.label").alias("ref_label")).agg(F.sum(dur).alias("seconds"))
