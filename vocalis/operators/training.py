"""Preparing examples for training: length filters, vocabularies, padded batches, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the label id that a loss ignores.
IGNORED = -100


def length_between(signal: Column, least: float, most: float) -> Column:
    """Whether a signal is longer than ``least`` and shorter than ``most`` samples, both strictly."""
    return (F.size(signal) > least) & (F.size(signal) < most)


def more_than_half(signal: Column, seconds: float, rate: int) -> Column:
    """Whether a chunk has more than half of its samples; the last one of a signal may not."""
    return F.size(signal) > seconds / 2 * rate


def within_audio(segments: DataFrame, audio_end: Column) -> DataFrame:
    """Predictions that begin within the audio; those of calibration data behind it go."""
    return segments.filter(F.col("start") <= audio_end)


def speech_like(text: Column, position: Column) -> Column:
    """Whether a transcript has a capital letter; the first one needs none."""
    return (position == 0) | text.rlike("[A-Z]")


def whole_segments(df: DataFrame, id_col: str) -> DataFrame:
    """A segment for each recording, from its beginning to an end that is not known."""
    return df.select(F.col(id_col).alias("id"), F.col(id_col).alias("audio_id"), F.lit(0.0).alias("start"), F.lit(None).cast("double").alias("end"))


def segment_totals(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Seconds and number of segments."""
    return segments.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("seconds"), F.count(F.lit(1)).alias("n"))


def zip_by_position(df: DataFrame, left: str, right: str) -> DataFrame:
    """A row for each position of two arrays, with ``pos`` and both elements; arrays of different sizes are an error."""
    fits = F.when(F.size(left) != F.size(right), F.raise_error(F.lit("arrays of different sizes"))).otherwise(F.arrays_zip(F.col(left).alias("l"), F.col(right).alias("r")))
    rest = [c for c in df.columns if c not in (left, right)]
    return df.select(*rest, F.posexplode(fits).alias("pos", "z")).select(*rest, "pos", F.col("z.l").alias(left), F.col("z.r").alias(right))


def training_vocabulary(tokens: DataFrame, delimiter: str | None = None, unknown: str | None = None, padding: str | None = None) -> DataFrame:
    """``token, id`` of given tokens: the space becomes the delimiter, tokens that are missing come behind.

    Repeated tokens are an error, and so is an added one that a token equals but for its case.
    """
    named = tokens.select(F.when((F.col("token") == " ") & F.lit(delimiter is not None), F.lit(delimiter)).otherwise(F.col("token")).alias("token"), F.col("id").cast("long").alias("id"))
    added = [t for t in (unknown, padding) if t is not None]
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    facts = named.agg(
        F.count("token").alias("n"),
        F.count_distinct("token").alias("different"),
        *(has(F.col("token") == t).alias(f"has{i}") for i, t in enumerate(added)),
        *(has((F.upper("token") == t) | (F.lower("token") == t)).alias(f"case{i}") for i, t in enumerate(added)),
    )
    wrong = F.when(F.col("n") != F.col("different"), F.raise_error(F.lit("a token is repeated")))
    rows = []
    for i, t in enumerate(added):
        wrong = wrong.when(~F.col(f"has{i}") & F.col(f"case{i}"), F.raise_error(F.lit(f"a token differs from {t} by its case only")))
        before = sum((F.when(F.col(f"has{j}"), 0).otherwise(1) for j in range(i)), F.lit(0))
        rows.append(F.when(~F.col(f"has{i}"), F.struct(F.lit(t).alias("token"), (F.col("n") + before).alias("id"))))
    behind = F.filter(F.array(*rows), lambda x: x.isNotNull()) if rows else F.expr("cast(array() as array<struct<token:string,id:bigint>>)")
    checked = facts.select(F.when(wrong.otherwise(F.lit(0)).cast("int") == 0, behind).alias("behind"))
    return named.unionByName(checked.select(F.explode("behind").alias("x")).select("x.token", "x.id")) if rows else named.join(F.broadcast(checked)).select("token", "id")


def vocabulary_json(vocabulary: DataFrame) -> DataFrame:
    """One line of JSON: the id of each token, in order of the ids."""
    return vocabulary.agg(F.to_json(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("id", "token"))), lambda x: F.struct(x["token"], x["id"])))).alias("line"))


def padded_batches(df: DataFrame, batch: str, signal: str, labels: str, multiple: int = 1) -> DataFrame:
    """Signals padded with zeros and labels with ignored ids to the longest of their batch, and the ``mask`` of real samples.

    Signals are padded on to a multiple of ``multiple``. Only sizes are compared in the batch, so no batch has to fit in memory.
    """
    whole = Window.partitionBy(batch)
    wide = F.ceil(F.max(F.size(signal)).over(whole) / multiple) * multiple
    sized = df.withColumn("_wide", wide.cast("int")).withColumn("_labels", F.max(F.size(labels)).over(whole))
    gap = F.col("_wide") - F.size(signal)
    pad = lambda value, n, c: F.array_repeat(F.lit(value).cast(df.schema[c].dataType.elementType), n)
    masked = sized.withColumn("mask", F.concat(F.array_repeat(F.lit(1), F.size(signal)), F.array_repeat(F.lit(0), gap)))
    filled = masked.withColumn(signal, F.concat(signal, pad(0, gap, signal)))
    return filled.withColumn(labels, F.concat(labels, pad(IGNORED, F.col("_labels") - F.size(labels), labels))).drop("_wide", "_labels")


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    """Rows in random order: that of a hash of seed and columns, so partitioning does not change it and a repeated task gives the same. Equal rows stand together."""
    mixed = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})), 256)
    return df.withColumn("_mixed", mixed).orderBy("_mixed").drop("_mixed")
