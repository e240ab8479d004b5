"""Corpora of files: text files, tables in packed CSV, audio manifests, and files that stand beside each other line by line."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vocalis.sources.formats import read_lines, vtt_lines, write_lines


def text_corpus(spark: SparkSession, folder: str, pattern: str, target: str, limit: int | None = None, extract: Callable[[Column], Column] | None = None) -> int:
    """Write the lines of all files below a folder to gz files and return their number; no lines are an error.

    ``extract`` makes a text of each line (null: the line is left out); ``limit`` counts lines of all files together, before that.
    """
    lines = read_lines(spark, folder, pattern, limit)
    if extract is not None:
        lines = lines.select(extract(F.col("line")).alias("line")).filter("line is not null")
    write_lines(lines, target)
    n = read_lines(spark, target, "*.gz").count()
    if not n:
        raise ValueError(f"no lines in {pattern} below {folder}")
    return n


def named_file(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Lines of the first file (by its path) of a name below a folder; without one there are none."""
    every = read_lines(spark, folder, name)
    first = sorted(every.inputFiles())[:1]
    return spark.read.text(first).withColumnRenamed("value", "line") if first else every.limit(0)


def csv_texts(spark: SparkSession, path: str, column: str = "text") -> DataFrame:
    """One column of a CSV, also a packed one, with quoted line ends: line feeds become spaces, carriage returns go, rows without a text are left out.

    A file whose fields hold line ends can't be split, so it is one task's work, row by row; other columns are not read into rows.
    """
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"').select(F.col(column).alias("text"))
    return rows.filter("text is not null").select(F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit("")).alias("text"))


def length_in_samples(start: Column, end: Column, rate: int = 16000) -> Column:
    return ((end - start) * rate).cast("int")


def language_manifest(rows: DataFrame, files: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """``audio_filepath, duration, label, text, offset, split``: of each language and split, ``most`` rows whose files exist, by a hash of seed and path.

    ``rows`` has ``path, locale, split``; ``files`` has ``path, duration`` of the files that are there. The best ``most`` of each task go to a language's
    task, not all its rows. Rows of one path are kept as they come, ordered by the path.
    """
    there = rows.select("path", "locale", "split").join(files.select("path", "duration"), "path")
    order = Window.partitionBy("locale", "split").orderBy(F.xxhash64(F.lit(seed), "path"), "path")
    chosen = there.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= most)
    return chosen.select(F.col("path").alias("audio_filepath"), "duration", F.col("locale").alias("label"), F.lit("_").alias("text"), F.lit(0.0).alias("offset"), "split")


def write_counts(counts: DataFrame, path: str, word: str = "token", n: str = "n") -> None:
    """Tab-separated words and counts, the most frequent first; ties by the word."""
    counts.select(word, n).orderBy(F.desc(n), word).write.mode("overwrite").option("quote", "").csv(path, sep="\t")


def write_aligned(lines: DataFrame, order: list[str], columns: list[str], path: str) -> None:
    """Each column as text files in a folder of its name; line by line they belong together. ``order`` has to tell all rows apart.

    The rows are ordered once, in one written table, whose partitions the text files then follow.
    """
    spark = lines.sparkSession
    whole = f"{path}/_rows"
    lines.select(*order, *(c for c in columns if c not in order)).orderBy(*order).withColumn("_part", F.spark_partition_id()).write.mode("overwrite").partitionBy("_part").parquet(whole)
    rows = spark.read.parquet(whole)
    n = max(1, (rows.agg(F.max("_part")).first()[0] or 0) + 1)
    for c in columns:
        text = rows.select("_part", *order, F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\r\n]+", " ").alias("_line"))
        text.repartitionByRange(n, "_part").sortWithinPartitions("_part", *order).select("_line").write.mode("overwrite").text(f"{path}/{c}")


def webvtt_files(captions: DataFrame, key: str, second: str | None = None) -> DataFrame:
    """``key, content``: a WebVTT file for each key of captions (``start_ms, end_ms, text``), with a second row of text if ``second`` names one. A file is one row."""
    text = F.col("text") if second is None else F.concat_ws("\n", "text", second)
    one = F.struct("start_ms", "end_ms", vtt_lines(F.col("start_ms"), F.col("end_ms"), text).alias("lines"))
    files = captions.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("c"))
    return files.select(key, F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("c", lambda x: x["lines"]), "\n\n"), F.lit("\n")).alias("content"))


# Colours of up to three speakers, as blue, green and red.
ASS_COLOURS = ["&H00FFFFFF", "&H00FFFF00", "&H0064FFFF"]
ASS_STYLE = "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"
ASS_EVENT = "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"


def ass_header(sizes: dict[str, float]) -> str:
    """Up to the first event: a style with a colour of its own and no shadow for each speaker, of whom there are three at most."""
    if len(sizes) > len(ASS_COLOURS):
        raise ValueError(f"{len(sizes)} speakers, but {len(ASS_COLOURS)} colours")
    styles = [f"Style: {name},Arial,{size:g},{colour},&H000000FF,&H00000000,&H00000000,0,0,0,0,100,100,0,0,1,2,0,2,10,10,10,1" for (name, size), colour in zip(sizes.items(), ASS_COLOURS, strict=False)]
    return "\n".join(["[Script Info]", "ScriptType: v4.00+", "", "[V4+ Styles]", ASS_STYLE, *styles, "", "[Events]", ASS_EVENT, ""])


def ass_files(events: DataFrame, key: str, sizes: dict[str, float]) -> DataFrame:
    """``key, content``: an ASS file for each key of events (``start_ms, end_ms, name, text``). Events without a text are left out. A file is one row."""
    from vocalis.sources.formats import ass_line

    one = F.struct("start_ms", "end_ms", "name", ass_line(F.col("start_ms"), F.col("end_ms"), F.col("text"), F.col("name")).alias("line"))
    files = events.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.length("text") > 0, one))).alias("c"))
    return files.select(key, F.concat(F.lit(ass_header(sizes)), F.array_join(F.transform("c", lambda x: F.concat(x["line"], F.lit("\n"))), "")).alias("content"))
