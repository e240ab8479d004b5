"""Readers and writers of speech-corpus files."""

from __future__ import annotations

import io
import tarfile
import wave

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from vocalis.functions.udf import arrow_function


def read_lines(spark: SparkSession, folder: str, pattern: str = "*", limit: int | None = None) -> DataFrame:
    """Lines of all files below a folder whose names fit; gz files are unpacked."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder).withColumnRenamed("value", "line")
    return df if limit is None else df.limit(limit)


def json_field(line: Column, path: str) -> Column:
    return F.get_json_object(line, f"$.{path}")


def read_tsv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=header, quote="", schema=schema)


def common_voice(spark: SparkSession, path: str) -> DataFrame:
    """A Common Voice table: counts as numbers, accents as a list, the file's id."""
    raw = read_tsv(spark, path, "client_id string, path string, sentence string, up_votes string, down_votes string, age string, gender string, accents string, locale string, segment string")
    return raw.withColumns({"up_votes": F.col("up_votes").cast("int"), "down_votes": F.col("down_votes").cast("int"), "accents": F.split(F.coalesce("accents", F.lit("")), ","), "id": F.substring_index("path", "/", -1)})


def mls_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """``id, transcript`` of the lines of a Multilingual LibriSpeech transcript file."""
    return read_tsv(spark, path, "id string, transcript string", header=False)


def mls_id(member: Column) -> Column:
    """The id of an audio member of an archive: its name without folders and ``.flac``."""
    return F.replace(F.substring_index(member, "/", -1), F.lit(".flac"), F.lit(""))


def write_lines(lines: DataFrame, path: str) -> None:
    """One column of text as gz files, a line for each row."""
    lines.write.mode("overwrite").option("compression", "gzip").text(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    """Rows as gz files of JSON lines."""
    rows.write.mode("overwrite").option("compression", "gzip").json(path)


def parse_rttm(line: Column) -> Column:
    f = F.split(F.trim(line), r"\s+")
    return F.struct(F.get(f, 1).alias("file_id"), F.get(f, 3).cast("double").alias("start"), (F.get(f, 4).cast("double") + F.get(f, 3).cast("double")).alias("end"), F.get(f, 7).alias("label"))


def rttm_line(file_id: Column, start: Column, end: Column, label: Column, strict: bool = True) -> Column:
    """A segment as a line; if ``strict``, one without a duration is an error."""
    duration = F.when(end - start > 0, end - start).otherwise(F.raise_error(F.lit("a segment has no duration")).cast("double")) if strict else end - start
    return F.format_string("SPEAKER %s 1   %.3f   %.3f <NA> <NA> %s <NA> <NA>", file_id, start, duration, label)


def vtt_lines(start_ms: Column, end_ms: Column, text: Column) -> Column:
    from vocalis.functions.text import clock

    return F.concat(clock(start_ms), F.lit(" --> "), clock(end_ms), F.lit("\n"), text)


def ass_line(start_ms: Column, end_ms: Column, text: Column, style: Column) -> Column:
    from vocalis.functions.text import clock

    short = lambda c: F.substring(clock(c), 2, 10)
    return F.concat(F.lit("Dialogue: 0,"), short(start_ms), F.lit(","), short(end_ms), F.lit(","), style, F.lit(",,0,0,0,,"), F.replace(text, F.lit("_"), F.lit(" ")))


def manifest_line(**columns: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in columns.items()]))


def arpa_unigrams(lines: DataFrame) -> DataFrame:
    """Distinct words of the first section; ``lines`` has ``file, lineno, line``."""
    cut = lines.filter(F.col("line").startswith("\\2-grams:")).groupBy("file").agg(F.min("lineno").alias("cut"))
    head = lines.join(cut, "file", "left").filter(F.col("cut").isNull() | (F.col("lineno") < F.col("cut")))
    f = F.split("line", "\t")
    return head.filter(F.size(f) >= 2).select(F.explode(F.split(F.get(f, 1), " ")).alias("word")).filter("word <> ''").distinct()


def probe_streams(probe: Column) -> Column:
    """Streams of a media probe's JSON."""
    kind = "struct<streams:array<struct<codec_name:string,codec_type:string,tags:struct<language:string,title:string>>>>"
    return F.transform(F.from_json(probe, kind)["streams"], lambda s: F.struct(s["codec_name"].alias("codec_name"), s["codec_type"].alias("codec_type"), s["tags"]["language"].alias("language"), s["tags"]["title"].alias("title")))


def markdown_languages(lines: DataFrame) -> DataFrame:
    """Language codes of a list of archives."""
    return lines.filter(F.col("line").startswith("* [") & F.col("line").endswith(".tar)")).select(F.regexp_extract("line", r"^\* \[([^\]]+)\]", 1).alias("language"))


def read_tar_members(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """Members of tar archives: ``archive, member, content``. An archive is one task's work and is read as a stream."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content), mode="r|*") as tar:
                    for m in tar:
                        if m.isfile() and m.name.endswith(suffix):
                            yield pd.DataFrame({"archive": [p], "member": [m.name], "content": [tar.extractfile(m).read()]})

    return files.mapInPandas(run, "archive string, member string, content binary")


def duplicate_names(manifest: DataFrame, path: str) -> DataFrame:
    """Base names that stand more than once in a manifest."""
    return manifest.groupBy(F.substring_index(path, "/", -1).alias("name")).count().filter("count > 1")


@arrow_function("struct<rate:int,samples:array<double>>")
def decode_wav(content: pd.Series) -> pd.DataFrame:
    """PCM WAV of 16 bits to a signal between -1 and 1, channels averaged; null where it isn't one."""
    import numpy as np

    rows = []
    for c in content:
        try:
            with wave.open(io.BytesIO(c)) as w:
                if w.getsampwidth() != 2:
                    raise wave.Error("16 bits only")
                x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels()).mean(axis=1) / 32768
                rows.append((w.getframerate(), x.tolist()))
        except (wave.Error, EOFError, TypeError):
            rows.append((None, None))
    return pd.DataFrame(rows, columns=["rate", "samples"])


@arrow_function("binary")
def encode_wav(samples: pd.Series, rate: pd.Series) -> pd.Series:
    import numpy as np

    out = []
    for x, r in zip(samples, rate, strict=True):
        buf = io.BytesIO()
        with wave.open(buf, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(int(r))
            w.writeframes((np.clip(np.asarray(x, float), -1, 1) * 32767).astype("<i2").tobytes())
        out.append(buf.getvalue())
    return pd.Series(out)
