"""Tar archives of speech corpora as a data source: members as rows, transcripts and audio joined by id.

An archive is opened in the task that reads it, through ``pyarrow``'s file systems (local and mounted paths, ``s3``, ``gs``, ``hdfs``), and read as a
stream, so it may be of any size; a member has to fit into a row. Plain archives can be cut: ``member_index`` lists
members by reading headers alone, and ``read_members`` reads the contents at their places, dealt over all tasks. Packed ones (gz, bz2, xz) are one
task's work each. Conditions on ``member`` are handed to the reader (where ``spark.sql.python.filterPushdown.enabled`` is set), which then skips contents.
"""

from __future__ import annotations

import re
import tarfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

MEMBERS = "archive string, member string, place long, size long, content binary"
#: Bytes of contents in a batch of rows, about.
BATCH = 16 << 20
#: Larger members have no content in their row.
MOST = 1 << 30


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def list_archives(path: str) -> list[str]:
    """The archive at a path, or those below a folder."""
    from pyarrow import fs

    system, inner = _system(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return sorted(head + f.path for f in found if f.type == fs.FileType.File and re.search(r"\.(tar|tgz|tar\.(gz|bz2|xz))$", f.path))


@dataclass
class ArchivePartition(InputPartition):
    path: str


@dataclass
class ArchiveReader(DataSourceReader):
    """``member`` is a pattern that names of members match somewhere; ``until`` are ends of names: once each was met, the rest of an archive
    is not read; ``contents`` tells whether contents are wanted."""

    path: str
    member: str = ""
    until: tuple[str, ...] = ()
    contents: bool = True
    most: int = MOST
    tests: list[tuple[str, object]] = field(default_factory=list)

    def wanted(self, name: str) -> bool:
        does = {"EqualTo": lambda v: name == v, "In": lambda v: name in v, "StringStartsWith": name.startswith, "StringEndsWith": name.endswith, "StringContains": lambda v: v in name}
        return re.search(self.member, name) is not None and all(does[kind](value) for kind, value in self.tests)

    def partitions(self) -> list[ArchivePartition]:
        return [ArchivePartition(p) for p in list_archives(self.path)]

    def read(self, partition: ArchivePartition) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("place", pa.int64()), ("size", pa.int64()), ("content", pa.binary())])
        system, inner = _system(partition.path)
        rows, held, open_ends = [], 0, set(self.until)
        packed = not inner.endswith(".tar")
        with system.open_input_file(inner) as f, tarfile.open(fileobj=f, mode="r|*" if packed else "r:") as tar:
            for m in tar:
                tar.members = []  # a list of all members is not needed
                if not m.isfile():
                    continue
                if self.wanted(m.name):
                    content = tar.extractfile(m).read() if self.contents and m.size <= self.most else None
                    rows.append((partition.path, m.name, None if packed else m.offset_data, m.size, content))
                    held += len(content or b"") + 200
                    if held >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows, held = [], 0
                open_ends -= {e for e in open_ends if m.name.endswith(e)}
                if self.until and not open_ends:
                    break
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


class PushedReader(ArchiveReader):
    """Takes conditions on ``member`` over from Spark."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            known = {EqualTo: "__eq__", StringStartsWith: "startswith", StringEndsWith: "endswith", StringContains: "__contains__"}
            if getattr(f, "attribute", None) == ("member",) and isinstance(f, (*known, In)):
                self.tests.append((type(f).__name__, f.value))
            else:
                yield f


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "speech_archive"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> ArchiveReader:
        o = self.options
        # Spark refuses a reader that takes conditions while its setting for that is off
        kind = PushedReader if o.get("pushdown") == "true" else ArchiveReader
        return kind(o["path"], o.get("member", ""), tuple(x for x in o.get("until", "").split(",") if x), o.get("contents", "true") == "true", int(o.get("most", MOST)))


def archive_members(spark: SparkSession, path: str, member: str = "", until: tuple[str, ...] = (), contents: bool = True, most: int = MOST) -> DataFrame:
    """``archive, member, place, size, content`` of the members of the archives at a path; ``place`` is null in packed archives."""
    spark.dataSource.register(ArchiveSource)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("speech_archive").options(pushdown=pushdown, path=path, member=member, until=",".join(until), contents=str(contents).lower(), most=str(most)).load()


def member_index(spark: SparkSession, path: str, member: str = "") -> DataFrame:
    """``archive, member, place, size`` of plain archives, without reading contents."""
    return archive_members(spark, path, member, contents=False).filter("place is not null").drop("content")


def read_members(index: DataFrame, tasks: int | None = None) -> DataFrame:
    """The index's columns and the ``content`` of each member, read at its place; members of one archive are dealt over tasks."""
    n = tasks or int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.repartition(n, "archive", "member").sortWithinPartitions("archive", "place")
    at = [index.columns.index(c) for c in ("archive", "place", "size")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = file = None
        for batch in batches:
            starts, held = 0, 0
            content: list[bytes] = []
            for archive, place, size in zip(*(batch.column(i).to_pylist() for i in at), strict=True):
                if archive != path:
                    if file:
                        file.close()
                    path, (system, inner) = archive, _system(archive)
                    file = system.open_input_file(inner)
                file.seek(place)
                content.append(file.read(size))
                held += size
                if held >= BATCH:
                    part = batch.slice(starts, len(content))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(content, pa.binary())], names=[*batch.schema.names, "content"])
                    starts, held, content = starts + len(content), 0, []
            part = batch.slice(starts, len(content))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(content, pa.binary())], names=[*batch.schema.names, "content"])
        if file:
            file.close()

    from pyspark.sql.types import BinaryType, StructType

    return dealt.mapInArrow(run, StructType([*index.schema.fields]).add("content", BinaryType()))


@dataclass(frozen=True)
class CorpusForm:
    """How a corpus keeps its transcripts: the end of a split's member, whether a header names the columns (of id and text, else the first two), the end of
    audio members and what of their base name is no part of the id."""

    transcripts: str
    header: bool
    id_column: str
    text_column: str
    audio: str
    drop: str

    def audio_id(self, member: Column) -> Column:
        name = F.substring_index(member, "/", -1)
        return F.replace(name, F.lit(self.drop), F.lit("")) if self.drop else name


COMMON_VOICE = CorpusForm("/{split}.tsv", True, "path", "sentence", ".mp3", "")
LIBRISPEECH = CorpusForm("/{split}/transcripts.txt", False, "", "", ".flac", ".flac")
SPLITS = ("train", "dev", "test")


def archive_transcripts(spark: SparkSession, path: str, form: CorpusForm, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """``split, id, text`` of an archive's transcripts; reading ends when all splits were met. A split that is not there is an error."""
    ends = {form.transcripts.format(split=s): s for s in splits}
    pattern = "(" + "|".join(re.escape(e) for e in ends) + ")$"
    found = archive_members(spark, path, pattern, tuple(ends)).select("member", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for member, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                split = next(s for e, s in ends.items() if member.endswith(e))
                rows = [line.rstrip("\r").split("\t") for line in content.decode("utf-8").split("\n") if line]
                at = (0, 1)
                if form.header:
                    names, rows = (rows[0], rows[1:]) if rows else ([], [])
                    at = (names.index(form.id_column), names.index(form.text_column)) if names else at
                yield pa.RecordBatch.from_arrays([pa.array([split] * len(rows), pa.string()), *(pa.array([r[i] if i < len(r) else None for r in rows], pa.string()) for i in at)], names=["split", "id", "text"])

    names = {r.member for r in archive_members(spark, path, pattern, tuple(ends), contents=False).select("member").collect()}
    missing = [s for e, s in ends.items() if not any(n.endswith(e) for n in names)]
    if missing:
        raise ValueError(f"no transcripts of {', '.join(missing)} in {path}")
    return found.mapInArrow(run, "split string, id string, text string")


def cached_transcripts(spark: SparkSession, path: str, form: CorpusForm, cache: str, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """The transcripts, kept as Parquet by split in a folder that all tasks see; they are taken out of the archive once."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{cache}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        archive_transcripts(spark, path, form, splits).write.mode("overwrite").partitionBy("split").parquet(cache)
    return spark.read.schema("id string, text string, split string").parquet(cache)


def transcribed_audio(spark: SparkSession, path: str, form: CorpusForm, transcripts: DataFrame) -> DataFrame:
    """``id, format, content, text`` and the transcripts' other columns, of audio members that have a transcript.

    Ids are matched before contents are read where archives are plain; members of packed ones are read along the way.
    """
    named = lambda df: df.withColumn("id", form.audio_id(F.col("member"))).withColumn("format", F.substring_index("member", ".", -1))
    pattern = re.escape(form.audio) + "$"
    if all(p.endswith(".tar") for p in list_archives(path)):
        out = read_members(named(member_index(spark, path, pattern)).join(transcripts, "id"))
    else:
        out = named(archive_members(spark, path, pattern)).join(transcripts, "id")
    return out.select("id", "format", "content", *(c for c in transcripts.columns if c != "id"))


def audio_only(audio: DataFrame, limit: int | None = None) -> DataFrame:
    """Audio without its transcripts."""
    out = audio.select("id", "format", "content")
    return out if limit is None else out.limit(limit)
