"""Archives made here: members, splits, early stop, transcripts joined to audio."""

import io
import tarfile

import pytest
from pyspark.sql import functions as F

from vocalis.sources import archives as A
from vocalis.sources.formats import decode_wav, encode_wav


def make(path, members, mode):
    with tarfile.open(path, mode) as tar:
        for name, content in members:
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
        folder = tarfile.TarInfo("corpus/empty")
        folder.type = tarfile.DIRTYPE
        tar.addfile(folder)


def voice_members(ids, splits=A.SPLITS):
    tsv = lambda s: ("client\tpath\tsentence\n" + "".join(f"c\t{i}.mp3\tText \"{i}\"\n" for i in ids if i % 3 == A.SPLITS.index(s))).encode()
    return [(f"corpus/{s}.tsv", tsv(s)) for s in splits] + [(f"corpus/clips/{i}.mp3", bytes([i % 256]) * (100 + i)) for i in [*ids, 999]]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("archives")
    (d / "packed").mkdir()
    (d / "plain").mkdir()
    make(d / "packed" / "cv.tar.gz", voice_members(range(40)), "w:gz")
    make(d / "plain" / "cv.tar", voice_members(range(40)), "w")
    return d


@pytest.mark.parametrize("kind", ["packed", "plain"])
def test_transcribed_audio(spark, folder, tmp_path, kind):
    path = str(folder / kind)
    cache = str(tmp_path / "cache")
    transcripts = A.cached_transcripts(spark, path, A.COMMON_VOICE, cache)
    assert {(r.split, r.id, r.text) for r in transcripts.collect()} == {(A.SPLITS[i % 3], f"{i}.mp3", f'Text "{i}"') for i in range(40)}
    assert A.cached_transcripts(spark, "/nowhere", A.COMMON_VOICE, cache).count() == 40  # not read again
    got = A.transcribed_audio(spark, path, A.COMMON_VOICE, transcripts.filter("split = 'dev'"))
    assert got.columns == ["id", "format", "content", "text", "split"]
    assert {(r.id, r.format, bytes(r.content), r.text) for r in got.collect()} == {(f"{i}.mp3", "mp3", bytes([i]) * (100 + i), f'Text "{i}"') for i in range(1, 40, 3)}
    assert A.audio_only(got, 5).count() == 5


def test_index_splits_and_pushed_conditions(spark, folder):
    path = str(folder / "plain" / "cv.tar")
    index = A.member_index(spark, path, r"\.mp3$")
    assert index.count() == 41 and A.read_members(index, 8).rdd.getNumPartitions() == 8
    assert {(r.member, bytes(r.content)) for r in A.read_members(index, 8).collect()} == {(f"corpus/clips/{i}.mp3", bytes([i % 256]) * (100 + i)) for i in [*range(40), 999]}
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled", None)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        few = A.archive_members(spark, path).filter(F.col("member").endswith("7.mp3") & F.col("member").contains("clips") & (F.col("size") > 120))
        assert {r.member.split("/")[-1] for r in few.collect()} == {"27.mp3", "37.mp3"}
        assert {r.member for r in A.archive_members(spark, path).filter(F.col("member").isin("corpus/dev.tsv", "x")).collect()} == {"corpus/dev.tsv"}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled") if before is None else spark.conf.set("spark.sql.python.filterPushdown.enabled", before)
    reader = A.PushedReader(path)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    kept = list(reader.pushFilters([EqualTo(("member",), "corpus/dev.tsv"), GreaterThan(("size",), 1)]))
    assert [type(f) for f in kept] == [GreaterThan] and [len(b) for b in reader.read(A.ArchivePartition(path))] == [1]


def test_reading_stops_and_errors(spark, folder, tmp_path):
    # what follows the splits is broken and is not reached
    whole = (folder / "packed" / "cv.tar.gz").read_bytes()
    import gzip

    raw = gzip.decompress(whole)
    (tmp_path / "cut.tar").write_bytes(raw[: 512 * 12 + 700])
    assert A.archive_transcripts(spark, str(tmp_path / "cut.tar"), A.COMMON_VOICE).count() == 40
    with pytest.raises(ValueError, match="no transcripts of test"):
        make(tmp_path / "two.tar", voice_members(range(4), ("train", "dev")), "w")
        A.archive_transcripts(spark, str(tmp_path / "two.tar"), A.COMMON_VOICE)
    with pytest.raises(FileNotFoundError):
        A.list_archives(str(tmp_path / "none"))
    big = A.archive_members(spark, str(folder / "plain" / "cv.tar"), r"\.mp3$", most=110).collect()
    assert {r.member.split("/")[-1] for r in big if r.content is not None} == {f"{i}.mp3" for i in range(11)} and len(big) == 41


def test_lines_of_ids_and_waves(spark, tmp_path):
    audio = spark.createDataFrame([([0.0, 0.5, -0.5, 0.25], 8000)], "x array<double>, r int").select(encode_wav("x", "r").alias("w")).first().w
    members = [(f"mls/{s}/transcripts.txt", f"{s}_1\thello {s}\n{s}_2\tno audio\n".encode()) for s in A.SPLITS] + [(f"mls/{s}/audio/{s}_1.flac", bytes(audio)) for s in A.SPLITS]
    make(tmp_path / "mls.tar.gz", members, "w:gz")
    path = str(tmp_path / "mls.tar.gz")
    transcripts = A.archive_transcripts(spark, path, A.LIBRISPEECH)
    assert transcripts.count() == 6
    arrays = A.transcribed_audio(spark, path, A.LIBRISPEECH, transcripts).select("id", "text", decode_wav("content").alias("d")).collect()
    assert {(r.id, r.text, r.d.rate, len(r.d.samples)) for r in arrays} == {(f"{s}_1", f"hello {s}", 8000, 4) for s in A.SPLITS}
