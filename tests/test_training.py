"""Subtitle blocks against a plain loop, vocabularies, padding, and files written and read again."""

import pytest
from pyspark.sql import functions as F

from vocalis.operators import subtitles, training
from vocalis.plans import registry
from vocalis.sources import formats

DIR = "/root/testdata/sf0.001"


def blocks_by_hand(tokens, translated, most=50):
    chunks, now = [], []
    for token, ts in tokens:
        now.append((token, ts))
        if sum(len(t) for t, _ in now) > most:
            chunks.append(now)
            now = []
    chunks += [now] if now else []
    squeeze = lambda ts: " ".join(" ".join(ts).replace("\n", " ").split(" "))
    starts = [c[0][1] for c in chunks] + [10000.0]
    return [(k, starts[k], starts[k + 1], squeeze(t for t, _ in c), squeeze(t for t, s in translated if starts[k] <= s < starts[k + 1])) for k, c in enumerate(chunks)]


def test_subtitle_blocks(spark):
    from vocalis.plans.training_queries import _placed

    tables = []
    for text in (F.col("text"), F.reverse("text")):
        rows: dict = {}
        for r in sorted(_placed(spark, DIR, text).collect(), key=lambda r: (r.conv_id, r.pos, r.token)):
            rows.setdefault(r.conv_id, []).append((r.token, r.ts))
        tables.append(rows)
    got: dict = {}
    for r in registry.queries()["subtitle_blocks"](spark, DIR).collect():
        got.setdefault(r.conv_id, []).append((r.block, r.start, r.end, *(" ".join(x.split()) for x in (r.text, r.translation))))
    assert got.keys() == tables[0].keys() and len(got) > 5
    for i, rows in got.items():
        want = [(*b[:3], *(" ".join(x.split()) for x in b[3:])) for b in blocks_by_hand(tables[0][i], tables[1][i])]
        assert sorted(rows) == want


def test_subtitle_blocks_of_odd_keys(spark):
    schema = "k string, pos int, token string, ts double"
    rows = [(None, 1, "a" * 51, 0.0), (None, 2, "b", 1.0), ("x", 1, None, 0.0), ("x", 2, "c", 2.0)]
    got = subtitles.subtitle_blocks(spark.createDataFrame(rows, schema), spark.createDataFrame([("x", 1, "t", 1.0), ("y", 1, "u", 1.0), ("x", 2, "v", -1.0)], schema), "k").collect()
    assert sorted((r.k or "", r.block, r.start, r.end, r.translation) for r in got) == [("", 0, 0.0, 1.0, ""), ("", 1, 1.0, 10000.0, ""), ("x", 0, 0.0, 10000.0, "t")]
    empty = spark.createDataFrame([], schema)
    assert subtitles.subtitle_blocks(empty, empty, "k").collect() == []


def test_training_vocabulary(spark):
    of = lambda *t: spark.createDataFrame([(x, i) for i, x in enumerate(t)], "token string, id int")
    ids = lambda df: {r.token: r.id for r in df.collect()}
    assert ids(training.training_vocabulary(of("a", " "), "|", "<unk>", "<pad>")) == {"a": 0, "|": 1, "<unk>": 2, "<pad>": 3}
    assert ids(training.training_vocabulary(of("a", "<unk>", " "), None, "<unk>", "<pad>")) == {"a": 0, "<unk>": 1, " ": 2, "<pad>": 3}
    assert ids(training.training_vocabulary(of("a", "b"))) == {"a": 0, "b": 1}
    for bad in (of("a", "a"), of("a", "<UNK>")):
        with pytest.raises(Exception, match="repeated|case only"):
            training.training_vocabulary(bad, "|", "<unk>", "<pad>").collect()


def test_padding(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], [7]), (1, [3.0], [8, 9]), (2, [], [])], "b int, x array<double>, y array<int>")
    got = sorted(tuple(map(tuple, (r.x, r.y, r.mask))) for r in training.padded_batches(df, "b", "x", "y", 3).collect())
    assert got == [((), (), ()), ((1.0, 2.0, 0.0), (7, -100), (1, 1, 0)), ((3.0, 0.0, 0.0), (8, 9), (1, 0, 0))]


def test_arrays_of_different_sizes_do_not_zip(spark):
    df = spark.createDataFrame([(1, [1], [1, 2])], "i int, x array<int>, y array<int>")
    with pytest.raises(Exception, match="different sizes"):
        training.zip_by_position(df, "x", "y").collect()


def test_files(spark, tmp_path):
    formats.write_lines(spark.createDataFrame([("a b",), ("c",)], "line string"), str(tmp_path / "lines"))
    assert sorted(r.line for r in formats.read_lines(spark, str(tmp_path / "lines"), "*.gz").collect()) == ["a b", "c"]
    formats.write_json_lines(spark.createDataFrame([(1, "x")], "i int, t string"), str(tmp_path / "rows"))
    assert [formats_row.line for formats_row in formats.read_lines(spark, str(tmp_path / "rows"), "*.json.gz").collect()] == ['{"i":1,"t":"x"}']
    (tmp_path / "transcripts.txt").write_text("1_2_3\tein \"Satz\n4_5_6\tnoch einer\n")
    rows = formats.mls_transcripts(spark, str(tmp_path / "transcripts.txt"))
    names = spark.createDataFrame([("mls/audio/1/2/1_2_3.flac",), ("mls/audio/9.flac",)], "member string")
    assert [(r.id, r.transcript) for r in names.withColumn("id", formats.mls_id(F.col("member"))).join(rows, "id").collect()] == [("1_2_3", 'ein "Satz')]
