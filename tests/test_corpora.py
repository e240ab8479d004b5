"""Corpora of files, renderings of alignments, decoded label ids."""

import bz2
import gzip
import json

import pytest
from pyspark.sql import functions as F

from vocalis.functions import arrays as R
from vocalis.functions import text as T
from vocalis.operators import alignment as A
from vocalis.operators import decoding as D
from vocalis.sources import corpora as C
from vocalis.sources.formats import write_json_lines


def test_text_corpus(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    with gzip.open(tmp_path / "in/deep/a.txt.gz", "wt") as f:
        f.write('{"t": "one"}\n{"u": 1}\n')
    (tmp_path / "in/b.txt.gz").write_bytes(gzip.compress(b'{"t": "two"}\n'))
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    assert C.text_corpus(spark, folder, "*.txt.gz", out) == 3
    assert C.text_corpus(spark, folder, "*.txt.gz", out, limit=2) == 2
    assert C.text_corpus(spark, folder, "*.txt.gz", out, extract=lambda c: F.get_json_object(c, "$.t")) == 2
    with pytest.raises(ValueError):
        C.text_corpus(spark, folder, "*.txt.gz", out, extract=lambda c: F.get_json_object(c, "$.none"))
    assert [r.line for r in C.named_file(spark, folder, "b.txt.gz").collect()] == ['{"t": "two"}']
    assert sorted(r.line for r in C.named_file(spark, folder, "*.txt.gz").collect()) == ['{"t": "two"}']
    assert C.named_file(spark, folder, "c.txt.gz").count() == 0


def test_packed_csv(spark, tmp_path):
    p = tmp_path / "news.csv.bz2"
    p.write_bytes(bz2.compress('url,text,tag\nx,"a ""b""\nc, d\r",t\ny,,t\nz,e,\n'.encode()))
    assert sorted(r.text for r in C.csv_texts(spark, str(p)).collect()) == ['a "b" c, d', "e"]


def test_language_manifest(spark, tmp_path):
    rows = spark.createDataFrame([(f"{lang}{i}", lang, "train" if i % 4 else "test") for lang in ("de", "en") for i in range(40)], "path string, locale string, split string")
    files = spark.createDataFrame([(f"{lang}{i}", i / 2) for lang in ("de", "en") for i in range(0, 40, 3)], "path string, duration double")
    a = C.language_manifest(rows, files, 5, 1)
    b = C.language_manifest(rows.repartition(7), files, 5, 1)
    got = sorted(map(tuple, a.collect()))
    assert got == sorted(map(tuple, b.collect())) != sorted(map(tuple, C.language_manifest(rows, files, 5, 2).collect()))
    counts = {(lang, split): sum(r[2] == lang and r[5] == split for r in got) for lang in ("de", "en") for split in ("train", "test")}
    assert counts == {("de", "train"): 5, ("en", "train"): 5, ("de", "test"): 4, ("en", "test"): 4}
    assert all(int(r[0][2:]) % 3 == 0 and r[1] == int(r[0][2:]) / 2 and r[3:5] == ("_", 0.0) for r in got)
    write_json_lines(a.drop("split"), str(tmp_path / "m"))
    assert all(set(json.loads(r.value)) == {"audio_filepath", "duration", "label", "text", "offset"} for r in spark.read.text(str(tmp_path / "m")).collect())
    assert [r.n for r in spark.createDataFrame([(0.5, 2.0)], "s double, e double").select(C.length_in_samples(F.col("s"), F.col("e")).alias("n")).collect()] == [24000]


def lines_of(folder):
    return [line for p in sorted(folder.glob("part-*")) for line in p.read_text().splitlines()]


def test_written_files(spark, tmp_path):
    df = spark.range(500).select("id", F.concat(F.lit("w"), "id").alias("text"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("l\n"), "id")).alias("labels")).repartition(5)
    C.write_aligned(df, ["id"], ["text", "labels"], str(tmp_path / "a"))
    assert lines_of(tmp_path / "a/text") == [f"w{i}" for i in range(500)]
    assert lines_of(tmp_path / "a/labels") == [f"l {i}" if i % 7 else "" for i in range(500)]
    counts = spark.createDataFrame([("b", 2), ("a", 2), ('"c', 9)], "token string, n long")
    C.write_counts(counts, str(tmp_path / "c"))
    assert lines_of(tmp_path / "c") == ['"c\t9', "a\t2", "b\t2"]


def test_subtitles(spark):
    df = spark.createDataFrame([("k", 2000, 3000, "b", "x"), ("k", 0, 1500, "a", None), ("m", 5, 6, "c", "y")], "k string, start_ms long, end_ms long, text string, other string")
    got = {r.k: r.content for r in C.webvtt_files(df, "k", "other").collect()}
    assert got["k"] == "WEBVTT\n\n00:00:00.000 --> 00:00:01.500\na\n\n00:00:02.000 --> 00:00:03.000\nb\nx\n"
    assert {r.k: r.content for r in C.webvtt_files(df, "k").collect()}["m"] == "WEBVTT\n\n00:00:00.005 --> 00:00:00.006\nc\n"
    events = spark.createDataFrame([("k", 2000, 3000, "en", "b_c"), ("k", 0, 1500, "de", "a"), ("k", 0, 1, "de", ""), ("e", 0, 1, "de", None)], "k string, start_ms long, end_ms long, name string, text string")
    files = {r.k: r.content for r in C.ass_files(events, "k", {"de": 20.0, "en": 17.5}).collect()}
    assert files["k"].startswith("[Script Info]\n") and files["k"].count("\nStyle: ") == 2 and "Style: en,Arial,17.5,&H00FFFF00," in files["k"]
    assert files["k"].splitlines()[-2:] == ["Dialogue: 0,0:00:00.00,0:00:01.50,de,,0,0,0,,a", "Dialogue: 0,0:00:02.00,0:00:03.00,en,,0,0,0,,b c"]
    assert files["e"] == C.ass_header({"de": 20.0, "en": 17.5})
    with pytest.raises(ValueError):
        C.ass_header(dict.fromkeys("abcd", 1.0))


def test_alignment_lines(spark):
    df = spark.createDataFrame([(1, "abcdef", "abxdefgh"), (2, "", "ab"), (3, None, None), (4, "same", "same")], "i int, r string, h string")
    rows = {r.i: r for r in df.select("i", A.align_characters("r", "h").alias("a"), A.align_groups("r", "h", F.lit(4)).alias("g")).select("i", "g", A.padded_lines(F.col("a.pairs")).alias("p")).collect()}
    for i, (r, h) in {1: ("abcdef", "abxdefgh"), 2: ("", "ab"), 3: ("", ""), 4: ("same", "same")}.items():
        p = rows[i].p
        assert len(p.ref) == len(p.edits) == len(p.hyp) and (p.ref.replace("*", ""), p.hyp.replace("*", "")) == (r, h)
        assert ("".join(g.ref for g in rows[i].g), "".join(g.hyp for g in rows[i].g)) == (p.ref, p.hyp)
        assert all(len(g.ref) == 3 for g in rows[i].g[:-1]) and all(0 < len(g.ref) < 4 for g in rows[i].g)
    words = spark.sql("select array(named_struct('ref', 'longer', 'hyp', 'one'), named_struct('ref', '*', 'hyp', 'xy'), named_struct('ref', 'abc', 'hyp', '*'), named_struct('ref', 'q', 'hyp', 'qrs')) as p").select(A.padded_lines(F.col("p")).alias("l")).first().l
    assert (words.ref, words.hyp) == ("longer**abcq**", "one***xy***qrs") and words.edits == "sss   ++---sss"


def test_evaluated(spark):
    vocab = ["<pad>", "a", "b", "|"]
    hot = lambda ids: [[1.0 if i == k else 0.0 for i in range(4)] for k in ids]
    df = spark.createDataFrame([(1, hot([1, 1, 0, 1, 3, 2]), [1, 1, 3, 2, -100]), (2, hot([0, 3]), [2, 2, 0, -100]), (3, [], []), (4, None, None)], "i int, s array<array<double>>, l array<int>")
    got = {r.i: (r.prediction, r.reference) for r in D.evaluated(df, "s", "l", vocab).collect()}
    assert got[1] == ("aa b", "aa b") and got[2] == ("", "bb") and got[3] == ("", "")
    rates = A.error_rates(D.evaluated(df.filter("i < 3"), "s", "l", vocab), A.word_edits("reference", "prediction"), []).first()
    assert (rates.errors, rates.ref_tokens) == (1, 3)


def test_small_things(spark):
    row = spark.createDataFrame([([16384, -32768],)], "x array<int>").select(R.model_input(F.col("x")).alias("m")).first().m
    assert row.length == 2 and [round(v, 3) for v in row.signal] == [0.5, -1.0]
    part = spark.range(1).select(T.sox_part(F.lit("a.wav"), tempo=0.9, gain_n=-1).alias("a"), T.sox_transcode(F.lit("a"), F.lit("b"), F.lit("mp3")).alias("b")).first()
    assert part.a == "sox a.wav -p tempo 0.9 gain -n -1" and part.b is None
