"""Small functions with values, ordinals, shuffles, splits and joins by time against plain forms."""

import math
import random

import pytest
from pyspark.sql import functions as F

from vocalis.functions import arrays as R
from vocalis.operators import corpus as C
from vocalis.operators import models as M
from vocalis.operators import segments as S
from vocalis.operators import training as P
from vocalis.operators.ordinals import number_rows
from vocalis.plans import registry
from vocalis.sources import formats

DIR = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head().x


def arr(*x):
    return F.array(*(F.lit(float(v)) for v in x)) if x else F.array().cast("array<double>")


def test_arrays(spark):
    assert one(spark, R.from_int16(arr(16384, -32768))) == [0.5, -1.0]
    assert one(spark, R.pad_to(arr(1, 2), 4)) == [1, 2, 0, 0] and one(spark, R.pad_to(arr(1, 2), 1)) == [1, 2] and one(spark, R.pad_to(arr(), 1)) == [0]
    assert one(spark, R.unit_length(arr(3, 4))) == [0.6, 0.8]
    assert one(spark, R.power_distance(arr(0, 1, -1))) == [0, -1, 0.5]
    assert one(spark, R.frame_times(arr(0, 5), F.lit(1600), F.lit(10), 16000)) == [0, 0.05]
    assert one(spark, R.frame_times(arr(0, 5), F.lit(1600), F.lit(10), 16000, F.lit(8000))) == [0.5, 0.55]
    for x, want in (((), True), ((1,), True), ((1, 1, 2), True), ((1, 0), False)):
        assert one(spark, R.weakly_increasing(arr(*x))) is want
    spans = F.array(F.struct(F.lit(0.0).alias("start"), F.lit(0.2).alias("end")), F.struct(F.lit(0.3).alias("start"), F.lit(9.0).alias("end")))
    assert one(spark, R.keep_voiced(arr(0, 1, 2, 3, 4, 5), spans, 10)) == [0, 1, 3, 4]
    assert one(spark, R.keep_voiced(arr(7, 8), F.slice(spans, 1, 0), 10)) == [7, 8]
    words = F.array(*(F.struct(F.lit(w).alias("word"), F.lit(a).alias("start"), F.lit(b).alias("end")) for w, a, b in (("abc", 0, 6), ("", 6, 7), ("d", 8, 9))))
    assert one(spark, R.character_frames(words)) == [0, 2, 4, 8]


def test_shares_and_samples(spark):
    shares = [one(spark, C.worker_range(F.lit(10), 3, k)) for k in range(3)]
    assert [(x.begin, x.end) for x in shares] == [(0, 4), (4, 8), (8, 10)]
    x = [r.x for r in spark.range(2000).select(C.log_uniform(0.01, 100.0, 3).alias("x")).collect()]
    assert all(0.01 <= v <= 100 for v in x) and 0.45 < sum(v < 1 for v in x) / len(x) < 0.55


def test_models(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, []), (3, None)], "i int, x array<double>")
    double = M.array_model(lambda: lambda x: [v * 2 for v in x if 1 / len(x)], "array<double>")
    assert {r.i: r.y for r in df.select("i", double("x").alias("y")).collect()} == {1: [2.0, 4.0], 2: [], 3: None}
    broken = M.array_model(lambda: lambda x: [1 / len(x)], "array<double>")
    assert {r.i: r.y for r in df.select("i", broken("x").alias("y")).collect()} == {1: [0.5], 2: None, 3: None}
    up = df.filter("i < 3").select("i", M.resampler(1, 2)("x").alias("y")).collect()
    assert {r.i: r.y for r in up} == {1: [1.0, 1.5, 2.0, 2.0], 2: []}
    assert M.infer(df, lambda batches: (b[["i"]] for b in batches), "i int").count() == 3
    import zlib

    for r in registry.queries()["compression_ratio"](spark, DIR).limit(20).join(spark.read.parquet(f"{DIR}/documents.parquet"), "doc_id").collect():
        b = r.text.encode()
        assert r.ratio == len(b) / len(zlib.compress(b))


def test_formats(spark, tmp_path):
    wav = spark.createDataFrame([([0.0, 0.5, -1.0], 8000), ([], 16000)], "x array<double>, r int").select(formats.encode_wav("x", "r").alias("w"))
    got = [r.d for r in wav.select(formats.decode_wav("w").alias("d")).collect()]
    assert [d.rate for d in got] == [8000, 16000] and got[1].samples == []
    assert all(abs(a - b) < 1e-4 for a, b in zip(got[0].samples, [0.0, 0.5, -1.0], strict=True))
    bad = spark.createDataFrame([(b"no",), (None,)], "w binary").select(formats.decode_wav("w").alias("d")).collect()
    assert all(r.d is None or (r.d.rate is None and r.d.samples is None) for r in bad)
    line = one(spark, formats.ass_line(F.lit(61230), F.lit(3661000), F.lit("a_b"), F.lit("Main")))
    assert line.startswith("Dialogue: 0,0:01:01.23,1:01:01.00,Main,") and line.endswith("a b")
    probe = '{"streams":[{"codec_name":"aac","codec_type":"audio","tags":{"language":"deu","title":"t"}},{"codec_name":"h264","codec_type":"video"}]}'
    streams = one(spark, formats.probe_streams(F.lit(probe)))
    assert [(s.codec_name, s.codec_type, s.language) for s in streams] == [("aac", "audio", "deu"), ("h264", "video", None)]
    lines = spark.createDataFrame([("* [de](https://x.org/de.tar)",), ("* [en](x.zip)",), ("text",)], "line string")
    assert [r.language for r in formats.markdown_languages(lines).collect()] == ["de"]
    head = "client_id\tpath\tsentence\tup_votes\tdown_votes\tage\tgender\taccents\tlocale\tsegment\n"
    (tmp_path / "v.tsv").write_text(head + 'c\ta/b.mp3\tsay "it"\t2\t0\t\t\tx,y\ten\t\n')
    row = formats.common_voice(spark, str(tmp_path / "v.tsv")).head()
    assert (row.id, row.sentence, row.up_votes, row.accents) == ("b.mp3", 'say "it"', 2, ["x", "y"])


def test_numbered_rows_for_any_cuts(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 5.0, float(rng.randrange(40))]), i) for i in range(700)]
    want = {i: k for k, (_, i) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0.0, r[1])))}
    df = spark.createDataFrame(rows, "a double, i int").repartition(7)
    for parts in (2, 9, 1000):
        assert {r.i: r.row for r in number_rows(df, F.col("a"), ["i"], parts=parts).collect()} == want
    assert number_rows(df.limit(0), F.col("a"), ["i"]).collect() == []
    assert sorted(r.row for r in number_rows(df.select(F.lit(None).cast("int").alias("a"), "i"), F.col("a"), ["i"]).collect()) == list(range(700))


def test_shuffle_has_an_order_of_its_own(spark):
    df = spark.createDataFrame([(i, None if i % 5 else "x") for i in range(300)], "i int, t string")
    order = lambda x, seed: [r.i for r in P.shuffled(x, seed).collect()]
    one_, again, other = order(df.repartition(2), 1), order(df.repartition(9), 1), order(df, 2)
    assert one_ == again and one_ != other and sorted(one_) == sorted(other) == list(range(300))
    # neither order keeps the table's: about half of the neighbours rise
    assert all(0.4 < sum(a < b for a, b in zip(x, x[1:], strict=False)) / 299 < 0.6 for x in (one_, other))


def test_split_breaks_ties(spark):
    df = spark.createDataFrame([(1, k) for k in range(10)] + [(None, 10)], "a int, k int")
    dev = lambda order, n: sorted(r.k for r in C.train_dev_split(df, order, n).filter("split = 'dev'").collect())
    assert dev(["a", "k"], 4) == [0, 1, 2, 10] and dev("a", 1) == [10]
    with pytest.raises(Exception, match="fewer rows"):
        C.train_dev_split(df, "a", 12).collect()


def test_overlaps_and_blocks_equal_all_pairs(spark):
    rng = random.Random(8)
    segs = lambda n: [(rng.choice(["a", "b", None]), s := rng.uniform(0, 100), s + rng.choice([0.0, 0.01, 1.0, 5.0, 90.0]), rng.choice("xyz")) for _ in range(n)]
    sys, ref = segs(150), segs(120)
    schema = "k string, start double, end double, label string"
    got = {(r.k, r.sys_label, r.ref_label): r.seconds for r in S.overlap_seconds(spark.createDataFrame(sys, schema), spark.createDataFrame(ref, schema), ["k"]).collect()}
    want: dict = {}
    for k, s, e, x in sys:
        for q, t, f, y in ref:
            if k == q and s < f and t < e and s < e and t < f:
                want[k, x, y] = want.get((k, x, y), 0.0) + min(e, f) - max(s, t)
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i]) for i in want)
    tokens = [(rng.choice(["a", "b", None]), i, str(i), rng.uniform(-5, 105)) for i in range(300)]
    blocks = [(k, i, s, e) for i, (k, s, e, _) in enumerate(sys)]
    found = S.tokens_in_blocks(spark.createDataFrame(tokens, "k string, pos int, token string, ts double"), spark.createDataFrame(blocks, "k string, block int, start double, end double"), "k", "block").collect()
    texts = {b: " ".join(w for q, _, w, ts in tokens if q == k and s <= ts < e) for k, b, s, e in blocks}
    assert {r.block: r.text for r in found} == {b: t for b, t in texts.items() if t}


def test_word_errors_of_whole_texts(spark):
    import duckdb

    from vocalis.plans.text_queries import CLEANED

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DIR}/documents.parquet'")
    rows = con.execute(f"select lang, sum(len(regexp_extract_all(t, ' the ')))::bigint, sum(len(list_filter(string_split(t, ' '), lambda w: w <> '')))::bigint from {CLEANED} group by lang").fetchall()
    got = {r.lang: (r.errors, r.ref_tokens) for r in registry.queries()["wer_by_lang"](spark, DIR).collect()}
    assert got == {lang: (errors, words) for lang, errors, words in rows} and sum(e for e, _ in got.values()) > 100
