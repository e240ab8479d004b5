"""Stateful rules by hand and against their batch forms."""

import math
import random

import pytest

from vocalis.operators.alignment import align
from vocalis.operators.chunking import overlapping_chunks
from vocalis.operators.decoding import beam_search
from vocalis.operators.transcripts import new_suffix
from vocalis.streaming.chunker import Chunker, chunk_batch, chunk_stream
from vocalis.streaming.segmenter import Gluer, Hysteresis


def test_stateful_chunks_equal_the_closed_form(spark):
    rng = random.Random(5)
    cases = [(n, size, step, least) for n in (0, 1, 3, 7, 20) for size in (3, 5) for step in (1, 2, 3) for least in (None, 1, 2)]
    df = spark.createDataFrame([(n,) for n in sorted({c[0] for c in cases})], "n int")
    for size, step, least in sorted({c[1:] for c in cases}, key=str):
        from pyspark.sql import functions as F

        want = {r.n: [tuple(x) for x in r.c] for r in df.select("n", overlapping_chunks(F.col("n"), size, step, least).alias("c")).collect()}
        for n in want:
            c, got = Chunker(size, step, least), []
            for i in range(n):
                got += c.feed(i, [float(i)], False)
            got += c.feed(n, [], True)
            assert [(a, len(x), e) for a, x, e in got] == want[n], (n, size, step, least, rng)


def test_largest_step_and_gap():
    c = Chunker(4, 2, most=3)
    out = c.feed(0, [float(x) for x in range(12)], True)
    assert [a for a, _, _ in out] == [0, 3, 6, 8] and out[-1][2]
    with pytest.raises(ValueError):
        Chunker(4, 2).feed(3, [1.0], False)


def test_chunk_stream_equals_batch(spark, tmp_path):
    rows = []
    for m in ("a", "b"):
        at = 0
        for k, n in enumerate((3, 4, 5, 2)):
            rows.append((m, at, [float(at + i) for i in range(n)], False))
            at += n
        rows.append((m, at, [], True))
    schema = "message_id string, frame_idx long, array array<double>, end_of_signal boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = chunk_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 6, 2)
    q = stream.writeStream.format("memory").queryName("chunks").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.message_id, r.frame_idx, r.array, r.end_of_signal) for r in spark.table("chunks").collect())
    want = sorted((r.message_id, r.frame_idx, r.array, r.end_of_signal) for r in chunk_batch(spark.createDataFrame(rows, schema), 6, 2).collect())
    assert got == want and len(got) == 12


def test_hysteresis():
    h = Hysteresis(0.5, 2, 1)
    found = [x for i, p in enumerate([0, 0, 1, 1, 1, 0, 1, 0, 0, 1, 1]) if (x := h.feed(i, p))]
    assert found == [(1, 7)] and h.finish(10) == (8, 11)


def test_glue():
    left = ("hello wor", [i * 0.1 for i in range(9)])
    right = ("wo world", [0.55 + i * 0.1 for i in range(8)])
    g = Gluer()
    assert g.feed(*left)[0] == "hello wor"
    g.feed(*right)
    assert g.letters.startswith("hello w") and g.letters.endswith("ld")
    assert new_suffix(("ab", [0.0, 0.1]), ("cd", [1.0, 1.1])) == (" cd", [0.999, 1.0, 1.1])
    assert new_suffix(("ab", [0.0, 1.1]), ("xy", [1.0, 1.2])) is None


def test_align():
    score, pairs = align(list("abcde"), list("bxd"))
    assert score == 3 and "".join(p[0] for p in pairs) == "abcde"
    assert align(list("ab"), [])[1][0][1] == "*"


def test_beam_search_prefers_the_best_path():
    logp = [[-5.0, -0.1, -5.0], [-0.1, -5.0, -5.0], [-5.0, -5.0, -0.1]]
    assert beam_search(logp, ["_", "a", "b"], 0, 8, None, 1.0, 0.0)[0][0] == "ab"


def test_beam_search_equals_all_paths():
    import itertools
    import random

    rng, vocab = random.Random(6), ["_", "a", "b", " "]
    logp = []
    for _ in range(6):
        p = [rng.random() for _ in vocab]
        logp.append([math.log(x / sum(p)) for x in p])
    want: dict[str, float] = {}
    for path in itertools.product(range(4), repeat=6):
        text = "".join(vocab[i] for k, i in enumerate(path) if i and (k == 0 or path[k - 1] != i))
        want[text] = want.get(text, 0.0) + math.exp(sum(logp[k][i] for k, i in enumerate(path)))
    got = dict(beam_search(logp, vocab, 0, 100_000, None, 1.0, 0.0))
    assert got.keys() == want.keys() and all(abs(math.exp(got[t]) - p) < 1e-9 for t, p in want.items())


def test_ctc_beams_decodes_whole_messages(spark):
    from vocalis.plans import registry, signal_queries

    got = [r for r in registry.queries()["ctc_beams"](spark, "/root/testdata/sf0.001").collect() if r.msg == 0]
    frames = [r.x for r in sorted(signal_queries._frames(spark, "/root/testdata/sf0.001").filter("msg = 0").collect(), key=lambda r: r.frame)]
    assert len(frames) == 20 and len(frames[0]) == len(signal_queries.VOCAB) == 64
    logp = [[x - math.log(sum(math.exp(y) for y in f)) for x in f] for f in frames]
    want = beam_search(logp, [" " if v == "|" else v for v in signal_queries.VOCAB], 0, 100, None, 1.0, 0.5)[:3]
    assert [(r.text, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(t, round(s, 6)) for t, s in want]
