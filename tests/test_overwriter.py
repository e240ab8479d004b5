"""Streams whose transcripts are taken back and said anew."""

import numpy as np
import pytest

from vocalis.streaming.chunker import Chunker
from vocalis.streaming.overwriter import Overwriter, _follow, fold_responses, overwrite_batch, overwrite_stream, repetitive, response_text, spelled, spelled_model, word_times, words_since

RATE, SAMPLES, HOP = 16000, 393990, 8000
WORDS = [f"W{i:03d}" for i in range(SAMPLES // HOP)]


def folded(responses):
    text = ""
    for _, _, remove, append, _, more, _ in responses:
        assert not remove or text.endswith(remove)
        text = _follow(text, remove, append + "".join(s[2] for s in more))
    return text


@pytest.mark.parametrize(("step", "window", "expected"), [(4.0, 4.0, 7), (2.0, 4.0, 12), (1.0, 4.0, 22)])
def test_responses_and_whole_text(step, window, expected):
    samples = np.r_[spelled(WORDS, HOP), np.zeros(SAMPLES - len(WORDS) * HOP)]
    rule, out = Overwriter(spelled_model(HOP, RATE), Chunker(int(window * RATE), int(step * RATE)), RATE), []
    for at in range(0, SAMPLES, 1600):
        out += rule.feed(at, samples[at : at + 1600].tolist(), at + 1600 >= SAMPLES)
    assert len(out) == expected and [r[0] for r in out] == list(range(expected)) and [r[-1] for r in out] == [False] * (expected - 1) + [True]
    assert folded(out) == "".join(f" {w}" for w in WORDS)
    assert any(r[2] for r in out) and not out[0][2]
    assert rule.open == [] and rule.sent == 0


def test_words_are_placed_evenly():
    assert word_times(1.0, 3.0, 3) == [1.0, 2.0, 3.0] and word_times(1.0, 3.0, 1) == [2.0] and word_times(1.0, 3.0, 0) == []
    open_ = [(0.0, 1.0, " a b"), (1.0, 3.0, " c  d e"), (3.0, 4.0, " f")]
    assert words_since(open_, 2.0) == ["d", "e", "f"] and words_since(open_, 1.0) == ["b", "c", "d", "e", "f"]
    assert words_since(open_, 4.5) is None and words_since([(0.0, 2.0, " ")], 1.0) == []
    assert repetitive("no " * 60) and not repetitive("a sentence of words") and not repetitive("")


def test_prefix_prompt_and_strange_segments():
    asked = []

    def model(samples, prompt, prefix):
        asked.append((prompt, prefix))
        return {1: [(0.0, 1.0, " One two"), (1.0, 3.9, " Three four five six"), (3.9, 4.0, " ...")], 3: [], 4: [(0.0, 0.5, " Late")]}.get(len(asked), [(0.0, 1.0, " x")])

    rule = Overwriter(model, Chunker(4, 2), 1)
    out = [x for at in range(0, 12, 2) for x in rule.feed(at, [1.0, 1.0], at == 10)]
    assert asked[0] == (None, None)
    # words at 2 s and later are known; the last three may change, two stay at least
    assert asked[1] == (None, "five six") and out[1][2] == "five six"
    assert [s[2] for s in out[0][5]] == [" Three four five six"]
    # the segment of the second chunk ended at 3 s, before the third and fourth began
    assert asked[2] == asked[3] == (" x", None) and len(out) == len(asked) - 1


def test_every_occurrence_is_removed():
    assert _follow("a b c b", "b", " d") == "a c d" and _follow("a b", "x", " c") == "a b c" and _follow("", None, " c") == " c" and _follow("a", "", "b") == "ab"


def rows_of(words, hop, piece):
    samples = spelled(words, hop)
    return [(at, samples[at : at + piece], at + piece >= len(samples)) for at in range(0, len(samples), piece)]


def test_stream_and_batch(spark, tmp_path):
    messages = {"a": [f"W{i}" for i in range(40)], "b": [f"B{i}" for i in range(17)], "c": ["Alone"]}
    schema = "message_id string, frame_idx long, array array<double>, end_of_signal boolean"
    rows = [(m, *r) for m, words in messages.items() for r in rows_of(words, 8, 12)]
    df = spark.createDataFrame(rows, schema)
    load = lambda: spelled_model(8, 8)
    plain = lambda rows: sorted((r.message_id, r.response, r.frame_idx, r.remove, r.append, r.end, [s.text for s in r.segments], r.end_of_message) for r in rows)
    got = overwrite_batch(df, load, 8, 64, 24)
    texts = fold_responses(got.withColumn("more", response_text()), ["message_id"], ["response"], append="more")
    assert {r.message_id: r.text for r in texts.collect()} == {m: "".join(f" {w}" for w in words) for m, words in messages.items()}
    # a file a micro-batch, so state is kept between them
    for i in range(6):
        spark.createDataFrame([r for j, r in enumerate(sorted(rows, key=lambda r: r[1])) if j * 6 // len(rows) == i], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = overwrite_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), load, 8, 64, 24).writeStream.format("memory").queryName("overwrites").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert plain(spark.table("overwrites").collect()) == plain(got.collect())
    assert overwrite_batch(df.limit(0), load, 8, 64, 24).collect() == []


def test_fold_of_nulls_and_two_keys(spark):
    df = spark.createDataFrame([("a", None, 1, None, " x y"), ("a", None, 2, "y", " z"), ("a", 1, 1, None, None), (None, 1, 3, "q", "  b")], "m string, k long, i int, remove string, append string")
    assert {(r.m, r.k): r.text for r in fold_responses(df, ["m", "k"], ["i"]).collect()} == {("a", None): " x z", ("a", 1): "", (None, 1): " b"}
