"""Chunks, model and gluing together, with a model that reads letters off the samples."""

import random

import numpy as np
import pytest

from vocalis.streaming.chunker import Chunker
from vocalis.streaming.segmenter import Gluer
from vocalis.streaming.transcriber import Transcriber, ctc_model, transcribe_batch, transcribe_stream

RATE, SAMPLES, HOP = 16000, 393990, 1600
TEXT = "".join(random.Random(4).choices("abcdefghijklmnopqrstuvwxyz '", k=SAMPLES // HOP + 1))


def reader(rate, hop, text):
    """A model: samples are their own positions, and each whole multiple of ``hop`` has a letter."""

    def model(samples):
        at = np.arange(len(samples))[samples.astype(int) % hop == 0]
        return "".join(text[int(samples[i]) // hop] for i in at), [i / rate for i in at.tolist()]

    return model


def assemble(parts):
    """A suffix takes the place of all letters from its first time on."""
    letters = []
    for text, times in parts:
        letters = [x for x in letters if x[0] < times[0]] + list(zip(times, text, strict=True))
    return "".join(c for _, c in letters)


@pytest.mark.parametrize(("step", "window", "most", "piece", "responses"), [(1.0, 2.0, None, 0.1, 25), (1.5, 3.0, None, 0.1, 17), (1.0, 4.0, None, 0.1, 25), (2.0, 4.0, None, 0.1, 13), (1.0, 4.0, 2.0, 2.0, 13), (4.0, 8.0, None, 0.1, 7), (1.0, 8.0, None, 0.1, 25)])
def test_responses(step, window, most, piece, responses):
    chunker = Chunker(int(window * RATE), int(step * RATE), RATE, int(most * RATE) if most else None)
    rule, n, out = Transcriber(reader(RATE, HOP, TEXT), chunker, Gluer(), RATE), int(piece * RATE), []
    for at in range(0, SAMPLES, n):
        out += rule.feed(at, [float(i) for i in range(at, min(at + n, SAMPLES))], False)
    out += rule.feed(SAMPLES, [], True)
    assert len(out) == responses and [x[3] for x in out] == [False] * (responses - 1) + [True]
    assert assemble((x[1], x[2]) for x in out) == TEXT


def test_stream_and_batch(spark, tmp_path):
    text = "the quick brown fox jumps over it"
    pieces = [(at, [float(i) for i in range(at, min(at + 35, 10 * len(text)))], False) for at in range(0, 10 * len(text), 35)]
    rows = [(m, *p) for m in "ab" for p in [*pieces, (10 * len(text), [], True)]]
    schema = "message_id string, frame_idx long, array array<double>, end_of_signal boolean"
    df = spark.createDataFrame(rows, schema)
    model = reader(10, 10, text)  # a closure travels by value, the module of a test can't be imported by workers
    load = lambda: model
    got = sorted((r.message_id, r.frame_idx, r.letters, r.times) for r in transcribe_batch(df, load, 10, 120, 40).collect())
    for m in "ab":
        assert assemble(x[2:] for x in got if x[0] == m) == text
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = transcribe_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), load, 10, 120, 40).writeStream.format("memory").queryName("transcripts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.message_id, r.frame_idx, r.letters, r.times) for r in spark.table("transcripts").collect()) == got
    assert transcribe_batch(df.limit(0), load, 10, 120, 40).collect() == []


def test_ctc_model():
    scores = np.eye(4)[[0, 1, 1, 0, 1, 2, 3, 3, 0, 0]]
    letters, times = ctc_model(lambda samples: scores, ["<pad>", "a", "|", "b"], 10)(np.zeros(100))
    assert (letters, times) == ("aa b", [1.0, 4.0, 5.0, 6.0])
    assert ctc_model(lambda samples: np.zeros((0, 4)), ["<pad>", "a", "|", "b"], 10)(np.zeros(0)) == ("", [])
