"""Voice segments of streams, decoding, resampling and perturbing, against plain versions."""

import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocalis.operators import perturb as P
from vocalis.sources import audio as A
from vocalis.streaming.voice import Frames, Segmenter, VoiceRule, voice_batch, voice_stream

#: Scores of the 30 frames of a listed recording of 47640 samples.
SCORES = [0.124, 0.035, 0.644, 0.324, 0.455, 0.111, 0.648, 0.662, 0.954, 0.985, 0.963, 0.681, 0.293, 0.635, 0.99, 0.975, 1.0, 0.987, 0.978, 0.941, 1.0, 1.0, 1.0, 0.999, 0.999, 0.987, 0.989, 0.998, 0.999, 0.996]


def spoken(threshold, piece=160):
    scores = iter(SCORES)
    s = Segmenter(lambda x: next(scores), 1600, 4, threshold, 2, False)
    pieces = [[0.0] * min(piece, 47640 - i) for i in range(0, 47640, piece)]
    return [x for p in pieces for x in s.feed(p, False)] + s.feed(None, True)


@pytest.mark.parametrize("threshold,voice,segments", [(0.5, 46040, 2), (0.8, 36440, 3)])
def test_listed_segments(threshold, voice, segments):
    found = spoken(threshold)
    assert len(found) == segments and sum(e - b for _, b, e, _ in found) == voice
    assert found == spoken(threshold, 1600) == spoken(threshold, 1)


def by_lists(voiced, size, tail, patience):
    """Segments as lists of the samples themselves."""
    buffer, memory, left, out = [], [], patience, []
    half = patience // 2
    for k, v in enumerate(voiced):
        frame = list(range(k * size, k * size + (tail if k == len(voiced) - 1 else size)))
        if v or left > 0:
            buffer.append(frame)
        elif buffer:
            out.append(memory[len(memory) - half :] + buffer[: len(buffer) - half])
            buffer, memory = [], [frame]
        else:
            memory = (memory + [frame])[-max(1, half) :]
        left = patience if v else left - 1
    if buffer:
        out.append((memory[max(0, len(memory) - half) :] if half else []) + buffer)
    flat = [[i for f in s for i in f] for s in out]
    assert all(s == list(range(s[0], s[-1] + 1)) for s in flat)
    return [(s[0], s[-1] + 1, True) for s in flat]


@pytest.mark.parametrize("patience", [1, 2, 3])
def test_rule_equals_lists(patience):
    rng = np.random.default_rng(patience)
    for _ in range(200):
        voiced, tail = list(rng.random(rng.integers(1, 40)) < 0.4), int(rng.integers(1, 6))
        rule = VoiceRule(5, patience)
        found = [rule.feed(5 * k, tail if k == len(voiced) - 1 else 5, v) for k, v in enumerate(voiced)] + [rule.finish(5 * (len(voiced) - 1) + tail)]
        assert [x for x in found if x and x[2]] == by_lists(voiced, 5, tail, patience)


def test_frames():
    f = Frames(4)
    out = [f.feed(np.arange(a, b)) for a, b in ((0, 3), (3, 7), (7, 7), (7, 9), (9, 10))]
    assert [None if x is None else x.tolist() for x in out] == [None, [0, 1, 2, 3], None, [4, 5, 6, 7], None]
    assert f.flush().tolist() == [8, 9] and f.flush() is None
    with pytest.raises(ValueError):
        f.feed(np.zeros(5))


def test_stream_equals_batch(spark, tmp_path):
    energy = lambda: lambda x: float(np.abs(x).mean())  # noqa: E731  local, so it goes to the workers by value
    rng = np.random.default_rng(3)
    rows = []
    for m in range(4):
        x = np.repeat(rng.random(30) < 0.5, 10).astype(float)[: 300 - m]
        rows += [(f"m{m}", i, x[i : i + 7].tolist(), False) for i in range(0, len(x), 7)] + [(f"m{m}", 1000, None, True)]
    schema = "message_id string, frame_idx long, array array<double>, end_of_signal boolean"
    df = spark.createDataFrame(rows, schema)
    want = sorted(map(tuple, voice_batch(df, energy, 8, 2, 0.4, 2, True).collect()))
    assert sum(r[4] for r in want) > 8 and any(not r[4] for r in want)
    for k in range(3):
        df.filter(f"frame_idx >= {k * 100} and (frame_idx < {k * 100 + 100} or {k} = 2)").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = voice_stream(stream, energy, 8, 2, 0.4, 2, True).writeStream.format("memory").queryName("voices").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("voices").collect())) == want


def wav(samples, rate, width, channels=1):
    """Samples of -1 to 1 by frame and channel."""
    x = np.asarray(samples, float).reshape(-1, channels)
    ints = np.round(x * (2 ** (8 * width - 1) - 1)).astype(np.int64)
    data = (ints + 128).astype(np.uint8).tobytes() if width == 1 else ints.astype("<i8").reshape(-1, 1).view(np.uint8)[:, :width].tobytes()
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(data)
    return out.getvalue()


def test_decoding(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (1000, 2))
    rows = [(f"w{b}", wav(x, 100, b, 2), "wav", None, None) for b in (1, 2, 3, 4)]
    rows += [("part", wav(x, 100, 2, 2), "wav", 2.505, 1.5), ("beyond", wav(x, 100, 2, 2), "wav", 99.0, None), ("long", wav(x, 100, 2, 2), "wav", 9.0, 50.0)]
    rows += [("broken", b"RIFF", "wav", None, None), ("other", b"fLaC", "flac", None, None), ("null", None, "wav", None, None)]
    df = spark.createDataFrame(rows, "id string, c binary, f string, o double, d double")
    got = {r.id: r.s for r in df.select("id", A.decoded(F.col("c"), F.col("f"), F.col("o"), F.col("d")).alias("s")).collect()}
    for b in (1, 2, 3, 4):
        s = got[f"w{b}"]
        assert (s.rate, s.channels, s.frames, s.error) == (100, 2, 1000, None)
        assert np.abs(np.array(s.samples) - x.mean(axis=1)).max() < 2.0 ** (3 - 8 * min(b, 3))
    assert np.allclose(got["part"].samples, x[250:400].mean(axis=1), atol=1e-4) and got["part"].frames == 1000
    assert got["beyond"].samples == [] and len(got["long"].samples) == 100 and got["null"] is None
    assert got["broken"].samples is None and "EOFError" in got["broken"].error and "no decoder for flac" in got["other"].error
    flac = {"flac": lambda c, part: (part(10)[0] or 10, 3, np.ones((3, 1)))}
    first = df.filter("id in ('w2', 'other')").select("id", A.decoded(F.col("c"), F.col("f"), F.lit(10), F.lit(5), "frames", "first", decoders=flac).alias("s"))
    got = {r.id: r.s for r in first.collect()}
    assert np.allclose(got["w2"].samples, x[10:15, 0], atol=1e-4) and got["other"].samples == [1, 1, 1]
    info = {r.id: r.i for r in df.select("id", A.audio_info(F.col("c")).alias("i")).collect()}
    assert tuple(info["w3"]) == (100, 2, 24, 1000, 10.0, None) and info["null"] is None and info["broken"].error
    with pytest.raises(ValueError):
        A.decoded(F.col("c"), F.col("f"), unit="hours")


def tone(hertz, rate, seconds=1.0):
    return np.sin(2 * np.pi * hertz * np.arange(int(rate * seconds)) / rate)


@pytest.mark.parametrize("source,target", [(44100, 16000), (48000, 16000), (8000, 16000), (16000, 8000), (22050, 16000)])
def test_tones(source, target):
    low = min(source, target) / 2
    for share in (0.05, 0.3, 0.6, 0.9):
        y, want = A.resample(tone(share * low, source), source, target), tone(share * low, target)
        assert len(y) == len(want) and np.abs(y - want)[1000:-1000].max() < 1e-3
    if target < source:
        y = A.resample(tone(min(1.1 * low, source / 2 - 1), source), source, target)
        assert np.abs(y[1000:-1000]).max() < 1e-3


def test_resampled_rows(spark, monkeypatch):
    x = np.random.default_rng(1).standard_normal(5000)
    whole = A.resample(x, 441, 160)
    monkeypatch.setattr(A, "BLOCK", 7)
    assert np.array_equal(A.resample(x, 441, 160), whole) and np.allclose(A.resample(np.ones(4000), 441, 160)[200:-200], 1)
    df = spark.createDataFrame([(1, [1.0, 2.0], 2), (2, [], 2), (3, None, 2), (4, [1.0], None), (5, [1.0, 2.0, 3.0], 3)], "i int, x array<double>, r int")
    got = {r.i: r.y for r in df.select("i", A.resampled(F.col("x"), F.col("r"), 3).alias("y")).collect()}
    assert len(got[1]) == 3 and got[2] == [] and got[3] is None and got[4] is None and got[5] == [1.0, 2.0, 3.0]
    with pytest.raises(ValueError):
        A.resample(x, 0, 3)


def test_trimming(spark):
    x = np.concatenate([np.zeros(5000), tone(400, 16000, 0.5), np.full(6000, 1e-6)])
    kept = A.trim(x)
    assert 8000 <= len(kept) <= 8000 + 2 * 2048 and np.isin(tone(400, 16000, 0.5), kept).all()
    assert len(A.trim(np.zeros(3000))) == 0 and len(A.trim(np.zeros(0))) == 0 and len(A.trim(np.ones(5))) == 5
    df = spark.createDataFrame([(1, [0.0] * 3), (2, None), (3, [])], "i int, x array<double>")
    assert {r.i: r.y for r in df.select("i", A.trimmed(F.col("x")).alias("y")).collect()} == {1: [], 2: None, 3: []}


def fails(x, rate, rng):
    raise ValueError("never")


def often(x, rate, rng):
    if rng.random() < 0.5:
        raise ValueError("at times")
    return x + 1


STEPS = [(0.3, P.Gain()), (0.6, P.RandomBand()), (1.0, P.DynamicNoise())]


def test_rows_decide_not_partitions(spark):
    df = spark.range(3000).select("id", F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: F.sin(k * (F.col("id") % 7 + 1) / 9)).alias("x"))
    p = lambda d: {r.id: r.p for r in d.select("id", P.perturbed(F.col("x"), F.lit(16000), F.col("id"), STEPS, 5).alias("p")).collect()}
    a, b = p(df.repartition(3)), p(df.orderBy(F.desc("id")).coalesce(1))
    assert a == b
    for name, share in (("Gain", 0.3), ("RandomBand", 0.6), ("DynamicNoise", 1.0)):
        n = sum(name in r.applied for r in a.values())
        assert abs(n - 3000 * share) <= 3 * (3000 * share * (1 - share)) ** 0.5
    u = {r.id: r.u for r in df.repartition(5).select("id", P.row_uniform(3, F.col("id")).alias("u")).collect()}
    assert u == {r.id: r.u for r in df.select("id", P.row_uniform(3, F.col("id")).alias("u")).collect()}
    assert abs(np.mean(list(u.values())) - 0.5) < 3 * (1 / 12 / 3000) ** 0.5 and 0 <= min(u.values()) and max(u.values()) < 1


def test_laws(spark):
    u = F.col("u")
    got = spark.createDataFrame([(k / 100,) for k in range(100)], "u double").select(P.uniform(u, -1, 3).alias("a"), P.log_uniform(u, 2, 200).alias("b"), P.triangular(u, 0.8, 1.0, 1.2).alias("c"), P.triangular(u, -10, 0, 30).alias("d")).collect()
    for k, r in enumerate(got):
        share = k / 100
        assert np.isclose(r.a, -1 + 4 * share) and np.isclose(np.log(r.b / 2) / np.log(100), share)
        for x, (lo, mode, hi) in ((r.c, (0.8, 1.0, 1.2)), (r.d, (-10, 0, 30))):
            below = (x - lo) ** 2 / ((hi - lo) * (mode - lo)) if x <= mode else 1 - (hi - x) ** 2 / ((hi - lo) * (hi - mode))
            assert np.isclose(below, share)


def test_retries(spark):
    x = np.ones(10)
    y, applied, tries, error = P.perturb(x, 8000, [(1.0, P.Gain()), (1.0, fails)], (1, "a"), 3)
    assert np.array_equal(y, x) and (applied, tries) == ([], 3) and "never" in error
    done = [P.perturb(x, 8000, [(1.0, often)], (1, k), 3) for k in range(2000)]
    for n, share in ((1, 0.5), (2, 0.25)):
        assert abs(sum(d[2] == n and d[1] == ["often"] for d in done) - 2000 * share) < 3 * (2000 * share * (1 - share)) ** 0.5
    assert all(np.array_equal(d[0], x + 1 if d[1] else x) for d in done)
    df = spark.createDataFrame([("a", [1.0], 8000), (None, [1.0], 8000), ("b", None, 8000), ("c", [1.0], None), ("d", [], 8000)], "k string, x array<double>, r int")
    got = {r.k: r.p for r in df.select("k", P.perturbed(F.col("x"), F.col("r"), F.col("k"), [(1.0, P.Gain())]).alias("p")).collect()}
    assert got["a"].applied == got[None].applied == ["Gain"] and got["b"] is None and got["c"] is None and (got["d"].samples, got["d"].applied) == ([], [])


def test_what_perturbations_do():
    rate, x = 16000, tone(500, 16000) * 0.5
    rng = lambda k: P.generator(9, k)
    assert all(np.abs(P.Gain()(x, rate, rng(k))).max() <= 1 for k in range(20))
    for k in range(20):
        noise = P.DynamicNoise(20)(x, rate, rng(k)) - x
        assert 0 < np.abs(noise).max() <= np.abs(x).max() * 0.1 + 1e-9
        low, high = P.RandomBand().cuts(rate, rng(k))
        assert 0 <= low <= high - 100 and high <= 8000
    factor = [len(x) / len(P.Speed()(x, rate, rng(k))) for k in range(50)]
    assert 0.79 < min(factor) < 0.95 and 1.05 < max(factor) < 1.21
    y = P.ALaw()(x, rate, rng(0))
    assert len(y) == len(x) and 1e-5 < np.sqrt(np.mean((y - x)[500:-500] ** 2)) < 0.02
    assert np.abs(P.ALaw()(tone(6000, rate), rate, rng(0)))[500:-500].max() < 1e-2
    assert np.abs(P.VaryingGain()(x, rate, rng(1))).max() <= np.abs(x).max()
    assert np.array_equal(P.Gain()(np.zeros(5), rate, rng(0)), np.zeros(5))
