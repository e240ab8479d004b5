"""Diarization error, agreement and voice segments against plain versions."""

import collections
import itertools
import math
import random

import pytest

from vocalis.operators import diarization as D
from vocalis.operators import voice as V

TICK = 0.05


def speech(rng, speakers, n):
    out = []
    for _ in range(n):
        a = rng.randrange(0, 400)
        out.append((a * TICK, (a + rng.randrange(1, 60)) * TICK, rng.choice(speakers)))
    return out


def framewise(ref, sys, collar, ignore):
    lo, hi = min(s for s, _, _ in ref), max(e for _, e, _ in ref)
    frames = collections.Counter()
    step = TICK / 5
    shared = collections.Counter()
    for i in range(round(lo / step), round(hi / step)):
        t = (i + 0.5) * step
        if any(abs(t - b) < collar for s, e, _ in ref for b in (s, e)):
            continue
        r, y = ({x for s, e, x in side if s < t < e} for side in (ref, sys))
        if ignore and len(r) > 1:
            continue
        frames["scored"] += len(r)
        frames["miss"] += max(0, len(r) - len(y))
        frames["fa"] += max(0, len(y) - len(r))
        frames["both"] += min(len(r), len(y))
        for p in itertools.product(r, y):
            shared[p] += 1
    left, right = sorted({x for _, _, x in ref}), sorted({x for _, _, x in sys})
    best = 0
    for some in itertools.permutations([*right, *[None] * len(left)], len(left)):
        best = max(best, sum(shared[p] for p in zip(left, some, strict=True)))
    return frames["scored"] * step, frames["miss"] * step, frames["fa"] * step, (frames["both"] - best) * step


@pytest.mark.parametrize(("collar", "ignore"), [(0.0, False), (0.25, True), (0.25, False)])
def test_error_equals_frames(spark, collar, ignore):
    rng = random.Random(8)
    files = {f"f{i}": (speech(rng, "abc", 9), speech(rng, "xyzw"[: i + 1], 9)) for i in range(4)}
    files["silent"] = (speech(rng, "ab", 3), [])
    schema = "file string, start double, end double, speaker string"
    ref, sys = (spark.createDataFrame([(f, *s) for f, sides in files.items() for s in sides[k]] + ([("f0", 3.0, 3.0, "q")] if k else []), schema) for k in (0, 1))
    got = {r.file: r for r in D.diarization_report(ref, sys, collar=collar, ignore_overlap=ignore).collect()}
    totals = [0.0] * 4
    for f, sides in files.items():
        want = framewise(*sides, collar, ignore)
        totals = [a + b for a, b in zip(totals, want, strict=True)]
        r = got[f]
        assert math.isclose(r.scored, want[0], abs_tol=1e-6)
        for have, part in zip((r.miss, r.false_alarm, r.confusion), want[1:], strict=True):
            assert math.isclose(have, 100 * part / want[0], abs_tol=1e-5)
    assert math.isclose(got[None].der, 100 * sum(totals[1:]) / totals[0], abs_tol=1e-5)
    assert D.diarization_report(ref.limit(0), sys, collar=collar).collect()[0].der == 0


def test_best_mapping():
    rng = random.Random(1)
    for _ in range(200):
        left, right = rng.randrange(1, 5), rng.randrange(1, 5)
        s = {(f"l{i}", f"r{j}"): rng.randrange(9) for i in range(left) for j in range(right) if rng.random() < 0.7}
        if not s:
            continue
        found = D.best_mapping(s)
        assert len(set(found.values())) == len(found)
        best = max(sum(s.get((f"l{i}", f"r{j}"), 0) for i, j in enumerate(p) if j is not None) for p in itertools.permutations([*range(right), *[None] * left], left))
        assert sum(s[p] for p in found.items()) == best


def information(a, b):
    n = len(a)
    x, y, xy = collections.Counter(a), collections.Counter(b), collections.Counter(zip(a, b, strict=True))
    return sum(c / n * math.log(n * c / (x[i] * y[j])) for (i, j), c in xy.items())


def entropy(a):
    return -sum(c / len(a) * math.log(c / len(a)) for c in collections.Counter(a).values())


def test_adjusted_mutual_information(spark):
    rng = random.Random(3)
    for trial in range(4):
        a, b = [rng.choice("xyz") for _ in range(7)], [rng.choice("pq") for _ in range(7)]
        expected = sum(information(a, p) for p in itertools.permutations(b)) / math.factorial(7)
        sizes = lambda v: list(collections.Counter(collections.Counter(v).values()).items())
        assert math.isclose(D.expected_information(sizes(a), sizes(b), 7), expected, rel_tol=1e-9)
        want = (information(a, b) - expected) / ((entropy(a) + entropy(b)) / 2 - expected)
        got = D.adjusted_mutual_information(spark.createDataFrame(list(zip(a, b, strict=True)), "a string, b string"), "a", "b").first().ami
        assert math.isclose(got, want, abs_tol=1e-9), trial
    same = spark.createDataFrame([(i % 3, -(i % 3)) for i in range(30)], "a int, b int")
    assert math.isclose(D.adjusted_mutual_information(same, "a", "b").first().ami, 1.0)
    assert D.adjusted_mutual_information(same.limit(0), "a", "b").first().ami == 1.0


def plain_voice(scores, shift, onset, offset, pad_on, pad_off, least_on, least_off, first):
    out, start, on, i = [], 0, False, 0
    for i, p in enumerate(scores):
        if on and p < offset:
            out.append((max(0.0, start * shift - pad_on), i * shift + pad_off))
            on = False
        elif not on and p > onset:
            start, on = i, True
    if on:
        out.append((max(0.0, start * shift - pad_on), i * shift + pad_off))
    out = [s for s in out if s[1] > s[0]]

    def merge(segments, gap):
        done = []
        for s, e in sorted(segments):
            if done and (s <= done[-1][1] or s - done[-1][1] < gap):
                done[-1][1] = max(done[-1][1], e)
            else:
                done.append([s, e])
        return done

    out = merge(out, 0)
    long = lambda segments: [s for s in segments if s[1] - s[0] >= least_on]
    return merge(long(out), least_off) if first else long(merge(out, least_off))


@pytest.mark.parametrize("params", [(0.5, 0.3, 0.0, 0.0, 0.0, 0.0, True), (0.6, 0.5, 0.5, 0.25, 0.75, 0.5, True), (0.6, 0.5, 0.125, -0.125, 0.5, 1.0, False)])
def test_offline_voice(spark, params):
    rng = random.Random(5)
    signals = {k: [rng.random() for _ in range(rng.randrange(1, 90))] for k in range(30)}
    df = spark.createDataFrame([(k, i, p) for k, s in signals.items() for i, p in enumerate(s)], "k int, i int, p double")
    for how, covering in (("median", 4), ("mean", 3), ("median", 1)):
        smooth = {}
        for k, s in signals.items():
            windows = [sorted(s[max(0, i - covering + 1) : i + 1]) for i in range(len(s))]
            smooth[k] = [sum(w) / len(w) if how == "mean" else (w[(len(w) - 1) // 2] + w[len(w) // 2]) / 2 for w in windows]
        onset, offset, *rest = params
        got = collections.defaultdict(list)
        for r in V.offline_voice_segments(V.smoothed_scores(df, ["k"], "i", "p", covering, how), ["k"], "i", "smooth", 0.25, onset, offset, *rest).collect():
            got[r.k].append((r.start, r.end))
        for k, s in smooth.items():
            want = plain_voice(s, 0.25, *params)
            assert sorted(got[k]) == [(a, b) for a, b in want]
    with pytest.raises(ValueError, match="mean"):
        V.smoothed_scores(df, ["k"], "i", "p", 2, "mode")
