"""Alignments and edit counts against plain tables, and long texts."""

import random
import time

import pytest

from vocalis.operators import alignment as A


def plain_align(ref, hyp):
    """Scores and ways of the whole table."""
    n, m = len(ref), len(hyp)
    score = {(i, 0): 0 for i in range(n + 1)} | {(0, j): -j for j in range(m + 1)}
    way = {(0, j): "i" for j in range(1, m + 1)}
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            options = [(score[i - 1, j - 1] + (2 if ref[i - 1] == hyp[j - 1] else -1), "d"), (score[i - 1, j] - 1, "r"), (score[i, j - 1] - 1, "i")]
            score[i, j], way[i, j] = max(options, key=lambda o: o[0])
    end = max(range(n + 1), key=lambda i: (score[i, m], i))
    i, j, out = end, m, []
    while j:
        w = way[i, j]
        k, q = i - (w != "i"), j - (w != "r")
        out.append((ref[k] if w != "i" else "*", hyp[q] if w != "r" else "*", k, q, i, j))
        i, j = k, q
    return score[end, m], [(ref[k], "*", k, 0, k + 1, 0) for k in range(i)] + out[::-1] + [(ref[k], "*", k, m, k + 1, m) for k in range(end, n)]


def plain_counts(ref, hyp):
    rows = [[(j, 0, 0, j, 0) for j in range(len(hyp) + 1)]]
    for i, r in enumerate(ref, 1):
        row = [(i, 0, 0, 0, i)]
        for j, h in enumerate(hyp, 1):
            (c, *d), (x, *y), (u, *v) = rows[-1][j - 1], row[j - 1], rows[-1][j]
            options = [(c, d[0] + 1, *d[1:]) if r == h else (c + 1, d[0], d[1] + 1, *d[2:]), (x + 1, *y[:2], y[2] + 1, y[3]), (u + 1, *v[:3], v[3] + 1)]
            row.append(min(options, key=lambda o: o[0]))
        rows = [row]
    return rows[-1][-1]


def pairs_of_texts():
    rng = random.Random(4)
    yield from [("", ""), ("a", ""), ("", "a"), ("a", "a"), ("a", "b"), ("ab", "ba"), ("aaaa", "aa"), ("aa", "aaaa")]
    for _ in range(400):
        letters = "ab" if rng.random() < 0.5 else "abcde "
        ref = [rng.choice(letters) for _ in range(rng.randrange(30))]
        hyp = [rng.choice(letters) for _ in range(rng.randrange(30))]
        if rng.random() < 0.5:
            hyp = [rng.choice(letters) if rng.random() < 0.2 else c for c in ref if rng.random() > 0.1]
        yield "".join(ref), "".join(hyp)


def test_alignments_equal_the_whole_table():
    for ref, hyp in pairs_of_texts():
        assert A.align(list(ref), list(hyp)) == plain_align(ref, hyp), (ref, hyp)


def test_edit_counts_equal_the_whole_table():
    for ref, hyp in pairs_of_texts():
        cost, *counts = plain_counts(ref, hyp)
        assert A.edit_distance(ref, hyp) == cost, (ref, hyp)
        assert A._edit_counts(list(ref), list(hyp)) == tuple(counts), (ref, hyp)


def test_long_texts():
    rng = random.Random(5)
    ref = [rng.choice("abcdefgh") for _ in range(100_000)]
    hyp = [c for k, c in enumerate(ref) if k % 500]
    began = time.time()
    assert A.edit_distance(ref, hyp) == 200
    assert A._edit_counts(ref, hyp) == (99_800, 0, 0, 200)
    score, out = A.align(ref[:6000], hyp[:5000])
    assert score == 2 * 5000 - 10 and sum(p[1] == "*" for p in out) == 1000
    assert time.time() - began < 120


def test_rates_of_odd_rows(spark):
    df = spark.createDataFrame([("k", "a b c", "a x c d"), ("k", "", "y"), ("k", None, None), (None, "ä 𝄞", "ä")], "k string, r string, h string")
    got = {r.k: r for r in A.error_rates(df, A.word_edits("r", "h"), ["k"]).collect()}
    assert (got["k"].errors, got["k"].ref_tokens, got["k"].rejected) == (2, 3, 2) and got["k"].ins_rate == pytest.approx(1 / 3)
    assert (got[None].errors, got[None].del_rate) == (1, 0.5)
    e = df.select("k", A.character_edits("r", "h").alias("e")).filter("k is null").collect()[0].e
    assert (e.hits, e.sub, e.ins, e["del"]) == (1, 0, 0, 2)
    cer = {r.k: r for r in A.cer(df, "r", "h", ["k"]).collect()}
    assert (cer["k"].errors, cer["k"].ref_chars) == (4, 5) and (cer[None].errors, cer[None].ref_chars) == (2, 3)
    assert A.cer(df.limit(0), "r", "h", ["k"]).collect() == []


def test_edit_symbols_of_texts_with_stars(spark):
    from vocalis.operators.alignment import align_characters, edit_symbols

    rows = [(0, "the cat", "the cat"), (1, "abcdef", "abxdf"), (2, "a*b", "a*b"), (3, "a*b", "axb"), (4, "axb", "a*b"), (5, "abc", ""), (6, None, "ab"), (7, "ab", "aTb")]
    df = spark.createDataFrame(rows, "i int, r string, h string").select("i", align_characters("r", "h").alias("a"))
    got = {r.i: r.e for r in df.select("i", edit_symbols(df["a.pairs"]).alias("e")).collect()}
    assert got == {0: "ccccccc", 1: "ccsc-c", 2: "ccc", 3: "csc", 4: "csc", 5: "---", 6: "++", 7: "c+c"}


def test_distances_by_bounds_equal_the_whole_table(monkeypatch):
    rng = random.Random(11)
    pairs = []
    for k in range(400):
        a = rng.choices(["ab", "abcdefgh"][k % 2], k=rng.randrange(1, 90))
        b = list(a) if k % 3 else rng.choices("abc", k=rng.randrange(1, 90))
        for _ in range(rng.randrange(12) * (k % 3)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choices("abz", k=rng.randrange(2))
        pairs.append((a, b[len(b) // 4 :] + b[: len(b) // 4] if k % 5 == 0 else b))

    def by_table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    want = [by_table(a, b) for a, b in pairs]
    for stretch, narrow, whole in ((1, 2, 0), (4, 6, 8), (16, 64, 20), (128, 192, 10_000)):
        monkeypatch.setattr(A, "STRETCH", stretch)
        monkeypatch.setattr(A, "NARROW", narrow)
        monkeypatch.setattr(A, "WHOLE", whole)
        assert [A.edit_distance(a, b) for a, b in pairs] == want


def test_pairs_alone_need_no_table(monkeypatch):
    ref = ["w", "the", "x"] * 20_000
    hyp = ["a" if w == "the" else w for w in ref]
    assert A._edit_counts(ref, ref[:-1]) == (59_999, 0, 0, 1)
    monkeypatch.setattr(A.np, "full", None)
    monkeypatch.setattr(A, "_bits", None)
    assert A._edit_counts(ref, hyp) == (40_000, 20_000, 0, 0)
