"""String alignment and error rates. Dynamic programs run in Arrow functions, the rest is built in."""

from __future__ import annotations

import difflib
import math
from collections import Counter
from collections.abc import Sequence
from operator import ne

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from vocalis.functions.udf import arrow_function

# Scores of the local alignment.
MATCH, MISMATCH, GAP = 2, -1, -1
ALIGNMENT = "struct<score:int,pairs:array<struct<ref:string,hyp:string,refi_from:int,hypi_from:int,refi_to:int,hypi_to:int>>>"


def align(ref: list[str], hyp: list[str], eps: str = "*") -> tuple[int, list[tuple]]:
    """Place the whole hypothesis in the reference; what the reference has before and behind counts as deletions.

    Of equal scores a pair of tokens is preferred to a deletion, a deletion to an insertion, and the
    last place of the reference where the best score ends.

    Score rows are vectors; one in about sqrt(n) is kept, and rows between two of them are made again on the way
    back: memory grows with m * sqrt(n), time with n * m.
    """
    n, m = len(ref), len(hyp)
    if not m:
        return 0, [(r, eps, i, 0, i + 1, 0) for i, r in enumerate(ref)]
    ids = {t: k for k, t in enumerate(dict.fromkeys(hyp))}
    wanted, places = np.array([ids[t] for t in hyp]), np.arange(m + 1, dtype=np.int32)
    pairs = {k: np.where(wanted == k, MATCH, MISMATCH).astype(np.int32) for k in {ids.get(t, -1) for t in ref}}

    def below(row: np.ndarray, token: str) -> np.ndarray:
        best = row + np.int32(GAP)
        np.maximum(best[1:], row[:-1] + pairs[ids.get(token, -1)], out=best[1:])
        best[0] = 0
        # an insertion costs the same everywhere, so the best one before a place is a running maximum
        return np.maximum.accumulate(best - GAP * places) + GAP * places

    every = math.isqrt(n) + 1
    row, kept, last = GAP * places, [GAP * places], [GAP * m]
    for i, token in enumerate(ref, 1):
        row = below(row, token)
        last.append(int(row[m]))
        if i % every == 0:
            kept.append(row)
    end = max(range(n + 1), key=lambda i: (last[i], i))
    i, j, out, first, block = end, m, [], n + 1, []
    while j:
        if i and i - 1 < first:
            first = (i - 1) // every * every
            block = [kept[first // every]]
            for token in ref[first:i]:
                block.append(below(block[-1], token))
        here = block[i - first][j] if i else None
        if i and here == block[i - 1 - first][j - 1] + (MATCH if ref[i - 1] == hyp[j - 1] else MISMATCH):
            out.append((ref[i - 1], hyp[j - 1], i - 1, j - 1, i, j))
            i, j = i - 1, j - 1
        elif i and here == block[i - 1 - first][j] + GAP:
            out.append((ref[i - 1], eps, i - 1, j, i, j))
            i -= 1
        else:
            out.append((eps, hyp[j - 1], i, j - 1, i, j))
            j -= 1
    before = [(ref[k], eps, k, 0, k + 1, 0) for k in range(i)]
    after = [(ref[k], eps, k, m, k + 1, m) for k in range(end, n)]
    return last[end], [*before, *out[::-1], *after]


@arrow_function(ALIGNMENT)
def align_characters(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    names = ("ref", "hyp", "refi_from", "hypi_from", "refi_to", "hypi_to")
    found = [align(list(r or ""), list(h or "")) for r, h in zip(ref, hyp, strict=True)]
    return pd.DataFrame({"score": [s for s, _ in found], "pairs": [[dict(zip(names, p, strict=True)) for p in ps] for _, ps in found]})


def edit_kind(pair: Column, eps: str = "*") -> Column:
    return F.when(pair["ref"] == eps, "ins").when(pair["hyp"] == eps, "del").when(pair["ref"] == pair["hyp"], "cor").otherwise("sub")


def edit_sign(pair: Column, eps: str = "*") -> Column:
    kind = edit_kind(pair, eps)
    return F.when(kind == "cor", "c").when(kind == "sub", "s").when(kind == "ins", "+").otherwise("-")


def edit_symbols(pairs: Column) -> Column:
    """One sign for each pair: c, s, + and -, by the places, since a text may hold the sign for nothing itself."""

    def sign(p: Column) -> Column:
        return F.when(p["refi_from"] == p["refi_to"], "+").when(p["hypi_from"] == p["hypi_to"], "-").when(p["ref"] == p["hyp"], "c").otherwise("s")

    # a function of one argument: a second one would be given the index
    return F.array_join(F.transform(pairs, lambda p: sign(p)), "")


def aligned_ngrams(pairs: Column, order: int) -> Column:
    """Runs of aligned pairs up to ``order``, as (ref, hyp) texts."""
    runs = [F.transform(F.filter(F.transform(pairs, lambda p, i: i), lambda i, n=n: i + n <= F.size(pairs)), lambda i, n=n: F.struct(F.array_join(F.transform(F.slice(pairs, i + 1, n), lambda p: p["ref"]), "").alias("ref"), F.array_join(F.transform(F.slice(pairs, i + 1, n), lambda p: p["hyp"]), "").alias("hyp"))) for n in range(1, order + 1)]
    return F.flatten(F.array(*runs))


@arrow_function("array<struct<ref:string,hyp:string>>")
def error_words(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """Words of the reference that the hypothesis has otherwise, by character alignment."""
    out = []
    for r, h in zip(ref, hyp, strict=True):
        _, pairs = align(list(r or ""), list(h or ""))
        words, mine, other = [], "", ""
        for p in [*pairs, (" ", " ")]:
            if p[0] == " ":
                if mine and mine != other.strip():
                    words.append({"ref": mine, "hyp": other.strip()})
                mine, other = "", ""
            else:
                mine += "" if p[0] == "*" else p[0]
                other += "" if p[1] == "*" else p[1]
        out.append(words)
    return pd.Series(out)


@arrow_function("array<struct<ref:string,hyp:string>>")
def align_lines(ref: pd.Series, hyp: pd.Series, n: pd.Series) -> pd.Series:
    """An aligned pair of texts in lines, cut at the first space of both after ``n`` characters."""
    out = []
    for r, h, k in zip(ref, hyp, n, strict=True):
        _, pairs = align(list(r or ""), list(h or ""))
        lines, a, b = [], "", ""
        for p in pairs:
            a, b = a + p[0], b + p[1]
            if len(a) > k and p[0] == " ":
                lines.append({"ref": a, "hyp": b})
                a, b = "", ""
        if a:
            lines.append({"ref": a, "hyp": b})
        out.append(lines)
    return pd.Series(out)


def padded_lines(pairs: Column, eps: str = "*") -> Column:
    """Three lines of an alignment that stand below each other: reference, kinds of edits, hypothesis.

    Both tokens of a pair are filled with ``eps`` to the longer one's length; the sign of the edit stands once for each letter of the hypothesis (of the
    reference in a deletion).
    """
    bare = lambda c: F.when(c == eps, "").otherwise(c)

    def column(p: Column) -> Column:
        ref, hyp = bare(p["ref"]), bare(p["hyp"])
        width = F.greatest(F.length(ref), F.length(hyp))
        signs = F.repeat(edit_sign(p, eps), F.when(hyp == "", F.length(ref)).otherwise(F.length(hyp)))
        return F.struct(F.rpad(ref, width, F.lit(eps)).alias("ref"), F.rpad(signs, width, F.lit(" ")).alias("edits"), F.rpad(hyp, width, F.lit(eps)).alias("hyp"))

    three = F.transform(pairs, column)
    line = lambda name: F.array_join(F.transform(three, lambda x: x[name]), "").alias(name)
    return F.struct(line("ref"), line("edits"), line("hyp"))


@arrow_function("array<struct<ref:string,hyp:string>>")
def align_groups(ref: pd.Series, hyp: pd.Series, n: pd.Series) -> pd.Series:
    """An aligned pair of texts, with gaps, in lines of fewer than ``n`` characters each."""
    out = []
    for r, h, k in zip(ref, hyp, n, strict=True):
        _, pairs = align(list(r or ""), list(h or ""))
        step = max(1, int(k) - 1)
        parts = [pairs[i : i + step] for i in range(0, len(pairs), step)]
        out.append([{"ref": "".join(p[0] for p in part), "hyp": "".join(p[1] for p in part)} for part in parts])
    return pd.Series(out)


@arrow_function("array<struct<a:int,b:int,size:int>>")
def matching_blocks(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b, strict=True):
        out.append([{"a": m.a, "b": m.b, "size": m.size} for m in difflib.SequenceMatcher(a=x or "", b=y or "", autojunk=False).get_matching_blocks()])
    return pd.Series(out)


#: Columns between two choices of the rows that are looked at, rows of a first, narrow band, and most rows for which choosing is not worth while.
STRETCH, NARROW, WHOLE = 128, 192, 16384


def edit_distance(ref: Sequence, hyp: Sequence) -> int:
    """Fewest substitutions, insertions and deletions. Memory grows with the longer side alone.

    What the sides have in common at their ends goes first. Of sides of one length the unlike places are enough if no edit can do with
    fewer, for it has to change as many tokens as one side has more of than the other. Else a narrow band gives a bound, and within
    this bound the table is filled.
    """
    n, m = len(ref), len(hyp)
    low = 0
    while low < min(n, m) and ref[low] == hyp[low]:
        low += 1
    while min(n, m) > low and ref[n - 1] == hyp[m - 1]:
        n, m = n - 1, m - 1
    ref, hyp = ref[low:n], hyp[low:m]
    n, m = len(ref), len(hyp)
    if not n or not m:
        return n + m
    if n == m:
        unlike, more = sum(map(ne, ref, hyp)), Counter(ref)
        more.subtract(hyp)
        if unlike == sum(x for x in more.values() if x > 0):
            return unlike
    places: dict = {}
    for i, t in enumerate(ref):
        places.setdefault(t, []).append(i)
    equal = {t: _bits(at, n) for t, at in places.items()}
    most = n + m if n <= WHOLE else _within(equal, n, hyp, None)
    return _within(equal, n, hyp, most)


def _within(equal: dict, n: int, hyp: Sequence, most: int | None) -> int:
    """The edit distance if it is at most ``most``; without that a bound for it, from a narrow band.

    A column of the table is two bit vectors of the steps from row to row. Every ``STRETCH`` columns rows are left out through which no edit
    of at most ``most`` can pass, given what it costs up to there and how far it is from the corner; what is left out
    counts as one more than its neighbour, which is never too little.
    """
    m = len(hyp)
    top, bottom, first = 0, min(n, NARROW if most is None else n), 0
    # bit k is the step from row top + k - 1 to row top + k; bit 0 stands for the row at the top, which rises by one in each column
    up, down = (1 << (bottom + 1)) - 2, 0
    whole = most == n + m
    here = {t: x << 1 for t, x in equal.items()} if whole else {}
    for j in range(0, m, STRETCH):
        part = hyp[j : j + STRETCH]
        if most is None:
            centre = (j + STRETCH // 2) * n // m
            low = max(top, min(centre - NARROW // 2, bottom))
            high = n if j + STRETCH >= m else max(bottom, min(n, centre + NARROW // 2))
        elif whole:
            low, high = 0, n
        elif j:
            steps = _marks(up, bottom - top + 1).astype(np.int32) - _marks(down, bottom - top + 1)
            rows = np.arange(top, bottom + 1)
            off = (n - m + j) - rows
            spare = most - (first + np.cumsum(steps) + np.abs(off))
            kept = spare >= 0
            rows, off, spare = rows[kept], off[kept], spare[kept]
            # an edit goes down to the corner's diagonal for nothing more, beyond it for two a row
            low, high = int(rows[0]), min(n, int((rows + np.maximum(off, 0) + spare // 2).max()) + len(part))
        else:
            low, high = 0, min(n, max(0, n - m) + most // 2 + len(part))
        if low > top:
            cut = (1 << (low - top + 1)) - 2
            first += (up & cut).bit_count() - (down & cut).bit_count()
        size = min(bottom, high) - low
        keep = (1 << (size + 1)) - 2
        up, down = up >> (low - top) & keep, down >> (low - top) & keep
        if high > bottom:
            up |= (1 << (high - low + 1)) - (1 << (size + 1))
        top, bottom = low, high
        all_rows, rows_below = (1 << (bottom - top + 1)) - 1, (1 << (bottom - top + 1)) - 2
        if not whole:
            here = {t: (equal[t] >> top << 1) & rows_below for t in set(part) if t in equal}
        for t in part:
            e = here.get(t, 0)
            # bits above the last row are never seen by those below
            flat = ((e & up) + up ^ up) | e
            right = (down | all_rows ^ (flat | up)) << 1
            e |= down
            down, up = e & right, (up & flat) << 1 | rows_below ^ (e | right)
        up, down = up & rows_below, down & rows_below
        first += len(part)
    if bottom < n:
        return n + m
    return first + up.bit_count() - down.bit_count()


def _marks(bits: int, size: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits.to_bytes((size + 7) // 8, "little"), np.uint8), count=size, bitorder="little")


def _bits(at: list[int], size: int) -> int:
    marks = np.zeros(size, bool)
    marks[at] = True
    return int.from_bytes(np.packbits(marks, bitorder="little").tobytes(), "little")


def _edit_counts(ref: list[str], hyp: list[str]) -> tuple[int, int, int, int]:
    """Hits, substitutions, insertions and deletions of a shortest edit; a pair is preferred where it costs no more, then an insertion.

    What the sides have in common at their ends are hits. If sides of one length have as many unlike places as the edit costs, it is
    pairs alone. Else a shortest edit leaves the diagonal by at most its cost, so only that band is filled, in vectors along the
    other diagonal. Deletions follow from insertions and the sizes.
    """
    whole, low, high = len(ref), 0, 0
    while low < min(len(ref), len(hyp)) and ref[low] == hyp[low]:
        low += 1
    while high < min(len(ref), len(hyp)) - low and ref[-1 - high] == hyp[-1 - high]:
        high += 1
    ref, hyp = ref[low : len(ref) - high], hyp[low : len(hyp) - high]
    n, m, band = len(ref), len(hyp), edit_distance(ref, hyp)
    if n == m and sum(map(ne, ref, hyp)) == band:
        return whole - band, band, 0, 0
    ids = {t: k for k, t in enumerate(dict.fromkeys([*ref, *hyp]))}
    a, b = np.array([ids[t] for t in ref], np.int64), np.array([ids[t] for t in hyp], np.int64)[::-1]
    far = n + m + 1
    # places are shifted by one, so that the first has a neighbour
    costs, inserted = [np.full(n + 3, far) for _ in range(3)], [np.zeros(n + 3, np.int64) for _ in range(3)]
    costs[0][1] = 0
    for s in range(1, n + m + 1):
        low, high = max(0, s - m, (s - band + 1) // 2), min(n, s, (s + band) // 2)
        (now, one, two), (ins, ins1, ins2) = ([x[(s - k) % 3] for k in range(3)] for x in (costs, inserted))
        here, above = slice(low + 1, high + 2), slice(low, high + 1)
        left, over, cost, count = one[here] + 1, one[above] + 1, np.full(high - low + 1, far), ins2[above].copy()
        begin, stop = max(low, 1), min(high, s - 1)
        if begin <= stop:
            unlike = a[begin - 1 : stop] != b[m - s + begin : m - s + stop + 1]
            cost[begin - low : stop - low + 1] = two[begin : stop + 1] + unlike
        for other, counts in ((left, ins1[here] + 1), (over, ins1[above])):
            better = other < cost
            cost, count = np.where(better, other, cost), np.where(better, counts, count)
        now[here], ins[here] = cost, count
        now[low] = now[high + 2] = far
    i = int(inserted[(n + m) % 3][n + 1])
    d = i + n - m
    sub = band - i - d
    return whole - sub - d, sub, i, d


@arrow_function("int")
def whole_distance(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """Edit distance of whole texts, of any length; null where a side is null."""
    return pd.Series([None if r is None or h is None else edit_distance(r, h) for r, h in zip(ref, hyp, strict=True)], dtype="Int64")


@arrow_function("struct<hits:int,sub:int,ins:int,del:int>")
def word_edits(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_edit_counts((r or "").split(), (h or "").split()) for r, h in zip(ref, hyp, strict=True)], columns=["hits", "sub", "ins", "del"])


@arrow_function("struct<hits:int,sub:int,ins:int,del:int>")
def character_edits(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_edit_counts(list(r or ""), list(h or "")) for r, h in zip(ref, hyp, strict=True)], columns=["hits", "sub", "ins", "del"])


def error_rates(df: DataFrame, edits: Column, keys: list[str]) -> DataFrame:
    """Corpus error rates over reference tokens; rows without reference tokens count as rejected."""
    e = df.select(*keys, edits.alias("e")).select(*keys, "e.*").withColumn("n", F.col("hits") + F.col("sub") + F.col("del"))
    ok = F.col("n") > 0

    def total(c: str) -> Column:
        return F.sum(F.when(ok, F.col(c)).otherwise(0))

    return e.groupBy(*keys).agg((total("sub") + total("ins") + total("del")).alias("errors"), total("n").alias("ref_tokens"), ((total("sub") + total("ins") + total("del")) / total("n")).alias("rate"), (total("ins") / total("n")).alias("ins_rate"), (total("del") / total("n")).alias("del_rate"), (total("sub") / total("n")).alias("sub_rate"), F.sum((~ok).cast("int")).alias("rejected"))


def cer(df: DataFrame, ref: str, hyp: str, keys: list[str]) -> DataFrame:
    """Character error rate of whole texts."""
    e = df.select(*keys, F.length(ref).alias("n"), whole_distance(F.col(ref), F.col(hyp)).alias("e"))
    return e.groupBy(*keys).agg(F.sum("e").alias("errors"), F.sum("n").alias("ref_chars"), (F.sum("e") / F.sum("n")).alias("cer"))
