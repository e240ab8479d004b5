"""Signals in arrays: cutting, scaling, arg max, interpolation. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def peak(a: Column) -> Column:
    return F.array_max(F.transform(a, lambda x: F.abs(x)))


def fixed_chunks(a: Column, size: int) -> Column:
    """Pieces of ``size`` samples; the last may be short."""
    starts = F.sequence(F.lit(0), F.size(a) - 1, F.lit(size))
    return F.when(F.size(a) > 0, F.transform(starts, lambda i: F.slice(a, i + 1, size))).otherwise(F.array())


def to_int16(a: Column) -> Column:
    """Scaled to the peak and cut to whole numbers; silence stays silence."""
    m = peak(a)
    return F.when(m > 0, F.transform(a, lambda x: (x / m * 32767).cast("smallint"))).otherwise(F.transform(a, lambda x: F.lit(0).cast("smallint")))


def from_int16(a: Column, bits: int = 16) -> Column:
    return F.transform(a, lambda x: x / float(1 << (bits - 1)))


def attenuate(a: Column, most: float = 0.8) -> Column:
    """Scaled down to a peak of ``most`` where it is louder."""
    m = peak(a)
    return F.when(m > most, F.transform(a, lambda x: x / m * most)).otherwise(a)


def time_slice(a: Column, start: Column, end: Column, rate: int) -> Column:
    """Samples from start to end in seconds; the last sample of the signal is never part."""
    low = F.greatest(F.lit(0), F.bround(start * rate).cast("int"))
    high = F.least(F.size(a) - 1, F.bround(end * rate).cast("int"))
    return F.slice(a, low + 1, F.greatest(high - low, F.lit(0)))


def keep_voiced(a: Column, spans: Column, rate: int) -> Column:
    """Samples inside spans, one after the other; all where there is no span."""
    return F.when(F.size(spans) > 0, F.flatten(F.transform(spans, lambda s: time_slice(a, s["start"], s["end"], rate)))).otherwise(a)


def arg_max(a: Column) -> Column:
    """Position of the first largest value, from 0."""
    return F.array_position(a, F.array_max(a)) - 1


def softmax(a: Column) -> Column:
    m = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - m))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def pad_to(a: Column, size: int) -> Column:
    return F.concat(a, F.array_repeat(F.lit(0.0).cast("double"), F.greatest(F.lit(size) - F.size(a), F.lit(0))))


def unit_length(a: Column) -> Column:
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(a, lambda x: x.cast("double") / norm)


def power_distance(d: Column) -> Column:
    """1 - 2^d of each distance."""
    return F.transform(d, lambda x: 1 - F.pow(F.lit(2.0), x))


def interpolate_rounded(start: Column, end: Column, n: Column) -> Column:
    """n times from start to end, to three digits; the start alone for one."""
    return F.when(n == 1, F.array(start)).when(n > 1, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.bround(start + (end - start) * k / (n - 1), 3))).otherwise(F.array().cast("array<double>"))


def interpolate(start: Column, end: Column, n: Column) -> Column:
    """n times from start to end; the middle for one."""
    return F.when(n == 1, F.array((start + end) / 2)).when(n > 1, F.transform(F.sequence(F.lit(0), n - 1), lambda k: start + (end - start) * k / (n - 1))).otherwise(F.array().cast("array<double>"))


def character_frames(spans: Column) -> Column:
    """A frame for each character of words that span frames: structs of word, start, end."""
    frame = lambda w, k: F.bround(w["start"] + (w["end"] - w["start"]) * k / F.length(w["word"])).cast("int")
    some = F.filter(spans, lambda w: F.length(w["word"]) > 0)
    return F.flatten(F.transform(some, lambda w: F.transform(F.sequence(F.lit(0), F.length(w["word"]) - 1), lambda k: frame(w, k))))


def frame_times(frames: Column, audio_len: Column, logit_len: Column, rate: int, first_sample: Column | None = None) -> Column:
    """Seconds of logit frames, shifted by where the chunk begins."""
    shift = first_sample / rate if first_sample is not None else F.lit(0.0)
    return F.transform(frames, lambda f: audio_len / logit_len * f / rate + shift)


def weakly_increasing(a: Column) -> Column:
    return F.forall(F.zip_with(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: x <= y), lambda ok: ok)


def sized_chunks(a: Column, sizes: Column) -> Column:
    """Pieces of the given sizes, one behind the other; the last may be short, pieces behind the end are null."""
    begin = lambda i: F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda s, x: s + x)
    return F.transform(sizes, lambda n, i: F.when(begin(i) < F.size(a), F.slice(a, begin(i) + 1, n)))


def elements_at(a: Column, places: Column) -> Column:
    """Elements whose positions, from 0, are listed, in their order."""
    return F.filter(a, lambda x, i: F.array_contains(places, i))


def model_input(a: Column, bits: int = 16) -> Column:
    """Integer samples as numbers of -1 to 1 and how many there are."""
    return F.struct(from_int16(a, bits).alias("signal"), F.size(a).alias("length"))


def voice_slices(a: Column, start: Column, spans: Column, rate: int) -> Column:
    """``start, end, samples`` of each span of voice in a piece that begins at ``start``: the samples by the span's own seconds, the times by the recording's."""
    return F.transform(spans, lambda s: F.struct((start + s["start"]).alias("start"), (start + s["end"]).alias("end"), time_slice(a, s["start"], s["end"], rate).alias("samples")))
