"""Audio bytes to signals: information, decoding of a part, channels, resampling and trimming, in Arrow functions."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable
from functools import lru_cache
from math import ceil, gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

SIGNAL = "struct<rate:int,channels:int,frames:long,samples:array<float>,error:string>"
INFO = "struct<rate:int,channels:int,bits:int,frames:long,seconds:double,error:string>"
#: From bytes, first frame and number of frames (None: all) to the rate, the frames of the file, and samples of -1 to 1 by frame and channel.
Decoder = Callable[[bytes, Callable[[int], tuple[int, int | None]]], tuple[int, int, np.ndarray]]
#: Zero crossings of the resampling filter to each side, and its cut as a share of the lower half rate.
CROSSINGS, ROLLOFF = 64, 0.97
#: Output samples that are filtered together.
BLOCK = 1 << 14


def pcm(data: bytes, width: int) -> np.ndarray:
    """Little-endian integers of 1 to 4 bytes as numbers from -1 to 1; those of one byte are unsigned."""
    if width == 1:
        return (np.frombuffer(data, np.uint8).astype(float) - 128) / 128
    if width == 3:
        three = np.frombuffer(data, np.uint8).reshape(-1, 3)
        return np.pad(three, ((0, 0), (1, 0))).copy().view("<i4")[:, 0] / 2.0**31
    return np.frombuffer(data, f"<i{width}") / 2.0 ** (8 * width - 1)


def decode_pcm(content: bytes, part: Callable[[int], tuple[int, int | None]]) -> tuple[int, int, np.ndarray]:
    """WAV of 8, 16, 24 or 32 bits; only the wanted part is converted, and a part beyond the end is empty."""
    with wave.open(io.BytesIO(content)) as w:
        first, n = part(w.getframerate())
        w.setpos(min(max(0, first), w.getnframes()))
        data = w.readframes(w.getnframes() if n is None else max(0, n))
        step = w.getsampwidth() * w.getnchannels()
        return w.getframerate(), w.getnframes(), pcm(data[: len(data) // step * step], w.getsampwidth()).reshape(-1, w.getnchannels())


def mixed(samples: np.ndarray, channel: str) -> np.ndarray:
    if channel not in ("mean", "first"):
        raise ValueError(f"channel is mean or first, not {channel}")
    return samples.mean(axis=1) if channel == "mean" else samples[:, 0]


def audio_info(content: Column) -> Column:
    """Rate, channels, bits, frames and seconds of a WAV's header; ``error`` says why there are none. Null bytes give null."""

    @pandas_udf(INFO)
    def run(contents: pd.Series) -> pd.DataFrame:
        def one(c):
            if c is None:
                return (None,) * 6
            try:
                with wave.open(io.BytesIO(c)) as w:
                    return w.getframerate(), w.getnchannels(), 8 * w.getsampwidth(), w.getnframes(), w.getnframes() / w.getframerate(), None
            except (wave.Error, EOFError, ZeroDivisionError) as e:
                return None, None, None, None, None, f"{type(e).__name__}: {e}"

        return _table([one(c) for c in contents], {"rate": "Int32", "channels": "Int32", "bits": "Int32", "frames": "Int64", "seconds": "Float64", "error": object})

    return F.when(content.isNotNull(), run(content))


def _table(rows: list[tuple], kinds: dict) -> pd.DataFrame:
    return pd.DataFrame({k: pd.Series([r[i] for r in rows], dtype=t) for i, (k, t) in enumerate(kinds.items())})


def decoded(content: Column, form: Column, offset: Column | None = None, duration: Column | None = None, unit: str = "seconds", channel: str = "mean", target: int | None = None, decoders: dict[str, Decoder] | None = None) -> Column:
    """The signal of an audio file, or of a part of it.

    ``form`` names the format; ``wav`` is built in, ``decoders`` adds others or replaces it. ``offset`` and ``duration`` are seconds, which are rounded to
    frames, or frames (``unit``); null is the start, or all that follows. Channels are averaged or the first is taken, then the signal is resampled to
    ``target``. A file that can't be decoded has null samples and an ``error``, so failures can be counted; null bytes give null.
    """
    if unit not in ("seconds", "frames"):
        raise ValueError(f"unit is seconds or frames, not {unit}")
    table = {"wav": decode_pcm, **(decoders or {})}

    @pandas_udf(SIGNAL)
    def run(contents: pd.Series, forms: pd.Series, offsets: pd.Series, durations: pd.Series) -> pd.DataFrame:
        def one(c, f, o, d):
            if c is None:
                return (None,) * 5

            def part(rate):
                scale = rate if unit == "seconds" else 1
                return 0 if pd.isna(o) else round(o * scale), None if pd.isna(d) else round(d * scale)

            try:
                if f not in table:
                    raise ValueError(f"no decoder for {f}")
                rate, frames, samples = table[f](c, part)
                signal = mixed(samples, channel)
                signal = signal if target is None else resample(signal, rate, target)
                return target or rate, samples.shape[1], frames, signal.astype(np.float32), None
            except Exception as e:  # noqa: BLE001  the row tells what failed
                return None, None, None, None, f"{type(e).__name__}: {e}"

        rows = [one(*r) for r in zip(contents, forms, offsets, durations, strict=True)]
        return _table(rows, {"rate": "Int32", "channels": "Int32", "frames": "Int64", "samples": object, "error": object})

    number = lambda c: F.lit(None).cast("double") if c is None else c.cast("double")
    return F.when(content.isNotNull(), run(content, form, number(offset), number(duration)))


@lru_cache(maxsize=16)
def filter_bank(up: int, down: int) -> tuple[int, np.ndarray]:
    """A low-pass for each of ``up`` phases: a sinc under a Hann window, which sums to 1, so a constant stays what it is."""
    cut = ROLLOFF * min(1.0, up / down)
    half = ceil(CROSSINGS / cut)
    t = cut * (np.arange(up)[:, None] / up - np.arange(-half, half + 1)[None, :])
    h = np.sinc(t) * np.where(np.abs(t) < CROSSINGS, np.cos(np.pi * t / (2 * CROSSINGS)) ** 2, 0.0)
    return half, h / h.sum(axis=1, keepdims=True)


def resample(x: np.ndarray, source: int, target: int) -> np.ndarray:
    """``ceil(n * target / source)`` samples by a windowed-sinc polyphase filter; before and after the signal are zeros. Memory is that of the signal and a block."""
    x = np.asarray(x, float)
    if source == target or not len(x):
        return x
    if source <= 0 or target <= 0:
        raise ValueError(f"no resampling from {source} to {target}")
    up, down = target // gcd(source, target), source // gcd(source, target)
    half, bank = filter_bank(up, down)
    padded = np.pad(x, half)
    views = np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1)
    y = np.empty(-(-len(x) * up // down))
    for a in range(0, len(y), BLOCK):
        j = np.arange(a, min(a + BLOCK, len(y)))
        y[a : a + BLOCK] = np.einsum("ij,ij->i", views[j * down // up], bank[j * down % up])
    return y


def resampled(samples: Column, source: Column, target: int) -> Column:
    """An array column from each row's rate to ``target``; null samples or a null rate give null, empty samples stay empty."""

    @pandas_udf("array<double>")
    def run(signals: pd.Series, rates: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or pd.isna(r) else resample(x, int(r), target) for x, r in zip(signals, rates, strict=True)], dtype=object)

    return run(samples, source.cast("int"))


def trim(x: np.ndarray, below: float = 60.0, frame: int = 2048, hop: int = 512) -> np.ndarray:
    """From the first to the last frame (centred, ``hop`` apart) whose power is at most ``below`` decibels under that of the loudest."""
    if not len(x):
        return x
    squares = np.concatenate([[0.0], np.cumsum(np.asarray(x, float) ** 2)])
    at = np.arange(0, len(x) + 1, hop)
    power = (squares[np.clip(at + frame // 2, 0, len(x))] - squares[np.clip(at - frame // 2, 0, len(x))]) / frame
    loud = np.flatnonzero(power > power.max() * 10 ** (-below / 10)) if power.max() > 0 else []
    return x[loud[0] * hop : min(len(x), (loud[-1] + 1) * hop)] if len(loud) else x[:0]


def trimmed(samples: Column, below: float = 60.0) -> Column:
    """Signals without silent ends; silence becomes empty, null stays null."""

    @pandas_udf("array<double>")
    def run(signals: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else trim(x, below) for x in signals], dtype=object)

    return run(samples)
