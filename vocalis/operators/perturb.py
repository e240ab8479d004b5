"""Perturbed signals for training. What happens to a row follows from a seed and the row's key, so neither partitions nor repeated tasks change it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from vocalis.sources.audio import resample

PERTURBED = "struct<samples:array<float>,applied:array<string>,tries:int,error:string>"
#: A perturbation: from a signal, its rate and a generator to a signal.
Perturbation = Callable[[np.ndarray, int, np.random.Generator], np.ndarray]


def generator(*key) -> np.random.Generator:
    """A generator that the values of ``key`` name."""
    return np.random.default_rng(int.from_bytes(blake2b("\x1f".join(map(str, key)).encode(), digest_size=16).digest(), "little"))


def row_uniform(seed: int, *key: Column) -> Column:
    """A number of [0, 1) that follows from a seed and the row's key, unlike ``rand``, which follows the partitions."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 53)).cast("double") / float(1 << 53)


def uniform(u: Column, low: float, high: float) -> Column:
    return F.lit(low) + u * (high - low)


def log_uniform(u: Column, low: float, high: float) -> Column:
    """Uniform in the logarithm: small values are as likely as large ones."""
    return F.exp(uniform(u, float(np.log(low)), float(np.log(high))))


def triangular(u: Column, left: float, mode: float, right: float) -> Column:
    """The value of a triangular law at the share ``u``."""
    rise = F.lit(left) + F.sqrt(u * ((right - left) * (mode - left)))
    fall = F.lit(right) - F.sqrt((F.lit(1.0) - u) * ((right - left) * (right - mode)))
    return F.when(u * (right - left) < mode - left, rise).otherwise(fall)


def band(x: np.ndarray, rate: int, low: float, high: float) -> np.ndarray:
    """Only the frequencies from ``low`` to ``high``."""
    spectrum, at = np.fft.rfft(x), np.fft.rfftfreq(len(x), 1 / rate)
    return np.fft.irfft(np.where((at >= low) & (at <= high), spectrum, 0), len(x))


def scaled(x: np.ndarray, decibels: float) -> np.ndarray:
    """The signal with its peak at so many decibels; what is over 0 is clipped."""
    most = np.abs(x).max(initial=0.0)
    return np.clip(x / most * 10 ** (decibels / 20), -1, 1) if most > 0 else x


def slow_noise(n: int, rate: int, most: float, rng: np.random.Generator) -> np.ndarray:
    """Noise of frequencies up to ``most``, with a peak of 1."""
    x = band(rng.standard_normal(n), rate, 0, most)
    return x / max(np.abs(x).max(initial=0.0), 1e-12)


@dataclass(frozen=True)
class Gain:
    """A peak from a triangular law of decibels; above 0 it clips."""

    low: float = -10.0
    mode: float = 0.0
    high: float = 30.0

    def __call__(self, x, rate, rng):
        return scaled(x, rng.triangular(self.low, self.mode, self.high))


@dataclass(frozen=True)
class VaryingGain:
    """Loudness goes up and down, with changes of up to ``most`` Hz and ``depth`` of the signal."""

    most: float = 1.0
    depth: float = 0.5

    def __call__(self, x, rate, rng):
        return x * (1 - self.depth / 2 + self.depth / 2 * slow_noise(len(x), rate, self.most, rng))


@dataclass(frozen=True)
class DynamicNoise:
    """White noise of a random band, whose loudness changes slowly, at least ``ratio`` decibels (and at most 60) under the signal's peak."""

    ratio: float = 20.0

    def __call__(self, x, rate, rng):
        high = rng.uniform(min(1000, rate / 4), 0.44 * rate)
        noise = band(rng.standard_normal(len(x)), rate, rng.uniform(1, high), high) * slow_noise(len(x), rate, rng.uniform(0.1, 2), rng)
        return x + scaled(noise, rng.uniform(-60, -self.ratio)) * np.abs(x).max(initial=0.0)


@dataclass(frozen=True)
class RandomBand:
    """A low-pass or not and a high-pass or not, each by half, with log-uniform cuts at least ``width`` Hz apart."""

    least_low: float = 200.0
    width: float = 100.0
    most_high: float = 1000.0

    def cuts(self, rate: int, rng: np.random.Generator) -> tuple[float, float]:
        draw = lambda a, b: float(np.exp(rng.uniform(np.log(a), np.log(max(a, b)))))
        top = 0.4375 * rate
        low = draw(self.least_low, top) if rng.random() < 0.5 else None
        high = draw(2.0, min(self.most_high, (top if low is None else low) - self.width)) if rng.random() < 0.5 else None
        return 0.0 if high is None else high, rate / 2 if low is None else low

    def __call__(self, x, rate, rng):
        return band(x, rate, *self.cuts(rate, rng))


@dataclass(frozen=True)
class Speed:
    """Faster or slower, with the pitch; a factor of a triangular law in whole percents."""

    low: float = 0.8
    mode: float = 1.0
    high: float = 1.2

    def __call__(self, x, rate, rng):
        return resample(x, round(100 * rng.triangular(self.low, self.mode, self.high)), 100)


@dataclass(frozen=True)
class ALaw:
    """As over an old telephone line: 8 kHz and 8 bits by the A-law."""

    a: float = 87.6
    rate: int = 8000

    def __call__(self, x, rate, rng):
        y = np.clip(resample(x, rate, self.rate), -1, 1)
        scale, size = 1 + np.log(self.a), np.abs(y)
        code = np.where(size < 1 / self.a, self.a * size, 1 + np.log(np.maximum(self.a * size, 1.0))) / scale
        code = np.round(code * 127) / 127 * scale
        size = np.where(code < 1, code / self.a, np.exp(code - 1) / self.a)
        return resample(np.sign(y) * size, self.rate, rate)[: len(x)]


def perturb(x: np.ndarray, rate: int, steps: list[tuple[float, Perturbation]], key: tuple, tries: int) -> tuple[np.ndarray, list[str], int, str | None]:
    """Each step happens with its probability, in order. After an error all begin anew with other numbers; after ``tries`` errors the signal stays as it was."""
    error = None
    for k in range(1, tries + 1):
        rng, y, applied = generator(*key, k), x, []
        try:
            for share, step in steps:
                if rng.random() < share:
                    y = step(y, rate, rng)
                    applied.append(getattr(step, "__name__", type(step).__name__))
            if not np.isfinite(y).all():
                raise FloatingPointError("a sample is no number")
            return y, applied, k, error
        except Exception as e:  # noqa: BLE001  the row tells what failed
            error = f"{type(e).__name__}: {e}"
    return x, [], tries, error


def perturbed(samples: Column, rate: Column, key: Column, steps: list[tuple[float, Perturbation]], seed: int = 0, tries: int = 3) -> Column:
    """``samples, applied, tries, error`` for each row; ``key`` names the row (rows of one key get the same numbers, null is a key as well).

    Null samples or a null rate give null; empty signals stay empty and nothing is applied. A signal is held by one task.
    """

    @pandas_udf(PERTURBED)
    def run(signals: pd.Series, rates: pd.Series, keys: pd.Series) -> pd.DataFrame:
        rows = []
        for x, r, k in zip(signals, rates, keys, strict=True):
            if x is None or pd.isna(r):
                rows.append((None, None, None, None))
            else:
                y, *rest = perturb(np.asarray(x, float), int(r), steps if len(x) else [], (seed, k), tries)
                rows.append((np.asarray(y, np.float32), *rest))
        return pd.DataFrame({"samples": pd.Series([r[0] for r in rows], dtype=object), "applied": pd.Series([r[1] for r in rows], dtype=object), "tries": pd.Series([r[2] for r in rows], dtype="Int32"), "error": pd.Series([r[3] for r in rows], dtype=object)})

    return F.when(samples.isNotNull() & rate.isNotNull(), run(samples.cast("array<double>"), rate.cast("int"), key.cast("string")))
