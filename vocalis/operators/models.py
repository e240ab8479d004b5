"""Slots for models: a callable goes in, an Arrow function comes out."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.functions import pandas_udf

from vocalis.functions.udf import arrow_function


def array_model(load: Callable[[], Callable[[list], list]], returns: str):
    """A function of an array column; the model is loaded once for each task, and a failing row gives null."""

    @pandas_udf(returns)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()

        def one(x):
            try:
                return None if x is None else model(list(x))
            except Exception:  # noqa: BLE001  a row that fails is a null
                return None

        for batch in batches:
            yield pd.Series([one(x) for x in batch], dtype=object)

    return run


def infer(df: DataFrame, model: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Rows in, rows out, batch by batch."""
    return df.mapInPandas(model, schema)


@arrow_function("double")
def compression_ratio(text: pd.Series) -> pd.Series:
    """Bytes of a text over its compressed bytes; repetitive texts have a high one."""
    return pd.Series([len((t or "").encode()) / max(1, len(zlib.compress((t or "").encode()))) for t in text])


def resampler(source: int, target: int):
    """Linear resampling of an array column."""

    @pandas_udf("array<double>")
    def run(signal: pd.Series) -> pd.Series:
        import numpy as np

        def one(x):
            x = np.asarray(x, float)
            n = int(round(len(x) * target / source))
            return np.interp(np.arange(n) * source / target, np.arange(len(x)), x).tolist() if len(x) else []

        return pd.Series([one(x) for x in signal], dtype=object)

    return run
