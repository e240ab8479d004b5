"""Arrow functions that are made when first used, so modules import without a session."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


def arrow_function(returns: str) -> Callable[[Callable], Callable[..., Column]]:
    def decorate(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def apply(*columns) -> Column:
            return pandas_udf(f, returns)(*columns)

        apply.plain = f
        return apply

    return decorate
