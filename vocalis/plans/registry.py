"""All queries of the core library, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vocalis.plans import audio_queries, signal_queries, speech_queries, text_queries, training_queries

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {**text_queries.QUERIES, **signal_queries.QUERIES, **training_queries.QUERIES, **speech_queries.QUERIES, **audio_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**text_queries.ORACLE, **signal_queries.ORACLE, **training_queries.ORACLE, **speech_queries.ORACLE, **audio_queries.ORACLE}
