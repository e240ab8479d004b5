"""The fixture tables that queries stand on, as Spark frames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Tables up to one split's size may be a single row group, so a single task.
SPREAD_BYTES = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small table dealt over all cores; larger tables have splits enough and stay as they are."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SPREAD_BYTES else df


EPOCH = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) / 1e6"


def segments(spark: SparkSession, sf_dir: str, scale: float = 60.0) -> DataFrame:
    """A segment for each event: it begins at the event and lasts as its value says."""
    e = read(spark, sf_dir, "events")
    return e.select("user_id", "event_id", F.expr(EPOCH).alias("start"), (F.expr(EPOCH) + F.col("value") * scale).alias("end"), F.col("event_type").alias("label"))


def segments_sql(scale: float = 60.0) -> str:
    return f"(select user_id, event_id, epoch_us(ts)/1e6 as start, epoch_us(ts)/1e6 + value*{scale} as \"end\", event_type as label from events)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")


VECTORS_SQL = "(select vec_id, embedding::double[] as x, label from embeddings)"
