"""Classification reports, clustering agreement, diarization error, corpus summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classification_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of each class, then accuracy and the two averages."""
    pairs = df.groupBy(F.col(truth).cast("string").alias("t"), F.col(predicted).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.col("n").alias("true_n"), F.lit(0).alias("pred_n"), F.lit(0).alias("hit")), F.struct(F.col("p").alias("label"), F.lit(0).alias("true_n"), F.col("n").alias("pred_n"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit")))).alias("s")).select("s.*")
    sums = sides.groupBy("label").agg(F.sum("true_n").alias("support"), F.sum("pred_n").alias("pred_n"), F.sum("hit").alias("hit"))
    precision = F.coalesce(F.try_divide("hit", "pred_n"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    per = sums.withColumn("precision", precision).withColumn("recall", recall).withColumn("f1", f1).select("label", "precision", "recall", "f1", "support", "hit")
    total = F.sum("support")
    names = ("precision", "recall", "f1")
    macro = per.agg(F.lit("macro avg").alias("label"), *[F.avg(c).alias(c) for c in names], total.alias("support"))
    weighted = per.agg(F.lit("weighted avg").alias("label"), *[(F.sum(F.col(c) * F.col("support")) / total).alias(c) for c in names], total.alias("support"))
    accuracy = per.agg(F.lit("accuracy").alias("label"), *[(F.sum("hit") / total).alias(c) for c in names], total.alias("support"))
    return per.drop("hit").unionByName(macro).unionByName(weighted).unionByName(accuracy)


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """The adjusted Rand index of two labellings, from their contingency table."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))

    def pairs(n: Column) -> Column:
        return n * (n - 1) / 2

    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("r"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("c"))
    both = cells.agg(F.sum(pairs(F.col("n"))).alias("i"), pairs(F.sum("n")).alias("t"))
    # one row each
    x = both.join(rows).join(cols)
    expected = F.col("r") * F.col("c") / F.col("t")
    return x.select(F.coalesce(F.try_divide(F.col("i") - expected, (F.col("r") + F.col("c")) / 2 - expected), F.lit(1.0)).alias("ari"))


def rate(part: Column, whole: Column) -> Column:
    """part / whole in percent; 0 for 0/0 and 100 for anything over 0."""
    return 100 * F.when((whole == 0) & (part == 0), 0.0).when(whole == 0, 1.0).otherwise(part / F.when(whole == 0, 1).otherwise(whole))


def diarization_error(overlaps: DataFrame, reference: DataFrame, system: DataFrame) -> DataFrame:
    """Missed, false and confused speech in percent of the reference, without a collar.

    Each system label is taken for the reference label with which it shares most time (several may
    take the same); segments of one side must not overlap each other.
    """
    mapped = overlaps.groupBy("sys_label").agg(F.max("seconds").alias("right"), F.sum("seconds").alias("shared")).agg(F.coalesce(F.sum("right"), F.lit(0.0)).alias("right"), F.coalesce(F.sum("shared"), F.lit(0.0)).alias("shared"))
    ref = reference.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0.0)).alias("ref"))
    sys = system.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0.0)).alias("sys"))
    x = mapped.join(ref).join(sys)
    miss, fa, confused = F.greatest(F.col("ref") - F.col("shared"), F.lit(0.0)), F.greatest(F.col("sys") - F.col("shared"), F.lit(0.0)), F.col("shared") - F.col("right")
    return x.select(rate(miss, F.col("ref")).alias("miss"), rate(fa, F.col("ref")).alias("false_alarm"), rate(confused, F.col("ref")).alias("confusion"), rate(miss + fa + confused, F.col("ref")).alias("der"))


def corpus_hours(df: DataFrame, signal: str, rate_hz: int) -> DataFrame:
    return df.agg((F.sum(F.size(signal)) / rate_hz / 3600).alias("hours"), F.count(F.lit(1)).alias("n"))


def length_summary(df: DataFrame, length: Column) -> DataFrame:
    x = df.select(length.cast("double").alias("x"))
    return x.agg(F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.percentile("x", F.lit(0.25)).alias("q25"), F.percentile("x", F.lit(0.5)).alias("q50"), F.percentile("x", F.lit(0.75)).alias("q75"), F.max("x").alias("max"))
