"""Places of rows in the order of a whole table, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(df: DataFrame, lead: Column, order: list[Column | str], name: str = "row", parts: int = 1000) -> DataFrame:
    """Rows numbered from 0 by ``lead`` (a number; nulls come first), then ``order``.

    At most ``parts`` - 1 approximate quantiles of ``lead`` cut the table; rows are numbered in their part and moved
    on by the rows of the parts before, one sum a part. Any cuts give the same numbers. Rows of one ``lead`` are one
    task's work, so a value that is very frequent should be told apart in ``lead`` itself. Equal rows are ordered
    arbitrarily; an empty table stays empty.
    """
    keyed = df.withColumn("_lead", lead.cast("double"))
    shares = F.array(*(F.lit(k / parts) for k in range(1, parts)))
    # at most parts - 1 numbers; they are fixed before rows are placed, so that repeated tasks place them alike
    cuts = sorted(set(keyed.agg(F.percentile_approx("_lead", shares, 10 * parts)).head()[0] or []))
    part = F.size(F.filter(F.lit(cuts).cast("array<double>"), lambda c: c <= F.col("_lead"))) if cuts else F.lit(0)
    placed = keyed.withColumn("_part", F.when(F.col("_lead").isNull(), 0).otherwise(part))
    # a row a part
    sums = placed.groupBy(F.col("_part").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    before = sums.select("_of", F.coalesce(F.sum("_n").over(Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_lead", *order)) - 1
    numbered = placed.withColumn("_inside", inside).join(F.broadcast(before), F.col("_part") == F.col("_of"))
    return numbered.withColumn(name, F.col("_before") + F.col("_inside")).drop("_lead", "_part", "_of", "_before", "_inside")
