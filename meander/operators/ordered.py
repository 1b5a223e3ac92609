"""Running sums and row numbers over a whole table without one task that sees it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.tables import written


def running_sum(df: DataFrame, value: Column, name: str, *order: Column, keep_range: bool = False) -> DataFrame:
    """df with the sum of value over all rows up to this one in an order without ties.

    Ranges of the order are numbered, their totals (a row for each range) give what lies before each, and a window inside
    a range adds the rest. keep_range: the number of the range stays as _range, and rows stand in the order of ranges and in theirs.
    """
    ranged = written(df.withColumn("_value", value).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(F.sum("_value").alias("_t"))
    before = totals.select("_range", (F.sum("_t").over(W.orderBy("_range")) - F.col("_t")).alias("_before"))
    inside = F.sum("_value").over(W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    # One row for each range: as many as the session has shuffle partitions.
    out = ranged.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + inside)
    return out.sortWithinPartitions("_range", *order).drop("_value", "_before") if keep_range else out.drop("_value", "_range", "_before")


def row_numbers(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with the place of each row from 0."""
    return running_sum(df, F.lit(1).cast("bigint"), name, *order).withColumn(name, F.col(name) - 1)
