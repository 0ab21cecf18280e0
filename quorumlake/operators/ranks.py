"""Places of rows in a global order, without one task that sorts them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.session import staged


def ranked(df: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """df with its rows' places from 0 in the given order, which should leave no ties.

    Rows are dealt by range, ranked within ranges and shifted by the rows of the ranges before.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(df.repartitionByRange(ranges, *order).withColumn("__r", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("__r").agg(F.count(F.lit(1)).alias("n"))
    shift = F.coalesce(F.sum("n").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = F.broadcast(counts.select("__r", shift.alias("__shift")))  # one row a range
    own = F.row_number().over(Window.partitionBy("__r").orderBy(*order)) - 1
    return dealt.withColumn(name, own).join(before, "__r").withColumn(name, (F.col(name) + F.col("__shift")).cast("bigint")).drop("__r", "__shift")
