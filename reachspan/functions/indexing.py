"""Numbers for rows in an order, without a single task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reachspan.runtime import cut


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with a number from 1 in the order of a column: range partitions are numbered each, then moved by the rows before them."""
    dealt = cut(df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").count()
    before = sizes.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return dealt.join(F.broadcast(before), "_part").withColumn(name, (own + F.col("_before")).cast("long")).drop("_part", "_before")


def starts_with(column, prefix: str):
    return F.col(column).startswith(prefix)


def ends_with(column, suffix: str):
    return F.col(column).endswith(suffix)
