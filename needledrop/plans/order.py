"""Numbering and neighbours in a global order, without ever sorting all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from needledrop.plans.storage import written


#: Rows that a range may have on average; more rows make more ranges than there are shuffle partitions.
RANGE_ROWS = 1_000_000


def numbered(df: DataFrame, order: list[Column], name: str = "i") -> DataFrame:
    """``df`` with a 0-based ``name`` in ``order`` and ``part``, the range of rows a row was sorted in.

    Rows are written, dealt by range, sorted within their range and written with their place in it, all by one shuffle; then
    ranges are counted (one row each). What a task sorts doesn't grow with the rows, as the ranges do.
    """
    rows = written(df, "rows")  # so that the sample of the ranges' bounds doesn't compute ``df`` again
    ranges = -(-rows.count() // RANGE_ROWS)
    more = [ranges] if ranges > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    # Spark's increasing id is the task's number and, in its lower 33 bits, the row's place in the task
    dealt = written(rows.repartitionByRange(*more, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    dealt = dealt.withColumn("part", F.shiftright("_at", 33).cast("int"))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    joined = dealt.join(F.broadcast(sizes), "part")  # as many rows as there are ranges
    return joined.withColumn(name, F.col("before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("before", "_at")


def first_by(df: DataFrame, keys: list[str], order: list[Column], most: int = 1) -> DataFrame:
    """The first rows of each group; each task keeps so many of a group before they are shuffled."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= most).drop("_r")
