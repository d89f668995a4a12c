"""Row numbers over a whole table, without putting it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .session import checkpointed

#: Bits that monotonically_increasing_id() leaves for the place within a partition.
PLACE_BITS = 33


def numbered(df: DataFrame, *orders: Column | str, name: str = "row_number", start: int = 1) -> DataFrame:
    """Add ``name``: the row's place in order of ``orders``, from ``start``.

    Rows are dealt to ranges and sorted there; a row's number is its place in
    its range and the rows of the ranges before it. Only the sizes of the
    ranges, one row each, are summed up in one task. The dealt rows are written
    to the checkpoint folder, as ranges may differ from one run to the next.
    Rows that are equal in ``orders`` are numbered in any order.
    """
    dealt = df.repartitionByRange(*orders).sortWithinPartitions(*orders)
    dealt = checkpointed(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", PLACE_BITS)))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", before.alias("_before"))
    place = F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) + F.col("_before") + start
    return dealt.join(F.broadcast(sizes), "_range").withColumn(name, place).drop("_at", "_range", "_before")


def running_total(df: DataFrame, weight: str, *orders: Column | str, name: str = "running_total") -> DataFrame:
    """Add ``name``: the sum of ``weight`` of all rows before this one in order of ``orders``.

    As ``numbered``: totals within a range, and of the ranges before it.
    """
    dealt = df.repartitionByRange(*orders).sortWithinPartitions(*orders)
    dealt = checkpointed(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", PLACE_BITS)))
    earlier = lambda total, window: F.coalesce(F.sum(total).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = dealt.groupBy("_range").agg(F.sum(weight).alias("_n"))
    sizes = sizes.select("_range", earlier("_n", Window.orderBy("_range")).alias("_before"))
    within = earlier(weight, Window.partitionBy("_range").orderBy("_at"))
    return dealt.withColumn("_own", within).join(F.broadcast(sizes), "_range").withColumn(name, F.col("_own") + F.col("_before")).drop("_at", "_range", "_own", "_before")
