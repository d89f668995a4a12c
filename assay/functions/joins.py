"""Joins in which a hot key must not gather in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key that count as hot, and how many hot keys are broadcast at most.
HOT_ROWS, HOT_KEYS = 100_000, 100_000


def join_keyed(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hot_rows: int | None = None, hot_keys: int | None = None) -> DataFrame:
    """``left`` joined (inner or left) with ``right``, which has one row for each value of ``keys``.

    Keys with more than ``hot_rows`` rows on the left are counted first; their
    right rows are broadcast, so the left rows stay where they are. If there
    were more than ``hot_keys`` of them, none is large beside the rest, and all
    are shuffled. A key that holds a null matches nothing.
    """
    hot_rows, hot_keys = hot_rows or HOT_ROWS, hot_keys or HOT_KEYS
    hot = left.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows).select(*keys, F.lit(True).alias("_hot"))
    for key in keys:
        hot = hot.where(F.col(key).isNotNull())
    n = hot.limit(hot_keys + 1).count()
    if not 0 < n <= hot_keys:
        return left.join(right, keys, how)
    marked = left.join(F.broadcast(hot), keys, "left")
    few = F.broadcast(right.join(F.broadcast(hot.drop("_hot")), keys, "left_semi"))
    large = marked.where("_hot").drop("_hot").join(few, keys, how)
    return large.unionByName(marked.where("_hot is null").drop("_hot").join(right, keys, how))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt to spark.sql.shuffle.partitions tasks (by ``keys``), however few bytes they have.

    For rows with much work for each: adaptive execution would gather them in
    few tasks, and a scan of a small file is one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def join_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which rows of small tables make many pairs: both sides are shuffled, none is broadcast.

    A hash of the keys comes first, so that rows are sorted by a number.
    """
    both = [dealt(df.withColumn("_hash", F.xxhash64(*keys)), "_hash", *keys) for df in (left, right)]
    return both[0].hint("merge").join(both[1].hint("merge"), ["_hash", *keys]).drop("_hash")


def in_arrays(df: DataFrame, keys: list[str], fields: list[str], size: int, kept: list[str] | None = None) -> DataFrame:
    """(*keys, *kept, _array, _arrays, rows): rows of equal ``keys``, none of them null, in arrays of about ``size`` structs of ``fields``.

    Arrays meet where rows would: pairs are built of them by two explodes, so
    neither join nor sort handles a row for each of its keys and partners.
    ``_array`` counts from 0 to ``_arrays`` - 1 within the keys, on which
    ``kept`` columns depend. Rows are dealt to arrays by a hash of the fields.
    """
    kept = kept or []
    sizes = df.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias("_arrays"))
    parts = join_keyed(df.select(*keys, *kept, F.struct(*fields).alias("row")), sizes, keys).withColumn("_array", F.pmod(F.xxhash64("row"), F.col("_arrays")).cast("int"))
    return parts.groupBy(*keys, "_array", "_arrays").agg(F.collect_list("row").alias("rows"), *(F.first(c).alias(c) for c in kept))
