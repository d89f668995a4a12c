"""Exact quantiles of many groups by selection, without any group's values in one place.

Values are counted first, so a group of any size is spread over its distinct
values; the counts are put in order over ranges, and running totals say between
which ranks a value lies. Only the values at the wanted ranks reach the last
aggregation, two for each quantile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import col
from .joins import join_keyed
from .numbering import running_total
from .session import checkpointed


def summary(df: DataFrame, keys: list[str], value: Column | str, qs: dict[str, float], mean: bool = False) -> DataFrame:
    """(keys, n, min, max, with ``mean`` the mean, and a column for each of ``qs``) of the values that are not null.

    ``qs`` are names and shares; quantiles are interpolated linearly between the
    two nearest ranks. Null is a key like any other; a group without values has
    n = 0 and nulls.
    """
    key = F.to_json(F.struct(*keys)) if keys else F.lit("")
    counts = checkpointed(df.select(*keys, key.alias("_key"), col(value).cast("double").alias("_x")).groupBy(*keys, "_key", "_x").agg(F.count("*").alias("_m"), *([F.sum("_x").alias("_s")] if mean else [])))
    counts = counts.withColumn("_m", F.when(F.col("_x").isNotNull(), F.col("_m")).otherwise(F.lit(0)))
    totals = counts.groupBy("_key").agg(F.sum("_m").alias("n"), F.min("_x").alias("min"), F.max("_x").alias("max"), *([(F.sum("_s") / F.nullif(F.sum("_m"), F.lit(0))).alias("mean")] if mean else []))
    placed = running_total(counts, "_m", "_key", "_x", name="_total")
    first = placed.groupBy("_key").agg(F.min("_total").alias("_start"))
    rows = join_keyed(placed, totals.join(first, "_key"), ["_key"]).withColumn("_low", F.col("_total") - F.col("_start"))

    def at(rank: Column) -> Column:
        """The value at a rank, from 0."""
        return F.max(F.when((F.col("_low") <= rank) & (rank < F.col("_low") + F.col("_m")), F.col("_x")))

    def quantile(q: float) -> Column:
        place = (F.col("n") - 1) * F.lit(q)
        low, high = F.floor(place), F.ceil(place)
        share = F.max(place - low)
        return F.when(share == 0, at(low)).otherwise(at(low) * (1 - share) + at(high) * share)

    out = rows.groupBy(*keys, "_key").agg(F.first("n").alias("n"), F.first("min").alias("min"), F.first("max").alias("max"), *([F.first("mean").alias("mean")] if mean else []), *(quantile(q).alias(name) for name, q in qs.items()))
    return out.drop("_key")
