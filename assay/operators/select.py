"""Batch selection: exclusions, top-n with overflow, triage, outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbering import numbered
from .validate import duplicates, first_wins, last_wins


def with_audit(candidates: DataFrame, audit: DataFrame, keys: list[str], order: str = "_ord") -> DataFrame:
    """Candidates with the last audit row of their key (left join)."""
    right = last_wins(audit, keys, order).drop(order)
    return candidates.join(right, keys, "left")


def not_validated(candidates: DataFrame, done: DataFrame) -> DataFrame:
    return candidates.join(done.select("candidate_id").distinct(), "candidate_id", "left_anti")


def top_n_overflow(df: DataFrame, key: str, order: list[Column | str], n: int, max_total: int | None = None) -> DataFrame:
    """Add selected and overflow_reason: n rows of each key, then a total limit."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    rows = df.withColumn("rank_in_key", rank).withColumn("in_key", F.col("rank_in_key") <= n)
    reason = F.when(~F.col("in_key"), "per_formula_limit")
    if max_total is not None:
        rows = numbered(rows, F.desc("in_key"), key, "rank_in_key", name="place")
        reason = reason.when(F.col("place") > max_total, "total_limit")
    rows = rows.withColumn("overflow_reason", reason)
    return rows.withColumn("selected", F.col("overflow_reason").isNull()).drop("in_key", "place")


def zero_last(x: Column | str) -> Column:
    """Sort key in which null and exactly 0.0 come last."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(c.isNull() | (c == 0.0), F.lit(float("inf"))).otherwise(c)


def relaxation_candidates(rows: DataFrame, max_force: float = 5.0, max_stress: float = 0.2) -> DataFrame:
    ok = (F.col("validation_status") == "completed") & (F.col("force_max") <= max_force) & (F.col("stress_max").isNull() | (F.col("stress_max") <= max_stress))
    return rows.where(ok)


def triage(rows: DataFrame, n: int, key: str = "formula") -> DataFrame:
    """The first n relaxation candidates of each formula by force, stress, energy, id."""
    order = [zero_last("force_max"), zero_last("stress_max"), zero_last("energy"), F.col("candidate_id")]
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return relaxation_candidates(rows).withColumn("rank_within_formula", rank).where(F.col("rank_within_formula") <= n)


def outliers(rows: DataFrame, n: int, force_limit: float = 0.05, stress_limit: float = 0.05, key: str = "formula") -> DataFrame:
    """The n worst rows by the larger ratio of value and limit."""
    level = F.greatest(F.col("force_max") / force_limit, F.col("stress_max") / stress_limit)
    return rows.withColumn("severity", level).where("severity is not null").orderBy(F.desc("severity"), key, "candidate_id").limit(n)


def hydrate(compact: DataFrame, full: DataFrame, index: DataFrame, order: str = "_ord") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Triage rows with their full records in triage order; missing ids; repeated ids.

    The first full record and the first index row of an id count.
    """
    left = compact.select("candidate_id", order)
    record = first_wins(full, "candidate_id", order).drop(order)
    extra = first_wins(index, "candidate_id", order).drop(order)
    extra = extra.select("candidate_id", *(F.col(c).alias("index_" + c) for c in extra.columns if c != "candidate_id"))
    found = left.join(record, "candidate_id").join(extra, "candidate_id", "left").orderBy(order)
    return found, left.join(record.select("candidate_id"), "candidate_id", "left_anti"), duplicates(full, "candidate_id")


def match_references(tasks: DataFrame, references: DataFrame, fits, formula: str = "formula") -> DataFrame:
    """Each task's first reference (by ref_ord) of its formula for which ``fits``.

    ``fits`` maps the joined DataFrame to a boolean Column (for instance a
    pandas UDF around a structure matcher).
    """
    both = tasks.join(references.withColumnRenamed("candidate_id", "reference_id"), formula)
    hits = both.where(fits(both)).groupBy("candidate_id").agg(F.min_by("reference_id", "ref_ord").alias("reference_id"))
    return tasks.join(hits, "candidate_id", "left")


def novelty_tasks(candidates: DataFrame, limit: int, shards: int, by_ranking: bool = False) -> tuple[DataFrame, DataFrame]:
    """(tasks with shard_id, overflow) in order of id or of ranking."""
    order = [F.desc_nulls_last("ranking_score"), F.col("candidate_id")] if by_ranking else [F.col("candidate_id")]
    rows = numbered(candidates, *order, name="place")
    tasks = rows.where(F.col("place") <= limit).withColumn("shard_id", (F.col("place") - 1) % shards)
    return tasks, rows.where(F.col("place") > limit)


def task_plan(candidates: DataFrame, validators: list[str]) -> DataFrame:
    """Every candidate with every validator; validators are a short literal list."""
    return candidates.withColumn("validator", F.explode(F.array(*(F.lit(v) for v in validators))))
