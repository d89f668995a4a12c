"""Artifact quality checks: each returns violations in one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VIOLATION = ("severity", "check", "location", "detail")


def violation(rows: DataFrame, severity: str, check: str, location: Column | str, detail: Column | str) -> DataFrame:
    as_text = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    return rows.select(F.lit(severity).alias("severity"), F.lit(check).alias("check"), as_text(location).alias("location"), as_text(detail).alias("detail"))


def missing_values(rows: DataFrame, location: str, *columns: str) -> DataFrame:
    """Critical: a required column is null or empty."""
    gaps = F.array_compact(F.array(*(F.when(F.coalesce(F.col(c).cast("string") == "", F.lit(True)), F.lit(c)) for c in columns)))
    return violation(rows.withColumn("_gap", F.explode(gaps)), "critical", "missing_value", location, "_gap")


def repeated(rows: DataFrame, location: str, *keys: str) -> DataFrame:
    """Critical: a key that must be unique is not; one violation for each key."""
    twice = rows.groupBy(location, *keys).agg(F.count("*").alias("_n")).where("_n > 1")
    return violation(twice, "critical", "duplicate_key", location, F.concat_ws("|", *(F.col(k).cast("string") for k in keys)))


#: Evidence that F3 was not validated, and statuses of a finished validation.
NO_F3 = ("unknown", "unavailable", "unknown_unavailable")
FINISHED = ("validated_success", "success", "validated", "completed")


def claims_stable_without_f3(rows: DataFrame) -> Column:
    """A row that calls itself stable although F3 was never validated.

    Columns, absent ones being null: f3_label, offline_is_stable,
    f3_validation_available, evidence_f3_status, validation_status.
    """
    of = lambda name, kind: (F.col(name) if name in rows.columns else F.lit(None)).cast(kind)
    true = lambda c: F.coalesce(c, F.lit(False))
    claims = true(F.lower(of("f3_label", "string")).isin("pass", "stable")) | true(of("offline_is_stable", "boolean"))
    unavailable = true(of("evidence_f3_status", "string").isin(*NO_F3)) | ~true(of("f3_validation_available", "boolean"))
    return claims & (unavailable | ~true(F.lower(of("validation_status", "string")).isin(*FINISHED)))


def fabricated(rows: DataFrame, location: str) -> DataFrame:
    return violation(rows.where(claims_stable_without_f3(rows)), "critical", "fabricated_stability", location, "candidate_id")


def best_entries(candidates: DataFrame, priority: list[Column]) -> DataFrame:
    """One row of each candidate_id, by a list of preferences (true first)."""
    order = [F.desc(F.coalesce(p, F.lit(False))) for p in priority] + [F.col("_ord")]
    return candidates.withColumn("_rn", F.row_number().over(Window.partitionBy("candidate_id").orderBy(*order))).where("_rn = 1").drop("_rn")


def pair_references(pairs: DataFrame, candidates: DataFrame, location: str) -> DataFrame:
    """Critical: a pair names a candidate that does not exist or of another formula."""
    index = candidates.groupBy("candidate_id").agg(F.collect_set("formula").alias("formulas"))
    sides = pairs.select(location, "formula", F.explode(F.array("chosen_candidate_id", "rejected_candidate_id")).alias("candidate_id"))
    rows = sides.join(index, "candidate_id", "left")
    lost = violation(rows.where("formulas is null"), "critical", "missing_candidate", location, "candidate_id")
    other = rows.where(F.col("formulas").isNotNull() & ~F.array_contains("formulas", F.col("formula")))
    return lost.union(violation(other, "critical", "cross_formula_pair", location, "candidate_id"))


def pair_scores(pairs: DataFrame, location: str, tolerance: float = 1e-9) -> DataFrame:
    """Critical: score order, margin or sign is wrong."""
    gap = F.col("rejected_score") - F.col("chosen_score")
    problem = (
        F.when(F.col("chosen_score").isNull() | F.col("rejected_score").isNull(), "missing_scores")
        .when(gap < 0, "score_order")
        .when(F.abs(gap - F.col("preference_margin")) > tolerance, "margin_mismatch")
        .when(F.col("preference_margin") <= 0, "margin_not_positive")
    )
    return violation(pairs.withColumn("_problem", problem).where("_problem is not null"), "critical", "pair_scores", location, "_problem")


def zero_pairs(summaries: DataFrame) -> DataFrame:
    """A directory without pairs: a warning if documented, else critical.

    ``summaries``: directory, pair_count, documented_reason.
    """
    empty = summaries.where("coalesce(pair_count, 0) = 0")
    known = F.coalesce(F.col("documented_reason") != "", F.lit(False))
    return violation(empty.where(known), "warning", "zero_pairs", "directory", "documented_reason").union(violation(empty.where(~known), "critical", "zero_pairs", "directory", F.lit("undocumented")))


def missing_artifacts(present: DataFrame, expected: list[str]) -> DataFrame:
    """Directories (directory, name) that lack an expected artifact."""
    wanted = present.select("directory").distinct().withColumn("name", F.explode(F.array(*(F.lit(e) for e in expected))))
    return violation(wanted.join(present.select("directory", "name").distinct(), ["directory", "name"], "left_anti"), "critical", "missing_artifact", "directory", "name")


def in_progress(states: DataFrame) -> DataFrame:
    return violation(states.where(F.lower("status").isin("running", "in_progress", "pending")), "warning", "in_progress", "directory", "status")


def all_checks(*violations: DataFrame) -> DataFrame:
    """Union of all checks, distinct."""
    out = violations[0]
    for v in violations[1:]:
        out = out.union(v)
    return out.distinct()


def verdict(violations: DataFrame) -> DataFrame:
    """One row: counts by severity and whether the artifacts are ready."""
    return violations.agg(
        F.count("*").alias("total"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "warning").alias("warnings"),
        (F.count_if(F.col("severity") == "critical") == 0).alias("ready"),
    )


def collection_rollup(artifacts: DataFrame) -> DataFrame:
    """Per-formula state of (formula, kind, candidate_id, estimate, status, reason)."""
    ids = lambda k: F.countDistinct(F.when(F.col("kind") == k, F.col("candidate_id")))
    most = lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("estimate"))), F.lit(0))
    names = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c))))
    return artifacts.groupBy("formula").agg(
        F.greatest(ids("candidate"), most("candidate")).alias("candidates"), F.greatest(ids("audit"), most("audit")).alias("audited"),
        F.greatest(ids("pair"), most("pair")).alias("pairs"), names("status").alias("statuses"), names("reason").alias("reasons"),
    )


def row_count_check(rows: DataFrame, location: str, expected: int) -> DataFrame:
    """Critical: a file does not have the expected number of rows."""
    counts = rows.groupBy(location).agg(F.count("*").alias("_n")).where(F.col("_n") != expected)
    return violation(counts, "critical", "row_count", location, "_n")


def control_gate(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Control tasks (candidate_id, expected) against results (candidate_id, matched)."""
    both = tasks.join(results, "candidate_id", "left")
    state = F.when(F.col("matched").isNull(), "missing").when(F.col("matched") == F.col("expected"), "ok").otherwise("wrong")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("n"))
