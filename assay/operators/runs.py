"""Summaries over runs, bulk items and workers; feedback events; the seam for external evaluators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels
from ..sources.readers import whole_json
from .loop import evidence, validation_feedback
from .validate import breakdown, last_wins

#: The files of a run, and the metrics taken from its evaluation.
SUMMARY, EVALUATION = "experiment_summary.json", "evaluation_report.json"
METRICS = ("valid_rate", "failure_rate", "top_k_valid_rate", "top_k_average_failure", "average_pair_margin", "average_pair_confidence", "validated_stable_rate", "top_k_validated_stable_rate")


def run_table(spark: SparkSession, folders: list[str]) -> DataFrame:
    """One row for each run folder, from its summary and its evaluation; both must exist.

    Counts are the evaluation's, else the summary's, else 0.
    """
    def read(name: str, prefix: str) -> DataFrame:
        rows = whole_json(spark, [f"{f.rstrip('/')}/{name}" for f in folders]).where("issue is null")
        name_ = F.regexp_extract("file", r"([^/]+)/[^/]+$", 1)  # a file's path comes as a URI
        return rows.select(F.url_decode(F.regexp_replace(name_, r"\+", "%2B")).alias("run_name"), F.col("_raw").alias(prefix))

    get = lambda side, name, kind: F.try_variant_get(side, f"$.{name}", kind)
    both = read(SUMMARY, "s").join(read(EVALUATION, "e"), "run_name")
    count = lambda name: F.coalesce(get("e", name, "bigint"), get("s", name, "bigint"), F.lit(0)).alias(name)
    return both.select(
        "run_name", get("s", "pair_mode", "string").alias("pair_mode"), get("s", "ranking_mode", "string").alias("ranking_mode"), count("candidate_count"), count("pair_count"),
        F.coalesce(get("s", "feedback_count", "bigint"), F.lit(0)).alias("feedback_count"), *(F.coalesce(get("e", n, "bigint"), F.lit(0)).alias(n) for n in ("validation_count", "validation_failure_count")),
        *(get("e", n, "double").alias(n) for n in METRICS),
    )


def bulk_summary(items: DataFrame) -> DataFrame:
    """One row over the items of a bulk run: totals, merged histograms and timing.

    ``items``: status, candidate_count, dpo_eligible_count,
    preference_pair_count, parse_status_counts (map), generation_seconds,
    smoke_seconds, total_seconds.
    """
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    whole = items.agg(
        F.count("*").alias("completed_formula_count"), total("candidate_count").alias("total_candidates"), total("dpo_eligible_count").alias("total_dpo_eligible"), total("preference_pair_count").alias("total_preference_pairs"),
        F.sum("generation_seconds").alias("generation_seconds_total"), F.sum("smoke_seconds").alias("smoke_seconds_total"), F.sum("total_seconds").alias("formula_seconds_total"),
        F.max("total_seconds").alias("max_formula_seconds"), F.avg("total_seconds").alias("average_formula_seconds"),
    )
    merged = items.select(F.explode("parse_status_counts").alias("key", "n")).groupBy("key").agg(F.sum("n").alias("n"))
    merged = merged.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias("parse_status_counts"))
    return whole.crossJoin(breakdown(items, "status").withColumnRenamed("counts", "status_counts")).crossJoin(merged)  # one row each


def worker_summary(rows: DataFrame) -> DataFrame:
    """One row over a worker's validation rows: counts by status and by formula."""
    whole = rows.agg(F.count("*").alias("row_count"), F.count_if(F.col("validation_status") == "completed").alias("completed_count"), F.count_if(F.col("validation_status") == "failed").alias("failed_count"))
    for name, column in (("status_counts", "validation_status"), ("formula_counts", "formula")):
        whole = whole.crossJoin(breakdown(rows, column).withColumnRenamed("counts", name))
    return whole  # one row each


def feedback_events(validation: DataFrame, vectors: DataFrame, round_id: str, order: str = "_ord") -> DataFrame:
    """Feedback of every validation result, with the last failure vector of its candidate."""
    known = last_wins(vectors, "candidate_id", order).drop(order)
    events = validation_feedback(validation).withColumns({"round_id": F.lit(round_id), "source": F.lit("offline_validation")})
    return events.join(known, "candidate_id", "left")


def buffer_counters(events: DataFrame) -> DataFrame:
    """One row: evidence counts and the sorted ids to prefer and to avoid."""
    ids = lambda kind: F.array_sort(F.collect_set(F.when(evidence(kind), F.col("candidate_id"))))
    return events.agg(
        F.count("*").alias("event_count"), F.count_if(evidence("positive")).alias("positive_evidence_count"), F.count_if(evidence("negative")).alias("negative_evidence_count"),
        ids("positive").alias("prefer_candidate_ids"), ids("negative").alias("avoid_candidate_ids"),
    )


def evaluated(rows: DataFrame, kernel: Callable, schema: str, error: str = "oracle_error") -> DataFrame:
    """``kernel`` (pandas frame -> frame of ``schema``) over ``rows``, in batches; rows that raise have nulls and their error."""
    return kernels.evaluated(rows, kernel, [part.split()[0] for part in schema.split(",")], schema, error)
