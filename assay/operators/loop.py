"""Feedback buffer and the active loop.

``active_loop`` is a driver loop over batch jobs: a fixed small number of
rounds, each of which starts from the base candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from ..functions.session import checkpointed
from .rank import feedback_records, rank_by_utility, screen, validation_tasks
from .validate import result_succeeded


#: Decision and action of each outcome of a validation.
POSITIVE = ("positive_evidence", "sample_similar_mock_family")
FAILED = ("negative_evidence", "treat_failed_validation_as_future_negative")
UNSTABLE = ("negative_evidence", "avoid_similar_high_failure_candidates")
PENDING = ("pending_evidence", "defer_until_validation_completes")


def validation_feedback(validation: DataFrame) -> DataFrame:
    """(candidate_id, decision, action) from validation results.

    Columns: candidate_id, validated, status, is_stable, error_message.
    """
    ok, failed = result_succeeded(), F.coalesce(F.lower("status").isin("failed", "error"), F.lit(False))
    outcome = lambda pair: F.struct(F.lit(pair[0]).alias("decision"), F.lit(pair[1]).alias("action"))
    chosen = F.when(ok & F.col("is_stable"), outcome(POSITIVE)).when(failed, outcome(FAILED)).when(ok & ~F.col("is_stable"), outcome(UNSTABLE)).otherwise(outcome(PENDING))
    return validation.select("candidate_id", chosen.alias("_o")).select("candidate_id", "_o.*")


def evidence(kind: str) -> Column:
    """Whether an event is evidence of this kind (positive or negative)."""
    return F.coalesce(F.col("decision").isin(kind, f"{kind}_evidence"), F.lit(False))


def buffer_summary(events: DataFrame) -> DataFrame:
    """Counts and sorted ids; evidence against a candidate that is also positive is ignored."""
    ids = events.groupBy("candidate_id").agg(F.max(evidence("positive").cast("int")).alias("plus"), F.max(evidence("negative").cast("int")).alias("minus"))
    return ids.agg(F.count_if(F.col("plus") == 1).alias("positive_ids"), F.count_if((F.col("minus") == 1) & (F.col("plus") == 0)).alias("negative_ids"))


def adjusted(base: DataFrame, events: DataFrame) -> DataFrame:
    """Base candidates with the buffer's evidence: positives first, then by id."""
    ids = events.groupBy("candidate_id").agg(F.max(evidence("positive")).alias("plus"), F.max(evidence("negative")).alias("minus"))
    rows = base.join(ids, "candidate_id", "left")
    plus = F.coalesce("plus", F.lit(False))
    minus = F.coalesce("minus", F.lit(False)) & ~plus
    rows = rows.withColumns({"f3": F.when(minus, F.greatest(F.coalesce("f3", F.lit(0.5)), F.lit(0.8))).when(plus, F.lit(0.0)).otherwise(F.col("f3")), "_plus": plus})
    return numbered(rows, F.desc("_plus"), "candidate_id", name="_ord", start=0).select(*base.columns)


def active_loop(base: DataFrame, validation: DataFrame | None = None, rounds: int = 2, top_k: int = 3) -> DataFrame:
    """(round_id, candidate_id, selected_rank, decision): the selections of each round."""
    out, events = None, base.select("candidate_id", F.lit("selected").alias("decision")).limit(0)
    for k in range(1, rounds + 1):
        ranked = rank_by_utility(screen(adjusted(base, events)).where("screen_status = 'pass'"), top_k=top_k)
        picked = checkpointed(feedback_records(validation_tasks(ranked, top_k)).select(F.lit(k).alias("round_id"), "candidate_id", "selected_rank", "decision"))
        out = picked if out is None else out.union(picked)
        events = events.union(picked.select("candidate_id", "decision"))
        if k == 1 and validation is not None:
            events = events.union(validation_feedback(validation).select("candidate_id", "decision"))
    return out
