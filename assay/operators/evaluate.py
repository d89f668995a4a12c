"""One-row reports and audit summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import mean_present, pass_label, python_round, sorted_set
from ..functions.numbering import numbered
from ..functions.session import checkpointed
from .validate import last_wins, novelty_passed, result_succeeded


def rate(count: Column, total: Column) -> Column:
    return F.coalesce(count / F.nullif(total, F.lit(0)), F.lit(0.0))


def label_metrics(labels: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Averages, maxima and rates over labelled candidates.

    f1 and f2 average over all rows, f3 to f5 over the known ones; one threshold
    holds for all axes.
    """
    n = F.count("*")
    failed = ~F.col("is_valid") | (F.col("f1") >= threshold) | (F.col("f2") >= threshold) | F.coalesce(F.col("f3") >= threshold, F.lit(False))
    optional = [c for c in ("f4", "f5") if c in labels.columns]
    return labels.agg(
        n.alias("candidate_count"),
        rate(F.sum("f1"), n).alias("average_f1"), rate(F.sum("f2"), n).alias("average_f2"), F.avg("f3").alias("average_f3"),
        F.coalesce(F.max("f1"), F.lit(0.0)).alias("max_f1"), F.coalesce(F.max("f2"), F.lit(0.0)).alias("max_f2"), F.max("f3").alias("max_f3"),
        *(e for c in optional for e in (F.avg(c).alias(f"average_{c}"), F.max(c).alias(f"max_{c}"))),
        F.count_if("is_valid").alias("valid_count"), rate(F.count_if("is_valid"), n).alias("valid_rate"),
        F.count_if(failed).alias("failed_count"), rate(F.count_if(failed), n).alias("failure_rate"),
        F.count_if(~F.col("is_valid")).alias("hard_failure_count"),
    )


def histogram(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def pair_sums(pairs: DataFrame) -> list[Column]:
    """n, margin, confidence and valid of pairs, or of their counts (``pairs.pair_counts``), which have no confidence."""
    if "n" in pairs.columns:
        return [F.sum("n").alias("n"), F.sum(F.col("margin") * F.col("n")).alias("margin"), F.lit(None).cast("double").alias("confidence"), F.sum("n").alias("valid")]
    sides = F.count_if(F.col("winner_id").isNotNull() & F.col("loser_id").isNotNull())
    return [F.count("*").alias("n"), F.sum("margin").alias("margin"), F.sum("label_confidence").alias("confidence"), sides.alias("valid")]


def pair_metrics(pairs: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    """One row over pairs or their counts; ``sums``: their ``pair_sums`` by some keys, if they are there already."""
    sums = pairs.agg(*pair_sums(pairs)) if sums is None else sums
    total = F.coalesce(F.sum("n"), F.lit(0))
    out = sums.agg(total.alias("pair_count"), *(rate(F.sum(c), total).alias(name) for c, name in (("margin", "average_pair_margin"), ("confidence", "average_pair_confidence"), ("valid", "valid_pair_ratio"))))
    return out.withColumn("average_pair_confidence", F.lit(None).cast("double")) if "n" in pairs.columns else out


def ranking_metrics(ranked: DataFrame, top_k: int | None = None) -> DataFrame:
    """Top-k failure (a missing axis counts 0), valid rate and utility range; k = 0 or none means all."""
    top = F.col("rank") <= top_k if top_k else F.lit(True)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    failure = (zero("f1") + zero("f2") + zero("f3")) / 3.0
    return ranked.agg(
        F.avg(F.when(top, failure)).alias("top_k_average_failure"),
        (F.count_if(top & (F.col("validity") > 0)) / F.nullif(F.count_if(top), F.lit(0))).alias("top_k_valid_rate"),
        F.min("utility").alias("utility_min"), F.max("utility").alias("utility_max"), F.avg("utility").alias("utility_mean"),
    )


def validation_metrics(validation: DataFrame, ranked: DataFrame, top_k: int | None = None, order: str = "_ord") -> DataFrame:
    """Rates over validation results (validated, status, is_stable, e_above_hull,
    novelty_label, error_message) and over the top of a ranking."""
    ok = result_succeeded()
    stable = ok & F.coalesce("is_stable", F.lit(False))
    failed = F.coalesce(F.lower("status").isin("failed", "error"), F.lit(False)) | F.coalesce(F.col("error_message") != "", F.lit(False))
    share = lambda a, b: F.count_if(a) / F.nullif(F.count_if(b), F.lit(0))
    whole = validation.agg(
        F.count("*").alias("validation_count"), rate(F.count_if(ok), F.count("*")).alias("validation_success_rate"),
        F.count_if(stable).alias("validated_stable_count"), share(stable, ok).alias("validated_stable_rate"),
        F.avg(F.when(ok, F.col("e_above_hull"))).alias("average_validated_e_above_hull"),
        F.count_if(ok & novelty_passed()).alias("validated_novel_count"), share(ok & novelty_passed(), ok).alias("validated_novel_rate"),
        F.count_if(failed).alias("validation_failure_count"),
    )
    top = ranked.where(F.col("rank") <= top_k) if top_k else ranked
    columns = ["candidate_id", "validated", "status", "is_stable", "error_message"]
    latest = last_wins(validation.select(*columns, order), "candidate_id", order).withColumn("seen", F.lit(True))
    seen = F.coalesce("seen", F.lit(False))
    part = top.select("candidate_id").join(latest, "candidate_id", "left").agg(
        share(stable, ok).alias("top_k_validated_stable_rate"), (F.count_if(seen) / F.nullif(F.count("*"), F.lit(0))).alias("top_k_validation_coverage"),
    )
    return whole.crossJoin(part)  # one row each


def counts_map(rows: DataFrame, key: str, name: str, weight: str | None = None) -> DataFrame:
    """One row: how often each value of a column of few values occurs; ``weight``: the rows that a row stands for."""
    counts = rows.groupBy(F.col(key).cast("string").alias("key")).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias(name))


def report(labels: DataFrame, pairs: DataFrame, ranked: DataFrame, top_k: int | None = None, threshold: float = 0.1, validation: DataFrame | None = None, order: str = "_ord") -> DataFrame:
    """The one-row evaluation report: one aggregation for each input, and its distributions as maps.

    Tiers (-1 where a label has none), axes and modes (axis_aligned where a pair
    has none) are few by definition. Pairs are many and made once, summed up by
    axis and mode; ``pairs`` may be their counts instead (``pairs.pair_counts``),
    whose confidence is null. Without ``validation`` its metrics are unavailable: counts 0, rates null.
    """
    tiers = labels.select((F.coalesce("calibration_tier", F.lit(-1)) if "calibration_tier" in labels.columns else F.lit(-1)).alias("tier"))
    mode = (F.coalesce("mode", F.lit("axis_aligned")) if "mode" in pairs.columns else F.lit("axis_aligned")).alias("mode")
    modes = checkpointed(pairs.groupBy("axis", mode).agg(*pair_sums(pairs)))
    metrics = pair_metrics(pairs, modes)
    out = label_metrics(labels, threshold).crossJoin(metrics).crossJoin(ranking_metrics(ranked, top_k))  # one row each, as are all below
    out = out.crossJoin(counts_map(tiers, "tier", "calibration_tier_distribution")).crossJoin(counts_map(modes, "axis", "pairs_by_axis", "n")).crossJoin(counts_map(modes, "mode", "pairs_by_mode", "n"))
    if validation is None:
        zero, none = F.lit(0).cast("long"), F.lit(None).cast("double")
        names = {"validation_count": zero, "validation_success_rate": none, "validated_stable_count": zero, "validated_stable_rate": none, "average_validated_e_above_hull": none, "validated_novel_count": zero, "validated_novel_rate": none, "validation_failure_count": zero, "top_k_validated_stable_rate": none, "top_k_validation_coverage": none}
        return out.withColumns(names).withColumn("validation_metrics_available", F.lit(False))
    return out.crossJoin(validation_metrics(validation, ranked, top_k, order)).withColumn("validation_metrics_available", F.lit(True))


# --- Audit -------------------------------------------------------------------


def parse_status(stored: str = "parse_status") -> Column:
    """Stored status, else parsed, error, unparsed or partial."""
    full = (F.size("species") > 0) & (F.size("frac_coords") > 0) & (F.size("lattice_matrix") > 0)
    return (
        F.when(F.col(stored) != "", F.col(stored))
        .when(F.coalesce(full, F.lit(False)), "parsed_full_structure")
        .when(F.col("parse_error_message") != "", "parse_error")
        .when(F.col("structure_ref") != "", "unparsed_cif")
        .otherwise("partial_structure")
    )


def eligibility_reasons(sequence_status: Column, missing: Column, score: str = "failure_score") -> Column:
    """Why a row cannot enter a preference pair; eligible iff empty. ``score`` is the data's name of the score."""
    absent = lambda c: F.coalesce(F.col(c).cast("string") == "", F.lit(True))
    partial = sequence_status == "partial"
    return F.array_compact(F.array(
        F.when(absent("candidate_id"), F.lit("missing_candidate_id")),
        F.when(absent("formula"), F.lit("missing_condition")),
        F.when(sequence_status == "missing", F.lit("missing_raw_sequence")),
        F.when(partial, F.lit("partial_raw_sequence")),
        F.when(partial & (F.size(missing) > 0), F.concat(F.lit("missing_sequence_fields:"), F.array_join(missing, ","))),
        F.when(F.col(score).isNull(), F.lit(f"missing_comparable_{score}")),
        F.when(F.col("parse_status") == "parse_error", F.lit("parse_error")),
    ))


def audit_rows(df: DataFrame, stability_known: bool = False, score: str = "failure_score") -> DataFrame:
    """Add labels, scores and failure reasons to vectorised rows.

    Unless stability is known, f3 is set to null after labelling and the score
    is the mean of the other two. Scores are rounded to six digits.
    """
    f3 = F.col("f3_stability") if stability_known else F.lit(None).cast("double")
    df = df.withColumn("f3_stability", f3)
    reasons = F.concat("hard_failures", F.array(F.when(F.col("parse_status").isin("unparsed_cif", "parse_error", "partial_structure"), F.col("parse_status"))))
    df = df.withColumns({
        "f1_label": pass_label("f1_geometry"), "f2_label": pass_label("f2_chemistry"), "f3_label": pass_label("f3_stability"),
        score: python_round(mean_present(["f1_geometry", "f2_chemistry", "f3_stability"]), 6), "failure_reasons": sorted_set(reasons),
    })
    return df.withColumn("ranking_score", python_round(1.0 - F.col(score), 6))


def duplicate_extra(df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first of each repeated key."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra"))


def top_items(df: DataFrame, key: str, k: int = 10, first_seen: str | None = None) -> DataFrame:
    """The k most frequent values; ties by first appearance or by name."""
    seen = [F.min(first_seen).alias("_first")] if first_seen else []
    counts = df.groupBy(key).agg(F.count("*").alias("n"), *seen)
    return counts.orderBy(F.desc("n"), "_first" if first_seen else key).limit(k).drop("_first")


def summarize_audit(audit: DataFrame) -> DataFrame:
    n = F.count("*")
    unknown = F.col("f3_label").isin("unknown", "unavailable")
    return audit.agg(
        n.alias("total_candidates"),
        *(F.count_if(F.col("parse_status") == s).alias(f"{s}_count") for s in ("parsed_full_structure", "unparsed_cif", "parse_error")),
        *(F.count_if(F.col(f"{a}_label") == r).alias(f"{a}_{r}_count") for a in ("f1", "f2") for r in ("pass", "fail")),
        rate(F.count_if(F.col("f1_label") == "fail"), n).alias("f1_fail_rate"), rate(F.count_if(F.col("f2_label") == "fail"), n).alias("f2_fail_rate"),
        F.count_if(~unknown).alias("f3_available_count"), F.count_if(unknown).alias("f3_unknown_count"), rate(F.count_if(unknown), n).alias("f3_unknown_rate"),
        F.count_if("dpo_eligible").alias("dpo_eligible_count"), F.count_if(~F.col("dpo_eligible")).alias("dpo_ineligible_count"),
    )


def full_audit_summary(audit: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """One row: ``summarize_audit`` with sequences, duplicates, validations and the top reasons.

    ``audit``: as there and raw_sequence_status, source_format, failure_reasons,
    parse_error, f3_validation_available, validation_status, offline_is_stable.
    ``candidates``: composition, structure_ref. Top lists hold (reason, n).
    """
    from .validate import breakdown

    more = audit.agg(
        F.count_if(F.col("raw_sequence_status") == "partial").alias("partial_sequence_count"), F.count_if(F.col("raw_sequence_status") == "missing").alias("missing_raw_sequence_count"),
        F.count_if("f3_validation_available").alias("offline_validation_available_count"), F.count_if(F.col("validation_status").isin("error", "failed", "validation_error")).alias("offline_validation_error_count"),
        F.count_if(F.col("f3_validation_available") & F.col("offline_is_stable")).alias("f3_validated_stable_count"),
    )
    out = summarize_audit(audit).crossJoin(more)  # one row each, as are all below
    for name, column in (("duplicate_composition_count", "composition"), ("duplicate_structure_ref_count", "structure_ref")):
        out = out.crossJoin(duplicate_extra(candidates.where(F.col(column) != ""), column).select(F.col("extra").alias(name)))
    out = out.crossJoin(breakdown(audit, "source_format").withColumnRenamed("counts", "source_format_breakdown"))
    for name, rows in (("top_failure_reasons", audit.select(F.explode("failure_reasons").alias("reason"))), ("top_parse_errors", audit.where("parse_error != ''").select(F.col("parse_error").alias("reason")))):
        top = top_items(rows, "reason", k).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "reason"))).alias("x"))
        out = out.crossJoin(top.select(F.transform("x", lambda e: F.struct(e["reason"].alias("reason"), (-e["n"]).alias("n"))).alias(name)))
    return out


def round_robin(df: DataFrame, shards: int, order: str | list[str]) -> DataFrame:
    """Add shard_id: rows in order dealt to ``shards`` in turn."""
    orders = [order] if isinstance(order, str) else order
    return numbered(df, *orders, name="_place", start=0).withColumn("shard_id", (F.col("_place") % shards).cast("int")).drop("_place")


def chunks(df: DataFrame, size: int, order: str | list[str]) -> DataFrame:
    """Add chunk_id: runs of ``size`` rows in order."""
    orders = [order] if isinstance(order, str) else order
    return numbered(df, *orders, name="_place", start=0).withColumn("chunk_id", F.floor(F.col("_place") / size)).drop("_place")
