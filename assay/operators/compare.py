"""Distributions, rates and before/after comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite
from ..functions.quantiles import summary
from ..functions.session import checkpointed


def quantiles(x: Column | str, *qs: float) -> list[Column]:
    """Exact linearly interpolated quantiles, as p50, p90, ..."""
    return [F.percentile(x, q).alias(f"p{q * 100:g}") for q in qs]


def metric_summary(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """count, min, quantiles and max of the finite values, by ``keys``."""
    qs = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    return summary(df, list(keys), finite(column), qs).select(*keys, "n", "min", *qs, "max")


#: The overlapping subsets of validated candidates.
SUBSETS = ("all", "consensus_stable", "consensus_unstable", "disagreement", "validator_stable", "validator_unstable")


def subset_tags() -> Column:
    """Subsets a row belongs to; columns consensus_is_stable and is_stable."""
    c, s = F.col("consensus_is_stable"), F.col("is_stable")
    return F.array_compact(F.array(
        F.lit("all"), F.when(c, F.lit("consensus_stable")), F.when(~c, F.lit("consensus_unstable")), F.when(c.isNull(), F.lit("disagreement")),
        F.when(s, F.lit("validator_stable")), F.when(~s, F.lit("validator_unstable")),
    ))


def force_stats(rows: DataFrame, *keys: str, value: str = "force_max") -> DataFrame:
    """Force distribution of each subset, by ``keys``: one pass, tags exploded."""
    tagged = rows.select(*keys, finite(value).alias("_v"), F.explode(subset_tags()).alias("subset")).where("_v is not null")
    qs = {"p50": 0.5, "p90": 0.9, "p95": 0.95}
    return summary(tagged, [*keys, "subset"], "_v", qs, mean=True).select(*keys, "subset", "n", "mean", *qs, "max")


#: The subsets and statistics of a formula's forces, before and after.
FORMULA_SUBSETS, FORMULA_STATS = ("all_validated", "model_stable", "consensus_stable", "disagreement"), ("count", "mean", "median", "p90")


def force_by_formula(before: DataFrame, after: DataFrame, validators: list[str]) -> DataFrame:
    """Forces of each formula and validator on both sides: before_, after_ and delta_ of each subset's statistics.

    Sides: formula, validator, force_max, is_stable, consensus_is_stable. A
    formula occurs if either side has a finite force of it, then with every
    validator; a side without values counts 0 and has no other statistic.
    Disagreement is a null consensus; rows without a formula are left out.
    """
    side = lambda df, name: df.select(F.lit(name).alias("side"), "formula", "validator", finite("force_max").alias("_v"), "is_stable", "consensus_is_stable")
    rows = side(before, "before").unionByName(side(after, "after")).where(F.col("_v").isNotNull() & (F.col("formula") != "") & F.col("validator").isin(validators))
    c = F.col("consensus_is_stable")
    tags = F.array_compact(F.array(F.lit(FORMULA_SUBSETS[0]), F.when(F.col("is_stable"), F.lit(FORMULA_SUBSETS[1])), F.when(c, F.lit(FORMULA_SUBSETS[2])), F.when(c.isNull(), F.lit(FORMULA_SUBSETS[3]))))
    keys = ["formula", "validator", "side", "subset"]
    tagged = rows.select("formula", "validator", "side", "_v", F.explode(tags).alias("subset"))
    stats = summary(tagged, keys, "_v", {"median": 0.5, "p90": 0.9}, mean=True).withColumnRenamed("n", "count")
    stats = checkpointed(stats)  # one row for each formula, validator, side and subset
    of = lambda s, name, stat: F.max(F.when((F.col("side") == s) & (F.col("subset") == name), F.col(stat)))
    wide = stats.groupBy("formula", "validator").agg(*(of(s, n, x).alias(f"{s}_{n}_{x}") for n in FORMULA_SUBSETS for x in FORMULA_STATS for s in ("before", "after")))
    every = stats.select("formula").distinct().select("formula", F.explode(F.array(*(F.lit(v) for v in validators))).alias("validator"))
    out = every.join(wide, ["formula", "validator"], "left").fillna(0, [f"{s}_{n}_count" for s in ("before", "after") for n in FORMULA_SUBSETS])
    return out.withColumns({f"delta_{n}_{x}": F.col(f"after_{n}_{x}") - F.col(f"before_{n}_{x}") for n in FORMULA_SUBSETS for x in FORMULA_STATS})


def mean_force_stats(rows: DataFrame) -> DataFrame:
    """(subset, n, p50, p90, max) of mean_force; disagreement is agreement = false."""
    label = F.when(~F.col("agreement"), "disagreement").when(F.col("consensus_is_stable"), "consensus_stable").otherwise("consensus_unstable")
    tagged = rows.where("mean_force is not null").select("mean_force", F.explode(F.array(F.lit("all"), label)).alias("subset"))
    qs = {"p50": 0.5, "p90": 0.9}
    return summary(tagged, ["subset"], "mean_force", qs).select("subset", "n", *qs, "max")


def formula_table(rows: DataFrame, key: str = "formula", high: float = 0.5) -> DataFrame:
    """Quantiles, high counts and the worst candidate of each formula."""
    order = F.struct("force_max", F.col("candidate_id"))
    x = F.col("force_max")
    return rows.groupBy(key).agg(
        F.count("*").alias("n"), F.count(x).alias("measured"), *quantiles("force_max", 0.5, 0.9), F.max(x).alias("max"),
        F.count_if(x > high).alias("high_count"), (F.count_if(x > high) / F.count("*")).alias("high_rate"),
        F.max_by("candidate_id", F.when(x.isNotNull(), order)).alias("worst_id"),
    )


def entropy(df: DataFrame, key: str) -> DataFrame:
    """Natural-log entropy and number of the values of ``key``."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("distinct"))
    p = F.col("n") / F.col("total")
    return counts.crossJoin(F.broadcast(total)).agg(F.max("distinct").alias("distinct"), F.max("total").alias("total"), (-F.sum(p * F.ln(p))).alias("entropy"))


def side_metrics(candidates: DataFrame) -> DataFrame:
    """Coverage and validity of one side of a comparison.

    Columns: candidate_id, formula, sequence (text), space_group, f1_label,
    f2_label, dpo_eligible. A space group of 0 counts as absent.
    """
    n = F.count("*")
    share = lambda c: F.count_if(c) / F.nullif(n, F.lit(0))
    return candidates.agg(
        n.alias("candidates"), F.countDistinct("formula").alias("formulas"), F.countDistinct("sequence").alias("unique_sequences"),
        (F.countDistinct("sequence") / F.nullif(n, F.lit(0))).alias("unique_rate"),
        F.countDistinct(F.when(F.col("space_group") != 0, F.col("space_group"))).alias("space_groups"),
        share(F.col("f1_label") == "pass").alias("f1_pass_rate"), share(F.col("f2_label") == "pass").alias("f2_pass_rate"), share("dpo_eligible").alias("eligible_rate"),
    )


def side_report(candidates: DataFrame, consensus: DataFrame, votes: DataFrame, pairs: int | None = None) -> DataFrame:
    """One row: the wide report of one side of a comparison; maps hold the breakdowns.

    ``candidates``: formula, sequence, space_group, prototype, f1_label,
    f2_label, dpo_eligible. ``consensus``: rows of ``validate.consensus``.
    ``votes``: (validator, is_stable) of the candidates in it. Rates over
    nothing are null.
    """
    from .validate import breakdown

    n = F.count("*")
    group = F.when(F.col("space_group") != 0, F.col("space_group"))
    whole = candidates.agg(
        n.alias("candidate_count"), F.count_if("dpo_eligible").alias("dpo_eligible_count"), F.count_if(F.col("f1_label") != "pass").alias("f1_fail_count"), F.count_if(F.col("f2_label") != "pass").alias("f2_fail_count"),
        F.countDistinct(F.when(F.col("formula") != "", F.col("formula"))).alias("formula_count"), F.countDistinct("sequence").alias("unique_sequence_count"), F.countDistinct(group).alias("spacegroup_count"), F.countDistinct("prototype").alias("prototype_count"),
    )
    agreed = consensus.agg(
        F.count("*").alias("overlap_count"), F.count_if(F.col("consensus_is_stable")).alias("strict_three_mlip_stable_consensus_count"), F.count_if(~F.col("consensus_is_stable")).alias("unstable_consensus_count"),
        F.count_if(~F.col("agreement")).alias("disagreement_count"), F.try_divide(F.count_if("agreement"), F.count("*")).alias("all_three_agreement_rate"),
    )
    voted = votes.agg(F.countDistinct("validator").alias("validator_count"), F.count_if("is_stable").alias("stable_vote_count"))
    shares = entropy(candidates.select(group.alias("g")), "g").select(F.col("entropy").alias("spacegroup_entropy"))
    top = candidates.where("formula != ''").groupBy("formula").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("_most"))
    out = whole.crossJoin(agreed).crossJoin(voted).crossJoin(shares).crossJoin(top)  # one row each
    for name, rows, column in (("formula_coverage", candidates.where("formula != ''"), "formula"), ("spacegroup_coverage", candidates.where(group.isNotNull()), "space_group"), ("prototype_coverage", candidates.where("prototype is not null"), "prototype"), ("vote_pattern_counts", consensus, "vote_pattern")):
        out = out.crossJoin(breakdown(rows, column).withColumnRenamed("counts", name))
    share = lambda a, *b: F.try_divide(F.col(a), *(b if b and not isinstance(b[0], str) else map(F.col, b)))
    available = F.col("strict_three_mlip_stable_consensus_count") + F.col("unstable_consensus_count")
    rate = {"dpo_eligible_rate": "dpo_eligible_count", "f1_fail_rate": "f1_fail_count", "f2_fail_rate": "f2_fail_count", "stable_consensus_rate": "strict_three_mlip_stable_consensus_count", "dominant_formula_fraction": "_most", "unique_sequence_fraction": "unique_sequence_count", "average_stable_votes_per_generated_candidate": "stable_vote_count"}
    out = out.withColumn("f3_available_count", available).withColumns({k: share(v, "candidate_count") for k, v in rate.items()}).withColumns({
        "f3_available_rate": share("f3_available_count", "candidate_count"), "stable_consensus_rate_among_f3_available": share("strict_three_mlip_stable_consensus_count", "f3_available_count"),
        "average_stable_vote_fraction_all_generated": share("stable_vote_count", F.col("validator_count") * F.col("candidate_count")), "average_stable_votes_per_validated_candidate": share("stable_vote_count", "overlap_count"),
        "average_stable_vote_fraction_validated": share("stable_vote_count", F.col("validator_count") * F.col("overlap_count")), "preference_pair_yield": F.lit(pairs).cast("double"),
    })
    return out.drop("_most")


def before_after(before: DataFrame, after: DataFrame, key: str, *values: str) -> DataFrame:
    """Full outer join on ``key`` with before_x, after_x and delta_x."""
    left = before.select(key, *(F.col(v).alias(f"before_{v}") for v in values))
    right = after.select(key, *(F.col(v).alias(f"after_{v}") for v in values))
    both = left.join(right, key, "full_outer")
    return both.withColumns({f"delta_{v}": F.col(f"after_{v}") - F.col(f"before_{v}") for v in values})


#: Why a comparison diverges from its proxy.
DIVERGENCE = (
    "stable consensus rate increased while all-three agreement rate decreased",
    "stable consensus rate increased while disagreement count increased",
    "stable consensus rate increased while diversity/coverage decreased",
    "stable consensus rate increased while F1/F2 fail rate increased",
    "no observed strict-consensus stable-rate improvement in this matched proxy audit",
)


def divergence_reasons(delta: DataFrame) -> DataFrame:
    """Add divergence_reasons from the signs of the deltas; a missing delta has none.

    Columns: delta_ of stable_consensus_rate, all_three_agreement_rate,
    disagreement_count, unique_sequence_fraction, spacegroup_count, f1_fail_rate,
    f2_fail_rate and average_stable_vote_fraction_all_generated.
    """
    up = lambda name: F.coalesce(F.col(f"delta_{name}") > 0, F.lit(False))
    down = lambda name: F.coalesce(F.col(f"delta_{name}") < 0, F.lit(False))
    stable = up("stable_consensus_rate")
    rules = [
        stable & down("all_three_agreement_rate"), stable & up("disagreement_count"), stable & (down("unique_sequence_fraction") | down("spacegroup_count")),
        stable & (up("f1_fail_rate") | up("f2_fail_rate")), ~stable & ~up("average_stable_vote_fraction_all_generated"),
    ]
    return delta.withColumn("divergence_reasons", F.array_compact(F.array(*(F.when(rule, F.lit(why)) for rule, why in zip(rules, DIVERGENCE, strict=True)))))


def logprob_deltas(scores: DataFrame, before: str, after: str) -> DataFrame:
    """(candidate_id, delta) of candidates scored under both checkpoints."""
    of = lambda name: F.max(F.when(F.col("checkpoint_label") == name, F.col("logp_total")))
    rows = scores.groupBy("candidate_id").agg(of(before).alias("before"), of(after).alias("after"), F.first("consensus_label").alias("consensus_label"))
    return rows.where("before is not null and after is not null").withColumn("delta", F.col("after") - F.col("before"))


def logprob_groups(scores: DataFrame) -> DataFrame:
    """Count, mean and median of the scores of each checkpoint, label, side and reason."""
    keys = ["checkpoint_label", "consensus_label", "source_side", "panel_reason"]
    return summary(scores, keys, "logp_total", {"median": 0.5}, mean=True).select(*keys, "n", "mean", "median")


def logprob_delta_groups(scores: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """(kind, label, n, mean, median) of the deltas by consensus label and by panel reason, and the stable less the unstable mean.

    ``kind`` is consensus_label, panel_reason or stable_minus_unstable (one row,
    if both labels occur). A candidate's last row, by ``_ord``, says its label
    and reason.
    """
    of = lambda name: F.max_by("logp_total", F.when(F.col("checkpoint_label") == name, F.col("_ord")))
    rows = scores.groupBy("candidate_id").agg(of(before).alias("b"), of(after).alias("a"), F.max_by(F.struct("consensus_label", "panel_reason"), "_ord").alias("m")).where("a is not null and b is not null")
    tags = F.array(*(F.struct(F.lit(k).alias("kind"), F.coalesce(F.col(f"m.{k}"), F.lit("None")).alias("label")) for k in ("consensus_label", "panel_reason")))
    tagged = checkpointed(rows.select((F.col("a") - F.col("b")).alias("delta"), F.explode(tags).alias("t")).select("t.*", "delta"))
    groups = summary(tagged, ["kind", "label"], "delta", {"median": 0.5}, mean=True).select("kind", "label", "n", "mean", "median")
    mean = lambda label: F.avg(F.when(F.col("label") == label, F.col("delta")))
    gap = tagged.where("kind = 'consensus_label'").agg((mean("stable") - mean("unstable")).alias("mean")).where("mean is not null")
    return groups.unionByName(gap.select(F.lit("stable_minus_unstable").alias("kind"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("long").alias("n"), "mean", F.lit(None).cast("double").alias("median")))


def compare_modes(reports: dict[str, DataFrame]) -> DataFrame:
    """One row for each pair-construction mode."""
    rows = None
    for mode, report in reports.items():
        one = report.select(F.lit(mode).alias("mode"), "*")
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    return rows
