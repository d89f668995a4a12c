"""Consensus in detail: metrics of each formula, confidence tiers, readiness of an audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import col, finite, present, reasons
from ..sources import files
from .validate import duplicates, last_wins

#: Largest force of the tiers A and B.
TIER_A, TIER_B = 0.03, 0.04


def confidence_tier(max_force: Column | str) -> Column:
    x = col(max_force)
    return F.when(x <= TIER_A, "A_force_le_0.03").when(x <= TIER_B, "B_force_le_0.04").when(x.isNotNull(), "C_consensus_0.05")


def high_confidence(votes: DataFrame, validators: list[str], max_force: float = 0.05) -> DataFrame:
    """(candidate_id, max_force, tier): every validator converged, stable and within the force.

    ``votes``: one row for each (candidate_id, validator) with force_max,
    relaxation_converged and is_stable.
    """
    good = F.coalesce(F.col("relaxation_converged") & F.col("is_stable"), F.lit(False))
    rows = votes.where(F.col("validator").isin(validators)).groupBy("candidate_id").agg(
        F.count("force_max").alias("n"), F.min(good).alias("all_good"), F.max("force_max").alias("max_force"),
    )
    rows = rows.where((F.col("n") == len(validators)) & F.col("all_good") & (F.col("max_force") <= max_force))
    return rows.select("candidate_id", "max_force", confidence_tier("max_force").alias("tier"))


def high_confidence_candidates(votes: DataFrame, consensus: DataFrame, selected: DataFrame, validators: list[str], max_force: float = 0.05) -> DataFrame:
    """Candidates whose every validator converged, is stable and has a force within the limit, with what the selection says.

    ``votes``: one row for each (candidate_id, validator) with force_max,
    stress_max, energy, relaxation_converged and is_stable. ``consensus``:
    candidate_id, formula, spacegroup, consensus_is_stable, available_votes, stable_votes,
    vote_pattern. ``selected``: candidate_id, spacegroup, num_sites; of several
    rows of an id the last, by ``_ord``. A candidate that was not selected stays, without its fields.
    """
    of = votes.where(F.col("validator").isin(validators))
    x = lambda c: finite(c)
    good = F.coalesce(F.col("relaxation_converged") & F.col("is_stable"), F.lit(False))
    n = len(validators)
    stats = of.groupBy("candidate_id").agg(
        F.count(x("force_max")).alias("_n"), F.min(good).alias("_good"), F.max(x("force_max")).alias("max_force"), F.avg(x("force_max")).alias("mean_force"), F.median(x("force_max")).alias("median_force"),
        (F.max(x("force_max")) - F.min(x("force_max"))).alias("force_spread"), F.max(x("stress_max")).alias("max_stress"), F.avg(x("stress_max")).alias("mean_stress"),
        (F.max(x("energy")) - F.min(x("energy"))).alias("energy_range"), F.avg(x("energy")).alias("mean_energy"),
    ).where((F.col("_n") == n) & F.col("_good") & (F.col("max_force") <= max_force)).drop("_n", "_good")
    agreed = consensus.where(F.col("consensus_is_stable") & (F.col("available_votes") == n)).drop("consensus_is_stable", "available_votes")
    chosen = last_wins(selected, "candidate_id", "_ord").select("candidate_id", F.col("spacegroup").alias("_group"), "num_sites")
    rows = agreed.join(stats, "candidate_id").join(chosen, "candidate_id", "left")
    group = F.when(present("spacegroup"), F.col("spacegroup")).otherwise(F.col("_group"))
    return rows.withColumns({"confidence_tier": confidence_tier("max_force"), "spacegroup": group}).drop("_group")


def top_per_formula(rows: DataFrame, k: int) -> DataFrame:
    """Add rank_within_formula and keep the first k: by tier, largest and mean force, spread, id; what is missing comes last."""
    order = [F.coalesce("confidence_tier", F.lit("Z")), *(F.col(c).asc_nulls_last() for c in ("max_force", "mean_force", "force_spread")), F.col("candidate_id").cast("string")]
    return rows.withColumn("rank_within_formula", F.row_number().over(Window.partitionBy("formula").orderBy(*order))).where(F.col("rank_within_formula") <= k)


def formula_metrics(comparison: DataFrame, selected: DataFrame, generated: int) -> DataFrame:
    """Rates of each formula from comparison rows and the selected candidates.

    ``comparison``: formula, stable_votes, agreement, consensus_is_stable and,
    over the validators, force_max, force_mean and stress_max. ``selected``:
    formula. ``generated`` candidates were made for each formula.
    """
    known = lambda df: df.where("formula != ''")
    chosen = known(selected).groupBy("formula").agg(F.count("*").alias("selected_count"))
    stable = F.col("agreement") & F.col("consensus_is_stable")
    of_stable = lambda c: F.when(stable, F.col(c))
    seen = known(comparison).groupBy("formula").agg(
        F.count("*").alias("validated_count"), F.count_if("agreement").alias("f3_available_count"), F.count_if(stable).alias("stable_consensus_count"),
        F.count_if(F.col("agreement") & ~F.col("consensus_is_stable")).alias("unstable_consensus_count"), F.count_if(~F.col("agreement")).alias("disagreement_count"),
        F.coalesce(F.sum("stable_votes"), F.lit(0)).alias("stable_vote_count"), F.percentile(of_stable("force_max"), 0.5).alias("stable_force_max_median"),
        F.percentile(of_stable("force_max"), 0.9).alias("stable_force_max_p90"), F.percentile(of_stable("force_mean"), 0.5).alias("stable_force_mean_median"), F.percentile(of_stable("stress_max"), 0.5).alias("stable_stress_max_median"),
    )
    rows = chosen.join(seen, "formula", "full_outer").fillna(0, ["selected_count", "validated_count", "f3_available_count", "stable_consensus_count", "unstable_consensus_count", "disagreement_count", "stable_vote_count"])
    share = lambda a, b: F.try_divide(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)
    rows = rows.withColumn("generated_count", F.lit(generated)).withColumn("f1_f2_fail_count", F.when(F.col("selected_count") > 0, F.greatest(generated - F.col("selected_count"), F.lit(0))).otherwise(F.lit(generated)))
    return rows.withColumns({
        "selected_rate": share("selected_count", "generated_count"), "f1_f2_fail_rate": share("f1_f2_fail_count", "generated_count"), "stable_consensus_rate_generated": share("stable_consensus_count", "generated_count"),
        "stable_consensus_rate_validated": share("stable_consensus_count", "validated_count"), "disagreement_rate_validated": share("disagreement_count", "validated_count"),
        "f3_available_rate_validated": share("f3_available_count", "validated_count"), "avg_stable_votes_per_validated": share("stable_vote_count", "validated_count"),
    })


def high_leakage(rows: DataFrame, k: int = 10, least: float = 0.8) -> DataFrame:
    """The k candidates with the highest leakage of at least ``least``; ties by id."""
    return rows.where(F.col("f4_novelty_leakage") >= least).orderBy(F.desc("f4_novelty_leakage"), "candidate_id").limit(k)


def audit_readiness(tasks: DataFrame, results: DataFrame, expected: int, schema_version: str = "f4-audit-task-v1", require_results: bool = True) -> DataFrame:
    """(part, issue): what keeps a novelty audit from being ready; empty if nothing does.

    ``tasks``: task_id, candidate_id, schema_version. ``results``: candidate_id.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string") == "", F.lit(True))
    issue = lambda part, text: F.struct(F.lit(part).alias("part"), text.alias("issue"))
    counts = tasks.agg(F.count("*").alias("n"), F.count_if(blank("task_id")).alias("no_task"), F.count_if(blank("candidate_id")).alias("no_candidate"), F.count_if(~F.col("schema_version").eqNullSafe(F.lit(schema_version))).alias("other"))
    wrong = lambda name: F.concat(F.lit(f"{name}_count_mismatch:expected_{expected}:actual_"), F.col("n").cast("string"))
    whole = counts.select(F.explode(F.array_compact(F.array(
        F.when(F.col("n") != expected, issue("tasks", wrong("task"))), F.when(F.col("no_task") > 0, issue("tasks", F.lit("task_missing_task_id"))),
        F.when(F.col("no_candidate") > 0, issue("tasks", F.lit("task_missing_candidate_id"))), F.when(F.col("other") > 0, issue("tasks", F.lit("unexpected_task_schema_versions"))),
    ))).alias("x")).select("x.*")
    twice = lambda df, key, part, name: duplicates(df.where(~blank(key)), key).select(F.lit(part).alias("part"), F.concat(F.lit(f"{name}:"), F.col(key).cast("string")).alias("issue"))
    out = whole.union(twice(tasks, "task_id", "tasks", "duplicate_task_id")).union(twice(tasks, "candidate_id", "tasks", "duplicate_candidate_id"))
    out = out.union(twice(results, "candidate_id", "results", "duplicate_result_candidate_id"))
    if require_results:
        n = results.agg(F.count("*").alias("n")).where(F.col("n") != expected)
        out = out.union(n.select(F.lit("results").alias("part"), wrong("result").alias("issue")))
    return out


#: Schema of a reference pool's manifest.
POOL_SCHEMA = "f4-reference-pool-manifest-v1"


def shard_counts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, exists, n_rows, n_bad) of the shards a plan names, lines of all present ones counted in one scan."""
    schema = "path string, exists boolean"
    there = {p: files.exists(spark, p) for p in dict.fromkeys(paths)}
    named = spark.createDataFrame(list(there.items()), schema)
    found = [p for p, e in there.items() if e]
    if not found:
        return named.select("*", F.lit(0).cast("long").alias("n_rows"), F.lit(0).cast("long").alias("n_bad"))
    lines = None
    for i in range(0, len(found), 1000):
        some = spark.read.text(found[i : i + 1000]).select("value", F.col("_metadata.file_path").alias("_file")).where("trim(value) != ''")
        lines = some if lines is None else lines.unionByName(some)
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"^[A-Za-z][\w+.-]*:/*", "/"), "/+$", "")  # noqa: E731 - file:/x, file:///x and /x are one path
    good = F.coalesce(F.startswith(F.trim("value"), F.lit("{")) & F.try_parse_json("value").isNotNull(), F.lit(False))
    counts = lines.groupBy(bare(F.col("_file")).alias("_file")).agg(F.count("*").alias("n_rows"), F.count_if(~good).alias("n_bad"))
    # A shard is a file, or a folder of part files.
    by_shard = counts.select(F.explode(F.array("_file", F.regexp_replace("_file", "/[^/]+$", ""))).alias("_path"), "n_rows", "n_bad").groupBy("_path").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_bad").alias("n_bad"))
    out = named.join(by_shard, bare(F.col("path")) == F.col("_path"), "left").drop("_path")
    return out.fillna(0, ["n_rows", "n_bad"])


def shard_issues(shards: DataFrame, expected: int | None) -> DataFrame:
    """(part, issue) of ``shard_counts``: none named, missing, unreadable, or another total than planned."""
    of = lambda rows, name: rows.select(F.lit("shards").alias("part"), F.concat(F.lit(f"{name}:"), "path").alias("issue"))
    total = shards.agg(F.count("*").alias("shards"), F.coalesce(F.sum(F.when(F.col("n_bad") == 0, F.col("n_rows"))), F.lit(0)).alias("n"))
    differs = (F.col("n") != expected) if expected is not None else F.lit(False)
    text = F.when(F.col("shards") == 0, "missing_shard_paths").when(differs, F.concat(F.lit(f"shard_task_count_mismatch:expected_{expected}:actual_"), F.col("n").cast("string")))
    whole = total.select(F.lit("shards").alias("part"), text.alias("issue")).where("issue is not null")
    return of(shards.where("not exists"), "missing_shard").union(of(shards.where("exists and n_bad > 0"), "invalid_shard_jsonl")).union(whole)


def pool_issues(manifest: DataFrame, sources: DataFrame, pool_id: str | None = None) -> DataFrame:
    """(part, issue) of a reference pool.

    ``manifest``: one row of schema_version, example_manifest, reference_pool_id,
    total_reference_count; no row: it is missing. ``sources``: name, reference_count, exists.
    """
    n = manifest.agg(F.count("*").alias("n")).select(F.when(F.col("n") == 0, F.lit("missing_reference_manifest")).alias("issue")).where("issue is not null")
    empty = sources.agg(F.count("*").alias("_n"))  # one row
    row = manifest.crossJoin(empty)
    other = (~F.col("reference_pool_id").eqNullSafe(F.lit(pool_id))) if pool_id else F.lit(False)
    found = reasons(
        ("reference_manifest_schema_mismatch", ~F.col("schema_version").eqNullSafe(F.lit(POOL_SCHEMA))), ("reference_manifest_is_example", F.col("example_manifest")), ("reference_pool_id_mismatch", other),
        ("reference_sources_empty", F.col("_n") == 0), ("reference_pool_empty", F.coalesce("total_reference_count", F.lit(0)) < 1),
    )
    why = F.when(F.coalesce("reference_count", F.lit(0)) < 1, "reference_source_empty").when(~F.coalesce("exists", F.lit(False)), "reference_source_missing")
    each = sources.select(F.concat_ws(":", why, F.coalesce("name", F.lit("None"))).alias("issue"), why.alias("_why")).where("_why is not null").select("issue")
    issues = n.union(row.select(F.explode(found).alias("issue"))).union(each if manifest.limit(1).count() else each.limit(0))
    return issues.select(F.lit("reference_pool").alias("part"), "issue")


def readiness(issues: DataFrame) -> DataFrame:
    """One row: issue_count, ready, and the issues of each part counted."""
    parts = ("tasks", "shards", "reference_pool", "results")
    return issues.agg(F.count("*").alias("issue_count"), (F.count("*") == 0).alias("ready"), *(F.count_if(F.col("part") == p).alias(f"{p}_issues") for p in parts))
