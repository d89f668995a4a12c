"""Queries of whole audit rows, formula forces on two sides, high-confidence rows and the readiness of a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, compare, detail, validate
from ..sources import outputs
from .io_queries import folder
from .queries import CONSENSUS_SQL, nine, query
from .views import CAND, VAL_ORDER, VALIDATORS, table, val

#: Scalars of a candidate's metadata; Spark puts them into JSON, the oracle takes them as they are.
META = [
    "p_partkey AS k", "CASE WHEN p_partkey % 11 = 0 THEN 'free' END AS mode", "p_partkey % 11 = 1 AS null_mode", "CASE p_partkey % 5 WHEN 0 THEN 'NaCl' WHEN 1 THEN '' END AS formula_condition", "CASE WHEN p_partkey % 7 > 0 THEN concat('X', p_partkey % 3) END AS composition",
    "CASE p_partkey % 4 WHEN 0 THEN '12.0' WHEN 1 THEN 'none' WHEN 3 THEN CAST(p_partkey % 230 AS STRING) END AS sg", "CASE WHEN p_partkey % 3 = 0 THEN 'm' END AS model", "CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'cold' END AS temp", "CASE WHEN p_partkey % 6 < 4 THEN 'warm' END AS temp2",
    "CASE WHEN p_partkey % 8 = 0 THEN p_partkey % 50 END AS top_k", "CASE WHEN p_partkey % 3 = 1 THEN 'other' END AS temp3", "CASE WHEN p_partkey % 10 > 0 THEN 'g' ELSE '' END AS g", "CASE WHEN p_partkey % 20 > 1 THEN 'w' END AS w", "p_partkey % 12 AS n_atoms", "CASE WHEN p_partkey % 13 = 0 THEN 'full' END AS stored_sequence",
    "CASE p_partkey % 9 WHEN 0 THEN 'parsed_full_structure' WHEN 1 THEN '' END AS stored_parse", "CASE WHEN p_partkey % 9 = 2 THEN 'no cell' END AS message", "CASE WHEN p_partkey % 18 = 3 THEN 'ValueError' END AS error_type", "CASE WHEN p_partkey % 9 < 6 THEN 'ref' ELSE '' END AS ref",
    "CASE WHEN p_partkey % 17 = 0 THEN 'KernelError: stopped' END AS oracle_error",
]


def rows_with_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    some = lambda x: F.when(F.col(x).isNotNull(), F.col(x))
    m = table(spark, sf_dir, "part").selectExpr(*META, *(x for x in CAND if x.split(" AS ")[-1] in ("f1", "f2", "f3", "is_valid")))
    atoms = F.when(c("n_atoms") > 0, F.array_repeat(F.lit(11), 2)).otherwise(F.array().cast("array<int>"))
    body = F.to_json(F.struct(
        some("mode").alias("condition_mode"), "formula_condition", c("sg").alias("spacegroup_condition"), c("model").alias("source_model"), c("temp").alias("temperature"), "top_k",
        F.struct(c("temp2").alias("temperature"), c("temp3").alias("sample_temperature"), F.lit(7).alias("K")).alias("sampling_metadata"),
        F.when(c("k") % 14 > 0, F.struct(c("g"), atoms.alias("A"), F.lit("x").alias("X"), F.lit("l").alias("L"))).alias("raw_sequence_fields"), c("w").alias("raw_W"),
        c("stored_sequence").alias("raw_sequence_status"), F.when(c("stored_sequence").isNotNull(), F.array().cast("array<string>")).alias("missing_sequence_fields"),
        c("stored_parse").alias("parse_status"), c("message").alias("parse_error_message"), c("error_type").alias("parse_error_type"),
    ))
    text = F.when(c("null_mode"), F.concat(F.lit('{"condition_mode":null,'), F.substr(body, F.lit(2)))).otherwise(body)
    whole = lambda kind, value: F.when(c("k") % 9 == 4, value).cast(kind)
    return m.select(
        c("k").alias("candidate_id"), "composition", c("ref").alias("structure_ref"), whole("array<string>", F.array(F.lit("Na"))).alias("species"), whole("array<array<double>>", F.array(F.array(F.lit(0.0)))).alias("frac_coords"), whole("array<array<double>>", F.array(F.array(F.lit(5.0)))).alias("lattice_matrix"),
        c("f1").alias("f1_geometry"), c("f2").alias("f2_chemistry"), c("f3").alias("f3_stability"), F.when(~c("is_valid"), F.array(F.lit("hard"))).alias("hard_failures"), "oracle_error", F.parse_json(text).alias("metadata"),
    )


PARTS = [x for x in CAND if x.split(" AS ")[-1] in ("f1", "f2", "f3", "is_valid")]


@query(f"""WITH m AS (SELECT {', '.join(META)}, {', '.join(PARTS)} FROM part),
  q AS (SELECT *, coalesce(nullif(formula_condition, ''), composition) AS formula, CASE WHEN k % 4 = 2 THEN 5 ELSE CASE WHEN sg <> 'none' THEN CAST(CAST(sg AS DOUBLE) AS BIGINT) END END AS spacegroup, oracle_error IS NOT NULL AS broken,
    concat_ws(';', 'K=7', 'sample_temperature=' || temp3, 'source_model=' || model, 'temperature=' || coalesce(nullif(temp, ''), temp2), 'top_k=' || top_k) AS generation,
    CASE WHEN stored_sequence IS NOT NULL THEN '' ELSE concat_ws(',', CASE WHEN k % 14 = 0 OR g = '' THEN 'g' END, CASE WHEN w IS NULL THEN 'W' END, CASE WHEN k % 14 = 0 OR n_atoms = 0 THEN 'A' END, CASE WHEN k % 14 = 0 THEN 'X' END, CASE WHEN k % 14 = 0 THEN 'L' END) END AS missing,
    CASE WHEN stored_parse <> '' THEN stored_parse WHEN k % 9 = 4 THEN 'parsed_full_structure' WHEN message <> '' THEN 'parse_error' WHEN ref <> '' THEN 'unparsed_cif' ELSE 'partial_structure' END AS ps FROM m),
  s AS (SELECT *, CASE WHEN broken THEN 1.0 ELSE f1 END AS g1, CASE WHEN broken THEN 1.0 ELSE f2 END AS g2, CASE WHEN NOT broken THEN f3 END AS g3, CASE WHEN stored_sequence IS NOT NULL THEN 'full' WHEN missing = 'g,W,A,X,L' THEN 'missing' WHEN missing <> '' THEN 'partial' ELSE 'full' END AS seq FROM q),
  t AS (SELECT *, CASE WHEN g3 IS NULL THEN (g1 + g2) / 2 ELSE (g1 + g2 + g3) / 3 END AS raw, concat_ws(';', CASE WHEN formula IS NULL THEN 'missing_condition' END, CASE WHEN seq = 'missing' THEN 'missing_raw_sequence' END, CASE WHEN seq = 'partial' THEN 'partial_raw_sequence;missing_sequence_fields:' || missing END, CASE WHEN ps = 'parse_error' THEN 'parse_error' END) AS why FROM s),
  u AS (SELECT *, CAST(format('{{:.6f}}', raw) AS DOUBLE) AS score FROM t)
  SELECT k AS candidate_id, CASE WHEN null_mode THEN NULL ELSE coalesce(mode, 'csp') END AS mode, formula, spacegroup, generation, seq AS raw_sequence_status, missing AS missing_sequence_fields, ps AS parse_status,
    CASE WHEN g1 < 0.1 THEN 'pass' ELSE 'fail' END AS f1_label, CASE WHEN g2 < 0.1 THEN 'pass' ELSE 'fail' END AS f2_label, CASE WHEN g3 IS NULL THEN 'unknown' WHEN g3 < 0.1 THEN 'pass' ELSE 'fail' END AS f3_label,
    score AS failure_score, round(1 - score, 6) AS ranking_score, why = '' AS dpo_eligible, why AS dpo_ineligible_reasons, concat_ws(';', CASE WHEN NOT is_valid AND NOT broken THEN 'hard' END, CASE WHEN broken THEN 'oracle_error' END, CASE WHEN ps <> 'parsed_full_structure' THEN ps END) AS failure_reasons,
    CASE WHEN why = '' AND g3 IS NULL THEN 'geometry_chemistry_only' END AS preference_type, coalesce(oracle_error, nullif(message, ''), error_type) AS parse_error, CASE WHEN g3 IS NULL THEN 'unknown_unavailable' ELSE 'available' END AS f3_status FROM u""")
def audited_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every audit field of every candidate, its metadata in all the places that may hold them."""
    out = audit.audit_candidates(rows_with_metadata(spark, sf_dir), spacegroup=5, stability_mode="offline")
    entries = F.array_sort(F.transform(F.map_entries("condition.generation"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    join = lambda c, by: F.array_join(c, by).alias(c)
    return out.select(
        "candidate_id", "condition.mode", "condition.formula", "condition.spacegroup", F.array_join(entries, ";").alias("generation"), "raw_sequence_status", join("missing_sequence_fields", ","), "parse_status", "f1_label", "f2_label", "f3_label",
        "failure_score", "ranking_score", "dpo_eligible", join("dpo_ineligible_reasons", ";"), join("failure_reasons", ";"), "preference_type", "evidence.parse_error", "evidence.f3_status",
    )


STATS_SQL = "count(x) FILTER ({w}) AS {s}_{n}_count, avg(x) FILTER ({w}) AS {s}_{n}_mean, quantile_cont(x, 0.5) FILTER ({w}) AS {s}_{n}_median, quantile_cont(x, 0.9) FILTER ({w}) AS {s}_{n}_p90"
WHICH_SQL = {"all_validated": "true", "model_stable": "is_stable", "consensus_stable": "c", "disagreement": "c IS NULL"}
SIDES_SQL = ", ".join(STATS_SQL.format(w=f"side = '{s}' AND {w}", s=s, n=n) for s in ("before", "after") for n, w in WHICH_SQL.items())
STAT_NAMES = [f"{n}_{x}" for n in WHICH_SQL for x in ("count", "mean", "median", "p90")]


def rounded(column: str) -> str:
    return column if column.endswith("_count") else f"round({column}, 9)"


@query(f"""WITH {CONSENSUS_SQL}, v AS (SELECT CASE WHEN candidate_id % 3 = 0 THEN 'before' ELSE 'after' END AS side, CASE WHEN candidate_id % 31 = 0 THEN '' ELSE p_type END AS formula, validator, force_max AS x, is_stable, CASE WHEN agreement THEN stable_votes = 3 END AS c
    FROM last JOIN (SELECT candidate_id, agreement, stable_votes FROM cons) USING (candidate_id) JOIN part ON p_partkey = candidate_id),
  w AS (SELECT formula, validator, {SIDES_SQL} FROM v WHERE formula <> '' GROUP BY ALL), e AS (SELECT formula, validator FROM (SELECT DISTINCT formula FROM w), (SELECT unnest(['A', 'B', 'C']) AS validator))
  SELECT formula, validator, {', '.join(f"{f'coalesce({s}_{n}, 0)' if n.endswith('_count') else rounded(f'{s}_{n}')} AS {s}_{n}" for s in ('before', 'after') for n in STAT_NAMES)},
    {', '.join(f"{f'coalesce(after_{n}, 0) - coalesce(before_{n}, 0)' if n.endswith('_count') else f'round(after_{n} - before_{n}, 9) + 0'} AS delta_{n}" for n in STAT_NAMES)} FROM e LEFT JOIN w USING (formula, validator)""")
def force_by_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = validate.consensus_with_latest(val(spark, sf_dir), VALIDATORS, VAL_ORDER).select("candidate_id", "consensus_is_stable", "latest")
    formulas = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("candidate_id"), F.when(F.col("p_partkey") % 31 == 0, "").otherwise(F.col("p_type")).alias("formula"))
    both = decided.join(formulas, "candidate_id").select("candidate_id", "formula", "consensus_is_stable", F.explode("latest").alias("x")).select("candidate_id", "formula", "consensus_is_stable", "x.validator", "x.force_max", "x.is_stable")
    first = F.col("candidate_id") % 3 == 0
    out = nine(compare.force_by_formula(both.where(first), both.where(~first), VALIDATORS))
    return out.withColumns({c: F.col(c) + 0.0 for c, t in out.dtypes if c.startswith("delta_") and t == "double"})  # a zero has no sign


@query(f"""WITH {CONSENSUS_SQL}, g AS (SELECT candidate_id, max(force_max) AS max_force, avg(force_max) AS mean_force, median(force_max) AS median_force, max(force_max) - min(force_max) AS force_spread, max(stress_max) AS max_stress, avg(stress_max) AS mean_stress, max(energy) - min(energy) AS energy_range, avg(energy) AS mean_energy
    FROM last GROUP BY 1 HAVING count(force_max) = 3 AND bool_and(coalesce(relaxation_converged AND is_stable, false)) AND max(force_max) <= 0.1),
  h AS (SELECT g.*, 'f' || candidate_id % 4 AS formula, vote_pattern, stable_votes, CASE WHEN max_force <= 0.03 THEN 'A_force_le_0.03' WHEN max_force <= 0.04 THEN 'B_force_le_0.04' ELSE 'C_consensus_0.05' END AS confidence_tier FROM g JOIN cons USING (candidate_id) WHERE agreement AND cons.stable_votes = 3),
  r AS (SELECT *, row_number() OVER (PARTITION BY formula ORDER BY confidence_tier, max_force, mean_force, force_spread, CAST(candidate_id AS VARCHAR)) AS k FROM h), s AS (SELECT p_partkey, p_size FROM part WHERE p_partkey % 5 > 0)
  SELECT candidate_id, formula, confidence_tier, CASE WHEN candidate_id % 3 > 0 THEN candidate_id % 3 ELSE p_size % 230 END AS spacegroup, p_size AS num_sites, vote_pattern, stable_votes, max_force, round(mean_force, 9) AS mean_force, round(median_force, 9) AS median_force, round(force_spread, 9) AS force_spread, max_stress, round(mean_stress, 9) AS mean_stress,
    round(energy_range, 9) AS energy_range, round(mean_energy, 9) AS mean_energy, CAST(k AS INTEGER) AS rank_within_formula FROM r LEFT JOIN s ON p_partkey = candidate_id WHERE k <= 5""")
def high_confidence_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of each formula, joined to what was selected."""
    rows, c = val(spark, sf_dir), F.col("candidate_id")
    latest = validate.last_wins(rows, ["candidate_id", "validator"], VAL_ORDER)
    decided = validate.consensus(rows, VALIDATORS, VAL_ORDER).select("candidate_id", F.concat(F.lit("f"), (c % 4).cast("string")).alias("formula"), (c % 3).alias("spacegroup"), "consensus_is_stable", "available_votes", "stable_votes", "vote_pattern")
    chosen = table(spark, sf_dir, "part").where("p_partkey % 5 > 0").select(F.col("p_partkey").alias("candidate_id"), (F.col("p_size") % 230).alias("spacegroup"), F.col("p_size").alias("num_sites"), F.col("p_partkey").alias("_ord"))
    return nine(detail.top_per_formula(detail.high_confidence_candidates(latest, decided, chosen, VALIDATORS, 0.1), 5))


@query("""WITH n AS (SELECT count(*) AS n, count(*) FILTER (c_custkey % 4 = 1) AS bad FROM customer), d AS (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) > 1)
  SELECT 'tasks' AS part, 'task_count_mismatch:expected_7:actual_' || n AS issue FROM n UNION ALL SELECT 'tasks', 'duplicate_candidate_id:' || c_nationkey FROM d UNION ALL SELECT 'shards', 'missing_shard:4' UNION ALL SELECT 'shards', 'invalid_shard_jsonl:1'
  UNION ALL SELECT 'shards', 'shard_task_count_mismatch:expected_7:actual_' || (n - bad) FROM n UNION ALL SELECT 'reference_pool', unnest(['reference_manifest_schema_mismatch', 'reference_pool_id_mismatch'])
  UNION ALL SELECT 'reference_pool', CASE WHEN n_regionkey = 0 THEN 'reference_source_empty:' ELSE 'reference_source_missing:' END || n_name FROM nation WHERE n_regionkey < 2 UNION ALL SELECT 'results', 'result_count_mismatch:expected_7:actual_' || count(*) FROM nation""")
def plan_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks, written shards (one with broken lines, one missing), reference pool and results against a plan of seven tasks."""
    k = F.col("c_custkey")
    tasks = table(spark, sf_dir, "customer").select(k.alias("task_id"), F.col("c_nationkey").alias("candidate_id"), F.lit("f4-audit-task-v1").alias("schema_version"), (k % 4).cast("int").alias("shard_id"))
    paths = outputs.write_shards(tasks, path := folder(spark, "plan"), 4)
    broken = f"{path}/broken.jsonl"
    tasks.where("shard_id = 1").select(F.concat(F.lit("{"), F.col("task_id").cast("string")).alias("value")).write.text(broken)
    paths = [paths[0], broken, *paths[2:], f"{path}/none.jsonl"]
    shards = detail.shard_issues(detail.shard_counts(spark, paths), 7)
    for i, p in enumerate(paths):
        shards = shards.withColumn("issue", F.replace("issue", F.lit(p), F.lit(str(i))))
    manifest = table(spark, sf_dir, "nation").agg(F.lit("v0").alias("schema_version"), F.lit(False).alias("example_manifest"), F.lit("pool").alias("reference_pool_id"), F.count("*").alias("total_reference_count"))
    sources = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("reference_count"), (F.col("n_regionkey") > 1).alias("exists"))
    results = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("candidate_id"))
    return detail.audit_readiness(tasks, results, 7).union(shards).union(detail.pool_issues(manifest, sources, "another"))
