"""Queries of validation import, normalisation, matching and the comparison's rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns
from ..operators import checks, compare, dpo, evaluate, rank, validate
from .queries import nine, query
from .views import CAND_SQL, VAL_ORDER, VAL_SQL, cand, table, val

AUDIT = [
    "p_partkey AS candidate_id", "p_partkey AS _ord", "concat('f', p_partkey % 17) AS formula", "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_partkey % 7 END AS spacegroup", "CAST(p_partkey % 4 AS STRING) AS k",
    "CAST((p_partkey * 37) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS f1_geometry", "CAST((p_partkey * 53) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS f2_chemistry", "CAST(NULL AS DOUBLE) AS f3_stability", "p_partkey % 3 <> 0 AS dpo_eligible", "CAST(p_partkey % 9 AS DOUBLE) / CAST(8 AS DOUBLE) AS failure_score",
]
OFFLINE = [
    "l_partkey + CASE WHEN l_orderkey % 41 = 0 THEN 10000000 ELSE 0 END AS candidate_id", "CASE WHEN l_orderkey % 23 = 0 THEN NULL WHEN l_orderkey % 19 = 0 THEN 'other' ELSE concat('f', l_partkey % 17) END AS formula",
    "CASE WHEN l_suppkey % 5 = 0 THEN NULL WHEN l_suppkey % 5 = 1 THEN 99 ELSE l_partkey % 7 END AS spacegroup", "CASE WHEN l_linenumber = 6 THEN '9' ELSE CAST(l_partkey % 4 AS STRING) END AS k",
    "CASE l_linenumber % 5 WHEN 0 THEN 'Failed' WHEN 1 THEN 'running' WHEN 2 THEN 'Success' ELSE 'completed' END AS validation_status", "CASE WHEN l_quantity > 45 THEN 'late' WHEN l_quantity > 40 THEN '' END AS error_reason",
    "CASE WHEN l_quantity % 3 = 0 THEN NULL ELSE l_discount <= CAST(4 AS DOUBLE) / CAST(100 AS DOUBLE) END AS is_stable", "CASE WHEN l_quantity % 4 = 0 THEN NULL ELSE l_tax END AS e_above_hull", "l_returnflag AS validation_source",
    "l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_suppkey", "l_partkey",
]
OFFLINE_ORDER = OFFLINE[-9:]
IMPORT_SQL = f"""audit AS (SELECT {', '.join(AUDIT)} FROM part), off AS (SELECT {', '.join(OFFLINE)} FROM lineitem),
  seen AS (SELECT *, rank() OVER (PARTITION BY candidate_id ORDER BY {', '.join(OFFLINE_ORDER)}) AS rk FROM off),
  st AS (SELECT v.*, CASE WHEN rk > 1 THEN 'duplicate_validation_candidate_id' WHEN a.candidate_id IS NULL THEN 'candidate_not_found' WHEN v.formula IS DISTINCT FROM a.formula THEN 'formula_mismatch'
      WHEN v.spacegroup <> a.spacegroup THEN 'spacegroup_mismatch' WHEN v.k <> a.k THEN 'condition_mismatch'
      WHEN lower(validation_status) IN ('completed', 'success', 'succeeded', 'validated') AND coalesce(error_reason, '') = '' AND (is_stable IS NOT NULL OR e_above_hull IS NOT NULL) THEN 'validated_success' ELSE 'validation_error' END AS import_status,
    CAST(CASE WHEN is_stable OR (is_stable IS NULL AND e_above_hull <= 0.05) THEN 0 WHEN e_above_hull IS NOT NULL THEN greatest(0.3, least(1.0, e_above_hull)) ELSE 1 END AS DOUBLE) AS score
  FROM seen v LEFT JOIN audit a USING (candidate_id))"""


def generation() -> Column:
    return F.create_map(F.lit("K"), F.col("k"), F.lit("empty"), F.lit(""))


def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*AUDIT).withColumn("generation", generation()).drop("k")


def offline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr(*OFFLINE)
    return rows.withColumns({"generation": generation(), "_ord": F.struct(*OFFLINE_ORDER)}).drop("k", *OFFLINE_ORDER)


@query(f"WITH {IMPORT_SQL} SELECT import_status, count(*) AS n, round(sum(CASE WHEN import_status = 'validated_success' THEN score END), 6) AS score FROM st GROUP BY import_status")
def val_import_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validate.import_status(audit_rows(spark, sf_dir), offline_rows(spark, sf_dir)).withColumn("score", F.when(F.col("import_status") == "validated_success", validate.stability_score()))
    return rows.groupBy("import_status").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("score"))


@query(f"""WITH {IMPORT_SQL}, hit AS (SELECT DISTINCT candidate_id, import_status, score FROM st WHERE import_status IN ('validated_success', 'validation_error'))
  SELECT a.candidate_id, coalesce(import_status, 'not_provided') AS validation_status, CASE import_status WHEN 'validated_success' THEN 'offline_validation' WHEN 'validation_error' THEN 'offline_validation_error' ELSE 'unavailable_without_offline_validation' END AS f3_source,
    coalesce(import_status = 'validated_success', false) AS f3_validation_available, CASE import_status WHEN 'validated_success' THEN CASE WHEN score < 0.1 THEN 'pass' ELSE 'fail' END WHEN 'validation_error' THEN 'unknown' END AS f3_label,
    CASE WHEN dpo_eligible THEN CASE import_status WHEN 'validated_success' THEN 'stability_aware_offline_validation' WHEN 'validation_error' THEN 'geometry_chemistry_only' END END AS preference_type,
    CASE WHEN import_status = 'validated_success' THEN score END AS f3_stability, CASE WHEN import_status = 'validated_success' THEN round((f1_geometry + f2_chemistry + score) / 3, 5) ELSE round(a.failure_score, 5) END AS failure_score
  FROM audit a LEFT JOIN hit USING (candidate_id)""")
def val_import_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = validate.import_validation(audit_rows(spark, sf_dir), offline_rows(spark, sf_dir))
    return out.select("candidate_id", "validation_status", "f3_source", "f3_validation_available", "f3_label", "preference_type", "f3_stability", F.round("failure_score", 5).alias("failure_score"))


def as_text(counts: str) -> Column:
    """A breakdown as ``key=n;key=n``."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")


BREAKDOWN_SQL = "(SELECT string_agg(k || '=' || n, ';' ORDER BY k) FROM (SELECT {c} AS k, count(*) AS n FROM {t} GROUP BY 1))"


@query(f"""WITH {IMPORT_SQL}, skipped AS (SELECT * FROM st WHERE import_status <> 'validated_success')
  SELECT (SELECT count(*) FROM audit) AS audit_candidate_count, count(*) AS validation_record_count, count(*) FILTER (import_status IN ('validated_success', 'validation_error')) AS matched_count, count(*) FILTER (import_status = 'validated_success') AS f3_available_count,
    count(*) FILTER (import_status = 'validation_error') AS validation_error_count, count(*) FILTER (import_status <> 'validated_success') AS skipped_count,
    {BREAKDOWN_SQL.format(c='import_status', t='skipped')} AS skip_reasons, {BREAKDOWN_SQL.format(c='validation_source', t='st')} AS validation_source_breakdown FROM st""")
def val_import_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = validate.import_summary(audit_rows(spark, sf_dir), offline_rows(spark, sf_dir))
    return out.withColumns({c: as_text(c) for c in ("skip_reasons", "validation_source_breakdown")})


RAW = [
    "CASE WHEN l_orderkey % 29 = 0 THEN '' ELSE CAST(l_orderkey AS STRING) END AS sample_id", "CASE WHEN l_partkey % 31 = 0 THEN 'null' ELSE concat('f', l_partkey % 17) END AS composition",
    "CASE l_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'mace' ELSE 'chgnet' END AS source", "CASE WHEN l_suppkey % 8 = 0 THEN 'own' END AS validator",
    "CASE l_linenumber WHEN 1 THEN ' OK ' WHEN 2 THEN 'not_converged' WHEN 3 THEN '' WHEN 4 THEN 'Done' WHEN 5 THEN 'queued' WHEN 6 THEN NULL ELSE 'Success' END AS status", "CASE l_linenumber WHEN 1 THEN '2' WHEN 2 THEN 'TierX' WHEN 3 THEN 'UNKNOWN' WHEN 4 THEN 'None' END AS tier",
    "CASE WHEN l_quantity % 5 = 0 THEN 'bad' ELSE CAST(l_discount AS STRING) END AS fmax", "CASE WHEN l_quantity % 7 = 0 THEN 'none' ELSE CAST(l_tax AS STRING) END AS ehull", "CASE l_returnflag WHEN 'A' THEN 'Yes' WHEN 'R' THEN '2' ELSE 'failed' END AS is_stable",
    "CASE WHEN l_linestatus = 'F' THEN 'true' ELSE 'maybe' END AS converged", "CASE WHEN l_quantity % 11 = 0 THEN 'no' ELSE 'pass' END AS relaxed", "CASE WHEN l_quantity % 2 = 0 THEN concat('{\"mode\": \"csp2\", \"spacegroup\": 22', l_linenumber, ', \"generation\": {\"K\": \"', l_linenumber, '\", \"top_k\": \"\"}}') ELSE 'no json' END AS condition",
]
NORMAL_SQL = f"""raw AS (SELECT {', '.join(RAW)}, l_quantity, l_linenumber, l_discount, l_tax FROM lineitem), n AS (
  SELECT nullif(sample_id, '') AS candidate_id, nullif(composition, 'null') AS formula, coalesce(nullif(source, ''), validator) AS validation_source, coalesce(validator, nullif(source, '')) AS validator,
    CASE l_linenumber WHEN 1 THEN 'success' WHEN 2 THEN 'failed' WHEN 4 THEN 'completed' WHEN 5 THEN 'queued' WHEN 7 THEN 'success' ELSE 'unknown' END AS validation_status, CASE l_linenumber WHEN 1 THEN 'tier2' WHEN 2 THEN 'TierX' ELSE 'unknown' END AS calibration_tier,
    CASE WHEN l_quantity % 5 <> 0 THEN l_discount END AS force_max, CASE WHEN l_quantity % 7 <> 0 THEN l_tax END AS energy_above_hull, CASE WHEN converged = 'true' THEN true END AS relaxation_converged, relaxed = 'pass' AS relaxed,
    CASE is_stable WHEN 'Yes' THEN true WHEN 'failed' THEN false END AS given, CASE WHEN l_quantity % 2 = 0 THEN 'csp2' ELSE 'csp' END AS mode, CASE WHEN l_quantity % 2 = 0 THEN 220 + l_linenumber END AS spacegroup, CASE WHEN l_quantity % 2 = 0 THEN CAST(l_linenumber AS VARCHAR) END AS k FROM raw
), d AS (SELECT *, CASE WHEN given IS NOT NULL OR NOT relaxed THEN NULL WHEN force_max IS NULL THEN 'missing_force_max' WHEN relaxation_converged IS NULL THEN 'relaxation_not_converged' WHEN force_max > 0.05 THEN 'force_above_relaxation_stability_threshold' ELSE 'relaxation_converged_below_thresholds' END AS why FROM n),
p AS (SELECT *, coalesce(given, CASE WHEN why = 'relaxation_converged_below_thresholds' THEN true WHEN why <> 'missing_force_max' THEN false END) AS stable FROM d),
good AS (SELECT *, validation_status IN ('completed', 'success') AND (energy_above_hull IS NOT NULL OR stable IS NOT NULL) AS f3 FROM p WHERE candidate_id IS NOT NULL AND formula IS NOT NULL AND validation_source IS NOT NULL),
bad AS (SELECT 'missing required field(s): ' || concat_ws(',', CASE WHEN candidate_id IS NULL THEN 'candidate_id' END, CASE WHEN formula IS NULL THEN 'formula' END, CASE WHEN validation_source IS NULL THEN 'validation_source' END) AS message FROM p WHERE candidate_id IS NULL OR formula IS NULL OR validation_source IS NULL)"""


def normalised(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "lineitem").selectExpr(*RAW, "struct(l_orderkey, l_linenumber) AS _ord")
    return validate.normalize(rows, proxy={})


@query(f"WITH {NORMAL_SQL} SELECT candidate_id, formula, validation_source, validator, validation_status, calibration_tier, force_max, energy_above_hull, relaxation_converged, stable AS is_stable, why AS relaxation_proxy_reason, mode, spacegroup, k, f3 AS f3_available_after_normalization FROM good")
def val_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalised(spark, sf_dir)[0].select(
        "candidate_id", "formula", "validation_source", "validator", "validation_status", "calibration_tier", "force_max", "energy_above_hull", "relaxation_converged", "is_stable", "relaxation_proxy_reason", "mode", F.col("spacegroup").cast("int").alias("spacegroup"),
        F.col("generation_condition")["K"].alias("k"), "f3_available_after_normalization",
    )


@query(f"WITH {NORMAL_SQL} SELECT message, count(*) AS n FROM bad GROUP BY message")
def val_normalize_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.histogram(normalised(spark, sf_dir)[1], "message")


@query(f"""WITH {NORMAL_SQL}, twice AS (SELECT candidate_id FROM good GROUP BY 1 HAVING count(*) > 1), lost AS (SELECT count(*) AS n FROM good WHERE CAST(candidate_id AS BIGINT) NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))
  SELECT count(*) AS normalized_row_count, count(*) FILTER (validation_status NOT IN ('completed', 'success')) AS failed_or_incomplete_count, count(*) FILTER (f3) AS f3_available_candidate_count,
    (SELECT count(*) FROM bad) + (SELECT count(*) FROM twice) + (SELECT n FROM lost) AS issue_count, (SELECT count(*) FROM bad) AS missing_required_field_count, (SELECT n FROM lost) AS candidate_not_found_count, CAST(0 AS BIGINT) AS formula_mismatch_count, (SELECT count(*) FROM twice) AS duplicate_validation_candidate_id_count,
    {BREAKDOWN_SQL.format(c='validation_source', t='good')} AS validation_source_breakdown, {BREAKDOWN_SQL.format(c='validation_status', t='good')} AS validation_status_breakdown, {BREAKDOWN_SQL.format(c='calibration_tier', t='good')} AS calibration_tier_breakdown FROM good""")
def val_normalization_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, issues = normalised(spark, sf_dir)
    # Orders that are not finished are in the index under ids that no row has.
    key = F.col("o_orderkey").cast("string")
    index = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", key).otherwise(F.concat(F.lit("open "), key)).alias("candidate_id"), F.lit(None).cast("string").alias("formula"))
    out = validate.normalization_summary(rows, issues, validate.check_index(rows, index))
    return out.withColumns({c: as_text(c) for c in ("validation_source_breakdown", "validation_status_breakdown", "calibration_tier_breakdown")})


@query("""WITH r AS (SELECT CASE WHEN l_quantity % 11 = 0 THEN NULL ELSE l_quantity % 11 < 9 END AS relaxed, CASE WHEN l_quantity % 7 = 0 THEN NULL ELSE l_discount END AS f, CASE WHEN l_quantity % 5 = 0 THEN NULL ELSE l_tax END AS s, l_linestatus = 'F' AS c FROM lineitem)
  SELECT reason, is_stable, count(*) AS n FROM (SELECT CASE WHEN NOT coalesce(relaxed, false) THEN NULL WHEN f IS NULL THEN 'missing_force_max' WHEN NOT c THEN 'relaxation_not_converged' WHEN f > 0.05 THEN 'force_above_relaxation_stability_threshold'
    WHEN s > 0.06 THEN 'stress_above_relaxation_stability_threshold' WHEN s IS NULL THEN 'missing_stress_max' ELSE 'relaxation_converged_below_thresholds' END AS reason,
    CASE WHEN NOT coalesce(relaxed, false) OR f IS NULL THEN NULL ELSE c AND f <= 0.05 AND coalesce(s <= 0.06, false) END AS is_stable FROM r) GROUP BY ALL""")
def relaxation_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_quantity") % 11 != 0, F.col("l_quantity") % 11 < 9).alias("relaxed"), F.lit(None).cast("boolean").alias("relax_requested"), F.when(F.col("l_quantity") % 7 != 0, F.col("l_discount")).alias("force_max"),
        F.when(F.col("l_quantity") % 5 != 0, F.col("l_tax")).alias("stress_max"), (F.col("l_linestatus") == "F").alias("relaxation_converged"),
    )
    return evaluate.histogram(rows.select(validate.relaxation_proxy(max_stress=0.06).alias("x")).select("x.*"), "reason", "is_stable")


WORDS = "CASE p_partkey % 13 WHEN 0 THEN 'true' WHEN 1 THEN 'False' WHEN 2 THEN 'pass' WHEN 3 THEN 'stable' WHEN 4 THEN 'no' WHEN 5 THEN 'maybe' WHEN 6 THEN '' WHEN 7 THEN NULL WHEN 8 THEN '0' WHEN 9 THEN '2' WHEN 10 THEN '221.7' WHEN 11 THEN 'NaN' ELSE 'None' END"


@query(f"""WITH w AS (SELECT p_partkey, {WORDS} AS t, lower({WORDS}) AS x FROM part), v AS (SELECT *, t IS NULL OR t IN ('', 'None') AS gone FROM w)
  SELECT p_partkey, CASE WHEN t IS NOT NULL THEN t <> '' END AS c1, CASE WHEN gone THEN NULL WHEN x IN ('false', 'no', '0') THEN false ELSE true END AS c2,
    CASE WHEN gone THEN NULL WHEN x IN ('true', 'pass', 'stable') THEN true WHEN x IN ('false', 'no', '0') THEN false END AS c3, CASE WHEN gone THEN NULL WHEN x = 'true' THEN true WHEN x IN ('false', 'no', '0') THEN false END AS c4,
    CAST(CASE t WHEN '0' THEN 0 WHEN '2' THEN 2 WHEN '221.7' THEN 221.7 END AS DOUBLE) AS number, CAST(CASE t WHEN '0' THEN 0 WHEN '2' THEN 2 WHEN '221.7' THEN 221 END AS BIGINT) AS whole FROM v""")
def coercion_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{WORDS} AS t")
    whole = F.when(F.col("t") != "NaN", columns.to_int("t"))
    return rows.select("p_partkey", columns.bool_c1("t").alias("c1"), columns.bool_c2("t").alias("c2"), columns.bool_c3("t").alias("c3"), columns.bool_c4("t").alias("c4"), columns.double_finite("t").alias("number"), whole.alias("whole"))


DELTAS = {name: f"CASE WHEN c_custkey % {m} = 0 THEN NULL ELSE CAST(c_custkey % {m} - {m // 2} AS DOUBLE) / CAST(10 AS DOUBLE) END" for name, m in (
    ("stable_consensus_rate", 5), ("all_three_agreement_rate", 7), ("disagreement_count", 9), ("unique_sequence_fraction", 11), ("spacegroup_count", 13), ("f1_fail_rate", 15), ("f2_fail_rate", 17), ("average_stable_vote_fraction_all_generated", 19),
)}


@query(f"""WITH d AS (SELECT c_custkey, {', '.join(f'{e} AS {n}' for n, e in DELTAS.items())} FROM customer)
  SELECT c_custkey, concat_ws('; ', CASE WHEN stable_consensus_rate > 0 AND all_three_agreement_rate < 0 THEN 'stable consensus rate increased while all-three agreement rate decreased' END,
    CASE WHEN stable_consensus_rate > 0 AND disagreement_count > 0 THEN 'stable consensus rate increased while disagreement count increased' END,
    CASE WHEN stable_consensus_rate > 0 AND (unique_sequence_fraction < 0 OR spacegroup_count < 0) THEN 'stable consensus rate increased while diversity/coverage decreased' END,
    CASE WHEN stable_consensus_rate > 0 AND (f1_fail_rate > 0 OR f2_fail_rate > 0) THEN 'stable consensus rate increased while F1/F2 fail rate increased' END,
    CASE WHEN NOT coalesce(stable_consensus_rate > 0, false) AND NOT coalesce(average_stable_vote_fraction_all_generated > 0, false) THEN 'no observed strict-consensus stable-rate improvement in this matched proxy audit' END) AS reasons FROM d""")
def divergence_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", *(f"{e} AS delta_{n}" for n, e in DELTAS.items()))
    return compare.divergence_reasons(rows).select("c_custkey", F.array_join("divergence_reasons", "; ").alias("reasons"))


PANEL = [
    "CASE WHEN l_orderkey % 37 = 0 THEN '' ELSE concat('run-', l_partkey + CASE WHEN l_orderkey % 31 = 0 THEN 10000000 ELSE 0 END) END AS candidate_id", "CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE 'own' END AS formula",
    "CASE WHEN l_linenumber = 5 THEN 'failed' ELSE 'completed' END AS validation_status", "l_discount AS a", "CASE WHEN l_quantity % 9 = 0 THEN NULL ELSE l_tax END AS b", "l_discount + l_tax AS c",
    "l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_suppkey", "l_partkey",
]
PANEL_ORDER = PANEL[-9:]
MATCHED = [
    "p_partkey AS candidate_id", "p_partkey AS _ord", "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'audit' END AS formula", "CASE WHEN p_partkey % 23 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN 1.0 ELSE 0.0 END AS f1", "CAST(0 AS DOUBLE) AS f2",
    "CASE WHEN p_partkey % 29 = 0 THEN '' ELSE '1' END AS x", "CASE WHEN p_partkey % 17 = 0 THEN false WHEN p_partkey % 2 = 0 THEN true END AS dpo_eligible", "CASE WHEN p_partkey % 13 = 0 THEN 'parse_error' ELSE 'parsed_full_structure' END AS parse_status",
]


@query(f"""WITH con AS (SELECT {', '.join(PANEL)} FROM lineitem), aud AS (SELECT {', '.join(MATCHED)} FROM part), j AS (SELECT con.*, aud.candidate_id AS found, aud.formula AS own, f1, f2, x, dpo_eligible, parse_status FROM con LEFT JOIN aud ON con.candidate_id = 'run-' || aud.candidate_id),
  r AS (SELECT *, rank() OVER (PARTITION BY candidate_id ORDER BY {', '.join(PANEL_ORDER)}) AS rk FROM j)
  SELECT skip_reason, count(*) AS n, round(sum(CASE WHEN skip_reason IS NULL THEN (a + b + c) / 3 END), 6) AS force FROM (SELECT *, CASE WHEN candidate_id = '' THEN 'missing_consensus_candidate_id' WHEN found IS NULL THEN 'missing_audit_candidate' WHEN rk > 1 THEN 'duplicate_consensus_candidate_id'
    WHEN validation_status <> 'completed' THEN 'consensus_not_completed' WHEN a IS NULL OR b IS NULL OR c IS NULL THEN 'missing_three_mlip_force_evidence' WHEN x = '' THEN 'missing_raw_sequence' WHEN f1 IS NULL OR f2 IS NULL THEN 'missing_f1_or_f2'
    WHEN f1 <> 0 OR f2 <> 0 THEN 'f1_f2_not_passing' WHEN NOT coalesce(dpo_eligible, true) THEN 'not_dpo_eligible' WHEN parse_status = 'parse_error' THEN 'parse_error' WHEN formula = '' AND own = '' THEN 'missing_formula' END AS skip_reason FROM r) GROUP BY skip_reason""")
def f3_matched_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    forces = F.create_map(*(F.lit(x) if isinstance(x, str) and x in dpo.MODELS else F.col(x) for pair in zip(dpo.MODELS, "abc", strict=True) for x in pair))
    consensus = table(spark, sf_dir, "lineitem").selectExpr(*PANEL).select("candidate_id", "formula", "validation_status", forces.alias("forces"), F.struct(*PANEL_ORDER).alias("_ord"))
    sequence = F.create_map(*(y for n in dpo.SEQUENCE for y in (F.lit(n), F.col("x") if n == "X" else F.lit("1"))))
    audit = table(spark, sf_dir, "part").selectExpr(*MATCHED).withColumns({"sequence": sequence, "f1": F.col("f1").cast("double")}).drop("x")
    out = dpo.match_candidates(consensus, audit, "run-")
    return out.groupBy("skip_reason").agg(F.count("*").alias("n"), F.round(F.sum("mean_force"), 6).alias("force"))


@query("""SELECT 'critical' AS severity, 'fabricated_stability' AS "check", CAST(o_orderkey AS VARCHAR) AS location, CAST(o_custkey AS VARCHAR) AS detail FROM (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'Pass' WHEN 1 THEN 'fail' WHEN 2 THEN 'stable' END AS label, o_orderkey % 7 = 0 AS off,
    CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 9 <> 1 END AS avail, CASE WHEN o_orderkey % 11 = 0 THEN 'unknown' ELSE 'offline_validation' END AS ev, CASE o_orderstatus WHEN 'O' THEN 'Completed' WHEN 'F' THEN 'failed' END AS st FROM orders)
  WHERE (coalesce(lower(label) IN ('pass', 'stable'), false) OR off) AND (ev = 'unknown' OR NOT coalesce(avail, false) OR coalesce(lower(st), '') NOT IN ('validated_success', 'success', 'validated', 'completed'))""")
def qa_fabricated_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("candidate_id"), F.when(k % 4 == 0, "Pass").when(k % 4 == 1, "fail").when(k % 4 == 2, "stable").alias("f3_label"), (k % 7 == 0).alias("offline_is_stable"), F.when(k % 3 != 0, k % 9 != 1).alias("f3_validation_available"),
        F.when(k % 11 == 0, "unknown").otherwise("offline_validation").alias("evidence_f3_status"), F.when(F.col("o_orderstatus") == "O", "Completed").when(F.col("o_orderstatus") == "F", "failed").alias("validation_status"),
    )
    return checks.fabricated(rows, "o_orderkey")


@query("SELECT o_orderkey FROM orders")
def unique_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order once; a repeated key would raise."""
    return validate.unique_or_raise(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query(f"""WITH {CAND_SQL}, {VAL_SQL}, o AS (SELECT *, greatest(0, 1.0 - (f1 + f2 + least(coalesce(f3, 1), 1)) / 3) AS success, atoms::DOUBLE / 100 AS cost FROM cand WHERE is_valid),
  t AS (SELECT candidate_id, row_number() OVER (ORDER BY 0.4::DOUBLE * success + 0.2::DOUBLE * confidence + 0.15::DOUBLE + 0.15::DOUBLE * novelty + 0.1::DOUBLE * diversity - 0.05::DOUBLE * cost DESC, _ord) AS rank FROM o QUALIFY rank <= 30),
  l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY {', '.join(c + ' DESC' for c in VAL_ORDER)}) AS rn FROM val) WHERE rn = 1) SELECT candidate_id, CAST(rank AS INTEGER) AS rank, validation_status, l_orderkey FROM t LEFT JOIN l USING (candidate_id)""")
def rankings_with_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = rank.rank_by_utility(cand(spark, sf_dir), top_k=30).select("candidate_id", "rank")
    rows = val(spark, sf_dir).select("candidate_id", "validation_status", "l_orderkey", F.struct(*VAL_ORDER).alias("_ord"))
    return validate.join_rankings(top, rows)


@query(f"WITH {CAND_SQL} SELECT o_orderkey, CASE WHEN c.candidate_id IS NULL THEN 'candidate_not_found' WHEN c.prototype <> '' AND c.prototype IS DISTINCT FROM f THEN 'formula_mismatch' END AS issue FROM (SELECT o_orderkey, o_custkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'Brand#11' END AS f FROM orders) o LEFT JOIN cand c ON c.candidate_id = o.id")
def index_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("candidate_id"), F.when(F.col("o_orderkey") % 5 != 0, "Brand#11").alias("formula"))
    index = cand(spark, sf_dir).select("candidate_id", F.col("prototype").alias("formula"))
    return validate.check_index(rows, index).select("o_orderkey", "issue")


@query("""WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey % 6 AS DOUBLE) END AS c, CAST(o_orderkey % 5 AS DOUBLE) AS r, CAST(o_orderkey % 5 - o_orderkey % 6 AS DOUBLE) + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS m FROM orders),
  p AS (SELECT o_orderkey, CASE WHEN c IS NULL OR r IS NULL THEN 'missing_scores' WHEN r - c < 0 THEN 'score_order' WHEN abs(r - c - m) > 1e-9 THEN 'margin_mismatch' WHEN m <= 0 THEN 'margin_not_positive' END AS detail FROM s) SELECT 'critical' AS severity, 'pair_scores' AS "check", CAST(o_orderkey AS VARCHAR) AS location, detail FROM p WHERE detail IS NOT NULL""")
def qa_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    margin = (k % 5 - k % 6).cast("double") + F.when(k % 7 == 0, 1.0).otherwise(0.0)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 6 != 0, (k % 6).cast("double")).alias("chosen_score"), (k % 5).cast("double").alias("rejected_score"), margin.alias("preference_margin"))
    return checks.pair_scores(rows, "o_orderkey")


@query("""WITH d AS (SELECT c_nationkey AS directory, CASE WHEN c_nationkey % 3 = 0 THEN 0 ELSE count(*) END AS pairs, CASE WHEN c_nationkey % 2 = 0 THEN 'too few' ELSE '' END AS reason, CASE WHEN c_nationkey % 5 = 0 THEN 'RUNNING' ELSE 'done' END AS status FROM customer GROUP BY c_nationkey)
  SELECT CASE WHEN reason <> '' THEN 'warning' ELSE 'critical' END AS severity, 'zero_pairs' AS "check", CAST(directory AS VARCHAR) AS location, CASE WHEN reason <> '' THEN reason ELSE 'undocumented' END AS detail FROM d WHERE pairs = 0
  UNION ALL SELECT 'warning', 'in_progress', CAST(directory AS VARCHAR), status FROM d WHERE status = 'RUNNING' UNION ALL SELECT 'critical', 'row_count', CAST(c_nationkey AS VARCHAR), CAST(count(*) AS VARCHAR) FROM customer GROUP BY c_nationkey HAVING count(*) <> 6""")
def qa_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "directory")
    d = F.col("directory")
    state = rows.groupBy("directory").agg(F.count("*").alias("n")).select("directory", F.when(d % 3 == 0, 0).otherwise(F.col("n")).alias("pair_count"), F.when(d % 2 == 0, "too few").otherwise("").alias("documented_reason"), F.when(d % 5 == 0, "RUNNING").otherwise("done").alias("status"))
    return checks.all_checks(checks.zero_pairs(state), checks.in_progress(state), checks.row_count_check(rows, "directory", 6))


@query(f"""WITH {CAND_SQL}, p AS (SELECT o_orderkey, 'Brand#' || CAST(11 + o_orderkey % 3 AS VARCHAR) AS formula, unnest([o_custkey, o_custkey + 1]) AS id FROM orders), j AS (SELECT p.*, c.prototype FROM p LEFT JOIN cand c ON c.candidate_id = p.id)
  SELECT 'critical' AS severity, CASE WHEN prototype IS NULL THEN 'missing_candidate' ELSE 'cross_formula_pair' END AS "check", CAST(o_orderkey AS VARCHAR) AS location, CAST(id AS VARCHAR) AS detail FROM j WHERE prototype IS NULL OR prototype <> formula""")
def qa_pair_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Brand#"), (11 + F.col("o_orderkey") % 3).cast("string")).alias("formula"), F.col("o_custkey").alias("chosen_candidate_id"), (F.col("o_custkey") + 1).alias("rejected_candidate_id"))
    return checks.pair_references(rows, cand(spark, sf_dir).select("candidate_id", F.col("prototype").alias("formula")), "o_orderkey")


@query(f"""WITH {CAND_SQL}, s AS (SELECT candidate_id, CASE WHEN f1 < 0.1 THEN 'pass' ELSE 'fail' END AS f1_label, CASE WHEN f2 < 0.1 THEN 'pass' ELSE 'fail' END AS f2_label, round((f1 + f2) / 2, 6) AS score, CASE WHEN candidate_id % 3 = 0 THEN 'unparsed_cif' WHEN candidate_id % 5 = 0 THEN 'parse_error' ELSE 'parsed_full_structure' END AS ps, is_valid FROM cand)
  SELECT candidate_id, f1_label, f2_label, 'unknown' AS f3_label, score AS failure_score, round(1 - score, 6) AS ranking_score, concat_ws(';', CASE WHEN NOT is_valid THEN 'hard' END, CASE WHEN ps <> 'parsed_full_structure' THEN ps END) AS reasons FROM s""")
def audit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("candidate_id")
    rows = cand(spark, sf_dir).select(
        "candidate_id", F.col("f1").alias("f1_geometry"), F.col("f2").alias("f2_chemistry"), F.col("f3").alias("f3_stability"), F.when(F.col("is_valid"), F.array().cast("array<string>")).otherwise(F.array(F.lit("hard"))).alias("hard_failures"),
        F.when(k % 3 == 0, "unparsed_cif").when(k % 5 == 0, "parse_error").otherwise("parsed_full_structure").alias("parse_status"),
    )
    out = evaluate.audit_rows(rows)
    return out.select("candidate_id", "f1_label", "f2_label", "f3_label", "failure_score", "ranking_score", F.array_join("failure_reasons", ";").alias("reasons"))


@query("""WITH f AS (SELECT p_partkey, p_partkey % 6 AS m, CASE WHEN p_partkey % 6 > 0 THEN 'g' END AS g, CASE WHEN p_partkey % 6 > 1 THEN 'w' ELSE '' END AS w FROM part) SELECT p_partkey, CASE m WHEN 0 THEN 'missing' WHEN 5 THEN 'full' ELSE 'partial' END AS status FROM f""")
def sequence_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    fields = F.create_map(*(x for i, n in enumerate(dpo.SEQUENCE) for x in (F.lit(n), F.when(F.col("p_partkey") % 6 > i, n).otherwise(""))))
    return rows.select("p_partkey", dpo.sequence_status(fields).alias("status"))
