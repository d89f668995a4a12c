"""Queries of pair checks with context, reference matching and Python's rounding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import python_round
from ..functions.joins import dealt
from ..operators import pair_qa, reference_match
from .queries import query
from .views import percent, table

#: Scalars of the artifact rows; Spark puts them into JSON, the oracle takes them as they are.
PLAIN_ROWS = [
    "CASE WHEN p_partkey % 97 = 0 THEN '' ELSE concat('c', p_partkey % 1500) END AS id", "concat('r', p_partkey % 3) AS root", "CASE WHEN p_partkey % 41 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN concat('f', (p_partkey + 1) % 5) ELSE concat('f', p_partkey % 5) END AS formula",
    "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(p_partkey % 5 % 2 AS STRING) END AS k", "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_partkey % 5 END AS sg", "CAST(NULL AS STRING) AS label", "CAST(NULL AS BOOLEAN) AS available", "CAST(NULL AS STRING) AS status", "CAST(NULL AS BOOLEAN) AS stable",
    "CAST(NULL AS BOOLEAN) AS eligible", "CAST(p_partkey AS BIGINT) AS ord", "false AS audited",
]
AUDIT_ROWS = [
    "CASE WHEN c_custkey % 89 = 0 THEN NULL ELSE concat('c', c_custkey % 1200) END AS id", "concat('r', c_custkey % 2) AS root", "CASE WHEN c_custkey % 7 = 0 THEN concat('f', (c_custkey + 2) % 5) ELSE concat('f', c_custkey % 5) END AS formula",
    "CAST(c_custkey % 5 % 2 AS STRING) AS k", "c_custkey % 5 AS sg", "CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Pass' WHEN 2 THEN 'stable' ELSE 'fail' END AS label", "CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS available",
    "CASE WHEN c_custkey % 3 = 0 THEN 'validation_error' ELSE 'validated_success' END AS status", "CASE WHEN c_custkey % 8 < 6 THEN c_custkey % 8 < 3 END AS stable", "CASE WHEN c_custkey % 5 > 0 THEN true END AS eligible", "1000000000 + CAST(c_custkey AS BIGINT) AS ord", "true AS audited",
]
PAIR_ROWS = [
    "CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE concat('p', o_orderkey) END AS pair_id", "concat('r', o_custkey % 3) AS root", "o_orderkey % 61 <> 0 AS has_condition", "CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE concat('f', (o_custkey + CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END) % 5) END AS formula",
    "CAST(o_custkey % 5 % 2 AS STRING) AS k", "CASE WHEN o_orderkey % 67 = 0 THEN NULL ELSE concat('c', o_custkey % 1700) END AS chosen", "concat('c', (o_custkey + 5 * (o_orderkey % 4)) % 1700) AS rejected",
    "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 6 END AS chosen_score", "o_orderkey % 5 AS rejected_score", "o_orderkey % 5 - o_orderkey % 6 + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS margin",
    "CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE 'g' END AS chosen_g", "CASE WHEN o_orderkey % 21 > 0 THEN 'l' END AS rejected_l", "CASE WHEN o_orderkey % 38 = 0 THEN 'raw' END AS documented", "CASE o_orderkey % 12 WHEN 3 THEN 'other' WHEN 7 THEN NULL WHEN 0 THEN 'geometry_chemistry_only' ELSE 'stability_aware_offline_validation' END AS kind",
    "CASE WHEN o_orderkey % 10 < 4 THEN 'same_formula_rank_neighbor_f3_pairing_v1' END AS rule", "CASE WHEN o_orderkey % 20 > 2 THEN '0.2' END AS matgl", "CASE WHEN o_orderkey % 3 = 0 THEN 'offline_validation_imported' END AS vector_status",
    "CASE WHEN o_orderkey % 23 = 0 THEN 'f1' END AS chosen_formula", "CASE WHEN o_orderkey % 31 = 0 THEN 'f2' END AS rejected_formula", "CASE WHEN o_orderkey % 23 = 0 THEN '1' END AS chosen_k", "CASE WHEN o_orderkey % 37 = 0 THEN '3.0' END AS chosen_sg",
]


def candidate_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(table(spark, sf_dir, "part").select("p_partkey")).selectExpr(*PLAIN_ROWS).unionByName(dealt(table(spark, sf_dir, "customer").select("c_custkey")).selectExpr(*AUDIT_ROWS))
    body = F.struct(
        F.col("id").alias("candidate_id"), F.struct("formula", F.when(F.col("k").isNotNull(), F.struct(F.col("k").alias("K"), F.lit("").alias("top_k"))).alias("generation"), F.col("sg").alias("spacegroup")).alias("condition"),
        F.col("label").alias("f3_label"), F.col("available").alias("f3_validation_available"), F.col("status").alias("validation_status"), F.when(F.col("stable").isNotNull(), F.struct(F.col("stable").alias("is_stable"))).alias("offline_validation"),
        F.when(F.col("audited"), F.struct(F.lit(0.1).alias("f1_geometry"))).alias("failure_vector"), F.col("eligible").alias("dpo_eligible"),
    )
    artifact = F.when(F.col("audited"), pair_qa.AUDITED).otherwise("candidates.jsonl")
    return rows.select(F.concat_ws("/", "root", artifact).alias("path"), "root", artifact.alias("artifact"), F.col("ord").alias("_ord"), F.parse_json(F.to_json(body)).alias("row"))


def pair_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    forces = lambda matgl: F.struct(F.struct(F.lit(0.1).alias("MACE"), F.lit(0.2).alias("CHGNet"), matgl.alias("MatGL")).alias("model_forces"))
    letters = lambda g, l: F.struct(g.alias("g"), F.lit("w").alias("W"), F.array(F.lit(1)).alias("A"), F.lit("x").alias("X"), l.alias("L"))
    vector = F.struct(F.lit(0.1).alias("f3_stability"), F.struct(c("vector_status").alias("f3_status")).alias("metadata"))
    body = F.struct(
        "pair_id", F.when(c("has_condition"), F.struct("formula", F.struct(c("k").alias("K"), F.lit("").alias("top_k")).alias("generation"))).alias("condition"), F.when(~c("has_condition"), c("formula")).alias("formula"),
        c("chosen").alias("chosen_candidate_id"), c("rejected").alias("rejected_candidate_id"), "chosen_score", "rejected_score", c("margin").alias("preference_margin"), letters(c("chosen_g"), F.lit("l")).alias("chosen_sequence"), letters(F.lit("g"), c("rejected_l")).alias("rejected_sequence"),
        c("kind").alias("preference_type"), F.struct(c("documented").alias("raw_sequence_equivalent"), c("rule").alias("f3_pair_rule"), forces(F.lit(0.3)).alias("chosen_mlip_force_evidence"), forces(c("matgl")).alias("rejected_mlip_force_evidence"), c("k").alias("K")).alias("metadata"),
        vector.alias("chosen_failure_vector"), vector.alias("rejected_failure_vector"), "chosen_formula", "rejected_formula", F.when(c("chosen_k").isNotNull(), F.struct(F.struct(c("chosen_k").alias("K")).alias("generation"))).alias("chosen_generation"), c("chosen_sg").alias("chosen_spacegroup"),
    )
    keys = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))  # a row of two numbers becomes a large object
    return keys.selectExpr(*PAIR_ROWS).select(F.concat_ws("/", "root", F.lit("preference_pairs.jsonl")).alias("path"), "root", F.parse_json(F.to_json(body)).alias("row"))


ENTRIES_SQL = f"""raw AS (SELECT {', '.join(PLAIN_ROWS)} FROM part UNION ALL SELECT {', '.join(AUDIT_ROWS)} FROM customer),
  entries AS (SELECT nullif(id, '') AS id, root, formula, coalesce(k, '') AS gen, sg, label, coalesce(available, false) AS available, status, stable, eligible, ord, audited, root || '/' || CASE WHEN audited THEN 'audit_candidates.jsonl' ELSE 'candidates.jsonl' END AS path,
    coalesce(available, false) AND coalesce(status = 'validated_success', false) AND stable IS NOT NULL AS has_f3 FROM raw)"""
FINDING = "'{severity}' AS severity, '{check}' AS \"check\", path, formula, {candidate} AS candidate_id, {pair} AS pair_id"


def finding(severity: str, check: str, pair: bool = True) -> str:
    return FINDING.format(severity=severity, check=check, candidate="CAST(NULL AS VARCHAR)" if pair else "id", pair="pair_id" if pair else "CAST(NULL AS VARCHAR)")


PAIR_RULES = [
    ("critical", "missing_condition", "NOT has_condition"), ("critical", "missing_pair_candidate_id", "NOT named"), ("critical", "same_chosen_rejected", "named AND chosen = rejected"), ("critical", "missing_chosen_candidate", "named AND c IS NULL"), ("critical", "missing_rejected_candidate", "named AND r IS NULL"),
    ("critical", "cross_formula_pair", "named AND c_formula <> r_formula"), ("critical", "formula_mismatch", "named AND formula <> c_formula"), ("critical", "formula_mismatch", "named AND formula <> r_formula"), ("critical", "cross_generation_condition_pair", "named AND c_gen <> r_gen"),
    ("critical", "generation_condition_mismatch", "named AND k <> c_gen"), ("critical", "generation_condition_mismatch", "named AND k <> r_gen"), ("critical", "cross_spacegroup_condition_pair", "named AND c_sg <> r_sg"), ("critical", "chosen_score_worse_than_rejected", "named AND chosen_score > rejected_score"),
    ("critical", "preference_margin_inconsistent", "named AND rejected_score - chosen_score <> margin"), ("critical", "non_positive_preference_margin", "named AND chosen_score IS NOT NULL AND margin <= 0"), ("critical", "chosen_missing_sequence_fields", "named AND chosen_g = '' AND documented IS NULL"),
    ("critical", "rejected_missing_sequence_fields", "named AND rejected_l IS NULL AND documented IS NULL"),
    ("critical", "stability_preference_without_f3", "named AND kind = 'stability_aware_offline_validation' AND NOT coalesce(rule IS NOT NULL AND matgl IS NOT NULL, false) AND NOT CASE WHEN c IS NOT NULL AND r IS NOT NULL THEN c.has_f3 AND r.has_f3 ELSE vector_status IS NOT NULL END"),
    ("warning", "unsupported_preference_type", "named AND coalesce(kind, '') NOT IN ('geometry_chemistry_only', 'stability_aware_offline_validation')"),
]
BEST = "(SELECT e FROM entries e WHERE e.id = p.{side} ORDER BY CASE WHEN e.root = p.root AND e.formula = p.formula THEN CASE WHEN e.audited THEN 1 ELSE 2 END WHEN e.root = p.root THEN CASE WHEN e.audited THEN 3 ELSE 4 END WHEN e.formula = p.formula THEN CASE WHEN e.audited THEN 5 ELSE 6 END WHEN e.audited THEN 7 ELSE 8 END, ord LIMIT 1)"


@query(f"""WITH {ENTRIES_SQL}, p AS (SELECT {', '.join(PAIR_ROWS)} FROM orders), b AS (SELECT p.*, root || '/preference_pairs.jsonl' AS path, chosen IS NOT NULL AS named, {BEST.format(side='chosen')} AS c, {BEST.format(side='rejected')} AS r FROM p),
  s AS (SELECT *, coalesce(chosen_formula, c.formula) AS c_formula, coalesce(rejected_formula, r.formula) AS r_formula, coalesce(chosen_k, c.gen) AS c_gen, r.gen AS r_gen, coalesce(CAST(CAST(chosen_sg AS DOUBLE) AS BIGINT), c.sg) AS c_sg, r.sg AS r_sg FROM b)
  {' UNION ALL '.join(f'SELECT {finding(severity, check)} FROM s WHERE {where}' for severity, check, where in PAIR_RULES)}""")
def qa_pair_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding of every pair, the best entry of each side found among several."""
    return pair_qa.pair_findings(pair_qa.pair_fields(pair_artifacts(spark, sf_dir)), pair_qa.candidate_fields(candidate_artifacts(spark, sf_dir)))


@query(f"""WITH {ENTRIES_SQL}, d AS (SELECT *, row_number() OVER (PARTITION BY root, formula, gen, id, audited ORDER BY ord) AS rn FROM entries WHERE id IS NOT NULL)
  SELECT {finding('critical', 'missing_candidate_id', False)} FROM entries WHERE id IS NULL UNION ALL SELECT {finding('warning', 'missing_formula', False)} FROM entries WHERE id IS NOT NULL AND formula IS NULL
  UNION ALL SELECT {finding('critical', 'duplicate_candidate_id', False)} FROM d WHERE rn > 1 UNION ALL SELECT {finding('warning', 'missing_expected_audit_field', False)} FROM entries WHERE audited AND label IS NULL
  UNION ALL SELECT {finding('warning', 'missing_expected_audit_field', False)} FROM entries WHERE audited AND eligible IS NULL
  UNION ALL SELECT {finding('critical', 'fabricated_f3_or_stability', False)} FROM entries WHERE audited AND (coalesce(lower(label) IN ('pass', 'stable'), false) OR coalesce(stable, false)) AND (NOT available OR status <> 'validated_success')""")
def qa_candidate_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_qa.candidate_findings(pair_qa.candidate_fields(candidate_artifacts(spark, sf_dir)))


TASKS = ["p_partkey AS candidate_id", "CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE concat('f', p_partkey % 28) END AS formula", "p_size % 9 AS sites", percent("(p_partkey * 37) % 101") + " AS volume"]
REFERENCES = ["c_custkey AS reference_id", "concat('f', c_nationkey) AS formula", "c_custkey * 7919 % 10007 AS ref_ord", "c_custkey % 9 AS ref_sites", percent("(c_custkey * 53) % 101") + " AS ref_volume"]


@query(f"""WITH t AS (SELECT {', '.join(TASKS)} FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY formula ORDER BY ref_ord, reference_id) AS place, count(*) OVER (PARTITION BY formula) AS size FROM (SELECT {', '.join(REFERENCES)} FROM customer)),
  b AS (SELECT t.*, r.*, t.sites = r.ref_sites AS near, t.sites = r.ref_sites AND abs(t.volume - r.ref_volume) <= 0.1 AS fits FROM t JOIN r ON t.formula = r.formula),
  hit AS (SELECT candidate_id, max(size) AS size, min(CASE WHEN fits THEN place END) AS place, arg_min(CASE WHEN fits THEN reference_id END, CASE WHEN fits THEN place END) AS reference_id FROM b GROUP BY candidate_id),
  calls AS (SELECT candidate_id, count(*) AS n FROM b JOIN hit USING (candidate_id) WHERE near AND b.place < power(2, floor(log2(coalesce(hit.place, hit.size)) + 1)) GROUP BY candidate_id)
  SELECT candidate_id, hit.reference_id, CASE WHEN size IS NULL THEN 'no_exact_formula_reference' WHEN hit.place IS NULL THEN 'structure_matcher_formula_bucket_no_match' ELSE 'structure_matcher_formula_bucket_match' END AS match_type,
    CAST(hit.place IS NOT NULL AS DOUBLE) AS f4_novelty_leakage, CASE WHEN size IS NULL THEN 0.0 WHEN hit.place IS NULL THEN CAST(0.75 AS DOUBLE) ELSE CAST(0.95 AS DOUBLE) END AS confidence, coalesce(size, 0) AS formula_bucket_size, coalesce(hit.place, size, 0) AS checked_reference_count, coalesce(n, 0) AS kernel_calls
  FROM t LEFT JOIN hit USING (candidate_id) LEFT JOIN calls USING (candidate_id)""")
def f4_reference_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First fitting reference; the oracle also says how many pairs reached the kernel."""
    tasks, references = table(spark, sf_dir, "part").selectExpr(*TASKS), table(spark, sf_dir, "customer").selectExpr(*REFERENCES)
    fits = lambda pairs: pairs.withColumn("fits", (F.col("sites") == F.col("ref_sites")) & (F.abs(F.col("volume") - F.col("ref_volume")) <= 0.1))
    out = reference_match.match_references(tasks, references, fits, lambda: F.col("sites") == F.col("ref_sites"))
    return out.select("candidate_id", "reference_id", "match_type", "f4_novelty_leakage", "confidence", "formula_bucket_size", "checked_reference_count", "kernel_calls")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount, l_tax, CAST(format('{:.6f}', l_extendedprice * l_discount * l_tax / 7) AS DOUBLE) AS six, CAST(format('{:.2f}', l_extendedprice * l_discount / 16) AS DOUBLE) AS two FROM lineitem")
def python_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", python_round(c("l_extendedprice") * c("l_discount") * c("l_tax") / 7, 6).alias("six"), python_round(c("l_extendedprice") * c("l_discount") / 16, 2).alias("two"))
