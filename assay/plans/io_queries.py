"""Queries of sources, sinks, structures, nodes, details and the stream.

A source is tested by what it is for: a table's rows are written to the shared
folder in the source's format and read back, and the oracle is SQL on the table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import shared_folder
from ..operators import compare, detail, dpo, evaluate, nodes, pairs, rank, runs, select, structures, validate
from ..sources import adapters, files, outputs, readers, writers
from ..streaming import validation_stream
from .import_queries import as_text
from .queries import AXIS_SQL, CONSENSUS_SQL, RANK_SQL, RESULT_SQL, nine, query, results
from .views import CAND_SQL, LAST_SQL, VAL_ORDER, VAL_SQL, VALIDATORS, cand, table, val


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/io-{name}-{uuid.uuid4().hex}"


def as_lines(df: DataFrame, path: str) -> str:
    """JSON lines of ``df`` with null fields left out, below ``path``."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)
    return path


@query("SELECT p_partkey AS id, p_name AS name, p_size AS size, p_retailprice AS price FROM part")
def source_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted JSON lines out, typed rows in."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    writers.write_jsonl(rows, path := folder(spark, "jsonl"))
    return readers.jsonl(spark, path, "id bigint, name string, size int, price double").select("id", "name", "size", "price")


@query("SELECT CASE WHEN p_partkey % 9 = 0 THEN 'malformed' ELSE 'good' END AS kind, count(*) AS n FROM part GROUP BY 1")
def source_tolerant_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    lines = table(spark, sf_dir, "part").select(F.when(key % 9 == 0, F.concat(F.lit("{broken "), key.cast("string"))).otherwise(F.to_json(F.struct("p_partkey"))).alias("value"))
    lines.write.text(path := folder(spark, "tolerant"))
    good = readers.jsonl(spark, path, "p_partkey bigint", strict=False).agg(F.lit("good").alias("kind"), F.count("*").alias("n"))
    return good.union(readers.bad_lines(spark, path).agg(F.lit("malformed").alias("kind"), F.count("*").alias("n")))


@query("SELECT n_nationkey AS nation, c_custkey AS id FROM nation JOIN customer ON c_nationkey = n_nationkey")
def source_json_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON file for each nation, whose rows are wrapped in ``results``."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"))
    wrapped = rows.groupBy("nation").agg(F.to_json(F.struct(F.collect_list(F.struct("nation", "id")).alias("results"))).alias("value"))
    wrapped.repartition(25, "nation").write.option("maxRecordsPerFile", 1).partitionBy("nation").text(path := folder(spark, "json"))
    return readers.json_rows(spark, f"{path}/*/").select(readers.get("nation", "int").alias("nation"), readers.get("id", "bigint").alias("id"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier")
def source_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    writers.write_csv(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), path := folder(spark, "csv"))
    return readers.csv(spark, path).select("s_suppkey", "s_name", "s_nationkey")


@query("SELECT s_suppkey, s_name, NULL::VARCHAR AS c_name FROM supplier UNION ALL SELECT NULL, NULL, c_name FROM customer")
def sink_union_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), table(spark, sf_dir, "customer").select("c_name")
    outputs.union_csv(left, path := folder(spark, "union"), right)
    rows = readers.csv(spark, path)
    return rows.select(F.col("s_suppkey").try_cast("bigint").alias("s_suppkey"), "s_name", "c_name")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS candidate_id, p_brand AS composition, p_partkey % 230 + 1 AS space_group, round(CAST(p_size AS DOUBLE), 6) AS a, 90.0::DOUBLE AS alpha, CASE WHEN p_partkey % 2 = 0 THEN 'full' ELSE 'partial' END AS sequence FROM part""")
def source_sampling_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence fields and lattice columns whose names differ in case only."""
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        key.alias("candidate_id"), F.col("p_brand").alias("formula"), (key % 230 + 1).alias("g"), F.lit("w").alias("W"), F.lit("1").alias("A"), F.when(key % 2 == 0, "x").alias("X"), F.lit("l").alias("L"),
        F.col("p_size").alias("len_a"), F.lit(5).alias("len_b"), F.lit(6).alias("len_c"), F.lit(90).alias("alpha"), F.lit(90).alias("beta"), F.lit(90).alias("gamma"),
    )
    header = "candidate_id,formula,g,W,A,X,L,a,b,c,alpha,beta,gamma"
    lines = rows.select(F.to_csv(F.struct(*(F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(rows.columns)))).alias("value"))
    spark.createDataFrame([(header,)], "value string").union(lines).coalesce(1).write.text(path := folder(spark, "sampling"))
    out = readers.sampling_csv(spark, path)
    return out.select(
        "candidate_id", "composition", F.col("space_group").alias("space_group"), F.round(readers.lattice_lengths(F.col("lattice_matrix"))[0], 6).alias("a"), F.round(readers.lattice_angles(F.col("lattice_matrix"))[0], 6).alias("alpha"),
        dpo.sequence_status("raw_sequence_fields").alias("sequence"),
    )


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS candidate_id, 'f' || CAST(o_custkey % 7 AS VARCHAR) AS formula, CASE WHEN o_orderkey % 3 = 0 THEN 'unknown' ELSE 'completed' END AS validation_status, CAST(CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 230 ELSE 7 END AS INTEGER) AS spacegroup,
  CASE o_orderkey % 5 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN true END AS is_stable, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 10 / 100::DOUBLE END AS e_above_hull FROM orders""")
def source_offline_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialect 2, with fields that fall back to the condition."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        k.cast("string").alias("candidate_id"), F.concat(F.lit("f"), (F.col("o_custkey") % 7).cast("string")).alias("formula"), F.lit("mace").alias("validation_source"), F.when(k % 3 != 0, "completed").alias("status"),
        F.when(k % 4 == 0, (k % 230).cast("string")).alias("spacegroup"), F.struct(F.lit(7).alias("spacegroup")).alias("condition"), F.when(k % 5 == 0, "No").when(k % 5 == 1, "stable").when(k % 5 == 2, "maybe").when(k % 5 == 3, "none").alias("is_stable"),
        F.when(k % 2 == 0, (k % 10 / 100).cast("double")).alias("e_above_hull"),
    )
    out = adapters.offline_validation(spark, as_lines(rows, folder(spark, "offline")))
    return out.select("candidate_id", "formula", "validation_status", "spacegroup", "is_stable", "e_above_hull")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS candidate_id, coalesce(CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN true END, false) AS validated, 'unknown' AS status, o_orderkey % 4 = 0 AS is_stable FROM orders")
def source_validation_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialect 1: the text ``false`` is true."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.cast("string").alias("candidate_id"), F.when(k % 3 == 0, "false").when(k % 3 == 1, "yes").alias("validated"), (k % 4 == 0).alias("is_stable"))
    return adapters.validation_results(spark, as_lines(rows, folder(spark, "results"))).select("candidate_id", "validated", "status", "is_stable")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS candidate_id, o_orderkey % 101 / 100::DOUBLE AS f4_novelty_leakage, CASE WHEN o_orderkey % 2 = 0 THEN 0.5::DOUBLE END AS confidence FROM orders")
def source_novelty_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.cast("string").alias("candidate_id"), (k % 101 / 100).cast("double").alias("f4_novelty_leakage"), F.when(k % 2 == 0, 0.5).alias("confidence"))
    return adapters.novelty_audit(spark, as_lines(rows, folder(spark, "novelty"))).select("candidate_id", "f4_novelty_leakage", "confidence")


@query("SELECT CASE WHEN p_partkey % 4 = 0 THEN 'structure' ELSE 'mock' END AS kind, count(*) AS n, sum(p_partkey % 7) AS groups FROM part GROUP BY 1")
def source_mixed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    real = k % 4 == 0
    rows = table(spark, sf_dir, "part").select(
        k.cast("string").alias("candidate_id"), F.col("p_brand").alias("composition"), (k % 7).alias("space_group"), F.when(real, F.array(F.lit("Na"))).alias("species"),
        F.when(k % 2 == 0, F.array(F.array(F.lit(1.0)))).alias("lattice_matrix"), F.when(real, "made").alias("source"),
    )
    out = adapters.mixed_candidates(spark, as_lines(rows, folder(spark, "mixed")))
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.sum("space_group").alias("groups"))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS candidate_id, 'normalized_jsonl' AS source_format FROM supplier UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'sampling_csv' FROM nation UNION ALL SELECT r_name, 'struct_csv' FROM region UNION ALL SELECT 'inline', 'hand'""")
def source_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest with a record of its own, JSON lines, a sampling CSV and a CSV of structures."""
    path = folder(spark, "manifest")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("candidate_id"), F.lit("NaCl").alias("composition"))
    as_lines(rows, f"{path}/lines")
    writers.write_csv(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("candidate_id"), F.col("n_name").alias("formula")).coalesce(1), f"{path}/samples")
    writers.write_csv(table(spark, sf_dir, "region").select(F.col("r_name").alias("candidate_id"), F.lit("x.cif").alias("cif_path")).coalesce(1), f"{path}/tables")
    one = lambda name: files.matching(spark, f"{path}/{name}/part-*")[0]
    held = {"records": [{"candidate_id": "inline", "metadata": {"source_format": "hand"}}], "normalized_output": "lines", "files": [one("samples"), {"path": one("tables"), "source_format": "auto"}]}
    files.write_text(spark, f"{path}/manifest.json", json.dumps(held))
    return adapters.load(spark, path).select("candidate_id", "source_format")


@query("SELECT CAST(k AS INTEGER) AS shard, (SELECT count(*) FROM part WHERE p_partkey % 4 = k) AS n FROM range(6) t(k)")
def sink_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six shards, two of them empty, each read from its own path."""
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 4).cast("int").alias("shard_id"))
    paths = outputs.write_shards(rows, folder(spark, "shards"), 6)
    out = None
    for k, path in enumerate(paths):
        one = readers.lines(spark, path).agg(F.lit(k).alias("shard"), F.count("*").alias("n"))
        out = one if out is None else out.union(one)
    return out


@query("""SELECT 'audit_candidates.jsonl' AS file, (SELECT count(*) FROM part) AS n UNION ALL SELECT 'candidates.jsonl', (SELECT count(*) FROM part) UNION ALL SELECT 'failure_vectors.jsonl', (SELECT count(*) FROM part) UNION ALL SELECT 'audit_summary.json', 1 UNION ALL SELECT 'error_audit_table.md', 1 UNION ALL SELECT 'report.md', 1
  UNION ALL SELECT 'preference_pairs.jsonl', (SELECT count(*) FROM supplier) UNION ALL SELECT 'preference_summary.json', 1""")
def sink_output_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the tables, and 1 for each report, of two output sets."""
    path = folder(spark, "sets")
    rows = cand(spark, sf_dir).select("candidate_id", "_ord", F.col("f1").alias("f1_geometry"), F.col("f2").alias("f2_chemistry"), "is_valid")
    summary = rows.agg(F.count("*").alias("total_candidates"))
    made = outputs.audit_outputs(f"{path}/audit", rows, rows, summary) | outputs.preference_outputs(f"{path}/pairs", table(spark, sf_dir, "supplier").select("s_suppkey"), summary)
    out = None
    for name, where in made.items():
        lines = readers.lines(spark, where) if name.endswith(".jsonl") else readers.whole_json(spark, where)
        one = lines.agg(F.lit(name).alias("file"), F.count("*").alias("n"))
        out = one if out is None else out.union(one)
    return out.where("file != 'report.md'").union(out.where("file = 'report.md'").distinct())


@query("""WITH s AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE 'id' END AS id, p_partkey % 3 AS sites, p_partkey % 4 AS species, p_partkey % 5 AS coords, p_partkey % 240 AS sg, p_partkey % 6 AS rows FROM part)
  SELECT k, concat_ws(';', CASE WHEN id = '' THEN 'missing_candidate_id' END, CASE WHEN k % 7 = 0 THEN 'pbc_must_have_three_flags' END, CASE WHEN sites = 0 AND k % 2 = 0 THEN 'num_sites_must_be_nonnegative' END,
    CASE WHEN species > 0 AND n <> 0 AND species <> n THEN 'species_count_mismatch' END, CASE WHEN coords > 0 AND n <> 0 AND coords <> n THEN 'coord_count_mismatch' END, CASE WHEN species > 0 AND coords > 0 AND species <> coords THEN 'species_coord_count_mismatch' END,
    CASE WHEN rows > 0 AND rows <> 3 THEN 'lattice_matrix_must_have_three_rows' END, CASE WHEN rows > 0 AND k % 11 = 0 THEN 'lattice_matrix_rows_must_have_three_values' END, CASE WHEN coords > 0 AND k % 13 = 0 THEN 'frac_coords_rows_must_have_three_values' END,
    CASE WHEN sg NOT BETWEEN 1 AND 230 THEN 'space_group_out_of_range' END) AS errors FROM (SELECT *, CASE WHEN sites = 0 AND k % 2 = 0 THEN -1 ELSE sites END AS n FROM s)""")
def structure_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    repeat = lambda x, n: F.array_repeat(x, n.cast("int"))
    width = lambda m: F.when(k % m == 0, 2).otherwise(3)
    rows = table(spark, sf_dir, "part").select(
        k, F.when(k % 10 != 0, "id").otherwise("").alias("candidate_id"), repeat(F.lit(True), F.when(k % 7 == 0, 2).otherwise(3)).alias("pbc"), F.when((k % 3 == 0) & (k % 2 == 0), -1).otherwise(k % 3).alias("num_sites"), repeat(F.lit("Na"), k % 4).alias("species"),
        repeat(repeat(F.lit(0.5), width(13)), k % 5).alias("frac_coords"), repeat(repeat(F.lit(1.0), width(11)), k % 6).alias("lattice_matrix"), (k % 240).alias("space_group"),
    )
    return structures.basic_errors(rows).select(k.alias("k"), F.array_join("errors", ";").alias("errors"))


@query("""SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'own' ELSE 'Na2Cl' END AS composition, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 5 + 1 ELSE 3 END AS num_atoms, CAST(p_size AS DOUBLE) AS a, 90.0::DOUBLE AS gamma,
  CASE WHEN p_partkey % 4 = 0 THEN 0.25::DOUBLE ELSE 0.0 END AS geometry, CASE WHEN p_partkey % 5 = 0 THEN 'mine' ELSE 'unavailable_without_offline_validation' END AS mode FROM part""")
def structures_as_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    axis = lambda i: F.array(*(F.col("p_size").cast("double") if j == i else F.lit(0.0) for j in range(3)))
    metadata = F.map_filter(F.create_map(F.lit("mock_geometry_score"), F.when(k % 4 == 0, "0.25"), F.lit("stability_mode"), F.when(k % 5 == 0, "mine")), lambda _, v: v.isNotNull())
    rows = table(spark, sf_dir, "part").select(
        k.alias("candidate_id"), F.when(k % 3 == 0, "own").otherwise("").alias("composition"), F.when(k % 2 == 0, k % 5 + 1).otherwise(0).alias("num_sites"), F.array(F.lit("Na"), F.lit("Cl"), F.lit("Na")).alias("species"),
        F.array().cast("array<array<double>>").alias("frac_coords"), F.array(axis(0), axis(1), axis(2)).alias("lattice_matrix"), F.lit(1).alias("space_group"), F.lit(None).cast("string").alias("prototype"), F.lit("s").alias("source"), F.lit(None).cast("string").alias("structure_ref"), metadata.alias("metadata"),
    )
    out = structures.as_candidates(rows)
    return out.select(F.col("candidate_id").alias("k"), "composition", "num_atoms", F.round(F.col("lattice_lengths")[0], 9).alias("a"), F.round(F.col("lattice_angles")[2], 9).alias("gamma"), F.col("mock_geometry_score").alias("geometry"), F.col("metadata")["stability_mode"].alias("mode"))


@query("SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'O' WHEN 1 THEN 'Na,O' ELSE 'Na,Z150' END AS species, CASE p_partkey % 3 WHEN 0 THEN '2' WHEN 1 THEN '0,2' ELSE '0,1' END AS active FROM part")
def species_from_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("p_partkey") % 3 == 0, "[0, [0, 8]]").when(F.col("p_partkey") % 3 == 1, "(11, 0, 8.0)").otherwise("11 150 0")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), structures.species_of_numbers(structures.flat_numbers(text)).alias("x"))
    return rows.select("k", F.array_join("x.species", ",").alias("species"), F.array_join(F.transform("x.active", lambda i: i.cast("string")), ",").alias("active"))


@query(f"""WITH {VAL_SQL}, {LAST_SQL}, g AS (SELECT candidate_id, max(force_max) AS max_force FROM last GROUP BY 1 HAVING count(force_max) = 3 AND bool_and(coalesce(relaxation_converged AND is_stable, false)) AND max(force_max) <= 0.05)
  SELECT candidate_id, max_force, CASE WHEN max_force <= 0.03 THEN 'A_force_le_0.03' WHEN max_force <= 0.04 THEN 'B_force_le_0.04' ELSE 'C_consensus_0.05' END AS tier FROM g""")
def high_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = validate.last_wins(val(spark, sf_dir), ["candidate_id", "validator"], VAL_ORDER)
    return detail.high_confidence(latest, VALIDATORS)


@query("""WITH c AS (SELECT 'f' || CAST(l_partkey % 9 AS VARCHAR) AS formula, l_linenumber % 4 AS stable_votes, l_linenumber % 3 <> 0 AS agreement, CASE WHEN l_linenumber % 3 <> 0 THEN l_linestatus = 'F' END AS consensus_is_stable, l_discount AS force_max, l_tax AS force_mean, l_discount + l_tax AS stress_max FROM lineitem),
  s AS (SELECT 'f' || CAST(p_partkey % 11 AS VARCHAR) AS formula, count(*) AS selected_count FROM part GROUP BY 1), v AS (SELECT formula, count(*) AS validated_count, count(*) FILTER (agreement AND consensus_is_stable) AS stable_consensus_count, count(*) FILTER (NOT agreement) AS disagreement_count,
    round(quantile_cont(force_max, 0.5) FILTER (agreement AND consensus_is_stable), 9) AS stable_force_max_median, round(sum(stable_votes) / count(*), 9) AS avg_stable_votes_per_validated FROM c GROUP BY 1)
  SELECT s.formula, selected_count, coalesce(validated_count, 0) AS validated_count, coalesce(stable_consensus_count, 0) AS stable_consensus_count, coalesce(disagreement_count, 0) AS disagreement_count, greatest(100 - selected_count, 0) AS f1_f2_fail_count, round(coalesce(stable_consensus_count, 0) / 100::DOUBLE, 9) AS stable_consensus_rate_generated,
    stable_force_max_median, avg_stable_votes_per_validated FROM s LEFT JOIN v USING (formula)""")
def formula_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("f"), (F.col("l_partkey") % 9).cast("string")).alias("formula"), (n % 4).alias("stable_votes"), (n % 3 != 0).alias("agreement"), F.when(n % 3 != 0, F.col("l_linestatus") == "F").alias("consensus_is_stable"),
        F.col("l_discount").alias("force_max"), F.col("l_tax").alias("force_mean"), (F.col("l_discount") + F.col("l_tax")).alias("stress_max"),
    )
    selected = table(spark, sf_dir, "part").select(F.concat(F.lit("f"), (F.col("p_partkey") % 11).cast("string")).alias("formula"))
    out = detail.formula_metrics(rows, selected, 100)
    return nine(out.select("formula", "selected_count", "validated_count", "stable_consensus_count", "disagreement_count", "f1_f2_fail_count", "stable_consensus_rate_generated", "stable_force_max_median", "avg_stable_votes_per_validated"))


@query(f"WITH {CAND_SQL} SELECT candidate_id, f4 AS f4_novelty_leakage FROM cand WHERE f4 >= 0.8 ORDER BY f4 DESC, candidate_id LIMIT 10")
def high_leakage_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detail.high_leakage(cand(spark, sf_dir).select("candidate_id", F.col("f4").alias("f4_novelty_leakage")))


@query("""SELECT 'tasks' AS part, 'task_count_mismatch:expected_7:actual_' || count(*) AS issue FROM customer UNION ALL SELECT 'tasks', 'task_missing_task_id' UNION ALL SELECT 'tasks', 'unexpected_task_schema_versions'
  UNION ALL SELECT 'tasks', 'duplicate_candidate_id:' || c_nationkey FROM customer GROUP BY c_nationkey HAVING count(*) > 1 UNION ALL SELECT 'results', 'result_count_mismatch:expected_7:actual_' || count(*) FROM nation""")
def audit_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    tasks = table(spark, sf_dir, "customer").select(F.when(k % 3 != 0, k).alias("task_id"), F.col("c_nationkey").alias("candidate_id"), F.when(k % 2 == 0, "f4-audit-task-v1").otherwise("v0").alias("schema_version"))
    return detail.audit_readiness(tasks, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("candidate_id")), 7)


@query(f"WITH {AXIS_SQL}, k AS (SELECT axis, lid, rid, lw, gap, quality, row_number() OVER (PARTITION BY axis ORDER BY lid, rid) AS rn, reason FROM q WHERE reason IS NULL) SELECT axis, CASE WHEN lw THEN lid ELSE rid END AS winner_id, CASE WHEN lw THEN rid ELSE lid END AS loser_id FROM k WHERE rn <= 25")
def pairs_axis_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 pairs of each axis, which is what the limit is for."""
    rows = pairs.mine_axis_pairs(cand(spark, sf_dir), pairs.PairConfig(min_quality=0.0, max_pairs_per_axis=25))
    return rows.select("axis", "winner_id", "loser_id")


@query(f"WITH {AXIS_SQL} SELECT axis, CASE WHEN b3x BETWEEN 0.1 AND 0.2 THEN 'near_miss' WHEN b3x > 0.2 AND b3x <= 0.5 THEN 'moderate' WHEN b3x > 0.5 THEN 'catastrophic' ELSE 'unknown' END AS failure_bucket, count(*) AS n FROM (SELECT *, CASE WHEN lw THEN b3 ELSE a3 END AS b3x FROM q WHERE reason IS NULL) GROUP BY ALL")
def pair_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.pair_counts(cand(spark, sf_dir), pairs.PairConfig(min_quality=0.0)).groupBy("axis", "failure_bucket").agg(F.sum("n").alias("n"))


@query(f"WITH {RANK_SQL} SELECT 'mock-validation-' || candidate_id AS task_id, candidate_id, CAST(k AS INTEGER) AS priority, 'cheap' AS budget_tier FROM (SELECT candidate_id, row_number() OVER (ORDER BY utility DESC, _ord) AS k FROM ut) WHERE k <= 5")
def validation_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.validation_tasks(rank.rank_by_utility(cand(spark, sf_dir)), 5).select("task_id", "candidate_id", "priority", "budget_tier")


@query(f"WITH {CAND_SQL}, r AS (SELECT candidate_id, row_number() OVER (ORDER BY f1 DESC NULLS LAST, candidate_id) AS place FROM cand) SELECT candidate_id, CASE WHEN place <= 100 THEN (place - 1) % 8 END AS shard_id FROM r")
def novelty_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks, overflow = select.novelty_tasks(cand(spark, sf_dir).select("candidate_id", F.col("f1").alias("ranking_score")), 100, 8, by_ranking=True)
    return tasks.select("candidate_id", "shard_id").unionByName(overflow.select("candidate_id", F.lit(None).cast("bigint").alias("shard_id")))


@query("""SELECT s_name AS node, CASE WHEN s_suppkey % 3 = 0 THEN 'IDLE+DRAIN' ELSE 'MIXED' END AS state, 8 AS gpus, CAST(8 - s_suppkey % 5 AS INTEGER) AS gpus_free, 64 - s_suppkey % 7 AS cpus_free, 'p' || CAST(s_nationkey % 4 AS VARCHAR) AS partition, s_suppkey % 3 <> 0 AS usable FROM supplier""")
def node_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers written as blocks of Key=value text and parsed again."""
    t = lambda c: c.cast("string")
    key = F.col("s_suppkey")
    text = table(spark, sf_dir, "supplier").select(F.concat(
        F.lit("NodeName="), "s_name", F.lit(" CPUAlloc="), t(key % 7), F.lit(" CPUTot=64\n   Gres=gpu:a100:8(S:0-1)\n   State="), F.when(key % 3 == 0, "IDLE+DRAIN").otherwise("MIXED"), F.lit(" Partitions=p"), t(F.col("s_nationkey") % 4),
        F.lit("\n   RealMemory=515000 CfgTRES=cpu=64,mem=515000M,gres/gpu=8\n   AllocTRES=cpu=2,gres/gpu="), t(key % 5), F.lit("\n"),
    ).alias("value"))
    return nodes.from_blocks(text).select("node", "state", "gpus", "gpus_free", F.col("cpus_free").cast("bigint").alias("cpus_free"), F.col("partitions")[0].alias("partition"), nodes.usable_state().alias("usable"))


@query("SELECT CAST(row_number() OVER (ORDER BY m DESC, n DESC, p) AS INTEGER) AS choice, p AS partition, m AS max_gpus, n AS nodes FROM (SELECT 'p' || CAST(s_nationkey % 4 AS VARCHAR) AS p, CAST(max(s_suppkey % 9) AS INTEGER) AS m, count(*) AS n FROM supplier WHERE s_suppkey % 9 > 0 GROUP BY 1)")
def queueable_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array(F.concat(F.lit("p"), (F.col("s_nationkey") % 4).cast("string")))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("node"), parts.alias("partitions"), (F.col("s_suppkey") % 9).cast("int").alias("gpus"))
    return nodes.queueable(rows).select("choice", "partition", "max_gpus", "nodes")


@query("SELECT CAST(row_number() OVER (ORDER BY CAST(o_orderkey AS VARCHAR)) - 1 AS BIGINT) AS row_index, CAST(o_orderkey AS VARCHAR) AS pair_id, o_custkey AS chosen_id, o_custkey + 1 AS rejected_id FROM orders")
def split_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three tables of the split, put together again by their row index."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("pair_id"), F.col("o_custkey").alias("chosen_candidate_id"), (F.col("o_custkey") + 1).alias("rejected_candidate_id"), F.lit("s").alias("chosen_sequence"), F.lit("t").alias("rejected_sequence"), F.lit(0.1).alias("preference_margin"))
    chosen, rejected, index = dpo.split_pairs(rows)
    out = index.select("row_index", "pair_id").join(chosen.select("row_index", F.col("candidate_id").alias("chosen_id")), "row_index")
    return out.join(rejected.select("row_index", F.col("candidate_id").alias("rejected_id")), "row_index")


@query("SELECT p_partkey AS candidate_id, p_name, s_name AS index_supplier FROM part LEFT JOIN supplier ON s_suppkey = p_partkey WHERE p_partkey IN (SELECT l_partkey FROM lineitem)")
def hydrated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triage rows with their full record and index row."""
    full = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("candidate_id"), "p_name", F.col("p_partkey").alias("_ord"))
    compact = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("candidate_id"), F.col("p_partkey").alias("_ord"))
    compact = compact.join(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("candidate_id")).distinct(), "candidate_id", "left_semi")
    index = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("candidate_id"), F.col("s_name").alias("supplier"), F.col("s_suppkey").alias("_ord"))
    return select.hydrate(compact, full, index)[0].select("candidate_id", "p_name", "index_supplier")


STREAM = "candidate_id string, formula string, validator string, validation_status string, is_stable boolean, e_above_hull double, force_max double, ts timestamp"


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS candidate_id, event_type AS validator, date_trunc('millisecond', ts) AS ts, CASE WHEN value > 50 THEN 'completed' ELSE 'failed' END AS validation_status FROM events)
  SELECT candidate_id, validator, validation_status FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id, validator ORDER BY ts DESC, validation_status DESC) AS rn FROM e) WHERE rn = 1""")
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as validation files, merged by a stream into the latest row of each key."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("candidate_id"), F.lit("f").alias("formula"), F.col("event_type").alias("validator"), F.when(F.col("value") > 50, "completed").otherwise("failed").alias("validation_status"), F.col("ts"))
    rows.repartition(3).write.json(source := folder(spark, "stream"))
    target, stream = folder(spark, "stream-out"), spark.readStream.schema(STREAM).option("maxFilesPerTrigger", 1).json(source)
    validation_stream.keep_latest(stream, target, folder(spark, "stream-checkpoint"), buckets=4).awaitTermination()
    return validation_stream.read_latest(spark, target, STREAM).select("candidate_id", "validator", "validation_status")


@query("""SELECT date_trunc('hour', ts) AS start, event_type AS validator, count(*) AS n, count(*) FILTER (value > 50) AS stable FROM events GROUP BY ALL""")
def stream_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable rates by validator and hour, from a stream into a table."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("validator"), (F.col("value") > 50).alias("is_stable"), F.col("ts"))
    rows.coalesce(1).write.json(source := folder(spark, "rates"))
    stream = validation_stream.rate_by_window(spark.readStream.schema("validator string, is_stable boolean, ts timestamp").json(source), "1 hour", "36500 days")
    name = "rates_" + source.rpartition("-")[2]
    stream.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", folder(spark, "rates-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.col("window.start").alias("start"), "validator", "n", "stable")


@query(f"""WITH {CAND_SQL}, {CONSENSUS_SQL}, v AS (SELECT last.* FROM last JOIN cons USING (candidate_id)), cc AS (SELECT count(*) AS n FROM cand), o AS (SELECT count(*) AS n, count(*) FILTER (agreement AND stable_votes = 3) AS s, count(*) FILTER (agreement AND unstable_votes = 3) AS u, count(*) FILTER (agreement) AS a FROM cons), w AS (SELECT count(*) FILTER (is_stable) AS s FROM v)
  SELECT cc.n AS candidate_count, (SELECT count(*) FILTER (is_valid) FROM cand) AS dpo_eligible_count, (SELECT count(*) FILTER (f1 >= 0.1) FROM cand) AS f1_fail_count, (SELECT count(DISTINCT family) FROM cand) AS formula_count, (SELECT count(DISTINCT nullif(space_group, 0)) FROM cand) AS spacegroup_count,
    o.n AS overlap_count, o.s AS strict_three_mlip_stable_consensus_count, o.u AS unstable_consensus_count, o.n - o.a AS disagreement_count, round(o.a / o.n, 9) AS all_three_agreement_rate, w.s AS stable_vote_count, round(w.s / (3 * cc.n), 9) AS average_stable_vote_fraction_all_generated, round(w.s / (3 * o.n), 9) AS average_stable_vote_fraction_validated,
    round(o.s / cc.n, 9) AS stable_consensus_rate, round(o.s / nullif(o.s + o.u, 0), 9) AS stable_consensus_rate_among_f3_available, round((SELECT max(k) FROM (SELECT count(*) AS k FROM cand GROUP BY family)) / cc.n, 9) AS dominant_formula_fraction,
    (SELECT round(-sum(p * ln(p)), 9) FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM cand WHERE space_group <> 0 GROUP BY space_group)) AS spacegroup_entropy,
    (SELECT string_agg(k || '=' || m, ';' ORDER BY k) FROM (SELECT vote_pattern AS k, count(*) AS m FROM cons GROUP BY 1)) AS vote_pattern_counts FROM cc, o, w""")
def side_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.columns import pass_label

    rows = cand(spark, sf_dir).withColumns({"formula": F.col("family"), "sequence": F.concat("prototype", F.col("atoms").cast("string")), "f1_label": pass_label("f1"), "f2_label": pass_label("f2"), "dpo_eligible": F.col("is_valid")})
    decided = validate.consensus(val(spark, sf_dir), VALIDATORS, VAL_ORDER)
    out = compare.side_report(rows, decided, validate.votes(val(spark, sf_dir), VALIDATORS, VAL_ORDER))
    return nine(out.withColumn("vote_pattern_counts", as_text("vote_pattern_counts")).select(
        "candidate_count", "dpo_eligible_count", "f1_fail_count", "formula_count", "spacegroup_count", "overlap_count", "strict_three_mlip_stable_consensus_count", "unstable_consensus_count", "disagreement_count", "all_three_agreement_rate", "stable_vote_count",
        "average_stable_vote_fraction_all_generated", "average_stable_vote_fraction_validated", "stable_consensus_rate", "stable_consensus_rate_among_f3_available", "dominant_formula_fraction", "spacegroup_entropy", "vote_pattern_counts",
    ))


@query(f"""WITH {CONSENSUS_SQL} SELECT (SELECT string_agg(validator || '=' || n, ';' ORDER BY validator) FROM (SELECT validator, count(*) FILTER (is_stable) AS n FROM last JOIN cons USING (candidate_id) GROUP BY 1)) AS validator_stable_counts,
  (SELECT string_agg(vote_pattern || '=' || n, ';' ORDER BY vote_pattern) FROM (SELECT vote_pattern, count(*) AS n FROM cons GROUP BY 1)) AS vote_pattern_counts""")
def consensus_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = val(spark, sf_dir)
    out = validate.consensus_breakdown(validate.consensus(rows, VALIDATORS, VAL_ORDER), validate.votes(rows, VALIDATORS, VAL_ORDER))
    return out.withColumns({c: as_text(c) for c in out.columns})


@query(f"""WITH {CAND_SQL}, a AS (SELECT *, candidate_id AS k, CASE candidate_id % 4 WHEN 0 THEN 'unparsed_cif' WHEN 1 THEN 'parse_error' ELSE 'parsed_full_structure' END AS ps, CASE candidate_id % 3 WHEN 0 THEN 'missing' WHEN 1 THEN 'partial' ELSE 'full' END AS rs, 'f' || (candidate_id % 2) AS fmt,
    CASE WHEN candidate_id % 5 = 0 THEN 'validation_error' ELSE 'validated_success' END AS vs, candidate_id % 5 <> 0 AS av, candidate_id % 7 = 0 AS st, f1 < 0.1 AS p1, f2 < 0.1 AS p2 FROM cand), r AS (SELECT 'r' || (k % 6) AS reason FROM a UNION ALL SELECT 'hard' FROM a WHERE NOT is_valid)
  SELECT count(*) AS total_candidates, count(*) FILTER (ps = 'parsed_full_structure') AS parsed_full_structure_count, count(*) FILTER (p1) AS f1_pass_count, round(count(*) FILTER (NOT p2) / count(*), 9) AS f2_fail_rate, count(*) FILTER (rs = 'partial') AS partial_sequence_count, count(*) FILTER (rs = 'missing') AS missing_raw_sequence_count,
    count(*) FILTER (av) AS offline_validation_available_count, count(*) FILTER (vs = 'validation_error') AS offline_validation_error_count, count(*) FILTER (av AND st) AS f3_validated_stable_count, CAST(count(*) - count(DISTINCT family) AS BIGINT) AS duplicate_composition_count, CAST(count(*) - count(DISTINCT prototype) AS BIGINT) AS duplicate_structure_ref_count,
    (SELECT string_agg(fmt || '=' || n, ';' ORDER BY fmt) FROM (SELECT fmt, count(*) AS n FROM a GROUP BY 1)) AS source_format_breakdown, (SELECT string_agg(reason || '=' || n, ';' ORDER BY n DESC, reason) FROM (SELECT reason, count(*) AS n FROM r GROUP BY 1 ORDER BY n DESC, reason LIMIT 5)) AS top_failure_reasons, 'bad=' || count(*) FILTER (ps = 'parse_error') AS top_parse_errors FROM a""")
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.columns import pass_label

    k = F.col("candidate_id")
    none = F.array().cast("array<string>")
    rows = cand(spark, sf_dir).select(
        k, pass_label("f1").alias("f1_label"), pass_label("f2").alias("f2_label"), F.lit("unknown").alias("f3_label"), F.col("is_valid").alias("dpo_eligible"), F.when(k % 4 == 0, "unparsed_cif").when(k % 4 == 1, "parse_error").otherwise("parsed_full_structure").alias("parse_status"),
        F.when(k % 3 == 0, "missing").when(k % 3 == 1, "partial").otherwise("full").alias("raw_sequence_status"), F.concat(F.lit("f"), (k % 2).cast("string")).alias("source_format"), F.when(k % 5 == 0, "validation_error").otherwise("validated_success").alias("validation_status"),
        (k % 5 != 0).alias("f3_validation_available"), (k % 7 == 0).alias("offline_is_stable"), F.when(k % 4 == 1, "bad").alias("parse_error"),
        F.concat(F.array(F.concat(F.lit("r"), (k % 6).cast("string"))), F.when(F.col("is_valid"), none).otherwise(F.array(F.lit("hard")))).alias("failure_reasons"), F.col("family").alias("composition"), F.col("prototype").alias("structure_ref"),
    )
    out = evaluate.full_audit_summary(rows, rows, k=5)
    pairs_text = lambda c: F.array_join(F.transform(c, lambda e: F.concat(e["reason"], F.lit("="), e["n"].cast("string"))), ";")
    out = out.withColumns({"source_format_breakdown": as_text("source_format_breakdown"), "top_failure_reasons": pairs_text("top_failure_reasons"), "top_parse_errors": pairs_text("top_parse_errors")})
    return nine(out.select(
        "total_candidates", "parsed_full_structure_count", "f1_pass_count", "f2_fail_rate", "partial_sequence_count", "missing_raw_sequence_count", "offline_validation_available_count", "offline_validation_error_count", "f3_validated_stable_count",
        "duplicate_composition_count", "duplicate_structure_ref_count", "source_format_breakdown", "top_failure_reasons", "top_parse_errors",
    ))


@query("SELECT r_name AS run_name, 'mode' || r_regionkey AS pair_mode, CAST(CASE WHEN r_regionkey % 2 = 0 THEN 10 + r_regionkey ELSE 7 END AS BIGINT) AS candidate_count, CAST(0 AS BIGINT) AS validation_count, r_regionkey / 10::DOUBLE AS valid_rate FROM region")
def run_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run folder for each region, with its two reports."""
    path, folders = folder(spark, "runs"), []
    for r in table(spark, sf_dir, "region").collect():  # five rows
        folders.append(f"{path}/{r.r_name}")
        evaluation = {"valid_rate": r.r_regionkey / 10} | ({"candidate_count": 10 + r.r_regionkey} if r.r_regionkey % 2 == 0 else {})
        files.write_text(spark, f"{folders[-1]}/{runs.SUMMARY}", json.dumps({"pair_mode": f"mode{r.r_regionkey}", "candidate_count": 7}))
        files.write_text(spark, f"{folders[-1]}/{runs.EVALUATION}", json.dumps(evaluation))
    return runs.run_table(spark, folders).select("run_name", "pair_mode", "candidate_count", "validation_count", "valid_rate")


@query("""SELECT count(*) AS completed_formula_count, sum(o_custkey) AS total_candidates, round(sum(o_totalprice), 2) AS formula_seconds_total, max(o_totalprice) AS max_formula_seconds, round(avg(o_totalprice), 6) AS average_formula_seconds,
  (SELECT string_agg(k || '=' || n, ';' ORDER BY k) FROM (SELECT o_orderstatus AS k, count(*) AS n FROM orders GROUP BY 1)) AS status_counts, (SELECT string_agg(k || '=' || n, ';' ORDER BY k) FROM (SELECT o_orderpriority AS k, sum(o_orderkey % 5) AS n FROM orders GROUP BY 1)) AS parse_status_counts FROM orders""")
def bulk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("candidate_count"), F.lit(0).alias("dpo_eligible_count"), F.lit(0).alias("preference_pair_count"), F.create_map("o_orderpriority", F.col("o_orderkey") % 5).alias("parse_status_counts"),
        F.lit(1.0).alias("generation_seconds"), F.lit(1.0).alias("smoke_seconds"), F.col("o_totalprice").alias("total_seconds"),
    )
    out = runs.bulk_summary(rows).withColumns({c: as_text(c) for c in ("status_counts", "parse_status_counts")})
    return out.select("completed_formula_count", "total_candidates", F.round("formula_seconds_total", 2).alias("formula_seconds_total"), "max_formula_seconds", F.round("average_formula_seconds", 6).alias("average_formula_seconds"), "status_counts", "parse_status_counts")


@query(f"""WITH {VAL_SQL} SELECT count(*) AS row_count, count(*) FILTER (validation_status = 'completed') AS completed_count, count(*) FILTER (validation_status = 'failed') AS failed_count,
  (SELECT string_agg(k || '=' || n, ';' ORDER BY k) FROM (SELECT validator AS k, count(*) AS n FROM val GROUP BY 1)) AS formula_counts FROM val""")
def worker_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.worker_summary(val(spark, sf_dir).select("validation_status", F.col("validator").alias("formula")))
    return out.select("row_count", "completed_count", "failed_count", as_text("formula_counts").alias("formula_counts"))


@query(f"WITH {CAND_SQL}, {RESULT_SQL} SELECT CASE WHEN ok AND is_stable THEN 'positive_evidence' WHEN lower(status) IN ('failed', 'error') OR (ok AND NOT is_stable) THEN 'negative_evidence' ELSE 'pending_evidence' END AS decision, count(*) AS n, round(sum(f1), 6) AS f1 FROM judged LEFT JOIN cand USING (candidate_id) GROUP BY 1")
def feedback_with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = runs.feedback_events(results(spark, sf_dir), cand(spark, sf_dir).select("candidate_id", "f1", "_ord"), "round-1")
    return events.groupBy("decision").agg(F.count("*").alias("n"), F.round(F.sum("f1"), 6).alias("f1"))


@query(f"""WITH {RESULT_SQL}, d AS (SELECT candidate_id, coalesce(ok AND is_stable, false) AS plus, NOT coalesce(ok AND is_stable, false) AND (lower(status) IN ('failed', 'error') OR coalesce(ok AND NOT is_stable, false)) AS minus FROM judged)
  SELECT count(*) AS event_count, count(*) FILTER (plus) AS positive_evidence_count, count(*) FILTER (minus) AS negative_evidence_count, count(DISTINCT candidate_id) FILTER (plus) AS prefer, count(DISTINCT candidate_id) FILTER (minus) AS avoid FROM d""")
def buffer_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = runs.feedback_events(results(spark, sf_dir), cand(spark, sf_dir).select("candidate_id", "_ord"), "round-1")
    out = runs.buffer_counters(events)
    return out.select("event_count", "positive_evidence_count", "negative_evidence_count", F.size("prefer_candidate_ids").cast("bigint").alias("prefer"), F.size("avoid_candidate_ids").cast("bigint").alias("avoid"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size * 2 END AS score, CASE WHEN p_size % 5 = 0 THEN 'ValueError: size' END AS oracle_error FROM part")
def external_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A kernel outside Spark that fails on some rows."""
    def kernel(frame):
        if (frame["p_size"] % 5 == 0).any():
            raise ValueError("size")
        return frame.assign(score=frame["p_size"] * 2)[["p_partkey", "score"]]

    return runs.evaluated(table(spark, sf_dir, "part").select("p_partkey", "p_size"), kernel, "p_partkey bigint, score int")
