"""Queries of reports, small files and the functions that put them together."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import checkpointed
from ..operators import compare, evaluate, nodes, pairs, rank, select
from ..sources import artifacts, files, outputs, readers, writers
from .import_queries import as_text
from .io_queries import as_lines, folder
from .queries import AXIS_SQL, ORACLES, PAIR_SQL, RESULT_ORDER, nine, query, results
from .views import CAND_SQL, cand, table

COUNTS_SQL = "(SELECT string_agg(k || '=' || n, ';' ORDER BY k) FROM (SELECT {k} AS k, count(*) AS n FROM {t} GROUP BY 1))"


@query(f"""WITH e AS ({ORACLES['eval_report']}), r AS ({ORACLES['ranking_report']}), v AS ({ORACLES['validation_report']}), p AS (WITH {AXIS_SQL} {PAIR_SQL}), t AS (WITH {CAND_SQL} SELECT CASE WHEN candidate_id % 5 = 4 THEN -1 ELSE candidate_id % 5 END AS tier FROM cand),
  m AS (SELECT count(*) AS pair_count, round(avg(margin), 9) AS average_pair_margin, CAST(1 AS DOUBLE) AS valid_pair_ratio FROM p)
  SELECT e.*, r.*, v.*, m.*, {COUNTS_SQL.format(k='CAST(tier AS VARCHAR)', t='t')} AS calibration_tier_distribution, {COUNTS_SQL.format(k='axis', t='p')} AS pairs_by_axis, 'axis_aligned=' || pair_count AS pairs_by_mode, true AS validation_metrics_available FROM e, r, v, m""")
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report: labels, pairs, ranking and validation in one row."""
    labels = cand(spark, sf_dir).withColumn("calibration_tier", F.when(F.col("candidate_id") % 5 < 4, F.col("candidate_id") % 5))
    mined = pairs.pair_counts(cand(spark, sf_dir), pairs.PairConfig(min_quality=0.0))
    validation = results(spark, sf_dir).withColumn("_ord", F.struct(*RESULT_ORDER))
    out = evaluate.report(labels, mined, rank.rank_by_utility(cand(spark, sf_dir)), 50, validation=validation)
    return nine(out.drop("average_pair_confidence").withColumns({c: as_text(c) for c in ("calibration_tier_distribution", "pairs_by_axis", "pairs_by_mode")}))


SCORES = [
    "l_partkey AS candidate_id", "CASE WHEN l_linenumber % 3 = 0 THEN 'before' WHEN l_linenumber % 3 = 1 THEN 'after' ELSE 'other' END AS checkpoint_label", "CASE l_partkey % 3 WHEN 0 THEN 'stable' WHEN 1 THEN 'unstable' END AS consensus_label",
    "CASE WHEN l_partkey % 2 = 0 THEN 'before' ELSE 'after' END AS source_side", "concat('reason ', l_partkey % 4) AS panel_reason", "CAST(l_extendedprice AS DOUBLE) AS logp_total", "l_orderkey", "l_linenumber", "l_quantity",
]


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*SCORES).withColumn("_ord", F.struct("l_orderkey", "l_linenumber", "l_quantity", "logp_total"))


SCORES_SQL = f"s AS (SELECT {', '.join(SCORES)} FROM lineitem)"


@query(f"WITH {SCORES_SQL} SELECT checkpoint_label, consensus_label, source_side, panel_reason, count(*) AS n, round(avg(logp_total), 6) AS mean, round(quantile_cont(logp_total, 0.5), 6) AS median FROM s GROUP BY ALL")
def logprob_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.logprob_groups(scores(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("mean", "median")})


@query(f"""WITH {SCORES_SQL}, l AS (SELECT candidate_id, checkpoint_label, consensus_label, panel_reason, logp_total FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id, checkpoint_label ORDER BY l_orderkey DESC, l_linenumber DESC, l_quantity DESC, logp_total DESC) AS rn FROM s) WHERE rn = 1),
  d AS (SELECT a.candidate_id, a.consensus_label, a.panel_reason, a.logp_total - b.logp_total AS delta FROM l a JOIN l b USING (candidate_id) WHERE a.checkpoint_label = 'after' AND b.checkpoint_label = 'before'),
  t AS (SELECT 'consensus_label' AS kind, coalesce(consensus_label, 'None') AS label, delta FROM d UNION ALL SELECT 'panel_reason', panel_reason, delta FROM d)
  SELECT kind, label, count(*) AS n, round(avg(delta), 6) AS mean, round(quantile_cont(delta, 0.5), 6) AS median FROM t GROUP BY kind, label
  UNION ALL SELECT 'stable_minus_unstable', NULL, NULL, round(avg(delta) FILTER (consensus_label = 'stable') - avg(delta) FILTER (consensus_label = 'unstable'), 6), NULL FROM d""")
def logprob_delta_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.logprob_delta_groups(scores(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("mean", "median")})


@query(f"""WITH {CAND_SQL}, {AXIS_SQL.removeprefix(CAND_SQL + ', ')}, p AS ({PAIR_SQL}), e AS (SELECT count(*) AS pair_count, round(sum(margin) / count(*), 9) AS average_pair_margin FROM p)
  SELECT 'axis_aligned' AS mode, pair_count, average_pair_margin FROM e UNION ALL SELECT 'first_half', count(*), round(sum(margin) / count(*), 9) FROM p WHERE winner_id % 2 = 0""")
def mode_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of two ways to make pairs, side by side."""
    mined = checkpointed(pairs.pair_counts(cand(spark, sf_dir), pairs.PairConfig(min_quality=0.0), lambda winner: winner % 2 == 0))
    out = compare.compare_modes({"axis_aligned": evaluate.pair_metrics(mined), "first_half": evaluate.pair_metrics(mined.where("tag"))})
    return nine(out.select("mode", "pair_count", "average_pair_margin"))


@query("""WITH a AS (SELECT l_partkey AS candidate_id, max_by(l_quantity, (l_orderkey, l_linenumber, l_quantity)) AS q FROM lineitem GROUP BY 1) SELECT p_partkey AS candidate_id, p_size AS size, q AS quantity FROM part LEFT JOIN a ON candidate_id = p_partkey""")
def audit_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with their last audit row."""
    left = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("candidate_id"), F.col("p_size").alias("size"))
    audit = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("candidate_id"), F.col("l_quantity").alias("quantity"), F.struct("l_orderkey", "l_linenumber", "l_quantity").alias("_ord"))
    return select.with_audit(left, audit, ["candidate_id"])


@query("""SELECT 'n' || s_suppkey AS node, CASE WHEN s_suppkey % 3 = 0 THEN 'IDLE' ELSE 'DRAIN' END AS state, CAST(s_suppkey % 9 AS INTEGER) AS gpus, 'a,b' AS partitions FROM supplier""")
def node_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as lines of a node listing, each node in two partitions."""
    k = F.col("s_suppkey")
    line = lambda p: F.concat_ws("|", F.concat(F.lit("n"), k.cast("string")), F.lit(p), F.when(k % 3 == 0, "idle").otherwise("drain"), F.concat(F.lit("gpu:a100:"), (k % 9).cast("string")))
    text = table(spark, sf_dir, "supplier").select(F.explode(F.array(line("b"), line("a*"))).alias("value"))
    return nodes.from_rows(text).select("node", "state", "gpus", F.array_join("partitions", ",").alias("partitions"))


@query("""SELECT 'report.json' AS file, 1 AS n, CAST((SELECT count(*) FROM part) AS BIGINT) AS total UNION ALL SELECT 'bank', 5, NULL UNION ALL SELECT 'config', 2, CAST(7 AS BIGINT) UNION ALL SELECT 'chosen', 3, NULL""")
def small_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A one-row report, a formula bank and a configuration, written and read through Spark's file systems."""
    path = folder(spark, "small")
    writers.write_json_row(table(spark, sf_dir, "part").agg(F.count("*").alias("rows")), f"{path}/report.json")
    names = [r[0] for r in table(spark, sf_dir, "region").select("r_name").collect()]  # five regions
    files.write_text(spark, f"{path}/bank.json", json.dumps({"formulas": names}))
    files.write_text(spark, f"{path}/config.json", json.dumps({"run": {"k": 1, "seed": 2}}))
    total = json.loads(files.read_text(spark, f"{path}/report.json"))["rows"]
    config = readers.read_config(spark, f"{path}/config.json", {"run": {"k": 7}})
    chosen = files.chosen_paths(spark, [f"{path}/bank.json", f"{path}/none.json"], [f"{path}/*.json"])
    rows = [("report.json", 1, total), ("bank", len(readers.formula_bank(spark, f"{path}/bank.json")), None), ("config", len(config["run"]), config["run"]["k"]), ("chosen", len(chosen), None)]
    return spark.createDataFrame(rows, "file string, n int, total long")


@query("""SELECT s_suppkey % 4 AS bucket, count(*) AS n FROM supplier GROUP BY 1""")
def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written below formula folders; the listing names them, their hashes tell them apart, the path gives the formula."""
    path = folder(spark, "listing")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 4).alias("bucket"))
    for k in range(4):
        as_lines(rows.where(F.col("bucket") == k).coalesce(1), f"{path}/formulas/f{k}/candidates.jsonl")
    found = files.matching(spark, f"{path}/formulas/*/candidates.jsonl/part-*")
    hashes = readers.file_hashes(spark, found).select(readers.formula_from_path("path").alias("formula"), "sha256")
    lines = artifacts.artifact_tree(spark, [path])[0].select(F.regexp_extract("path", "/formulas/([^/]+)/", 1).alias("formula"))
    both = lines.join(hashes.where("length(sha256) = 64").select("formula"), "formula")
    return both.groupBy(F.substring("formula", 2, 9).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


@query("""SELECT 'candidates_with_f4.jsonl' AS file, (SELECT count(*) FROM part) AS n UNION ALL SELECT 'f4_import_summary.json', 1 UNION ALL SELECT 'formula_summary.jsonl', (SELECT count(*) FROM nation) UNION ALL SELECT 'normalized_validation_results.jsonl', (SELECT count(*) FROM supplier) UNION ALL SELECT 'qa_failures.jsonl', (SELECT count(*) FROM region)
  UNION ALL SELECT 'unmatched_validation_rows.jsonl', (SELECT count(*) FROM region)""")
def sink_more_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the tables of the novelty, normalisation and collection sets."""
    path = folder(spark, "more")
    one = lambda name: table(spark, sf_dir, name)
    total = one("part").agg(F.count("*").alias("n"))
    written = outputs.novelty_outputs(f"{path}/f4", one("part"), total) | outputs.normalization_outputs(f"{path}/n", one("supplier"), total, one("region")) | outputs.collection_outputs(f"{path}/c", one("nation"), one("region"), total)
    names = ["candidates_with_f4.jsonl", "f4_import_summary.json", "formula_summary.jsonl", "normalized_validation_results.jsonl", "qa_failures.jsonl", "unmatched_validation_rows.jsonl"]
    out = None
    for name in names:
        rows = spark.read.text(written[name], wholetext=name.endswith(".json")).where("value != ''").agg(F.lit(name).alias("file"), F.count("*").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""SELECT concat('ref_', lpad(CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS VARCHAR), 6, '0')) AS reference_id, 'f' || p_size AS formula, CASE WHEN p_partkey % 2 = 0 THEN 'cif_text' ELSE 'cif_path' END AS kind FROM part""")
def prepared_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("_ord"), F.concat(F.lit("f"), F.col("p_size").cast("string")).alias("formula"), F.when(k % 2 == 0, "data_x").alias("cif"), F.lit("x.cif").alias("cif_path"))
    return readers.prepare_references(rows).select("reference_id", "formula", "kind")


@query("""SELECT 'f' || o_custkey % 7 AS formula, count(*) AS n FROM orders WHERE o_custkey % 7 IN (1, 2) AND o_orderkey % 50 > 0 GROUP BY 1""")
def reference_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference lines of the wanted formulas, broken ones left out."""
    k = F.col("o_orderkey")
    line = F.when(k % 50 == 0, "{broken").otherwise(F.to_json(F.struct(F.concat(F.lit("f"), (F.col("o_custkey") % 7).cast("string")).alias("formula"), k.alias("id"))))
    table(spark, sf_dir, "orders").select(line.alias("value")).write.text(path := folder(spark, "references"))
    return evaluate.histogram(readers.reference_rows(spark, path, ["f1", "f2"])[0], "formula")
