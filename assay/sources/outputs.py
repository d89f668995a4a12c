"""Output sets: the named files that a step of the workflow leaves in a folder."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import matching, remove, rename, write_text
from .writers import markdown_table, sorted_json, sorted_json_value, write_jsonl


def union_csv(df: DataFrame, path: str, *more: DataFrame) -> None:
    """CSV of all frames under the union of their columns, in first-seen order."""
    for other in more:
        df = df.unionByName(other, allowMissingColumns=True)
    df.write.mode("overwrite").csv(path, header=True)


def write_shards(df: DataFrame, folder: str, shards: int, shard: str = "shard_id", prefix: str = "tasks.shard_") -> list[str]:
    """JSON lines of each shard below its own name, those without a row too; the paths.

    All shards are written in one pass, by ranges of (shard, ``_ord``), so a
    large one is spread over tasks and its files are in order; their folders
    are then named. Without ``_ord`` rows keep the order they are read in.
    A shard outside 0..``shards`` - 1, or null, raises.
    """
    spark, folder = df.sparkSession, folder.rstrip("/")
    paths = [f"{folder}/{prefix}{k:03d}.jsonl" for k in range(shards)]
    staging = f"{folder}/_shards-{uuid.uuid4().hex}"
    order = F.col("_ord") if "_ord" in df.columns else F.monotonically_increasing_id()
    rows = df.withColumns({"_shard": F.col(shard), "_place": order}).drop("_ord")
    lines = rows.select("_shard", "_place", sorted_json_value([c for c in rows.columns if c not in ("_shard", "_place")]).alias("value"))
    lines.repartitionByRange("_shard", "_place").sortWithinPartitions("_shard", "_place").drop("_place").write.partitionBy("_shard").text(staging)
    try:
        found = {p.rsplit("=", 1)[1]: p for p in matching(spark, f"{staging}/_shard=*")}
        if wrong := sorted(set(found) - {str(k) for k in range(shards)}):
            raise ValueError(f"shards outside 0..{shards - 1}: {wrong}")
        for k, path in enumerate(paths):
            if str(k) in found:
                rename(spark, found[str(k)], path)
            else:
                remove(spark, path)
                write_text(spark, f"{path}/part-00000.txt", "")
    finally:
        remove(spark, staging)
    return paths


def one_row(df: DataFrame) -> str:
    """A one-row report as indented JSON with sorted keys."""
    return json.dumps(json.loads(sorted_json(df).first().value), indent=2, sort_keys=True) + "\n"


def write_set(spark: SparkSession, folder: str, tables: dict[str, DataFrame], rows: dict[str, DataFrame], texts: dict[str, str]) -> dict[str, str]:
    """Tables as JSON lines, one-row reports as JSON and texts; name -> path."""
    folder = folder.rstrip("/")
    for name, table in tables.items():
        write_jsonl(table, f"{folder}/{name}")
    for name, row in rows.items():
        write_text(spark, f"{folder}/{name}", one_row(row))
    for name, text in texts.items():
        write_text(spark, f"{folder}/{name}", text)
    return {name: f"{folder}/{name}" for name in [*tables, *rows, *texts]}


def summary_text(title: str, summary: DataFrame) -> str:
    """A Markdown list of a one-row summary."""
    row = json.loads(sorted_json(summary).first().value)
    return "\n".join([f"# {title}", "", "## Summary", *(f"- {k}: {v}" for k, v in row.items()), ""])


def audit_outputs(folder: str, candidates: DataFrame, audit: DataFrame, summary: DataFrame) -> dict[str, str]:
    vectors = audit.select(*[c for c in ("_ord", "candidate_id", "f1_geometry", "f2_chemistry", "f3_stability", "calibration_tier", "is_valid", "hard_failures") if c in audit.columns])
    texts = {"error_audit_table.md": markdown_table(audit.drop("_ord")), "report.md": summary_text("Error audit", summary)}
    return write_set(audit.sparkSession, folder, {"candidates.jsonl": candidates, "audit_candidates.jsonl": audit, "failure_vectors.jsonl": vectors}, {"audit_summary.json": summary}, texts)


def preference_outputs(folder: str, pairs: DataFrame, summary: DataFrame) -> dict[str, str]:
    return write_set(pairs.sparkSession, folder, {"preference_pairs.jsonl": pairs}, {"preference_summary.json": summary}, {"report.md": summary_text("Preference pairs", summary)})


def novelty_outputs(folder: str, candidates: DataFrame, summary: DataFrame) -> dict[str, str]:
    return write_set(candidates.sparkSession, folder, {"candidates_with_f4.jsonl": candidates}, {"f4_import_summary.json": summary}, {"f4_import_report.md": summary_text("Novelty import", summary)})


def normalization_outputs(folder: str, rows: DataFrame, summary: DataFrame, unmatched: DataFrame) -> dict[str, str]:
    tables = {"validation_results.jsonl": rows, "normalized_validation_results.jsonl": rows, "unmatched_validation_rows.jsonl": unmatched}
    return write_set(rows.sparkSession, folder, tables, {"normalization_summary.json": summary}, {"report.md": summary_text("Offline validation normalization", summary)})


def collection_outputs(folder: str, formulas: DataFrame, failures: DataFrame, verdict: DataFrame) -> dict[str, str]:
    tables = {"formula_summary.jsonl": formulas, "qa_failures.jsonl": failures}
    return write_set(formulas.sparkSession, folder, tables, {"qa_summary.json": verdict}, {"collection_report.md": summary_text("Collection", verdict)})
