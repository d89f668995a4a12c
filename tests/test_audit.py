"""Audit rows, shard counts and reference pools against plain definitions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from assay.operators import audit, detail
from assay.sources import files, outputs

SCHEMA = """candidate_id string, composition string, structure_ref string, species array<string>, frac_coords array<array<double>>, lattice_matrix array<array<double>>,
    f1_geometry double, f2_chemistry double, f3_stability double, hard_failures array<string>, oracle_error string, meta string, formula string, score int"""


def some(r, *values):
    return r.choice([None, "", *values])


def a_row(r, i):
    meta = {}
    for name in ("condition_mode", "formula_condition", "source_model", "source_checkpoint", "temperature", "top_k", "K", "parse_status", "parse_error_message", "parse_error_type", "source_format"):
        if r.random() < 0.5:
            meta[name] = some(r, "x", "y")
    if r.random() < 0.5:
        meta["spacegroup_condition"] = some(r, "225", "12.7", "none", 9)
    if r.random() < 0.5:
        meta["sampling_metadata"] = r.choice(["text", {n: some(r, "s", "t") for n in ("temperature", "sample_temperature", "sampling_temperature", "top_k", "K") if r.random() < 0.6}])
    value = lambda: r.choice([None, "", [], "v", [1, 2]])
    if r.random() < 0.6:
        meta["raw_sequence_fields"] = r.choice(["text", {n: value() for n in "gWAXL"}, {n: "v" for n in "gWAXL"}])
    for n in "gWAXL":
        if r.random() < 0.4:
            meta[f"raw_{n}"] = value()
    if r.random() < 0.2:
        meta["raw_sequence_status"], meta["missing_sequence_fields"] = r.choice([("partial", ["g"]), ("full", []), ("", ["g"]), ("full", None)])
    whole = r.random() < 0.4
    number = lambda: r.choice([None, r.random() / 5])
    return (
        some(r, f"c{i}"), some(r, "NaCl"), some(r, "ref"), ["Na"] if whole else None, [[0.0]] if whole else [], [[5.0]] if whole else [], r.random() / 5, r.random() / 5, number(),
        r.choice([None, [], ["b", "a", "b"]]), r.choice([None, None, None, "KernelError: x"]), r.choice([json.dumps(meta)] * 9 + [None]), "other", 1,
    )


def gone(x):
    return x is None or x == "" or x == []


def plain(row, formula, group, known):
    _, composition, ref, species, coords, lattice, f1, f2, f3, hard, error, meta, *_ = row
    m = json.loads(meta) if meta else {}
    fields = m.get("raw_sequence_fields") if isinstance(m.get("raw_sequence_fields"), dict) else {}
    missing = [n for n in "gWAXL" if gone(fields.get(n)) and gone(m.get(f"raw_{n}"))]
    status = "missing" if len(missing) == 5 else "partial" if missing else "full"
    if m.get("raw_sequence_status") and isinstance(m.get("missing_sequence_fields"), list):
        status, missing = m["raw_sequence_status"], m["missing_sequence_fields"]
    sampling = m.get("sampling_metadata") if isinstance(m.get("sampling_metadata"), dict) else {}
    generation = {}
    for n in ("source_model", "source_checkpoint", "temperature", "top_k", "K", "sample_temperature", "sampling_temperature"):
        own = m.get(n) if not n.startswith("sampl") else None
        more = sampling.get(n) if not n.startswith("source") else None
        value = own if not gone(own) else more
        if not gone(value):
            generation[n] = str(value)
    sg = m.get("spacegroup_condition", group)
    sg = None if sg in (None, "", "none") else int(float(sg))
    where = m.get("formula_condition") or formula or composition or None
    parse = m.get("parse_status") or ("parsed_full_structure" if species and coords and lattice else "parse_error" if m.get("parse_error_message") else "unparsed_cif" if ref else "partial_structure")
    if error:
        f1, f2, f3, hard = 1.0, 1.0, None, ["oracle_error"]
    f3 = f3 if known else None
    values = [x for x in (f1, f2, f3) if x is not None]
    why = [] if row[0] else ["missing_candidate_id"]
    why += [] if where else ["missing_condition"]
    why += {"missing": ["missing_raw_sequence"], "partial": ["partial_raw_sequence"] + (["missing_sequence_fields:" + ",".join(missing)] if missing else [])}.get(status, [])
    why += ["parse_error"] if parse == "parse_error" else []
    reasons = sorted(set((hard or []) + ([parse] if parse in ("unparsed_cif", "parse_error", "partial_structure") else [])))
    return [
        m.get("condition_mode", "csp"), where, sg, generation, status, missing, parse, round(sum(values) / len(values), 6), why, reasons,
        "geometry_chemistry_only" if not why and f3 is None else None, error or m.get("parse_error_message") or m.get("parse_error_type") or None, "unknown_unavailable" if f3 is None else "available",
    ]


def test_audit_rows_equal_the_plain_definition(spark):
    r = random.Random(3)
    rows = [a_row(r, i) for i in range(400)] * 2  # repeated rows are audited alike
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_place", F.monotonically_increasing_id()).withColumn("metadata", F.parse_json("meta"))
    for formula, group, mode in ((None, None, audit.UNAVAILABLE), ("LiF", 3, "offline")):
        got = audit.audit_candidates(df, formula, group, mode).orderBy("_place").collect()
        assert len(got) == len(rows)
        for x, row in zip(got, rows, strict=True):
            want = plain(row, formula, group, mode != audit.UNAVAILABLE)
            c = x.condition
            error = x.evidence.parse_error
            have = [c.mode, c.formula, c.spacegroup, c.generation, x.raw_sequence_status, x.missing_sequence_fields, x.parse_status, x.failure_score, x.dpo_ineligible_reasons, x.failure_reasons, x.preference_type, error, x.evidence.f3_status]
            assert have == want, (row, have, want)
            assert x.dpo_eligible == (not want[8]) and x.formula == "other" and x.score == 1  # columns of clashing names pass through
    assert audit.audit_candidates(df.limit(0)).count() == 0


def test_shards_are_counted_as_files_and_folders(spark, tmp_path):
    tasks = spark.range(10).select(F.col("id").alias("task_id"), (F.col("id") % 3).cast("int").alias("shard_id"))
    paths = outputs.write_shards(tasks, f"file://{tmp_path}/s", 4)
    single, broken = f"{tmp_path}/one.jsonl", f"{tmp_path}/broken.jsonl"
    files.write_text(spark, single, '{"a": 1}\n\n{"a": 2}')
    files.write_text(spark, broken, '{"a": 1}\n[1]\n{')
    named = [*paths, single, broken, f"{tmp_path}/none.jsonl", single]
    got = {x.path: (x.exists, x.n_rows, x.n_bad) for x in detail.shard_counts(spark, named).collect()}
    assert [got[p] for p in paths] == [(True, 4, 0), (True, 3, 0), (True, 3, 0), (True, 0, 0)]
    assert got[single] == (True, 2, 0) and got[broken] == (True, 3, 2) and got[f"{tmp_path}/none.jsonl"] == (False, 0, 0) and len(got) == 7
    issues = lambda ps, n: sorted(x.issue for x in detail.shard_issues(detail.shard_counts(spark, ps), n).collect())
    assert issues(paths, 10) == [] and issues(paths, None) == [] and issues([], 10) == ["missing_shard_paths"]
    assert issues([single, broken], 3) == [f"invalid_shard_jsonl:{broken}", "shard_task_count_mismatch:expected_3:actual_2"]
    assert issues([f"{tmp_path}/none.jsonl"], 1) == [f"missing_shard:{tmp_path}/none.jsonl", "shard_task_count_mismatch:expected_1:actual_0"]


def test_reference_pool_and_readiness(spark):
    manifest = spark.createDataFrame([(detail.POOL_SCHEMA, False, "p", 5)], "schema_version string, example_manifest boolean, reference_pool_id string, total_reference_count long")
    sources = spark.createDataFrame([("a", 5, True), ("b", 0, True), (None, 2, False), ("d", None, None)], "name string, reference_count long, exists boolean")
    of = lambda *args: sorted(x.issue for x in detail.pool_issues(*args).collect())
    assert of(manifest, sources.where("name = 'a'"), "p") == []
    assert of(manifest, sources) == ["reference_source_empty:b", "reference_source_empty:d", "reference_source_missing:None"]
    assert of(manifest.limit(0), sources) == ["missing_reference_manifest"]
    odd = spark.createDataFrame([(None, True, None, None)], manifest.schema)
    assert of(odd, sources.limit(0), "p") == ["reference_manifest_is_example", "reference_manifest_schema_mismatch", "reference_pool_empty", "reference_pool_id_mismatch", "reference_sources_empty"]
    assert detail.readiness(detail.pool_issues(manifest, sources)).first().asDict() == {"issue_count": 3, "ready": False, "tasks_issues": 0, "shards_issues": 0, "reference_pool_issues": 3, "results_issues": 0}
    assert detail.readiness(detail.pool_issues(manifest, sources.where("name = 'a'"))).first().ready


def test_shards_are_written_in_one_pass_in_order(spark, tmp_path):
    hot = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5).cast("int")
    rows = spark.range(0, 4000, 1, 6).select(F.col("id").alias("n"), hot.alias("shard_id"), F.when(F.col("id") % 2 == 0, "x").alias("t"), (-F.col("id")).alias("_ord"))
    for _ in range(2):  # writing again replaces
        paths = outputs.write_shards(rows, f"file://{tmp_path}/w", 6)
    assert sorted(p.name for p in (tmp_path / "w").iterdir()) == [f"tasks.shard_{k:03d}.jsonl" for k in range(6)]
    for k, path in enumerate(paths):
        parts = sorted((tmp_path / "w" / path.rsplit("/", 1)[1]).glob("part-*"))
        lines = [json.loads(line) for p in parts for line in p.read_text().splitlines()]
        want = sorted((i for i in range(4000) if (0 if i % 3 == 0 else i % 5) == k), reverse=True)
        assert [x["n"] for x in lines] == want and all(list(x) == ["n", "shard_id", "t"] for x in lines)
    for bad in (rows.withColumn("shard_id", F.lit(6)), rows.withColumn("shard_id", F.lit(None).cast("int"))):
        with pytest.raises(ValueError, match="shards outside"):
            outputs.write_shards(bad, f"file://{tmp_path}/bad", 6)
    assert outputs.write_shards(rows.limit(0), f"file://{tmp_path}/none", 2) and len(list((tmp_path / "none").iterdir())) == 2
