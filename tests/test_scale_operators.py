"""Operators that must not gather a group in one place, against plain definitions."""

import ast
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions import literals, quantiles
from assay.functions.columns import python_round
from assay.functions.joins import join_keyed
from assay.operators import dpo, pair_qa, pairs, reference_match, structures
from assay.sources import adapters, artifacts
from assay.streaming import validation_stream


def test_python_round_equals_python(spark):
    r = random.Random(1)
    values = [r.uniform(-1, 1) * 10 ** r.randint(-9, 12) for _ in range(100_000)]
    values += [k / 2**20 for k in range(-3000, 3000)] + [k + 0.0000005 for k in range(100)] + [2.0**k + 0.5e-6 for k in range(30, 36)] + [0.5, 1.5, 2.5, -0.5, 1e300, -0.0, 2.675, 1.005, 4e9 + 0.1234565]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double")
    for digits in (0, 2, 6):
        got = dict(rows.select("i", python_round("x", digits)).collect())
        wrong = [(x, got[i], round(x, digits)) for i, x in enumerate(values) if got[i] != round(x, digits)]
        assert not wrong, wrong[:3]
    odd = spark.createDataFrame([(float("inf"),), (None,), (float("nan"),)], "x double").select(python_round("x").alias("x")).collect()
    assert odd[0].x == math.inf and odd[1].x is None and math.isnan(odd[2].x)


def test_join_keyed_is_a_join_with_hot_and_null_keys(spark):
    left = spark.createDataFrame([("hot", i) for i in range(50)] + [("b", 1), ("c", 2), (None, 3)], "k string, v int")
    right = spark.createDataFrame([("hot", "H"), ("b", "B"), ("z", "Z"), (None, "N")], "k string, w string")
    for how in ("inner", "left"):
        want = sorted(map(repr, left.join(right, "k", how).collect()))
        for limits in ({}, {"hot_rows": 10}, {"hot_rows": 1, "hot_keys": 1}):
            assert sorted(map(repr, join_keyed(left, right, ["k"], how, **limits).collect())) == want


def test_first_reference_equals_the_plain_definition_with_few_kernel_calls(spark):
    r = random.Random(2)
    tasks = [(i, r.choice(["f", "f", "f", "g", None, "none"]), r.randint(1, 4), r.random()) for i in range(120)]
    references = [(100 + j, r.choice(["f", "f", "g"]), r.randint(0, 30), r.randint(1, 4), r.random()) for j in range(90)]
    calls = spark.sparkContext.accumulator(0)

    def kernel(frames):
        for frame in frames:
            calls.add(len(frame))
            yield frame.assign(fits=(frame.volume - frame.ref_volume).abs() < 0.1)

    def fits(df):
        return df.mapInPandas(kernel, T.StructType([*df.schema.fields, T.StructField("fits", T.BooleanType())]))

    t = spark.createDataFrame(tasks, "candidate_id int, formula string, sites int, volume double")
    ref = spark.createDataFrame(references, "reference_id int, formula string, ref_ord int, ref_sites int, ref_volume double")
    got = {x.candidate_id: x for x in reference_match.match_references(t, ref, fits, lambda: F.col("sites") == F.col("ref_sites")).collect()}
    everything = sum(t[1] == x[1] for t in tasks for x in references)
    assert len(got) == len(tasks)
    for i, formula, sites, volume in tasks:
        bucket = sorted((x for x in references if x[1] == formula), key=lambda x: (x[2], x[0]))
        hits = [n for n, x in enumerate(bucket) if x[3] == sites and abs(x[4] - volume) < 0.1]
        row = got[i]
        assert row.reference_id == (bucket[hits[0]][0] if hits else None)
        assert row.match_type == (reference_match.NO_BUCKET if not bucket else reference_match.MATCH if hits else reference_match.NO_MATCH)
        assert row.checked_reference_count == (hits[0] + 1 if hits else len(bucket)) and row.formula_bucket_size == len(bucket)
    assert 0 < sum(x.kernel_calls for x in got.values()) == calls.value < everything / 3
    empty = reference_match.match_references(t.limit(0), ref, fits)
    assert empty.count() == 0 and {"reference_id", "match_type", "kernel_calls"} <= set(empty.columns)
    assert {x.match_type for x in reference_match.match_references(t, ref.limit(0), fits).collect()} == {reference_match.NO_BUCKET}


def test_the_entry_of_a_pair_follows_eight_preferences(spark):
    r = random.Random(4)
    entries = [(r.choice("ab"), r.choice("RS"), r.choice(["f", "g", None]), r.random() < 0.4, k) for k in range(14)]
    sides = sorted({(r.choice("abz"), r.choice("RST"), r.choice(["f", "g", "h", None])) for _ in range(40)}, key=repr)
    df = spark.createDataFrame(entries, "candidate_id string, root string, formula string, audited boolean, _ord int")
    asked = spark.createDataFrame(sides, "candidate_id string, root string, formula string")
    got = {(x.candidate_id, x.root, x.formula): x.entry._ord for x in pair_qa.best_entries(asked, df).collect()}
    for i, root, formula in sides:
        mine = [e for e in entries if e[0] == i]
        rules = [
            lambda e: e[1] == root and formula and e[2] == formula and e[3], lambda e: e[1] == root and formula and e[2] == formula, lambda e: e[1] == root and e[3], lambda e: e[1] == root,
            lambda e: formula and e[2] == formula and e[3], lambda e: formula and e[2] == formula, lambda e: e[3], lambda e: True,
        ]
        want = next((e[4] for rule in rules for e in mine if rule(e)), None)
        assert got.get((i, root, formula)) == want


def test_pair_findings_take_what_a_pair_states_before_its_entries(spark):
    pair = {"pair_id": "p", "condition": "none", "formula": "f", "chosen_candidate_id": "a", "rejected_candidate_id": "a", "chosen_formula": "g", "rejected_condition": {"formula": "h", "generation": {"K": 1}, "spacegroup": "3"}, "chosen_spacegroup": 4, "chosen_score": "0.5", "rejected_score": 0.25, "preference_margin": 0.25, "preference_type": "x"}
    rows = spark.createDataFrame([("path", "R", json.dumps(pair)), ("path", "R", json.dumps({"pair_id": ""}))], "path string, root string, t string").select("path", "root", F.parse_json("t").alias("row"))
    none = spark.createDataFrame([], "path string, root string, artifact string, _ord int, t string").select("path", "root", "artifact", "_ord", F.parse_json("t").alias("row"))
    got = sorted((x.pair_id or "", x.check) for x in pair_qa.pair_findings(pair_qa.pair_fields(rows), pair_qa.candidate_fields(none)).collect())
    assert got == sorted([("", "missing_condition"), ("", "missing_pair_candidate_id")] + [("p", c) for c in (
        "missing_condition", "same_chosen_rejected", "missing_chosen_candidate", "missing_rejected_candidate", "cross_formula_pair", "formula_mismatch", "formula_mismatch", "generation_condition_mismatch", "cross_spacegroup_condition_pair",
        "chosen_score_worse_than_rejected", "preference_margin_inconsistent", "chosen_missing_sequence_fields", "rejected_missing_sequence_fields", "unsupported_preference_type")])


def test_quantiles_by_selection_equal_numpy(spark):
    r = random.Random(5)
    rows = [(r.choice(["hot"] * 5 + ["b", None]), r.choice([None, 0.5, -1.0, r.random(), -r.random() * 1e9])) for _ in range(3000)] + [("empty", None)]
    qs = {"low": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "high": 1.0}
    got = {x.k: x for x in quantiles.summary(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v", qs).collect()}
    assert set(got) == {"hot", "b", None, "empty"}
    for k, row in got.items():
        values = [v for key, v in rows if key == k and v is not None]
        assert row.n == len(values)
        for name, q in qs.items():
            assert row[name] == (pytest.approx(float(np.quantile(values, q))) if values else None)
    whole = quantiles.summary(spark.createDataFrame(rows, "k string, v double"), [], "v", {"p50": 0.5}).first()
    assert whole.p50 == pytest.approx(float(np.median([v for _, v in rows if v is not None])))


def test_limited_pairs_are_the_first_of_all(spark):
    r = random.Random(6)
    rows = [(i, r.choice(["a", "a", "a", "b", "c"]), r.choice([0.1, 0.1005, r.random()]), r.random() < 0.3, False) for i in range(150)]
    df = spark.createDataFrame(rows, "candidate_id int, condition string, score double, f3_validated boolean, f3_unavailable boolean")
    everything = dpo.condition_pairs(df).orderBy("condition", "chosen_score", "chosen_id", "rejected_score", "rejected_id").collect()
    for n in (1, 7, 300, 10**6):
        got = dpo.condition_pairs(df, max_pairs=n).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, everything[:n]))
    assert dpo.first_chosen(df, 0.01, 5).count() == 1  # one row makes the first five pairs


def test_rank_neighbors_equal_brute_force(spark):
    r = random.Random(7)
    rows = [(f"c{i}", r.choice("fg"), r.choice([0.0, 0.1]), 0.0, round(r.random(), 2), (kind := r.random()) < 0.5, kind >= 0.5) for i in range(160)]
    df = spark.createDataFrame(rows, "candidate_id string, formula string, f1 double, f2 double, mean_force double, is_good boolean, is_near_miss boolean")
    got = sorted((x.chosen_id, x.rejected_id) for x in dpo.rank_neighbors(df, 2).collect())
    place = {}
    for good in (True, False):
        groups = {}
        for x in rows:
            if x[5] == good:
                groups.setdefault(x[1] if good else x[1:4], []).append(x)
        for group in groups.values():
            group.sort(key=lambda x: (x[4], x[0]))
            # Ties in (force, id) do not occur: ids differ.
            place |= {x[0]: i / (len(group) - 1) if len(group) > 1 else 0.0 for i, x in enumerate(group)}
    want = []
    for x in rows:
        if x[5]:
            near = sorted((y for y in rows if not y[5] and y[1:4] == x[1:4]), key=lambda y: (abs(place[x[0]] - place[y[0]]), y[4], y[0]))
            want += [(x[0], y[0]) for y in near[:2]]
    assert got == sorted(want)


def test_grid_join_keeps_the_pairs_of_the_full_join(spark):
    r = random.Random(8)
    value = lambda: r.choice([None, 0.0, 0.15, 0.3, round(r.random(), 2), r.random() * 3 - 1])
    rows = [(i, i, r.randint(1, 9), r.choice(["p", None]), r.choice([1, 2, None]), "x", value(), value(), value(), None, 0.9, True) for i in range(150)]
    df = spark.createDataFrame(rows, "candidate_id int, _ord int, atoms int, prototype string, space_group int, family string, f1 double, f2 double, f3 double, f4 double, confidence double, is_valid boolean")
    for cfg in (pairs.PairConfig(min_quality=0.0), pairs.PairConfig(min_quality=0.0, other_gap=0.0), pairs.PairConfig(min_quality=0.0, other_gap=1.0, atom_tolerance=1.0)):
        want = pairs.pair_columns(pairs.axis_rows(df, cfg).where("reason is null")).collect()
        got = pairs.mine_axis_pairs(df, cfg).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, want)) and want


LITERALS = ["[[0.1,0.2,0.3],[1,2,3]]", "((.1, 2., +3),)", "0 0 0; .5 .5 .5; 1 2", "[0.1,0.2,0.3,4]", "1,2,3", "(0,0,0),(1,1,1)", "abc", "", "None", "[]", "[[1,2],[1,2,3]]", "6", "{'a': 1}"]


def test_coordinates_of_every_literal_form(spark):
    def plain(text):
        text = text.strip()
        value = text
        for parse in (json.loads, ast.literal_eval):
            try:
                value = parse(text)
                break
            except (ValueError, SyntaxError):
                continue
        if isinstance(value, str):
            rows = [x.replace(",", " ").split() for x in value.split(";")]
            return [list(map(float, x)) for x in rows if len(x) == 3]
        if not isinstance(value, list | tuple):
            return []
        if value and all(not isinstance(x, list | tuple) for x in value):
            return [list(map(float, value[i : i + 3])) for i in range(0, len(value) - 2, 3)]
        return [list(map(float, x)) for x in value if len(x) == 3]

    df = spark.createDataFrame([(t,) for t in LITERALS], "t string").withColumn("v", literals.literal("t"))
    for row in df.select("t", literals.coordinates(F.col("v")).alias("c")).collect():
        assert row.c == plain(row.t), row.t


def test_species_fields_and_active_sites(spark):
    rows = [("[11, 0, 17]", ["Na", "Cl"], [0, 2]), ("11;17;0", ["Na", "Cl"], [0, 1]), ("['Na', 'Cl']", ["Na", "Cl"], None), ("Na Cl", ["Na", "Cl"], None), ("6", ["6"], None), ("", [], None), ("[[1],[8]]", ["H", "O"], [0, 1])]
    df = structures.with_species(spark.createDataFrame([(t,) for t, _, _ in rows], "t string").withColumn("v", literals.literal("t")), "v")
    assert [(r.t, r.species, r.active) for r in df.collect()] == rows
    some = F.array(*map(F.lit, "abc"))
    kept = lambda *at: structures.at_active(some, F.array(*map(F.lit, at)) if at else F.lit(None).cast("array<int>"))
    assert list(spark.range(1).select(kept(0, 2), kept(0, 3), kept()).first()) == [["a", "c"], ["a", "b", "c"], ["a", "b", "c"]]


def test_line_numbers_across_splits_and_issues_of_broken_files(spark, tmp_path):
    folder = tmp_path / "root" / "dpo_preferences" / "f7"
    folder.mkdir(parents=True)
    lines = [json.dumps({"k": i, "pad": "x" * 40}) for i in range(3000)]
    lines[10], lines[1500], lines[2999] = "", "{broken", '{"k": 1} more'
    (folder / "candidates.jsonl").write_text("\n".join(lines) + "\n")
    (folder / "audit_summary.json").write_text("[1")
    (folder / "preference_summary.json").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 16 << 10)
    try:
        rows, errors, files = artifacts.artifact_tree(spark, [str(tmp_path / "root")])
        assert spark.read.text(str(folder / "candidates.jsonl")).rdd.getNumPartitions() > 5
        got = sorted((e.issue, e.artifact, e.formula, e.line_no) for e in errors.collect() if e.issue != "missing_artifact")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [("corrupt_json", "audit_summary.json", "f7", None), ("empty_artifact", "preference_summary.json", "f7", None), ("malformed_jsonl", "candidates.jsonl", "f7", 1501), ("malformed_jsonl", "candidates.jsonl", "f7", 3000)]
    assert rows.where("ok").count() == 0 and files.count() == 3
    gone = {e.artifact for e in errors.where("issue = 'missing_artifact'").collect()}
    assert gone == {"audit_candidates.jsonl", "failure_vectors.jsonl", "report.md", "preference_pairs.jsonl"}


def test_stored_sequences_and_conditions_are_read(spark, tmp_path):
    row = {"candidate_id": "a", "species": ["Na", "Cl"], "frac_coords": [[0, 0, 0], [0.5, 0.5, 0.5]], "lattice_matrix": [[1, 0, 0], [0, 1, 0], [0, 0, 1]], "metadata": {"raw_sequence_fields": {"g": 1, "W": "a", "A": "b"}, "raw_X": "x", "raw_L": "l", "temperature": 0.7, "formula_condition": "NaCl", "spacegroup_condition": 225}}
    (tmp_path / "candidates.jsonl").write_text(json.dumps(row) + "\n")
    got = adapters.load(spark, str(tmp_path)).first()
    assert tuple(got.sequence) == ("1", "a", "b", "x", "l") and got.composition == "NaCl" and got.generation == {"temperature": "0.7"}
    assert (got.mode, got.formula_condition, got.spacegroup_condition, len(got.frac_coords), got.pbc) == ("csp", "NaCl", 225, 2, [True, True, True])


def test_stream_rewrites_only_the_buckets_a_batch_touches(spark, tmp_path):
    vs = validation_stream
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    put = lambda name, *rows: (source / name).write_text("".join(json.dumps({"candidate_id": c, "validator": "A", "validation_status": s, "ts": f"2024-01-{d:02d}T00:00:00Z"}) + "\n" for c, d, s in rows))
    run = lambda: vs.keep_latest(vs.validation_files(spark, str(source)), target, str(tmp_path / "ck"), buckets=16).awaitTermination(60)
    put("1.json", *((f"c{i}", 1, "failed") for i in range(60)))
    run()
    put("2.json", ("c5", 2, "completed"), ("c6", 0 + 1, "completed"), ("new", 1, "failed"))
    run()
    got = {r.candidate_id: r.validation_status for r in vs.read_latest(spark, target).collect()}
    assert len(got) == 61 and got["c5"] == "completed" and got["c7"] == "failed" and got["c6"] == "failed"
    second = [p for p in vs.bucket_paths(spark, target).values() if "batch=000000000001" in p]
    assert 1 <= len(second) <= 3
    (tmp_path / "out" / "batch=000000000001" / "_SUCCESS").unlink()  # an unfinished batch does not count
    assert {r.validation_status for r in vs.read_latest(spark, target).collect()} == {"failed"}
    (tmp_path / "out" / "batch=000000000001" / "_SUCCESS").write_text("")
    before = sorted(map(repr, vs.read_latest(spark, target).collect()))
    assert len(vs.remove_superseded(spark, target)) == len(second)
    assert sorted(map(repr, vs.read_latest(spark, target).collect())) == before


def test_last_votes_are_shuffled_once_with_their_consensus(spark):
    from assay.operators import validate

    made = [(k % 5, "abc"[k * 7 % 3 if k % 5 else k % 2], k * 13 % 41, (None, True, False)[k % 3], k / 10, k / 20, k % 4 > 0) for k in range(60)]
    rows = spark.createDataFrame(made, "candidate_id long, validator string, _ord long, is_stable boolean, force_max double, stress_max double, relaxation_converged boolean")
    out = validate.consensus_with_latest(rows, ["a", "b", "c"], ["_ord"])
    last = {}
    for r in sorted(made, key=lambda r: r[2]):
        last.setdefault(r[0], {})[r[1]] = (r[3], r[4])
    want = {c: {v: x for v, x in vs.items()} for c, vs in last.items() if len(vs) == 3}
    assert {r.candidate_id: {x.validator: (x.is_stable, x.force_max) for x in r.latest} for r in out.collect()} == want and 0 < len(want) < 5
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1  # one shuffle


def test_quantiles_come_with_their_mean_in_one_pass(spark):
    from assay.functions.quantiles import summary

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([("a", float(k % 7)) for k in range(50)] + [("b", None)], "key string, x double")
    got = {r.key: (r.n, r.mean) for r in summary(rows.mapInArrow(count, rows.schema), ["key"], "x", {"p50": 0.5}, mean=True).collect()}
    assert got == {"a": (50, sum(k % 7 for k in range(50)) / 50), "b": (0, None)} and seen.value == 51


def test_repeated_entries_do_not_come_under_eight_keys(spark):
    from assay.operators import pair_qa

    made = [("c", "r1", "f1", False, k, f"g{k}") for k in range(500)] + [("c", "r2", "f1", True, 1000, "x"), ("c", "r1", None, False, -1, "y")]
    entries = spark.createDataFrame(made, "candidate_id string, root string, formula string, audited boolean, _ord long, generation string")
    sides = spark.createDataFrame([("c", "r1", "f1"), ("c", "r1", "f9"), ("c", "r3", "f1"), ("d", "r1", "f1")], "candidate_id string, root string, formula string")
    out = pair_qa.best_entries(sides, entries)
    assert {(r.candidate_id, r.root, r.formula): r.entry._ord for r in out.collect()} == {("c", "r1", "f1"): 0, ("c", "r1", "f9"): -1, ("c", "r3", "f1"): 1000}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [candidate_id" in plan[plan.index("Generate"):]
