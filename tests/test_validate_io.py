"""Duplicate policies, coercion dialects, readers and writers."""

import json

import pytest
from pyspark.sql import functions as F

from assay.functions import columns
from assay.functions.numbering import numbered
from assay.operators import checks, dpo, evaluate, label, loop, nodes, select, validate
from assay.sources import readers, writers


def values(df, column="x"):
    return [r[column] for r in df.collect()]


def test_coercion_dialects_differ(spark):
    words = ["true", "false", "pass", "stable", "no", "maybe", "", None, "0", "2"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, t string")
    got = {r.t: tuple(r)[1:] for r in df.select("t", *(f("t").alias(f.__name__) for f in (columns.bool_c1, columns.bool_c2, columns.bool_c3, columns.bool_c4))).collect()}
    assert got["false"] == (True, False, False, False)
    assert got["pass"] == (True, True, True, None)
    assert got["stable"] == (True, True, True, None)
    assert got["maybe"] == (True, True, None, None)
    assert got[""] == (False, None, None, None)
    assert got[None] == (None, None, None, None)
    assert got["2"] == (True, True, None, None)
    assert got["0"] == (True, False, False, False)


def test_numbers(spark):
    df = spark.createDataFrame([("221.7",), ("x",), ("NaN",), ("None",)], "t string")
    rows = df.select(columns.double_lenient("t").alias("l"), columns.double_finite("t").alias("f")).collect()
    assert [r.f for r in rows] == [221.7, None, None, None]
    with pytest.raises(Exception, match="not a number"):
        df.where("t = 'x'").select(columns.double_strict("t")).collect()


def test_row_numbers_over_ranges(spark):
    df = spark.createDataFrame([(i * 7919 % 1000 // 3, i) for i in range(1000)], "a int, b int").repartition(7)
    got = [(r.a, r.b, r.n) for r in numbered(df, F.desc("a"), "b", name="n", start=0).collect()]
    assert sorted(got, key=lambda r: r[2]) == [(a, b, n) for n, (a, b) in enumerate(sorted(((a, b) for a, b, _ in got), key=lambda r: (-r[0], r[1])))]
    assert numbered(df.limit(0), "a").count() == 0


def test_duplicate_policies(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 3, 30)], "candidate_id string, _ord int, v int")
    assert sorted(values(validate.last_wins(df, "candidate_id", "_ord"), "v")) == [20, 30]
    assert sorted(values(validate.first_wins(df, "candidate_id", "_ord"), "v")) == [10, 30]
    with pytest.raises(Exception, match="duplicate candidate_id"):
        validate.unique_or_raise(df, "candidate_id").collect()
    assert validate.unique_or_raise(df.where("_ord > 1"), "candidate_id").count() == 2


def test_pearson_without_variance_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(validate.safe_corr("a", "b").alias("x")).first().x is None
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (None, 1.0)], "a double, b double")
    assert abs(df.agg(validate.safe_corr("a", "b").alias("x")).first().x - 1) < 1e-12


def test_consensus_needs_every_vote(spark):
    rows = [("1", "A", True), ("1", "B", True), ("2", "A", True), ("2", "B", False), ("3", "A", None), ("3", "B", True), ("4", "A", True)]
    df = spark.createDataFrame([(*r, 0.1, 0.1, True, i) for i, r in enumerate(rows)], "candidate_id string, validator string, is_stable boolean, force_max double, stress_max double, relaxation_converged boolean, o int")
    got = {r.candidate_id: r for r in validate.consensus(df, ["A", "B"], ["o"]).collect()}
    assert set(got) == {"1", "2", "3"}
    assert got["1"].agreement and got["1"].vote_pattern == "A:stable|B:stable"
    assert got["2"].error_reason == "mlip_relaxation_proxy_disagreement"
    assert got["3"].error_reason == "mlip_relaxation_proxy_unavailable" and got["3"].consensus_is_stable is None


def test_normalize_coalesces_aliases(spark):
    df = spark.createDataFrame([(0, "a", "NaCl", "", "mace", "Done", "2", "0.5", "yes"), (1, "", "NaCl", "x", "mace", "?", "", "", ""), (2, "b", "NaCl", "", "mace", None, "TierX", "bad", "2"), (3, "c", None, "", "mace", "not_converged", "Unknown", "", "no")],
                               "_ord int, id string, formula string, composition string, validator string, status string, tier string, ehull string, is_stable string")
    good, issues = validate.normalize(df)
    got = {r.candidate_id: (r.validation_status, r.calibration_tier, r.energy_above_hull, r.is_stable, r.f3_available_after_normalization) for r in good.collect()}
    assert got == {"a": ("completed", "tier2", 0.5, True, True), "b": ("unknown", "TierX", None, None, False)}
    assert sorted(values(issues, "message")) == ["missing required field(s): candidate_id", "missing required field(s): formula"]


def test_stated_stability_beats_the_hull(spark):
    rows = spark.createDataFrame([(False, 0.03), (None, 0.03), (None, 0.06), (True, 0.9), (False, None), (None, None), (False, 5.0)], "is_stable boolean, e_above_hull double")
    assert values(rows.select(validate.stability_score().alias("x"))) == [0.3, 0.0, 0.3, 0.0, 1.0, 1.0, 1.0]


def test_relaxation_proxy_needs_a_relaxation(spark):
    schema = "relaxed boolean, relax_requested boolean, force_max double, stress_max double, relaxation_converged boolean"
    rows = spark.createDataFrame([(None, None, 0.01, None, True), (True, None, 0.01, None, None), (True, None, 0.01, None, True), (None, True, None, None, True), (True, None, 0.06, None, True)], schema)
    got = [tuple(r.x) for r in rows.select(validate.relaxation_proxy().alias("x")).collect()]
    assert got == [(None, None), (False, "relaxation_not_converged"), (True, "relaxation_converged_below_thresholds"), (None, "missing_force_max"), (False, "force_above_relaxation_stability_threshold")]


def test_every_skipped_validation_has_its_reason(spark):
    schema = "candidate_id string, formula string, spacegroup int, generation map<string,string>, _ord int"
    audit = spark.createDataFrame([("a", "X", 1, {"K": "40"}, 0), ("b", None, None, {}, 1), ("c", "X", 2, {"K": "40", "top_k": ""}, 2)], schema)
    more = schema + ", validation_status string, error_reason string, is_stable boolean, e_above_hull double, validation_source string"
    ok = ("completed", None, True, None, "m")
    rows = [("a", "X", None, {"K": "40"}, 0, *ok), ("a", "X", None, {"K": "40"}, 1, *ok), ("b", "X", None, {}, 2, *ok), ("c", "X", 3, {}, 3, *ok), ("z", "X", 1, {}, 4, *ok)]
    got = [r.import_status for r in validate.import_status(audit, spark.createDataFrame(rows, more)).orderBy("_ord").collect()]
    assert got == ["validated_success", "duplicate_validation_candidate_id", "formula_mismatch", "spacegroup_mismatch", "candidate_not_found"]
    rows = [("c", "X", 2, {"K": 40 * "4"}, 0, *ok), ("a", "X", 1, {"K": "40"}, 1, "completed", "late", True, None, "m")]
    assert values(validate.import_status(audit, spark.createDataFrame(rows, more)).orderBy("_ord"), "import_status") == ["condition_mismatch", "validation_error"]


def test_novelty_import_lists_both_sides(spark):
    cand = spark.createDataFrame([("a",), ("b",)], "candidate_id string")
    audit = spark.createDataFrame([("a", 0.9, 0), ("z", 0.1, 1)], "candidate_id string, f4_novelty_leakage double, _ord int")
    out, orphan, missing = validate.import_novelty(cand, audit)
    assert {r.candidate_id: r.f4_risk for r in out.collect()} == {"a": "high", "b": None}
    assert values(orphan, "candidate_id") == ["z"] and values(missing, "candidate_id") == ["b"]
    with pytest.raises(Exception, match="outside"):
        validate.import_novelty(cand, audit.withColumn("f4_novelty_leakage", F.lit(1.2)))[0].collect()


def test_jsonl_round_trip_and_bad_lines(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text('{"b": 1, "a": "x"}\n\n{"a": "y"}\nnot json\n[1]\n')
    assert readers.jsonl(spark, str(path), "a string, b int", strict=False).orderBy("_ord").select("a", "b").collect() == [("x", 1), ("y", None)]
    assert readers.bad_lines(spark, str(path)).count() == 2
    with pytest.raises(Exception, match="not a JSON object"):
        readers.jsonl(spark, str(path), "a string").collect()
    writers.write_jsonl(spark.createDataFrame([(2, "z", 1), (1, "y", None)], "_ord int, b string, a int"), str(tmp_path / "out"), single=True)
    lines = [json.loads(x) for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == [{"a": None, "b": "y"}, {"a": 1, "b": "z"}]


def test_json_rows_unwraps(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"results": [{"id": 1}, {"id": 2}]}')
    (tmp_path / "b.json").write_text('{"id": 3}')
    (tmp_path / "c.json").write_text("{broken")
    rows = readers.json_rows(spark, str(tmp_path)).select(readers.get("id", "int").alias("x"))
    assert sorted(values(rows)) == [1, 2, 3]
    assert "corrupt_json" in values(readers.whole_json(spark, str(tmp_path)), "issue")


def test_sampling_csv_and_lattice(spark, tmp_path):
    path = tmp_path / "samples.csv"
    path.write_text("candidate_id,Formula,g,W,A,X,L,a,b,c,alpha,beta,gamma\nx1,BaTiO3,221,1,2,3,4,4,4,4,90,90,90\n,NaCl,,,,,,,,,,,\n")
    rows = {r.composition: r for r in readers.sampling_csv(spark, str(path)).select("*", readers.lattice_lengths(F.col("lattice_matrix")).alias("len"), readers.lattice_angles(F.col("lattice_matrix")).alias("ang")).collect()}
    assert [round(x, 9) for x in rows["BaTiO3"].len] == [4, 4, 4] and [round(x, 6) for x in rows["BaTiO3"].ang] == [90, 90, 90]
    assert rows["NaCl"].lattice_matrix is None and rows["NaCl"].candidate_id.startswith("row_")


def test_geometry_and_formula(spark):
    df = spark.createDataFrame([("a", "NaCl", 2, [5.0, 5.0, 5.0], [90.0] * 3, [[0.0, 0.0, 0.0], [0.02, 0.0, 0.0]], 0.0, 0.1, None, {})],
                               "candidate_id string, composition string, num_atoms int, lattice_lengths array<double>, lattice_angles array<double>, frac_coords array<array<double>>, mock_geometry_score double, mock_chemistry_score double, mock_stability_score double, metadata map<string,string>")
    row = label.label(label.vectorize(df)).first()
    assert abs(row.f1_geometry - (0.6 - 0.1) / 0.6) < 1e-12
    assert row.f3_stability == 0.5 and row.calibration_tier == 4 and row.is_valid
    assert df.select(readers.formula_of(F.array(F.lit("Ba"), F.lit("O"), F.lit("O"))).alias("x")).first().x == "BaO2"


def test_empty_tables_give_empty_or_zero_results(spark):
    empty = spark.createDataFrame([], "candidate_id string, f1 double, f2 double, f3 double, is_valid boolean")
    row = evaluate.label_metrics(empty).first()
    assert row.candidate_count == 0 and row.average_f1 == 0.0 and row.average_f3 is None
    votes = spark.createDataFrame([], "candidate_id string, validator string, is_stable boolean, force_max double, stress_max double, relaxation_converged boolean, o int")
    assert validate.consensus(votes, ["A"], ["o"]).count() == 0


def test_zero_force_sorts_last(spark):
    rows = [("a", "f", "completed", 0.0, 0.1, 1.0), ("b", "f", "completed", 0.04, 0.1, 1.0), ("c", "f", "failed", 0.01, 0.1, 1.0)]
    df = spark.createDataFrame(rows, "candidate_id string, formula string, validation_status string, force_max double, stress_max double, energy double")
    assert values(select.triage(df, 5).orderBy("rank_within_formula"), "candidate_id") == ["b", "a"]


def test_checks_and_verdict(spark):
    pairs = spark.createDataFrame([("d", "NaCl", "a", "b", 0.1, 0.5, 0.4), ("d", "NaCl", "a", "q", 0.5, 0.1, -0.4)], "dir string, formula string, chosen_candidate_id string, rejected_candidate_id string, chosen_score double, rejected_score double, preference_margin double")
    cands = spark.createDataFrame([("a", "NaCl"), ("b", "KCl")], "candidate_id string, formula string")
    found = checks.all_checks(checks.pair_references(pairs, cands, "dir"), checks.pair_scores(pairs, "dir"))
    assert {(r.check, r.detail) for r in found.collect()} == {("cross_formula_pair", "b"), ("missing_candidate", "q"), ("pair_scores", "score_order")}
    assert checks.verdict(found).first().ready is False


def test_negative_feedback_yields_to_positive(spark):
    events = spark.createDataFrame([("a", "positive"), ("a", "negative"), ("b", "negative")], "candidate_id string, decision string")
    assert tuple(loop.buffer_summary(events).first()) == (1, 1)


def test_nodes_from_text(spark):
    text = "NodeName=g1 CPUAlloc=2 CPUTot=64 Gres=gpu:rtx4090:8 State=MIXED Partitions=gpu,test RealMemory=500000 CfgTRES=cpu=64,gres/gpu=8 AllocTRES=cpu=2,gres/gpu=3\n\nNodeName=g2 CPUAlloc=0 CPUTot=64 Gres=gpu:8 State=IDLE+DRAIN Partitions=gpu AllocTRES=\n"
    rows = nodes.from_blocks(spark.createDataFrame([(text,)], "value string"))
    got = {r.node: r for r in rows.collect()}
    assert got["g1"].gpus_free == 5 and got["g2"].gpus_free == 8
    best = nodes.best_node(nodes.eligible(rows, 2)).first()
    assert (best.node, best.partition) == ("g1", "gpu")
    plan = nodes.plan_gpu_job(rows, minimum=2, queue_minimum=4).first()
    assert (plan["mode"], plan["request"]) == ("free_node", 4)
    times = spark.createDataFrame([("1-02:00:00",), ("00:30:30",), ("45",)], "t string").select(nodes.minutes(F.col("t")).alias("x"))
    assert values(times) == [1560, 31, 45]


def test_rank_neighbors_use_relative_rank(spark):
    rows = [("g1", 0.01, True, False), ("g2", 0.02, True, False), ("n1", 0.06, False, True), ("n2", 0.07, False, True), ("n3", 0.08, False, True)]
    df = spark.createDataFrame([(i, "f", 0.0, 0.0, m, g, n) for i, m, g, n in rows], "candidate_id string, formula string, f1 double, f2 double, mean_force double, is_good boolean, is_near_miss boolean")
    got = {(r.chosen_id, r.rejected_id) for r in dpo.rank_neighbors(df, 1).collect()}
    assert got == {("g1", "n1"), ("g2", "n3")}


def test_streamed_validation_keeps_the_latest(spark, tmp_path):
    from assay.streaming import validation_stream as vs

    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text('{"candidate_id": "a", "validator": "A", "is_stable": true, "ts": "2024-01-01T00:00:00Z"}\n{"candidate_id": "a", "validator": "A", "is_stable": false, "ts": "2024-01-02T00:00:00Z"}\n')
    query = vs.keep_latest(vs.validation_files(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(60)
    assert values(vs.read_latest(spark, str(tmp_path / "out")), "is_stable") == [False]
