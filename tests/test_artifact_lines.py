"""Lines of artifact trees: numbered over parts, parsed once, their facts counted without a sort."""

import json

import pytest

from assay.functions.session import checkpointed
from assay.operators import collection
from assay.sources import artifacts


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def tree(tmp_path):
    """An artifact in three parts with broken lines, one without; the lines' numbers run over the parts."""
    broken = tmp_path / "formulas" / "f1" / "candidates.jsonl"
    broken.mkdir(parents=True)
    good = json.dumps({"candidate_id": "c", "pad": "x" * 50})
    (broken / "part-00000.txt").write_text("\n".join([good] * 500 + ["", "{half"]) + "\n")
    (broken / "part-00001.txt").write_text("\n".join([good] * 700) + "\n")
    (broken / "part-00002.txt").write_text("\n".join(["[1]", *[good] * 400, '{"k": 1} more']) + "\n")
    rows = [{"sample_id": f"s{k % 40}", "formula": f"f{k % 3}", "dpo_eligible": k % 4 == 0, "dpo_ineligible_reasons": ["r", f"r{k % 2}"]} for k in range(300)]
    rows += [{"candidate_id": None, "sample_id": "none", "formula": "f2"}, {"sample_id": "lost"}]
    whole = tmp_path / "outputs"
    whole.mkdir()
    (whole / "audit_candidates.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    (whole / "part-00000.txt").write_text("no artifact\n")
    (whole / "preference_pairs.jsonl").write_text("".join(json.dumps({"condition": {"formula": "f1"}, "pair_id": f"p{k % 7}", "preference_type": "t"}) + "\n" for k in range(20)))
    return str(tmp_path)


@pytest.mark.parametrize("limit", [200_000, 0])
def test_line_numbers_run_over_the_parts_of_an_artifact(spark, tree, monkeypatch, limit):
    monkeypatch.setattr(artifacts, "BROADCAST_BLOCKS", limit)
    monkeypatch.setattr(artifacts, "STRETCH_BITS", 6, raising=False)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 16 << 10)
    try:
        rows, errors, _ = artifacts.artifact_tree(spark, [tree])
        got = sorted((e.line_no, e.message) for e in errors.where("issue = 'malformed_jsonl'").collect())
        n = {(r.artifact, r.ok): r["count"] for r in rows.groupBy("artifact", "ok").count().collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(502, "invalid JSON"), (1203, "JSONL row must be an object"), (1604, "invalid JSON")]
    assert n == {("candidates.jsonl", False): 1600, ("audit_candidates.jsonl", True): 302, ("preference_pairs.jsonl", True): 20}


def test_facts_parse_a_line_once_and_are_counted_without_a_sort(spark, tree, monkeypatch):
    plans = []
    monkeypatch.setattr(collection, "checkpointed", lambda df: plans.append(plan_of(df)) or checkpointed(df))
    rows, errors, _ = artifacts.artifact_tree(spark, [tree])
    formulas, reasons = collection.collect(rows, errors)
    got = {r.formula: r for r in formulas.collect()}
    counted = plans[-1]
    assert "SortAggregate" not in counted
    assert counted.count("VariantExpressionEvalUtils.parseJson") == 1
    audited = lambda f: {f"s{k % 40}" for k in range(300) if k % 3 == f}
    eligible = lambda f: {f"s{k % 40}" for k in range(300) if k % 3 == f and k % 4 == 0}
    assert [got[f"f{f}"].audit_candidate_count for f in range(3)] == [len(audited(f)) for f in range(3)]
    assert [got[f"f{f}"].dpo_eligible_count for f in range(3)] == [len(eligible(f)) for f in range(3)]
    assert got["f1"].preference_pair_count == 7 and got["f1"].candidate_count == 0
    top = {r["reason"]: r["count"] for r in got["f0"].top_reasons}
    assert (top["r"], top["r0"], top["r1"]) == (100, 50, 50)
    over_all = {r.reason: r["count"] for r in reasons.collect()}
    assert over_all == {"r": 300, "r0": 150, "r1": 150, "preference_type:t": 20}
