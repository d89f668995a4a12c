"""Pair mining and Pareto layers against brute force; order does not matter."""

import itertools
import random

import pytest

from assay.operators import pairs, rank

SCHEMA = "candidate_id bigint, _ord bigint, atoms int, prototype string, space_group int, family string, f1 double, f2 double, f3 double, f4 double, confidence double, is_valid boolean, novelty double, diversity double"


def fixture(n=60, seed=1):
    r = random.Random(seed)
    return [
        (i, i, r.choice([0, 1, 4, 5, 6, 20]), r.choice(["p", "q", "", None]), r.choice([0, 1, 2, None]), r.choice("xyz"), r.randrange(11) / 10, r.randrange(11) / 10, r.choice([None, *(k / 10 for k in range(11))]),
         r.choice([None, 0.1, 0.9]), r.choice([0.2, 0.5]), r.random() > 0.1, r.randrange(4) / 4, r.randrange(4) / 4)
        for i in range(n)
    ]


def reject(a, b, main, others, cfg):
    """A pair's rejection reason, written out plainly."""
    if max(a[2], b[2]) <= 0 or abs(a[2] - b[2]) / max(a[2], b[2]) > cfg.atom_tolerance:
        return "metadata_mismatch"
    for k in (3, 4):
        if a[k] and b[k] and a[k] != b[k]:
            return "metadata_mismatch"
    if not (a[3] or b[3] or a[4] or b[4]) and a[5] != b[5]:
        return "metadata_mismatch"
    if a[main] is None or b[main] is None:
        return "missing_main_axis"
    if abs(a[main] - b[main]) < cfg.main_gap:
        return "small_main_axis_gap"
    for o in others:
        if a[o] is None or b[o] is None:
            return "missing_other_axis"
        if abs(a[o] - b[o]) > cfg.other_gap:
            return "other_axis_leakage"
    return None


@pytest.mark.parametrize("seed", [1, 2])
def test_axis_pairs_and_rejections_match_brute_force(spark, seed):
    rows = fixture(seed=seed)
    cfg = pairs.PairConfig(min_quality=0.0)
    usable = [r for r in rows if r[11] and r[2] > 0]
    want, reasons = set(), {}
    for axis, main in (("F1", 6), ("F2", 7), ("F3", 8)):
        for a, b in itertools.combinations(usable, 2):
            reason = reject(a, b, main, [o for o in (6, 7, 8) if o != main], cfg)
            if reason:
                reasons[axis, reason] = reasons.get((axis, reason), 0) + 1
            else:
                w, l = (a, b) if a[main] <= b[main] else (b, a)
                want.add((axis, w[0], l[0]))
    df = spark.createDataFrame(rows, SCHEMA)
    got = pairs.mine_axis_pairs(df, cfg).collect()
    assert {(r.axis, r.winner_id, r.loser_id) for r in got} == want
    assert len(got) == len(want)
    assert {(r.axis, r.reason): r.n for r in pairs.mining_rejections(df, cfg).collect()} == reasons
    shuffled = spark.createDataFrame(random.Random(3).sample(rows, len(rows)), SCHEMA).repartition(7)
    assert {(r.axis, r.winner_id, r.loser_id) for r in pairs.mine_axis_pairs(shuffled, cfg).collect()} == want


def test_axis_limit_cuts_pairs_and_statistics(spark):
    rows = fixture(seed=4)
    df = spark.createDataFrame(rows, SCHEMA)
    cfg = pairs.PairConfig(min_quality=0.0, max_pairs_per_axis=2)
    usable = [r for r in rows if r[11] and r[2] > 0]
    want, kept = {}, {}
    for axis, main in (("F1", 6), ("F2", 7), ("F3", 8)):
        for a, b in itertools.combinations(usable, 2):
            if kept.get(axis, 0) >= 2:
                break
            reason = reject(a, b, main, [o for o in (6, 7, 8) if o != main], cfg)
            if reason:
                want[axis, reason] = want.get((axis, reason), 0) + 1
            else:
                kept[axis] = kept.get(axis, 0) + 1
    got = {r["axis"]: r["count"] for r in pairs.mine_axis_pairs(df, cfg).groupBy("axis").count().collect()}
    assert got == kept
    assert {(r.axis, r.reason): r.n for r in pairs.mining_rejections(df, cfg).collect()} == want


def test_random_negatives_repeat_for_a_seed(spark):
    df = spark.createDataFrame(fixture(), SCHEMA)
    one, two = ([r.pair_id for r in pairs.random_negative_pairs(df, threshold=0.4, seed=5).orderBy("pair_id").collect()] for _ in range(2))
    assert one == two
    every = {r.winner_id for r in pairs.binary_pairs(df, threshold=0.4).collect()}
    assert len(one) == len(every)


def test_weights_turn_the_winner(spark):
    rows = [(0, 0, 5, "p", 1, "x", 0.9, 0.0, 0.0, None, 0.5, True, 0.5, 0.5), (1, 1, 5, "p", 1, "x", 0.0, 0.8, 0.0, None, 0.5, True, 0.5, 0.5)]
    df = spark.createDataFrame(rows, SCHEMA)
    cfg = pairs.PairConfig(main_gap=0.05)
    assert pairs.weighted_sum_pairs(df, cfg).first().winner_id == 1
    assert pairs.weighted_sum_pairs(df, cfg, {"f1": 0.1}).first().winner_id == 0


def test_pareto_layers_match_brute_force(spark):
    df = spark.createDataFrame(fixture(40, 9), SCHEMA)
    points = {r.candidate_id: [r.success, r.confidence, r.validity, r.novelty, r.diversity, -r.cost] for r in rank.objectives(df).collect()}
    want, left, layer = {}, dict(points), 0
    while left:
        front = [k for k, x in left.items() if not any(all(b >= a for a, b in zip(x, y)) and any(b > a for a, b in zip(x, y)) for y in left.values())]
        want |= dict.fromkeys(front, layer)
        left = {k: x for k, x in left.items() if k not in front}
        layer += 1
    got = rank.pareto_layers(df).collect()
    assert {r.candidate_id: r.pareto_layer for r in got} == want
    assert sorted(r["rank"] for r in got) == list(range(1, len(want) + 1))


def test_screening_counts_a_missing_f3_as_one(spark):
    rows = [(0, 0, 5, "p", 1, "x", 0.1, 0.1, None, None, 0.5, True, 0.5, 0.5), (1, 1, 5, "p", 1, "x", 0.5, 0.5, None, None, 0.5, True, 0.5, 0.5)]
    got = {r.candidate_id: r.screen_status for r in rank.screen(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: "pass", 1: "reject"}


def test_top_k_ties_follow_input_order(spark):
    rows = [(i, 9 - i, 5, "p", 1, "x", 0.1, 0.1, 0.1, None, 0.5, True, 0.5, 0.5) for i in range(5)]
    got = rank.rank_by_utility(spark.createDataFrame(rows, SCHEMA), top_k=2).orderBy("rank").collect()
    assert [r.candidate_id for r in got] == [4, 3]
    assert rank.rank_by_utility(spark.createDataFrame([], SCHEMA)).count() == 0
