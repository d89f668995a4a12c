"""Queries of the engine's own operators, each with its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import fast_round, severity, stability_severity
from ..operators import checks, compare, dpo, evaluate, label, loop, nodes, pairs, rank, select, validate
from .views import CAND_SQL, LAST_SQL, VAL_ORDER, VAL_SQL, VALIDATORS, cand, table, val

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its oracle if SQL has one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def nine(df: DataFrame) -> DataFrame:
    """Doubles to nine digits: sums depend on the order of addition beyond them."""
    return df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


MOCK = [
    "p_partkey AS candidate_id", "CASE p_partkey % 5 WHEN 0 THEN 'NaCl' WHEN 1 THEN 'BaTiO3' WHEN 2 THEN '' WHEN 3 THEN 'xx1' ELSE 'Fe2O3' END AS composition",
    "p_partkey % 3 + CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END AS num_atoms",
    "CAST((p_partkey * 7) % 90 AS DOUBLE) AS length", "CAST((p_partkey * 13) % 190 AS DOUBLE) AS angle",
    "CAST((p_partkey * 37) % 101 AS DOUBLE) / CAST(200 AS DOUBLE) AS mock_geometry_score", "CAST((p_partkey * 53) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS mock_chemistry_score",
    "CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE CAST((p_partkey * 71) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) END AS mock_stability_score", "p_partkey % 3 AS sites",
]


def mock_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr(*MOCK)
    site = lambda x: F.array(F.lit(x), F.lit(0.0), F.lit(0.0))
    coords = F.when(F.col("sites") == 2, F.array(site(0.0), site(0.25))).when(F.col("sites") == 1, F.array(site(0.0))).otherwise(F.array().cast("array<array<double>>"))
    return rows.withColumns({
        "lattice_lengths": F.array("length", F.lit(5.0), F.lit(5.0)), "lattice_angles": F.array("angle", F.lit(90.0), F.lit(90.0)),
        "frac_coords": coords, "metadata": F.create_map().cast("map<string,string>"),
    })


MOCK_SQL = f"""mock AS (SELECT {', '.join(MOCK)} FROM part), scored AS (
  SELECT *, concat_ws(';', CASE WHEN num_atoms <= 0 THEN 'empty_structure' END, CASE WHEN angle <= 0 OR angle >= 180 THEN 'impossible_lattice_angle' END,
           CASE WHEN sites = 0 THEN 'missing_frac_coords' END, CASE WHEN sites > 0 AND sites <> num_atoms THEN 'coord_count_mismatch' END) AS h1,
         concat_ws(';', CASE WHEN composition = '' THEN 'empty_composition' END, CASE WHEN composition = 'xx1' THEN 'composition_parse_failed' END) AS h2,
         CASE WHEN length <= 0 THEN 1.0 WHEN length < 1 THEN (1.0 - length) / 1.0 WHEN length > 80 THEN least(1.0, (length - CAST(80 AS DOUBLE)) / CAST(80 AS DOUBLE)) ELSE 0.0 END AS ls,
         CASE WHEN angle < 20 THEN least(1.0, (CAST(20 AS DOUBLE) - angle) / CAST(20 AS DOUBLE)) WHEN angle > 160 THEN least(1.0, (angle - CAST(160 AS DOUBLE)) / CAST(20 AS DOUBLE)) ELSE 0.0 END AS an,
         CASE WHEN sites < 2 THEN 0.0 ELSE greatest(0.0, least(1.0, (CAST(0.6 AS DOUBLE) - sqrt(power(CAST(-0.25 AS DOUBLE) * length, 2))) / CAST(0.6 AS DOUBLE))) END AS ds
  FROM mock
), vec AS (
  SELECT candidate_id, CASE WHEN h1 <> '' THEN 1.0 ELSE greatest(0.0, least(1.0, greatest(ls, an, ds, mock_geometry_score))) END AS f1_geometry,
         CASE WHEN composition = '' THEN 1.0 WHEN composition = 'xx1' THEN 0.9 ELSE mock_chemistry_score END AS f2_chemistry,
         coalesce(mock_stability_score, 0.5) AS f3_stability, concat_ws(';', nullif(h1, ''), nullif(h2, '')) AS hard, mock_stability_score
  FROM scored
)"""


@query(f"""WITH {MOCK_SQL} SELECT candidate_id, CAST(f1_geometry AS DOUBLE) AS f1_geometry, CAST(f2_chemistry AS DOUBLE) AS f2_chemistry, CAST(f3_stability AS DOUBLE) AS f3_stability, hard,
  hard = '' AS is_valid, CASE WHEN hard <> '' THEN 0 WHEN mock_stability_score IS NULL THEN 4 ELSE 3 END AS calibration_tier,
  CAST(CASE WHEN hard <> '' THEN 0.0 WHEN mock_stability_score IS NULL THEN 0.2 ELSE 0.5 END AS DOUBLE) AS confidence FROM vec""")
def label_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = label.vectorize(mock_candidates(spark, sf_dir))
    return rows.select("candidate_id", "f1_geometry", "f2_chemistry", "f3_stability", F.array_join("hard_failures", ";").alias("hard"), "is_valid", "calibration_tier", "confidence")


SEVERITY_SQL = "CASE WHEN {x} IS NULL THEN 'unknown' WHEN {x} < 0.1 THEN 'pass' WHEN {x} < 0.3 THEN 'mild' WHEN {x} <= 0.7 THEN 'moderate' ELSE 'severe' END"


@query(f"WITH {CAND_SQL}, s AS (SELECT {SEVERITY_SQL.format(x='f1')} AS severity, 'f1' AS axis FROM cand UNION ALL SELECT {SEVERITY_SQL.format(x='f2')}, 'f2' FROM cand "
       "UNION ALL SELECT CASE WHEN f3 IS NULL THEN 'unknown' WHEN f3 < 0.1 THEN 'pass' WHEN f3 <= 0.2 THEN 'mild' WHEN f3 <= 0.5 THEN 'moderate' ELSE 'severe' END, 'f3' FROM cand) SELECT axis, severity, count(*) AS n FROM s GROUP BY ALL")
def severity_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda name, s: F.struct(F.lit(name).alias("axis"), s.alias("severity"))
    rows = cand(spark, sf_dir).select(F.inline(F.array(one("f1", severity("f1")), one("f2", severity("f2")), one("f3", stability_severity("f3")))))
    return evaluate.histogram(rows, "axis", "severity")


@query(f"WITH {CAND_SQL} SELECT candidate_id, f3 IS NOT NULL AND f3 < 0.1 AS is_stable, f3 IS NOT NULL AND f3 BETWEEN 0.1 AND 0.2 AS is_near_miss, f3 IS NOT NULL AND f3 > 0.2 AND f3 <= 0.5 AS is_moderate, coalesce(f3 > 0.5, false) OR NOT is_valid AS is_catastrophic FROM cand")
def label_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label.flags(cand(spark, sf_dir), "f3").select("candidate_id", "is_stable", "is_near_miss", "is_moderate", "is_catastrophic")


MATCH_SQL = """abs(l.atoms - r.atoms) / greatest(l.atoms, r.atoms) <= 0.2 AND l.prototype = r.prototype
  AND NOT (l.space_group <> 0 AND r.space_group <> 0 AND l.space_group <> r.space_group)"""
AXIS_SQL = f"""{CAND_SQL}, u AS (SELECT * FROM cand WHERE is_valid AND atoms > 0), m AS (
  SELECT l.candidate_id AS lid, r.candidate_id AS rid, l.f1 AS a1, r.f1 AS b1, l.f2 AS a2, r.f2 AS b2, l.f3 AS a3, r.f3 AS b3, l.f4 AS a4, r.f4 AS b4,
         0.35::DOUBLE * (least(l.atoms, r.atoms) / greatest(l.atoms, r.atoms)) + 0.3::DOUBLE + 0.2::DOUBLE * CASE WHEN l.space_group <> 0 AND l.space_group = r.space_group THEN 1 ELSE 0 END
           + 0.15::DOUBLE * CASE WHEN l.family = r.family THEN 1 ELSE 0 END AS sm
  FROM u l JOIN u r ON l._ord < r._ord AND {MATCH_SQL}
), x AS (
  SELECT lid, rid, sm, a4, b4, 'F1' AS axis, abs(a1 - b1) AS gap, abs(a2 - b2) AS d1, abs(a3 - b3) AS d2, a1 <= b1 AS lw, b3, a3 FROM m
  UNION ALL SELECT lid, rid, sm, a4, b4, 'F2', abs(a2 - b2), abs(a1 - b1), abs(a3 - b3), a2 <= b2, b3, a3 FROM m
  UNION ALL SELECT lid, rid, sm, a4, b4, 'F3', abs(a3 - b3), abs(a1 - b1), abs(a2 - b2), a3 <= b3, b3, a3 FROM m
), q AS (
  SELECT *, gap * greatest(0, 1 - (d1 + d2) / 2) * sm * greatest(0, least(1, 0.5 * least(1, gap / 0.3) * (0.5 + 0.5 * sm))) * greatest(0, 1 - coalesce(greatest(a4, b4), 0)) AS quality,
         CASE WHEN gap IS NULL THEN 'missing_main_axis' WHEN gap < 0.3 THEN 'small_main_axis_gap' WHEN d1 IS NULL THEN 'missing_other_axis' WHEN d1 > 0.15 THEN 'other_axis_leakage'
              WHEN d2 IS NULL THEN 'missing_other_axis' WHEN d2 > 0.15 THEN 'other_axis_leakage' END AS reason
  FROM x
)"""
PAIR_SQL = "SELECT axis, CASE WHEN lw THEN lid ELSE rid END AS winner_id, CASE WHEN lw THEN rid ELSE lid END AS loser_id, axis || ':' || CASE WHEN lw THEN lid ELSE rid END || '>' || CASE WHEN lw THEN rid ELSE lid END AS pair_id, gap AS main_axis_gap, CAST(CASE WHEN gap < 0.15 THEN 0.1 WHEN gap < 0.4 THEN 0.3 ELSE 0.5 END AS DOUBLE) AS margin, round(quality, 9) AS pair_quality FROM q WHERE reason IS NULL"
PAIR_COLUMNS = ("axis", "winner_id", "loser_id", "pair_id", "main_axis_gap", "margin")


@query(f"WITH {AXIS_SQL} {PAIR_SQL}")
def pairs_axis_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs.mine_axis_pairs(cand(spark, sf_dir), pairs.PairConfig(min_quality=0.0))
    return rows.select(*PAIR_COLUMNS, fast_round("pair_quality", 9).alias("pair_quality"))


@query(f"WITH {AXIS_SQL} {PAIR_SQL} AND quality >= 0.05")
def pairs_axis_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs.mine_axis_pairs(cand(spark, sf_dir), pairs.PairConfig(min_quality=0.05))
    return rows.select(*PAIR_COLUMNS, fast_round("pair_quality", 9).alias("pair_quality"))


@query(f"WITH {AXIS_SQL}, n AS (SELECT count(*) AS c FROM u), r AS (SELECT axis, coalesce(reason, 'kept') AS reason, count(*) AS n FROM q GROUP BY ALL) "
       "SELECT axis, reason, n FROM r WHERE reason <> 'kept' UNION ALL SELECT axis, 'metadata_mismatch', CAST(c * (c - 1) / 2 - s AS BIGINT) FROM (SELECT axis, sum(n) AS s FROM r GROUP BY axis), n")
def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.mining_rejections(cand(spark, sf_dir), pairs.PairConfig(min_quality=0.0))


BASE_SQL = f"""{CAND_SQL}, u AS (SELECT *, (f1 + f2 + coalesce(f3, 1)) / 3 AS agg, 1.0::DOUBLE * f1 + 1.0::DOUBLE * f2 + 1.0::DOUBLE * coalesce(f3, 1) AS ws FROM cand WHERE is_valid AND atoms > 0)"""


@query(f"""WITH {BASE_SQL}, m AS (SELECT CASE WHEN l.ws <= r.ws THEN l.candidate_id ELSE r.candidate_id END AS winner_id, CASE WHEN l.ws <= r.ws THEN r.candidate_id ELSE l.candidate_id END AS loser_id, abs(l.ws - r.ws) AS gap
  FROM u l JOIN u r ON l._ord < r._ord AND {MATCH_SQL}) SELECT 'weighted_sum:' || winner_id || '>' || loser_id AS pair_id, winner_id, loser_id, CAST(CASE WHEN gap < 0.15 THEN 0.1 WHEN gap < 0.4 THEN 0.3 ELSE 0.5 END AS DOUBLE) AS margin FROM m WHERE gap >= 0.3""")
def pairs_weighted_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.weighted_sum_pairs(cand(spark, sf_dir)).select("pair_id", "winner_id", "loser_id", "margin")


@query(f"""WITH {BASE_SQL}, m AS (SELECT l.candidate_id AS winner_id, r.candidate_id AS loser_id, greatest(0.1::DOUBLE, r.agg - l.agg) AS gap FROM u l JOIN u r ON l.agg < 0.3 AND r.agg >= 0.3 AND {MATCH_SQL})
  SELECT 'binary_success_failure:' || winner_id || '>' || loser_id AS pair_id, winner_id, loser_id, CAST(CASE WHEN gap < 0.15 THEN 0.1 WHEN gap < 0.4 THEN 0.3 ELSE 0.5 END AS DOUBLE) AS margin FROM m""")
def pairs_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.binary_pairs(cand(spark, sf_dir), threshold=0.3).select("pair_id", "winner_id", "loser_id", "margin")


@query(f"""WITH {BASE_SQL}, m AS (SELECT l.candidate_id AS winner_id, r.candidate_id AS loser_id, greatest(0.1::DOUBLE, r.agg - l.agg) AS gap FROM u l JOIN u r ON l.agg < 0.3 AND r.agg >= 0.3 AND {MATCH_SQL})
  SELECT 'random_negative:' || winner_id || '>' || loser_id AS pair_id, winner_id, loser_id, CAST(CASE WHEN gap < 0.15 THEN 0.1 WHEN gap < 0.4 THEN 0.3 ELSE 0.5 END AS DOUBLE) AS margin FROM m QUALIFY row_number() OVER (PARTITION BY winner_id ORDER BY md5('7:' || winner_id || ':' || loser_id)) = 1""")
def pairs_random_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.random_negative_pairs(cand(spark, sf_dir), threshold=0.3, seed=7).select("pair_id", "winner_id", "loser_id", "margin")


RANK_SQL = f"""{CAND_SQL}, o AS (SELECT *, greatest(0, 1.0 - (f1 + f2 + least(coalesce(f3, 1), 1)) / 3) AS success, atoms::DOUBLE / 100 AS cost FROM cand WHERE is_valid),
ut AS (SELECT *, 0.4::DOUBLE * success + 0.2::DOUBLE * confidence + 0.15::DOUBLE + 0.15::DOUBLE * novelty + 0.1::DOUBLE * diversity - 0.05::DOUBLE * cost AS utility FROM o)"""


@query(f"WITH {RANK_SQL} SELECT candidate_id, rank, round(utility, 9) AS utility FROM (SELECT *, CAST(row_number() OVER (ORDER BY utility DESC, _ord) AS INTEGER) AS rank FROM ut) WHERE rank <= 20")
def rank_utility_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nine(rank.rank_by_utility(cand(spark, sf_dir), top_k=20).select("candidate_id", "rank", "utility"))


@query(f"WITH {RANK_SQL} SELECT candidate_id FROM o a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.success >= a.success AND b.novelty >= a.novelty AND b.diversity >= a.diversity AND b.cost <= a.cost AND b.confidence >= a.confidence "
       "AND (b.success > a.success OR b.novelty > a.novelty OR b.diversity > a.diversity OR b.cost < a.cost OR b.confidence > a.confidence))")
def pareto_layer0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.pareto_layers(cand(spark, sf_dir), max_layers=1).select("candidate_id")


@query(f"WITH {CAND_SQL}, s AS (SELECT CASE WHEN is_valid AND (f1 + f2 + least(coalesce(f3, 1), 1)) / 3 <= 0.55 THEN 'pass' ELSE 'reject' END AS screen_status FROM cand) SELECT screen_status, count(*) AS n FROM s GROUP BY ALL")
def screen_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.histogram(rank.screen(cand(spark, sf_dir)), "screen_status")


@query(f"""WITH {CAND_SQL} SELECT count(*) AS candidate_count, round(sum(f1) / count(*), 9) AS average_f1, round(sum(f2) / count(*), 9) AS average_f2, round(avg(f3), 9) AS average_f3, max(f1) AS max_f1, max(f2) AS max_f2, max(f3) AS max_f3,
  round(avg(f4), 9) AS average_f4, max(f4) AS max_f4, count(*) FILTER (is_valid) AS valid_count, round(count(*) FILTER (is_valid) / count(*), 9) AS valid_rate,
  count(*) FILTER (NOT is_valid OR f1 >= 0.1 OR f2 >= 0.1 OR coalesce(f3 >= 0.1, false)) AS failed_count, round(count(*) FILTER (NOT is_valid OR f1 >= 0.1 OR f2 >= 0.1 OR coalesce(f3 >= 0.1, false)) / count(*), 9) AS failure_rate,
  count(*) FILTER (NOT is_valid) AS hard_failure_count FROM cand""")
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nine(evaluate.label_metrics(cand(spark, sf_dir)))


@query(f"""WITH {RANK_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY utility DESC, _ord) AS rank FROM ut) SELECT round(avg((f1 + f2 + coalesce(f3, 0)) / 3) FILTER (rank <= 50), 9) AS top_k_average_failure,
  CAST(1.0 AS DOUBLE) AS top_k_valid_rate, round(min(utility), 9) AS utility_min, round(max(utility), 9) AS utility_max, round(avg(utility), 9) AS utility_mean FROM r""")
def ranking_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nine(evaluate.ranking_metrics(rank.rank_by_utility(cand(spark, sf_dir)), top_k=50))


RESULT = [
    "l_partkey AS candidate_id", "l_linenumber % 4 <> 0 AS validated", "CASE l_linenumber % 5 WHEN 0 THEN 'Failed' WHEN 1 THEN 'pending' ELSE 'done' END AS status",
    "CASE WHEN l_quantity = 7 THEN NULL ELSE l_discount <= CAST(5 AS DOUBLE) / CAST(100 AS DOUBLE) END AS is_stable", "CASE WHEN l_quantity > 45 THEN 'late' WHEN l_quantity > 40 THEN '' END AS error_message",
    "CASE WHEN l_quantity = 9 THEN NULL ELSE l_tax END AS e_above_hull", "CASE l_returnflag WHEN 'A' THEN 'True' WHEN 'R' THEN 'known' END AS novelty_label",
    "l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_suppkey",
]
RESULT_ORDER = RESULT[-8:]
RESULT_SQL = f"""res AS (SELECT {', '.join(RESULT)} FROM lineitem), judged AS (SELECT *, validated AND lower(status) NOT IN ('failed', 'error') AND coalesce(error_message, '') = '' AS ok,
  lower(status) IN ('failed', 'error') OR coalesce(error_message, '') <> '' AS bad, coalesce(lower(novelty_label) IN ('novel', 'pass', 'passed', 'new', 'true'), false) AS new FROM res)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation results: validated, status, is_stable, error_message, e_above_hull, novelty_label."""
    return table(spark, sf_dir, "lineitem").selectExpr(*RESULT)


@query(f"""WITH {RANK_SQL}, {RESULT_SQL}, top AS (SELECT candidate_id FROM ut ORDER BY utility DESC, _ord LIMIT 50),
  latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY {', '.join(c + ' DESC' for c in RESULT_ORDER)}) AS rn FROM judged) WHERE rn = 1), t AS (SELECT ok, is_stable, rn FROM top LEFT JOIN latest USING (candidate_id))
  SELECT count(*) AS validation_count, round(count(*) FILTER (ok) / count(*), 9) AS validation_success_rate, count(*) FILTER (ok AND is_stable) AS validated_stable_count, round(count(*) FILTER (ok AND is_stable) / count(*) FILTER (ok), 9) AS validated_stable_rate,
    round(avg(e_above_hull) FILTER (ok), 9) AS average_validated_e_above_hull, count(*) FILTER (ok AND new) AS validated_novel_count, round(count(*) FILTER (ok AND new) / count(*) FILTER (ok), 9) AS validated_novel_rate, count(*) FILTER (bad) AS validation_failure_count,
    (SELECT round(count(*) FILTER (ok AND is_stable) / nullif(count(*) FILTER (ok), 0), 9) FROM t) AS top_k_validated_stable_rate, (SELECT round(count(rn) / count(*), 9) FROM t) AS top_k_validation_coverage FROM judged""")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(spark, sf_dir).withColumn("_ord", F.struct(*RESULT_ORDER))
    return nine(evaluate.validation_metrics(rows, rank.rank_by_utility(cand(spark, sf_dir), top_k=50), 50))


PICK = "candidate_id, validator, force_max, stress_max, is_stable, l_orderkey, l_linenumber"
ASC, DESC = ", ".join(VAL_ORDER), ", ".join(c + " DESC" for c in VAL_ORDER)


def latest(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The last validation row of each candidate and validator, of these columns only."""
    rows = val(spark, sf_dir).select(*dict.fromkeys(["candidate_id", "validator", *columns, *VAL_ORDER]))
    return validate.last_wins(rows, ["candidate_id", "validator"], VAL_ORDER)


def picked(df: DataFrame) -> DataFrame:
    return df.select(*PICK.split(", "))


@query(f"WITH {VAL_SQL}, {LAST_SQL} SELECT {PICK} FROM last")
def val_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picked(latest(spark, sf_dir, "force_max", "stress_max", "is_stable"))


@query(f"WITH {VAL_SQL} SELECT {PICK} FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY {ASC}) AS rn FROM val) WHERE rn = 1")
def val_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picked(validate.first_wins(val(spark, sf_dir), "candidate_id", VAL_ORDER))


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def val_orphans_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.orphans(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


CONSENSUS_SQL = f"""{VAL_SQL}, {LAST_SQL}, c AS (
  SELECT candidate_id, count(*) AS seen, count(is_stable) AS available_votes, count(*) FILTER (is_stable) AS stable_votes, count(*) FILTER (NOT is_stable) AS unstable_votes,
         string_agg(validator || ':' || CASE WHEN is_stable THEN 'stable' WHEN NOT is_stable THEN 'unstable' ELSE 'unknown' END, '|' ORDER BY validator) AS vote_pattern,
         max(force_max) AS force_max, max(stress_max) AS stress_max, bool_and(relaxation_converged) AS conv
  FROM last GROUP BY candidate_id HAVING count(*) = 3
), cons AS (SELECT *, available_votes = 3 AND (stable_votes = 3 OR unstable_votes = 3) AS agreement FROM c)"""


@query(f"""WITH {CONSENSUS_SQL} SELECT candidate_id, agreement, available_votes, stable_votes, unstable_votes, vote_pattern, CASE WHEN agreement THEN stable_votes = 3 END AS consensus_is_stable, force_max, stress_max,
  CASE WHEN agreement THEN conv END AS relaxation_converged, CASE WHEN agreement THEN 'tier2_mlip_ensemble' ELSE 'tier3_mlip_disagreement' END AS calibration_tier, CAST(CASE WHEN agreement THEN 0 ELSE 1 END AS DOUBLE) AS uncertainty,
  CASE WHEN NOT agreement THEN CASE WHEN available_votes < 3 THEN 'mlip_relaxation_proxy_unavailable' ELSE 'mlip_relaxation_proxy_disagreement' END END AS error_reason FROM cons""")
def consensus_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.consensus(val(spark, sf_dir), VALIDATORS, VAL_ORDER)


@query(f"""WITH {CONSENSUS_SQL} SELECT count(*) AS overlap_count, count(*) FILTER (agreement) AS agreement_count, round(count(*) FILTER (agreement) / count(*), 9) AS agreement_rate,
  count(*) FILTER (agreement AND stable_votes = 3) AS stable_consensus_count, count(*) FILTER (agreement AND unstable_votes = 3) AS unstable_consensus_count, count(*) FILTER (NOT agreement) AS disagreement_or_unavailable_count FROM cons""")
def consensus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nine(validate.consensus_summary(validate.consensus(val(spark, sf_dir), VALIDATORS, VAL_ORDER)))


@query(f"""WITH {VAL_SQL}, {LAST_SQL}, full3 AS (SELECT candidate_id FROM last GROUP BY 1 HAVING count(*) = 3), v AS (SELECT * FROM last SEMI JOIN full3 USING (candidate_id))
  SELECT l.validator AS left_validator, r.validator AS right_validator, count(*) FILTER (l.is_stable IS NOT NULL AND r.is_stable IS NOT NULL) AS compared, count(*) FILTER (l.is_stable = r.is_stable) AS agreed,
    round(count(*) FILTER (l.is_stable = r.is_stable) / count(*) FILTER (l.is_stable IS NOT NULL AND r.is_stable IS NOT NULL), 9) AS rate, round(corr(l.energy, r.energy), 6) AS pearson
  FROM v l JOIN v r ON l.candidate_id = r.candidate_id AND l.validator < r.validator GROUP BY ALL""")
def pairwise_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = val(spark, sf_dir).select(*dict.fromkeys(["candidate_id", "validator", "is_stable", "energy", *VAL_ORDER]))
    return nine(validate.pairwise_agreement(validate.votes(rows, VALIDATORS, VAL_ORDER), VALIDATORS, "energy")).withColumn("pearson", F.round("pearson", 6))


SUBSET_SQL = """unnest(list_filter(['all', CASE WHEN c THEN 'consensus_stable' END, CASE WHEN NOT c THEN 'consensus_unstable' END, CASE WHEN c IS NULL THEN 'disagreement' END,
  CASE WHEN is_stable THEN 'validator_stable' END, CASE WHEN NOT is_stable THEN 'validator_unstable' END], lambda x: x IS NOT NULL))"""


def voted(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = validate.consensus_with_latest(val(spark, sf_dir), VALIDATORS, VAL_ORDER)
    return decided.select("candidate_id", "consensus_is_stable", "agreement", F.explode("latest").alias("x")).select("candidate_id", "consensus_is_stable", "agreement", "x.validator", "x.force_max", "x.is_stable")


@query(f"""WITH {CONSENSUS_SQL}, v AS (SELECT last.*, CASE WHEN agreement THEN stable_votes = 3 END AS c FROM last JOIN cons USING (candidate_id)), t AS (SELECT validator, force_max AS x, {SUBSET_SQL} AS subset FROM v)
  SELECT validator, subset, count(*) AS n, round(avg(x), 9) AS mean, round(quantile_cont(x, 0.5), 9) AS p50, round(quantile_cont(x, 0.9), 9) AS p90, round(quantile_cont(x, 0.95), 9) AS p95, max(x) AS max FROM t GROUP BY ALL""")
def force_stats_by_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nine(compare.force_stats(voted(spark, sf_dir), "validator"))


@query(f"""WITH {VAL_SQL}, v AS (SELECT val.*, p_type AS formula FROM val JOIN part ON candidate_id = p_partkey)
  SELECT formula, count(*) AS n, count(force_max) AS measured, round(quantile_cont(force_max, 0.5), 9) AS p50, round(quantile_cont(force_max, 0.9), 9) AS p90, max(force_max) AS max, count(*) FILTER (force_max > 0.08) AS high_count,
    round(count(*) FILTER (force_max > 0.08) / count(*), 9) AS high_rate, max_by(candidate_id, force_max * 1000000000 + candidate_id) AS worst_id FROM v GROUP BY formula""")
def formula_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    formulas = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("candidate_id"), F.col("p_type").alias("formula"))
    return nine(compare.formula_table(val(spark, sf_dir).join(formulas, "candidate_id"), high=0.08))


@query(f"WITH {VAL_SQL} SELECT validator, count(stress_max) AS n, min(stress_max) AS min, round(quantile_cont(stress_max, 0.1), 9) AS p10, round(quantile_cont(stress_max, 0.5), 9) AS p50, round(quantile_cont(stress_max, 0.9), 9) AS p90, round(quantile_cont(stress_max, 0.95), 9) AS p95, round(quantile_cont(stress_max, 0.99), 9) AS p99, max(stress_max) AS max FROM val GROUP BY validator")
def metric_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nine(compare.metric_summary(val(spark, sf_dir), "stress_max", "validator"))


FORCE_SQL = f"""{VAL_SQL}, {LAST_SQL}, w AS (
  SELECT candidate_id, max(force_max) FILTER (validator = 'A') AS fa, max(force_max) FILTER (validator = 'B') AS fb, max(force_max) FILTER (validator = 'C') AS fc, bool_and(relaxation_converged) AS conv, count(*) AS k FROM last GROUP BY 1
), fr AS (SELECT candidate_id, p_brand AS formula, p_size % 3 AS f2, (fa + fb + fc) / 3 AS mean_force, greatest(fa, fb, fc) <= 0.05 AND conv AND k = 3 AS is_good, greatest(fa, fb, fc) <= 0.1 AND NOT greatest(fa, fb, fc) <= 0.05 AND k = 3 AS is_near
  FROM w JOIN part ON candidate_id = p_partkey WHERE fa IS NOT NULL AND fb IS NOT NULL AND fc IS NOT NULL)"""


def forces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest(spark, sf_dir, "force_max", "relaxation_converged")
    entry = lambda c: F.map_from_entries(F.collect_list(F.struct("validator", c)))
    rows = rows.groupBy("candidate_id").agg(entry("force_max").alias("forces"), entry("relaxation_converged").alias("converged"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("candidate_id"), F.col("p_brand").alias("formula"), F.lit(0).alias("f1"), (F.col("p_size") % 3).alias("f2"))
    return dpo.force_class(rows, tuple(VALIDATORS)).join(parts, "candidate_id")


@query(f"WITH {FORCE_SQL} SELECT is_good, is_near AS is_near_miss, count(*) AS n FROM fr GROUP BY ALL")
def force_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.histogram(forces(spark, sf_dir).where("mean_force is not null"), "is_good", "is_near_miss")


@query(f"""WITH {FORCE_SQL}, g AS (SELECT *, percent_rank() OVER (PARTITION BY formula ORDER BY mean_force, candidate_id) AS gr FROM fr WHERE is_good),
  nm AS (SELECT *, percent_rank() OVER (PARTITION BY formula, f2 ORDER BY mean_force, candidate_id) AS nr FROM fr WHERE is_near),
  p AS (SELECT g.formula, g.candidate_id AS chosen_id, nm.candidate_id AS rejected_id, row_number() OVER (PARTITION BY g.formula, g.candidate_id ORDER BY abs(gr - nr), nm.mean_force, nm.candidate_id) AS neighbor FROM g JOIN nm ON g.formula = nm.formula AND g.f2 = nm.f2)
  SELECT formula, chosen_id, rejected_id, CAST(neighbor AS INTEGER) AS neighbor FROM p WHERE neighbor <= 2""")
def f3_rank_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dpo.rank_neighbors(forces(spark, sf_dir)).select("formula", "chosen_id", "rejected_id", "neighbor")


@query(f"""WITH {CAND_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY f1, candidate_id) AS k FROM cand), p AS (SELECT *, row_number() OVER (ORDER BY k <= 30 DESC, family, k) AS place FROM r)
  SELECT candidate_id, CAST(k AS INTEGER) AS rank_in_key, CASE WHEN k > 30 THEN 'per_formula_limit' WHEN place > 100 THEN 'total_limit' END AS overflow_reason, k <= 30 AND place <= 100 AS selected FROM p""")
def per_formula_topn_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = select.top_n_overflow(cand(spark, sf_dir), "family", [F.col("f1"), F.col("candidate_id")], 30, 100)
    return rows.select("candidate_id", "rank_in_key", "overflow_reason", "selected")


@query(f"""WITH {VAL_SQL}, {LAST_SQL} SELECT candidate_id, validator, force_max, stress_max, round(severity, 9) AS severity FROM (SELECT *, greatest(force_max / 0.05, stress_max / 0.05) AS severity FROM last)
  ORDER BY severity DESC, validator, candidate_id LIMIT 25""")
def outliers_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest(spark, sf_dir, "force_max", "stress_max")
    return nine(select.outliers(rows, 25, key="validator").select("candidate_id", "validator", "force_max", "stress_max", "severity"))


@query(f"""WITH {VAL_SQL}, {LAST_SQL}, v AS (SELECT last.*, p_type || '|' || validator AS formula FROM last JOIN part ON candidate_id = p_partkey WHERE validation_status = 'completed' AND force_max <= 5 AND (stress_max IS NULL OR stress_max <= 0.2)),
  r AS (SELECT candidate_id, formula, row_number() OVER (PARTITION BY formula ORDER BY CASE WHEN force_max IS NULL OR force_max = 0 THEN 1e300 ELSE force_max END, CASE WHEN stress_max IS NULL OR stress_max = 0 THEN 1e300 ELSE stress_max END,
    CASE WHEN energy IS NULL OR energy = 0 THEN 1e300 ELSE energy END, candidate_id) AS k FROM v) SELECT candidate_id, formula, CAST(k AS INTEGER) AS rank_within_formula FROM r WHERE k <= 10""")
def relaxation_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    formulas = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("candidate_id"), F.col("p_type").alias("formula"))
    rows = latest(spark, sf_dir, "force_max", "stress_max", "energy", "validation_status").join(formulas, "candidate_id").withColumn("formula", F.concat_ws("|", "formula", "validator"))
    return select.triage(rows, 10).select("candidate_id", "formula", "rank_within_formula")


@query("WITH c AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1), t AS (SELECT sum(n) AS total FROM c) SELECT count(*) AS distinct, CAST(max(total) AS BIGINT) AS total, round(-sum(n / total * ln(n / total)), 9) AS entropy FROM c, t")
def entropy_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nine(compare.entropy(table(spark, sf_dir, "documents"), "source"))


@query(f"""WITH {VAL_SQL}, b AS (SELECT l_linenumber AS k, count(*) AS n, max(force_max) AS worst FROM val WHERE validator = 'A' AND l_linenumber <> 1 GROUP BY 1), a AS (SELECT l_linenumber AS k, count(*) AS n, max(force_max) AS worst FROM val WHERE validator = 'B' AND l_linenumber <> 2 GROUP BY 1)
  SELECT coalesce(a.k, b.k) AS k, b.n AS before_n, b.worst AS before_worst, a.n AS after_n, a.worst AS after_worst, a.n - b.n AS delta_n, a.worst - b.worst AS delta_worst FROM b FULL OUTER JOIN a ON a.k = b.k""")
def before_after_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = val(spark, sf_dir).withColumnRenamed("l_linenumber", "k")
    side = lambda v, without: rows.where((F.col("validator") == v) & (F.col("k") != without)).groupBy("k").agg(F.count("*").alias("n"), F.max("force_max").alias("worst"))
    return compare.before_after(side("A", 1), side("B", 2), "k", "n", "worst")


@query("SELECT CAST(sum(n - 1) AS BIGINT) AS extra FROM (SELECT text, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1)")
def dup_extra_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.duplicate_extra(table(spark, sf_dir, "documents"), "text")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 10")
def top_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.top_items(table(spark, sf_dir, "events"), "event_type")


@query("SELECT event_type, n FROM (SELECT event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1 ORDER BY n DESC, first LIMIT 10)")
def top_reasons_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.top_items(table(spark, sf_dir, "events"), "event_type", first_seen="event_id")


@query("""SELECT 'critical' AS severity, 'missing_value' AS "check", CAST(o_orderkey AS VARCHAR) AS location, 'customer' AS detail FROM orders WHERE o_custkey % 50 = 0
  UNION ALL SELECT 'critical', 'duplicate_key', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def qa_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("customer", F.when(F.col("o_custkey") % 50 != 0, F.col("o_custkey")))
    return checks.all_checks(checks.missing_values(orders, "o_orderkey", "customer"), checks.repeated(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber"))


@query("SELECT count(*) AS total, count(*) AS critical, CAST(0 AS BIGINT) AS warnings, count(*) = 0 AS ready FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def qa_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.verdict(checks.repeated(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber"))


@query("SELECT DISTINCT 'critical' AS severity, 'missing_artifact' AS \"check\", CAST(c AS VARCHAR) AS location, p AS detail FROM (SELECT DISTINCT o_custkey AS c FROM orders), (VALUES ('1-URGENT'), ('2-HIGH')) v(p) WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c AND o_orderpriority = p)")
def qa_missing_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("directory"), F.col("o_orderpriority").alias("name"))
    return checks.missing_artifacts(present, ["1-URGENT", "2-HIGH"])


@query(f"WITH {CAND_SQL} SELECT candidate_id, CAST((row_number() OVER (ORDER BY candidate_id) - 1) % 8 AS INTEGER) AS shard_id FROM cand")
def shard_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.round_robin(cand(spark, sf_dir), 8, "candidate_id").select("candidate_id", "shard_id")


@query(f"WITH {CAND_SQL} SELECT candidate_id, CAST(floor((row_number() OVER (ORDER BY candidate_id) - 1) / 64) AS BIGINT) AS chunk_id FROM cand")
def shard_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.chunks(cand(spark, sf_dir), 64, "candidate_id").select("candidate_id", "chunk_id")


COND_SQL = f"{CAND_SQL}, cr AS (SELECT candidate_id, prototype AS formula, space_group AS spacegroup, atoms % 2 AS generation, 'csp' AS mode, (f1 + f2) / 2 AS score, candidate_id % 5 = 0 AS v FROM cand WHERE is_valid)"


def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cand(spark, sf_dir).where("is_valid").select(
        "candidate_id", F.col("prototype").alias("formula"), F.col("space_group").alias("spacegroup"), (F.col("atoms") % 2).alias("generation"), F.lit("csp").alias("mode"),
        ((F.col("f1") + F.col("f2")) / 2).alias("score"), (F.col("candidate_id") % 5 == 0).alias("f3_validated"), (F.col("candidate_id") % 5 != 0).alias("f3_unavailable"),
    )
    return rows.withColumn("condition", F.concat_ws("|", dpo.condition_key(), F.col("generation").cast("string")))


@query(f"""WITH {COND_SQL} SELECT c.candidate_id AS chosen_id, r.candidate_id AS rejected_id, c.score AS chosen_score, r.score AS rejected_score, round(r.score - c.score, 9) AS preference_margin,
  CASE WHEN c.v THEN 'stability_aware_offline_validation' ELSE 'geometry_chemistry_only' END AS preference_type
  FROM cr c JOIN cr r USING (formula, spacegroup, generation) WHERE c.v = r.v AND (c.score < r.score OR (c.score = r.score AND c.candidate_id < r.candidate_id)) AND round(r.score - c.score, 12) >= 0.01""")
def condition_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dpo.condition_pairs(conditions(spark, sf_dir)).drop("condition")
    return rows.withColumn("preference_margin", fast_round("preference_margin", 9))


@query(f"""WITH {COND_SQL}, k AS (SELECT *, formula || '|' || spacegroup || '|' || generation AS condition FROM cr) SELECT condition, c.candidate_id AS chosen_id, r.candidate_id AS rejected_id, round(r.score - c.score, 9) AS preference_margin
  FROM k c JOIN k r USING (condition) WHERE c.v = r.v AND (c.score < r.score OR (c.score = r.score AND c.candidate_id < r.candidate_id)) AND round(r.score - c.score, 12) >= 0.01 ORDER BY condition, c.score, c.candidate_id, r.score, r.candidate_id LIMIT 300""")
def condition_pairs_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 300 pairs in order of condition, chosen and rejected row."""
    rows = conditions(spark, sf_dir).withColumn("condition", F.concat_ws("|", "formula", F.col("spacegroup").cast("string"), F.col("generation").cast("string")))
    out = dpo.condition_pairs(rows, max_pairs=300)
    return out.select("condition", "chosen_id", "rejected_id", F.round("preference_margin", 9).alias("preference_margin"))


@query(f"""WITH {COND_SQL}, p AS (SELECT CASE WHEN a.formula <> b.formula THEN 'different_formula_condition' WHEN a.spacegroup <> b.spacegroup THEN 'different_spacegroup_condition' ELSE 'different_generation_condition' END AS reason, a.n * b.n AS n
  FROM (SELECT formula, spacegroup, generation, count(*) AS n FROM cr GROUP BY ALL) a JOIN (SELECT formula, spacegroup, generation, count(*) AS n FROM cr GROUP BY ALL) b ON (a.formula, a.spacegroup, a.generation) < (b.formula, b.spacegroup, b.generation)) SELECT reason, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY reason""")
def cross_condition_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dpo.cross_condition_skips(conditions(spark, sf_dir))


@query(f"WITH {COND_SQL}, g AS (SELECT count(*) AS n, max(score) - min(score) AS gap FROM cr GROUP BY formula, spacegroup, generation) SELECT count(*) AS condition_count, count(*) FILTER (n < 2) AS too_small, count(*) FILTER (n < 2 OR gap < 0.01) AS no_comparable FROM g")
def dpo_build_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dpo.build_summary(conditions(spark, sf_dir))


PROBLEM_SQL = """SELECT o_orderkey, list_sort(list_distinct(list_filter([
  CASE WHEN o_orderkey % 11 = 0 THEN 'missing_pair_id' END, CASE WHEN o_custkey = o_custkey % 40 THEN 'same_chosen_and_rejected' END,
  CASE WHEN o_orderkey % 7 = 0 THEN 'missing_scores' END, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 7 > 4 THEN 'chosen_score_worse_than_rejected' END,
  CASE WHEN o_orderkey % 5 - 1 <= 0 THEN 'non_positive_preference_margin' END, CASE WHEN o_orderkey % 3 = 0 THEN 'chosen_missing_sequence_fields' END,
  CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 'unsupported_preference_type' END, CASE WHEN o_orderpriority = '2-HIGH' AND o_orderkey % 2 = 0 THEN 'stability_aware_missing_f3_evidence' END
], lambda x: x IS NOT NULL))) AS r FROM orders"""


@query(f"SELECT reason, count(*) AS n FROM (SELECT unnest(r) AS reason FROM ({PROBLEM_SQL})) GROUP BY reason")
def pair_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = F.create_map(*(F.lit(x) for n in dpo.SEQUENCE for x in (n, "1")))
    key = F.col("o_orderkey")
    pair_rows = table(spark, sf_dir, "orders").select(
        F.when(key % 11 != 0, key.cast("string")).alias("pair_id"), F.lit("c").alias("condition"),
        F.col("o_custkey").alias("chosen_candidate_id"), (F.col("o_custkey") % 40).alias("rejected_candidate_id"),
        F.when(key % 3 != 0, full).alias("chosen_sequence"), full.alias("rejected_sequence"),
        F.when(key % 7 != 0, (key % 7).cast("double")).alias("chosen_score"), F.lit(4.0).alias("rejected_score"), (key % 5 - 1).cast("double").alias("preference_margin"),
        F.when(F.col("o_orderpriority") == "1-URGENT", dpo.GEOMETRY).when(F.col("o_orderpriority") == "2-HIGH", dpo.STABILITY).otherwise("other").alias("preference_type"),
        F.when(key % 2 != 0, 0.1).alias("chosen_f3"), F.lit(0.2).alias("rejected_f3"),
    )
    return evaluate.histogram(dpo.pair_problems(pair_rows).select(F.explode("invalid_reasons").alias("reason")), "reason")


@query(f"""WITH {CAND_SQL} SELECT count(f4) AS n, min(f4) AS min, round(quantile_cont(f4, 0.5), 9) AS median, round(avg(f4), 9) AS mean, max(f4) AS max, count(*) FILTER (f4 < 0.2) AS bin_0_02, count(*) FILTER (f4 >= 0.2 AND f4 < 0.5) AS bin_02_05, count(*) FILTER (f4 >= 0.5 AND f4 < 0.8) AS bin_05_08, count(*) FILTER (f4 >= 0.8) AS bin_08_1 FROM cand""")
def novelty_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cand(spark, sf_dir)
    audit = rows.where("f4 is not null").select("candidate_id", F.col("f4").alias("f4_novelty_leakage"), "_ord")
    joined, _, _ = validate.import_novelty(rows.select("candidate_id"), audit)
    return nine(validate.novelty_summary(joined))


@query("""SELECT event_type, count(*) AS n, count(TRY_CAST(props->>'$.k' AS BIGINT)) AS numbers, min(TRY_CAST(props->>'$.k' AS BIGINT)) AS low, max(TRY_CAST(props->>'$.k' AS BIGINT)) AS high FROM events GROUP BY event_type""")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, sf_dir, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("*").alias("n"), F.count("k").alias("numbers"), F.min("k").alias("low"), F.max("k").alias("high"))


@query("WITH e AS (SELECT user_id, max(CASE WHEN event_type IN (SELECT min(event_type) FROM events) THEN 1 ELSE 0 END) AS p, max(CASE WHEN event_type IN (SELECT max(event_type) FROM events) THEN 1 ELSE 0 END) AS m FROM events GROUP BY user_id) SELECT count(*) FILTER (p = 1) AS positive_ids, count(*) FILTER (m = 1 AND p = 0) AS negative_ids FROM e")
def feedback_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    ends = F.broadcast(events.agg(F.min("event_type").alias("low"), F.max("event_type").alias("high")))  # one row
    kind = F.when(F.col("event_type") == F.col("low"), "positive").when(F.col("event_type") == F.col("high"), "negative").otherwise("pending")
    return loop.buffer_summary(events.crossJoin(ends).select(F.col("user_id").alias("candidate_id"), kind.alias("decision")))


@query(f"""WITH {RESULT_SQL}, d AS (SELECT CASE WHEN ok AND is_stable THEN 'positive_evidence' WHEN lower(status) IN ('failed', 'error') OR (ok AND NOT is_stable) THEN 'negative_evidence' ELSE 'pending_evidence' END AS decision,
  CASE WHEN ok AND is_stable THEN 'sample_similar_mock_family' WHEN lower(status) IN ('failed', 'error') THEN 'treat_failed_validation_as_future_negative' WHEN ok AND NOT is_stable THEN 'avoid_similar_high_failure_candidates' ELSE 'defer_until_validation_completes' END AS action FROM judged)
  SELECT decision, action, count(*) AS n FROM d GROUP BY ALL""")
def feedback_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.histogram(loop.validation_feedback(results(spark, sf_dir)), "decision", "action")


@query(f"WITH {CAND_SQL} SELECT candidate_id, validator FROM cand, (VALUES ('A'), ('B'), ('C')) v(validator)")
def task_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.task_plan(cand(spark, sf_dir), VALIDATORS).select("candidate_id", "validator")


@query(f"WITH {CAND_SQL}, {VAL_SQL} SELECT candidate_id FROM cand WHERE candidate_id NOT IN (SELECT candidate_id FROM val WHERE validation_status = 'completed' AND force_max > 0.09)")
def not_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = val(spark, sf_dir).where("validation_status = 'completed' and force_max > 0.09")
    return select.not_validated(cand(spark, sf_dir), done).select("candidate_id")


@query(f"""WITH {CAND_SQL} SELECT count(*) AS candidates, count(DISTINCT family) AS formulas, count(DISTINCT prototype || atoms) AS unique_sequences, round(count(DISTINCT prototype || atoms) / count(*), 9) AS unique_rate,
  count(DISTINCT CASE WHEN space_group <> 0 THEN space_group END) AS space_groups, round(count(*) FILTER (f1 < 0.1) / count(*), 9) AS f1_pass_rate, round(count(*) FILTER (f2 < 0.1) / count(*), 9) AS f2_pass_rate, round(count(*) FILTER (is_valid) / count(*), 9) AS eligible_rate FROM cand""")
def side_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.columns import pass_label

    rows = cand(spark, sf_dir).withColumns({"formula": F.col("family"), "sequence": F.concat("prototype", F.col("atoms").cast("string")), "f1_label": pass_label("f1"), "f2_label": pass_label("f2"), "dpo_eligible": F.col("is_valid")})
    return nine(compare.side_metrics(rows))


@query(f"""WITH {VAL_SQL}, {LAST_SQL}, p AS (SELECT candidate_id, max(energy) FILTER (validator = 'A') AS a, max(energy) FILTER (validator = 'B') AS b FROM last GROUP BY 1) SELECT candidate_id, b - a AS delta FROM p WHERE a IS NOT NULL AND b IS NOT NULL""")
def logprob_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = latest(spark, sf_dir, "energy").select("candidate_id", F.col("validator").alias("checkpoint_label"), F.col("energy").alias("logp_total"), F.lit("all").alias("consensus_label"))
    return compare.logprob_deltas(scores, "A", "B").select("candidate_id", "delta")


@query("""SELECT o_orderpriority AS formula, greatest(count(DISTINCT o_custkey) FILTER (o_orderstatus = 'O'), coalesce(max(o_custkey % 97) FILTER (o_orderstatus = 'O'), 0)) AS candidates,
  greatest(count(DISTINCT o_custkey) FILTER (o_orderstatus = 'F'), coalesce(max(o_custkey % 97) FILTER (o_orderstatus = 'F'), 0)) AS audited, greatest(count(DISTINCT o_custkey) FILTER (o_orderstatus = 'P'), coalesce(max(o_custkey % 97) FILTER (o_orderstatus = 'P'), 0)) AS pairs FROM orders GROUP BY 1""")
def collection_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "O", "candidate").when(F.col("o_orderstatus") == "F", "audit").when(F.col("o_orderstatus") == "P", "pair")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("formula"), kind.alias("kind"), F.col("o_custkey").alias("candidate_id"), (F.col("o_custkey") % 97).alias("estimate"), F.lit("done").alias("status"), F.lit("").alias("reason"))
    return checks.collection_rollup(rows).select("formula", "candidates", "audited", "pairs")


@query(f"WITH {CAND_SQL}, {VAL_SQL}, m AS (SELECT candidate_id, bool_or(is_stable) AS matched FROM val WHERE validation_status = 'completed' AND force_max > 0.09 GROUP BY 1), g AS (SELECT CASE WHEN matched IS NULL THEN 'missing' WHEN matched = is_valid THEN 'ok' ELSE 'wrong' END AS state FROM cand LEFT JOIN m USING (candidate_id)) SELECT state, count(*) AS n FROM g GROUP BY state")
def control_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = val(spark, sf_dir).where("validation_status = 'completed' and force_max > 0.09").groupBy("candidate_id").agg(F.max("is_stable").alias("matched"))
    return checks.control_gate(cand(spark, sf_dir).select("candidate_id", F.col("is_valid").alias("expected")), results)


@query(f"""WITH {CONSENSUS_SQL}, mf AS (SELECT candidate_id, (max(force_max) FILTER (validator = 'A') + max(force_max) FILTER (validator = 'B') + max(force_max) FILTER (validator = 'C')) / 3 AS mean_force FROM last GROUP BY 1),
  j AS (SELECT mean_force, unnest(['all', CASE WHEN NOT agreement THEN 'disagreement' WHEN stable_votes = 3 THEN 'consensus_stable' ELSE 'consensus_unstable' END]) AS subset FROM cons JOIN mf USING (candidate_id) WHERE mean_force IS NOT NULL)
  SELECT subset, count(*) AS n, round(quantile_cont(mean_force, 0.5), 9) AS p50, round(quantile_cont(mean_force, 0.9), 9) AS p90, round(max(mean_force), 9) AS max FROM j GROUP BY subset""")
def mean_force_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = validate.consensus(val(spark, sf_dir), VALIDATORS, VAL_ORDER).select("candidate_id", "agreement", "consensus_is_stable")
    return nine(compare.mean_force_stats(forces(spark, sf_dir).select("candidate_id", "mean_force").join(decided, "candidate_id")))


@query(f"""WITH {CAND_SQL}, {RESULT_SQL}, ev AS (SELECT candidate_id, bool_or(ok AND is_stable) AS plus, bool_or(NOT coalesce(ok AND is_stable, false) AND (lower(status) IN ('failed', 'error') OR coalesce(ok AND NOT is_stable, false))) AS minus FROM judged GROUP BY 1),
  adj AS (SELECT 1 AS round_id, cand.*, false AS up FROM cand UNION ALL SELECT 2, cand.* REPLACE (CASE WHEN minus AND NOT coalesce(plus, false) THEN greatest(coalesce(f3, 0.5), 0.8) WHEN plus THEN 0.0 ELSE f3 END AS f3), coalesce(plus, false) FROM cand LEFT JOIN ev USING (candidate_id)),
  sc AS (SELECT *, (f1 + f2 + least(coalesce(f3, 1), 1)) / 3 AS failure FROM adj WHERE is_valid),
  rk AS (SELECT *, row_number() OVER (PARTITION BY round_id ORDER BY 0.4::DOUBLE * greatest(0, 1.0 - failure) + 0.2::DOUBLE * confidence + 0.15::DOUBLE + 0.15::DOUBLE * novelty + 0.1::DOUBLE * diversity - 0.05::DOUBLE * (atoms::DOUBLE / 100) DESC, up DESC, candidate_id) AS k FROM sc WHERE failure <= 0.55)
  SELECT CAST(round_id AS INTEGER) AS round_id, candidate_id, CAST(k AS INTEGER) AS selected_rank, 'selected' AS decision FROM rk WHERE k <= 10""")
def active_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cand(spark, sf_dir)
    return loop.active_loop(rows, results(spark, sf_dir), rounds=2, top_k=10)


@query("""WITH n AS (SELECT s_name AS node, 'p' || CAST(s_nationkey % 4 AS VARCHAR) AS part, s_suppkey % 9 AS free FROM supplier)
  SELECT 'free_node' AS mode, node, part AS partition, CAST(least(4, free) AS INTEGER) AS request FROM n WHERE free >= 2 ORDER BY free DESC, part, node LIMIT 1""")
def gpu_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as nodes: the planner's decision row."""
    parts = F.array(F.concat(F.lit("p"), (F.col("s_nationkey") % 4).cast("string")))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("node"), F.lit("IDLE").alias("state"), parts.alias("partitions"), F.lit(8).alias("gpus"), (F.col("s_suppkey") % 9).cast("int").alias("gpus_free"), F.lit("gpu:8").alias("gres"))
    return nodes.plan_gpu_job(rows, minimum=2, queue_minimum=4)
