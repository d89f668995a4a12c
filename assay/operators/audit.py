"""The audit of candidates in one row each: condition, sequence, labels, score, eligibility and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import first_present, to_int
from .dpo import GEOMETRY, SEQUENCE
from .evaluate import audit_rows, eligibility_reasons, parse_status

#: How stability is known, and what takes its place.
UNAVAILABLE, NO_STABILITY = "unavailable_without_offline_validation", "unknown_unavailable"
#: Parts of a generation condition, and the sampling fields that complete them.
GENERATION = ("source_model", "source_checkpoint", "temperature", "top_k", "K")
SAMPLING = ("temperature", "sample_temperature", "sampling_temperature", "top_k", "K")


def at(path: str, kind: str = "string", metadata: str = "metadata") -> Column:
    """A value of the metadata (VARIANT) below a dotted path; null if it is absent or of another kind."""
    return F.try_variant_get(metadata, f"$.{path}", kind)


def missing_field(name: str) -> Column:
    """Whether a sequence field is absent, empty text or an empty list in both places that may hold it."""
    gone = lambda path: F.coalesce((at(path) == "") | (F.size(at(path, "array<variant>")) == 0), at(path).isNull())
    return gone(f"raw_sequence_fields.{name}") & gone(f"raw_{name}")


def with_sequence(df: DataFrame) -> DataFrame:
    """Add raw_sequence_status and missing_sequence_fields; a stored status with its list wins."""
    stored, listed = at("raw_sequence_status"), at("missing_sequence_fields", "array<string>")
    wins = F.coalesce(stored != "", F.lit(False)) & listed.isNotNull()
    absent = F.array_compact(F.array(*(F.when(missing_field(n), F.lit(n)) for n in SEQUENCE)))
    df = df.withColumn("missing_sequence_fields", F.when(wins, listed).otherwise(absent))
    n = F.size("missing_sequence_fields")
    return df.withColumn("raw_sequence_status", F.when(wins, stored).when(n == len(SEQUENCE), "missing").when(n > 0, "partial").otherwise("full"))


def generation() -> Column:
    """Map of what makes two candidates come from the same generator: the metadata's own value, else the sampling's."""
    names = list(dict.fromkeys(GENERATION + SAMPLING))
    own = lambda n: at(n) if n in GENERATION else F.lit(None).cast("string")
    more = lambda n: at(f"sampling_metadata.{n}") if n in SAMPLING else F.lit(None).cast("string")
    entries = F.map_from_arrays(F.array(*(F.lit(n) for n in names)), F.array(*(first_present(own(n), more(n)) for n in names)))
    return F.map_filter(entries, lambda _, v: v.isNotNull())


def condition(formula: str | None = None, spacegroup: int | None = None) -> Column:
    """(mode, formula, spacegroup, generation); an absent space group is the argument's, a null one stays null."""
    absent = lambda name: at(name, "variant").isNull()
    group = F.when(absent("spacegroup_condition"), F.lit(spacegroup).cast("bigint")).otherwise(to_int(at("spacegroup_condition")))
    return F.struct(
        F.when(absent("condition_mode"), F.lit("csp")).otherwise(at("condition_mode")).alias("mode"),
        first_present(at("formula_condition"), F.lit(formula).cast("string"), "composition").alias("formula"), group.alias("spacegroup"), generation().alias("generation"),
    )


def audit_candidates(candidates: DataFrame, formula: str | None = None, spacegroup: int | None = None, stability_mode: str = UNAVAILABLE, score: str = "failure_score", source: str = "oracle") -> DataFrame:
    """One audited row for each candidate.

    ``candidates``: candidate_id, composition, structure_ref, species,
    frac_coords, lattice_matrix, f1_geometry, f2_chemistry, f3_stability,
    hard_failures, metadata (VARIANT) and, optionally, oracle_error (the message
    of a kernel that failed: the row is then labelled as failing outright).
    Columns of other names pass through; those of the result replace earlier
    ones. Null metadata are empty. ``score`` names the score, ``source`` what
    stability comes from where it is known. A map-only plan.

    Defined results: a space group that is no number is null; null failures are
    none; a status the metadata store wins over what the columns show.
    """
    error = F.col("oracle_error") if "oracle_error" in candidates.columns else F.lit(None).cast("string")
    broken = error.isNotNull()
    rows = with_sequence(candidates.withColumn("oracle_error", error))
    rows = rows.withColumns({
        "condition": condition(formula, spacegroup), "source_format": F.coalesce(at("source_format"), F.lit("unknown")),
        "_stored": at("parse_status"), "parse_error_message": at("parse_error_message"),
        "f1_geometry": F.when(broken, 1.0).otherwise(F.col("f1_geometry")), "f2_chemistry": F.when(broken, 1.0).otherwise(F.col("f2_chemistry")),
        "f3_stability": F.when(~broken, F.col("f3_stability")), "hard_failures": F.when(broken, F.array(F.lit("oracle_error"))).otherwise(F.coalesce("hard_failures", F.array().cast("array<string>"))),
    })
    rows = rows.withColumn("parse_status", parse_status("_stored"))
    rows = audit_rows(rows, stability_mode != UNAVAILABLE, score)
    # The rule reads a column of the name formula: the condition's, lent for the moment.
    lent = rows.withColumn("_formula", F.col("formula") if "formula" in rows.columns else F.lit(None)).withColumn("formula", F.col("condition.formula"))
    rows = lent.withColumn("dpo_ineligible_reasons", eligibility_reasons(F.col("raw_sequence_status"), F.col("missing_sequence_fields"), score))
    rows = rows.withColumn("formula", F.col("_formula")) if "formula" in candidates.columns else rows.drop("formula")
    unknown, eligible = F.col("f3_stability").isNull(), F.size("dpo_ineligible_reasons") == 0
    evidence = F.struct(
        "condition", "missing_sequence_fields", at("source_checkpoint").alias("source_checkpoint"), at("original_row_index").alias("original_row_index"),
        first_present("oracle_error", "parse_error_message", at("parse_error_type")).alias("parse_error"),
        F.when(unknown, NO_STABILITY).otherwise("available").alias("f3_status"), F.lit(stability_mode).alias("stability_mode"),
    )
    rows = rows.withColumns({
        "evidence": evidence, "dpo_eligible": eligible, "preference_type": F.when(eligible & unknown, GEOMETRY), "validation_status": F.lit("not_provided"),
        "f3_source": F.when(unknown, UNAVAILABLE).otherwise(source), "f3_validation_available": F.lit(False),
    })
    return rows.drop("_stored", "_formula", "oracle_error", "parse_error_message")
