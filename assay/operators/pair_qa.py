"""Quality checks of candidate and pair artifacts, with the context of every pair.

Rows come as artifact files hold them: ``row`` (VARIANT) with its ``path``,
``root`` and reading order ``_ord``, candidates also with ``artifact`` (the file
name). A pair names its candidates by id, and an id may have several entries: in
its own root or another, of its own formula or another, audited or not. Which
entry counts depends on the pair, so all eight preferences are keys of one
table: grouping sets keep the first entry of each key, a pair's side looks its
keys up, and the most preferred one that exists wins. Entries and sides of one
id never meet as a product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import join_keyed
from ..functions.session import checkpointed
from .checks import FINISHED, NO_F3
from .dpo import GEOMETRY, MODELS, SEQUENCE, STABILITY

#: The audited artifact, and the evidence and rule names that stand for a validated pair.
AUDITED, IMPORTED, FORCE_RULE = "audit_candidates.jsonl", "offline_validation_imported", "same_formula_rank_neighbor_f3_pairing_v1"
#: Fields an audited candidate should have.
EXPECTED_FIELDS = ("f3_label", "failure_vector", "dpo_eligible")
FINDING = ("severity", "check", "path", "formula", "candidate_id", "pair_id")
#: Which parts of (root, formula, audited) a preference fixes, the first preference first.
PREFERENCES = [("root", "formula", "audited"), ("root", "formula"), ("root", "audited"), ("root",), ("formula", "audited"), ("formula",), ("audited",), ()]


def get(path: str, kind: str = "string", row: str = "row") -> Column:
    return F.try_variant_get(row, f"$.{path}", kind)


def text(path: str) -> Column:
    """A value as text; null where it is absent or empty."""
    value = get(path)
    return F.when(value != "", value)


def is_object(path: str) -> Column:
    return get(path, "map<string,variant>").isNotNull()


def truthy(path: str) -> Column:
    value = get(path)
    return F.coalesce(~value.isin("", "false", "0", "0.0", "[]", "{}"), F.lit(False))


def whole(path: str) -> Column:
    """A number or the text of one, cut to an integer."""
    value = get(path)
    return F.when(~value.isin("", "null", "None", "none"), value).try_cast("double").cast("long")


def canonical(generation: Column) -> Column:
    """A generation map without empty values, as text of its sorted entries."""
    kept = F.map_filter(generation, lambda k, v: v.isNotNull() & (v != ""))
    return F.to_json(F.array_sort(F.map_entries(kept)))


def generation(path: str) -> Column:
    return get(path, "map<string,string>")


def condition_fields() -> dict[str, Column]:
    """formula, generation (canonical text, "[]" for none) and space group of a row."""
    metadata = F.create_map(*(x for k in ("source_checkpoint", "temperature", "top_k", "K") for x in (F.lit(k), get(f"metadata.{k}"))))
    none = F.create_map().cast("map<string,string>")
    given = F.coalesce(generation("condition.generation"), F.when(is_object("metadata"), metadata), none)
    return {
        "formula": F.coalesce(text("condition.formula"), text("formula"), text("composition")),
        "generation": canonical(given),
        "spacegroup": F.when(is_object("condition"), whole("condition.spacegroup")).otherwise(whole("spacegroup")),
    }


def candidate_fields(candidates: DataFrame) -> DataFrame:
    """What the checks read of candidate rows (path, root, artifact, _ord, row), as a narrow table of its own."""
    of = condition_fields()
    stable = F.lower(get("f3_label")).isin("pass", "stable") | F.coalesce(get("offline_validation.is_stable", "boolean") & is_object("offline_validation"), F.lit(False))
    lacking = ~truthy("f3_validation_available") | F.coalesce(get("evidence.f3_status").isin(*NO_F3), F.lit(False))
    unfinished = ~F.coalesce(F.lower(get("validation_status")).isin(*FINISHED), F.lit(False))
    return checkpointed(candidates.select(
        "path", "root", "_ord", (F.col("artifact") == AUDITED).alias("audited"), "artifact", F.when(F.array_contains(F.map_keys(F.try_variant_get("row", "$", "map<string,variant>")), "candidate_id"), text("candidate_id")).otherwise(text("sample_id")).alias("candidate_id"),
        *(c.alias(k) for k, c in of.items()),
        (truthy("f3_validation_available") & F.coalesce(get("validation_status") == "validated_success", F.lit(False)) & is_object("offline_validation")).alias("has_f3"),
        (F.coalesce(stable, F.lit(False)) & (lacking | unfinished)).alias("fabricated"),
        F.array_except(F.array(*map(F.lit, EXPECTED_FIELDS)), F.map_keys(F.try_variant_get("row", "$", "map<string,variant>"))).alias("absent"),
    ))


def side_formula(side: str) -> Column:
    """A formula that a pair states for a side: an object's formula, or a text."""
    found = []
    for key in (f"{side}_formula", f"{side}_condition"):
        kind = F.schema_of_variant(F.coalesce(get(key, "variant"), F.parse_json(F.lit("null"))))
        found += [F.when(is_object(key), F.when(truthy(f"{key}.formula"), get(f"{key}.formula"))), F.when(kind == "STRING", text(key))]
    return F.coalesce(*found)


def side_generation(side: str) -> Column:
    """The generation that a pair states for a side: the first of its two objects, or that object's generation."""
    out = F.lit(None).cast("string")
    for key in (f"{side}_condition", f"{side}_generation"):
        out = F.when(is_object(key), canonical(F.coalesce(generation(f"{key}.generation"), generation(key)))).otherwise(out)
    return out


def side_spacegroup(side: str) -> Column:
    of = lambda key: F.when(is_object(key), whole(f"{key}.spacegroup")).otherwise(whole(key))
    return F.coalesce(of(f"{side}_spacegroup"), of(f"{side}_condition"))


def has_sequence(side: str) -> Column:
    """All sequence fields, or a documented equivalent in the metadata."""
    complete = is_object(f"{side}_sequence")
    for name in SEQUENCE:
        complete &= F.coalesce(~get(f"{side}_sequence.{name}").isin("", "[]"), F.lit(False))
    documented = truthy(f"metadata.{side}_raw_sequence_equivalent") | truthy("metadata.raw_sequence_equivalent") | truthy("metadata.documented_raw_sequence_fields")
    return complete | documented


def has_forces(side: str) -> Column:
    forces = [F.when(~get(f"metadata.{side}_mlip_force_evidence.model_forces.{m}").isin("", "null", "None", "none"), get(f"metadata.{side}_mlip_force_evidence.model_forces.{m}")).try_cast("double").isNotNull() for m in MODELS]
    out = forces[0]
    for f in forces[1:]:
        out &= f
    return out


def pair_fields(pairs: DataFrame) -> DataFrame:
    """What the checks read of pair rows (path, root, row), as a narrow table of its own."""
    of = condition_fields()
    number = lambda path: F.when(~get(path).isin("", "null", "None", "none"), get(path)).try_cast("double")
    vector = lambda side: F.coalesce(get(f"{side}_failure_vector.f3_stability").isNotNull() & (get(f"{side}_failure_vector.metadata.f3_status") == IMPORTED), F.lit(False))
    sides = [x for s in ("chosen", "rejected") for x in (text(f"{s}_candidate_id").alias(f"{s}_id"), side_formula(s).alias(f"{s}_formula"), side_generation(s).alias(f"{s}_generation"), side_spacegroup(s).alias(f"{s}_spacegroup"), has_sequence(s).alias(f"{s}_sequence"), number(f"{s}_score").alias(f"{s}_score"))]
    forced = F.coalesce(get("metadata.f3_pair_rule") == FORCE_RULE, F.lit(False)) & has_forces("chosen") & has_forces("rejected")
    return checkpointed(pairs.select(
        "path", "root", text("pair_id").alias("pair_id"), is_object("condition").alias("has_condition"), *(c.alias(k) for k, c in of.items()), *sides, number("preference_margin").alias("preference_margin"),
        get("preference_type").alias("preference_type"), forced.alias("force_evidence"), (vector("chosen") & vector("rejected")).alias("vector_evidence"),
    ))


def preference_keys(of: dict[str, Column]) -> list[tuple[Column, list[Column]]]:
    """For each preference: whether it applies, and its key."""
    empty, out = F.lit("").cast("string"), []
    for fixed in PREFERENCES:
        applies = F.lit(True)
        for part in fixed:
            applies &= F.col("audited") if part == "audited" else F.coalesce(F.col(part) != "", F.lit(False))
        out.append((applies, [of[p] if p in fixed else empty for p in ("root", "formula")]))
    return out


def best_entries(sides: DataFrame, entries: DataFrame) -> DataFrame:
    """The entry that counts for each (candidate_id, root, formula): columns of ``entries`` in ``entry``.

    ``sides`` are distinct; ``entries``: candidate_id, root, formula, audited,
    _ord and what is wanted of an entry. Same root, formula and audit come
    before the same root and formula, the root and audit, the root, then the
    same without root; of equals the first in reading order.
    """
    of = {"root": F.col("root"), "formula": F.col("formula")}
    options = preference_keys(of)
    keyed = F.array_compact(F.array(*(F.when(applies, F.struct(F.lit(i).alias("level"), *(k.alias(n) for k, n in zip(key, ("key_root", "key_formula"), strict=True)))) for i, (applies, key) in enumerate(options))))
    what = F.struct(*(c for c in entries.columns if c != "candidate_id"))
    # Of entries alike in all that a preference fixes only the first can count, so no other comes under eight keys.
    firsts = entries.groupBy("candidate_id", "root", "formula", "audited").agg(F.min_by(what, "_ord").alias("entry"))
    table = firsts.select("candidate_id", F.explode(keyed).alias("k"), "entry").select("candidate_id", "k.*", "entry").groupBy("candidate_id", "level", "key_root", "key_formula").agg(F.min_by("entry", "entry._ord").alias("entry"))
    asked = sides.withColumn("audited", F.lit(True)).select("candidate_id", "root", "formula", F.explode(keyed).alias("k")).select("candidate_id", "root", "formula", "k.*")
    found = join_keyed(asked, table, ["candidate_id", "level", "key_root", "key_formula"])
    return found.groupBy("candidate_id", "root", "formula").agg(F.min_by("entry", "level").alias("entry"))


def candidate_findings(fields: DataFrame) -> DataFrame:
    """Missing ids and formulas, repeated ids, absent audit fields, stability that nothing proves."""
    known = F.col("candidate_id").isNotNull()
    keys = ["root", "formula", "generation", "candidate_id", "artifact"]
    same = [F.coalesce(k, F.lit("\x00")).alias(k) for k in keys]
    # Every entry but the first of its key is a repetition.
    rows = fields.where(known).select("path", "_ord", F.col("formula").alias("own_formula"), *same)
    first = rows.groupBy(*keys).agg(F.min("_ord").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    twice = join_keyed(rows, first, keys).where("_ord > _first").select(F.lit("critical").alias("severity"), F.lit("duplicate_candidate_id").alias("check"), "path", F.col("own_formula").alias("formula"), "candidate_id", F.lit(None).cast("string").alias("pair_id"))
    found = F.array_compact(F.array(
        F.when(~known, F.struct(F.lit("critical").alias("severity"), F.lit("missing_candidate_id").alias("check"))),
        F.when(known & F.col("formula").isNull(), F.struct(F.lit("warning").alias("severity"), F.lit("missing_formula").alias("check"))),
        F.when(F.col("audited") & F.col("fabricated"), F.struct(F.lit("critical").alias("severity"), F.lit("fabricated_f3_or_stability").alias("check"))),
    ))
    absent = F.transform(F.when(F.col("audited"), F.col("absent")).otherwise(F.array().cast("array<string>")), lambda x: F.struct(F.lit("warning").alias("severity"), F.lit("missing_expected_audit_field").alias("check")))
    rows = fields.select(F.explode(F.concat(found, absent)).alias("f"), "path", "formula", "candidate_id")
    return rows.select("f.*", "path", "formula", "candidate_id", F.lit(None).cast("string").alias("pair_id")).unionByName(twice)


def pair_findings(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """All findings of pairs (``pair_fields``) whose candidates are ``candidates`` (``candidate_fields``)."""
    sides = pairs.select("root", "formula", F.explode(F.array("chosen_id", "rejected_id")).alias("candidate_id")).where("candidate_id is not null").distinct()
    entries = candidates.where("candidate_id is not null").select("candidate_id", "root", "formula", "audited", "_ord", "generation", "spacegroup", "has_f3")
    found = best_entries(sides, entries)
    # A null formula asks like any other, so the join compares it as text.
    found = found.withColumn("formula", F.coalesce("formula", F.lit("")))
    rows = pairs.withColumn("asked", F.coalesce("formula", F.lit("")))
    for side in ("chosen", "rejected"):
        one = found.select(F.col("candidate_id").alias(f"{side}_id"), "root", F.col("formula").alias("asked"), F.col("entry").alias(f"{side}_entry"))
        rows = join_keyed(rows, one, [f"{side}_id", "root", "asked"], "left")
    entry = {s: F.col(f"{s}_entry") for s in ("chosen", "rejected")}
    stated = lambda s, c: F.coalesce(F.col(f"{s}_{c}"), entry[s][c])
    formula, gen, group = ({s: stated(s, c) for s in entry} for c in ("formula", "generation", "spacegroup"))
    named = F.col("chosen_id").isNotNull() & F.col("rejected_id").isNotNull()
    validated = F.col("force_evidence") | F.when(entry["chosen"].isNotNull() & entry["rejected"].isNotNull(), entry["chosen"]["has_f3"] & entry["rejected"]["has_f3"]).otherwise(F.col("vector_evidence"))
    gap = F.col("rejected_score") - F.col("chosen_score")
    kind = F.coalesce("preference_type", F.lit(""))
    rules = [
        ("critical", "missing_condition", ~F.col("has_condition")),
        ("critical", "missing_pair_candidate_id", ~named),
        ("critical", "same_chosen_rejected", named & (F.col("chosen_id") == F.col("rejected_id"))),
        ("critical", "missing_chosen_candidate", named & entry["chosen"].isNull()),
        ("critical", "missing_rejected_candidate", named & entry["rejected"].isNull()),
        ("critical", "cross_formula_pair", named & (formula["chosen"] != formula["rejected"])),
        ("critical", "formula_mismatch", named & (F.col("formula") != formula["chosen"])),
        ("critical", "formula_mismatch", named & (F.col("formula") != formula["rejected"])),
        ("critical", "cross_generation_condition_pair", named & (gen["chosen"] != gen["rejected"])),
        ("critical", "generation_condition_mismatch", named & (F.col("generation") != gen["chosen"])),
        ("critical", "generation_condition_mismatch", named & (F.col("generation") != gen["rejected"])),
        ("critical", "cross_spacegroup_condition_pair", named & (group["chosen"] != group["rejected"])),
        ("critical", "chosen_score_worse_than_rejected", named & (gap < 0)),
        ("critical", "preference_margin_inconsistent", named & (F.abs(F.round(gap, 12) - F.col("preference_margin")) > 1e-9)),
        ("critical", "non_positive_preference_margin", named & gap.isNotNull() & (F.col("preference_margin") <= 0)),
        ("critical", "chosen_missing_sequence_fields", named & ~F.col("chosen_sequence")),
        ("critical", "rejected_missing_sequence_fields", named & ~F.col("rejected_sequence")),
        ("critical", "stability_preference_without_f3", named & (kind == STABILITY) & ~validated),
        ("warning", "unsupported_preference_type", named & ~kind.isin(GEOMETRY, STABILITY)),
    ]
    cases = F.array_compact(F.array(*(F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(check).alias("check"))) for severity, check, holds in rules)))
    return rows.select(F.explode(cases).alias("f"), "path", "formula", "pair_id").select("f.*", "path", "formula", F.lit(None).cast("string").alias("candidate_id"), "pair_id")
