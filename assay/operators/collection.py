"""Roll-up of artifact trees: nine kinds of files in one pass, one row for each formula.

Every artifact row says some facts (this id is a candidate, this formula failed,
this reason blocks so many times). Facts are counted by (formula, kind, key)
with map-side combining, so a formula that owns a third of all rows is spread
over its ids, and only then put together by formula. Rows of JSON lines, which
are many, have their fields taken out once, before the facts are laid out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.session import checkpointed

#: Statuses that settle a formula, and the groups of skip reasons of a preference summary.
FAILED, COMPLETED = ("failed", "generation_failed"), ("succeeded", "smoke_from_existing", "completed", "validated_ready")
SKIPS = ("skip_reasons", "candidate_skip_reasons", "pair_skip_reasons")
#: The kind of a reason that counts for its formula and over all formulas.
SHARED = "shared"
#: Reasons shown for each formula.
TOP = 10
FACT = "array<struct<formula:string,kind:string,key:string,n:bigint,value:double>>"


def text(row: Column, path: str) -> Column:
    value = F.try_variant_get(row, f"$.{path}", "string")
    return F.when(value != "", value)


def number(row: Column, path: str) -> Column:
    """An integer, 0 for whatever is none."""
    return F.coalesce(text(row, path).try_cast("double").cast("long"), F.lit(0))


def texts(row: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(row, f"$.{path}", "array<string>"), F.array().cast("array<string>"))


def items(row: Column, path: str = "items") -> Column:
    """The objects of an array."""
    found = F.coalesce(F.try_variant_get(row, f"$.{path}", "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(found, lambda x: F.schema_of_variant(x).startswith("OBJECT"))


def formula(row: Column, otherwise: Column) -> Column:
    return F.coalesce(text(row, "condition.formula"), text(row, "formula"), text(row, "composition"), text(row, "metadata.formula_condition"), otherwise)


def fact(of: Column | None, kind: Column | str, key: Column | None = None, n: Column | int = 1, value: Column | None = None) -> Column:
    """One fact of a formula, or of none: that counts over all formulas."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.struct((F.lit(None).cast("string") if of is None else of).alias("formula"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), (F.lit(None) if key is None else key).cast("string").alias("key"), n.cast("long").alias("n"), (F.lit(None) if value is None else value).cast("double").alias("value"))


def counted(row: Column, path: str) -> Column:
    """(key, n) of a map of counts."""
    entries = F.map_entries(F.coalesce(F.try_variant_get(row, f"$.{path}", "map<string,string>"), F.create_map().cast("map<string,string>")))
    return F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.coalesce(e["value"].try_cast("double").cast("long"), F.lit(0)).alias("n")))


def flat(*parts: Column) -> Column:
    return F.concat(*parts).cast(FACT)


def only(condition: Column, *parts: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.array(*parts).cast(FACT)).otherwise(F.array().cast(FACT))


def seen(of: Column) -> Column:
    return F.array(fact(of, "path", F.col("path")), fact(of, "root", F.col("root")))


def line_facts(rows: DataFrame) -> DataFrame:
    """(formula, kind, key, n, value) of the rows of JSON lines (root, path, artifact, path_formula, form, row)."""
    row, here, named = F.col("row"), F.col("path_formula"), F.col("artifact")
    listed, vectors, paired = named.isin("candidates.jsonl", "audit_candidates.jsonl"), named == "failure_vectors.jsonl", named == "preference_pairs.jsonl"
    audited = named == "audit_candidates.jsonl"
    # A key that is there counts, be its value null.
    ident = F.when(F.try_variant_get(row, "$.candidate_id", "variant").isNotNull(), text(row, "candidate_id")).otherwise(text(row, "sample_id"))
    condition = F.when(F.try_variant_get(row, "$.condition", "map<string,variant>").isNotNull(), F.to_json(F.try_variant_get(row, "$.condition", "variant"))).otherwise("{}")
    said = lambda name: F.coalesce(F.try_variant_get(row, f"$.{name}", "string"), F.lit("None"))
    pair = F.concat_ws("|", condition, F.coalesce(text(row, "pair_id"), F.concat_ws("|", said("chosen_candidate_id"), said("rejected_candidate_id"))))
    fields = rows.where("form = 'lines'").select(
        "root", "path", F.when(vectors, here).otherwise(formula(row, here)).alias("formula"), F.when(listed, ident).when(paired, pair).alias("id"),
        F.when(listed, F.when(audited, "audited").otherwise("candidates")).when(paired, "pairs").alias("kind"),
        F.when(audited, F.try_variant_get(row, "$.dpo_eligible", "boolean")).alias("eligible"), F.when(paired, text(row, "preference_type")).alias("type"),
        F.when(audited, texts(row, "dpo_ineligible_reasons")).when(vectors, texts(row, "hard_failures")).otherwise(F.array().cast("array<string>")).alias("reasons"),
    )
    scoped = F.when(F.col("id").isNotNull(), F.concat_ws("|", "root", "id"))
    # By place: path, root, id, id if eligible, type, and reasons from there on. A row without a formula says nothing.
    keys = F.concat(F.array(F.col("path"), F.col("root"), scoped, F.when(F.col("eligible"), scoped), F.concat(F.lit("preference_type:"), "type")), "reasons")
    # Outer: else Spark would filter by the size of the array, and take the fields out of the row once more for it.
    placed = fields.select("formula", "kind", F.posexplode_outer(F.when(F.col("formula").isNotNull(), keys)).alias("at", "key"))
    at = F.col("at")
    kind = F.when(at == 0, "path").when(at == 1, "root").when(at == 2, F.col("kind")).when(at == 3, "eligible").when(at == 4, "reason").otherwise(SHARED)
    kept = placed.where((at > 4) | F.col("key").isNotNull())
    return kept.select(fact(F.when(at != 4, F.col("formula")), kind, F.col("key")).alias("fact")).select("fact.*")


def file_facts(rows: DataFrame) -> DataFrame:
    """(formula, kind, key, n, value, _ord) of the rows of whole files (root, path, artifact, path_formula, form, row, _ord)."""
    row, here = F.col("row"), F.col("path_formula")
    own = formula(row, here)
    none = F.array().cast(FACT)
    numbers = lambda of, pairs: F.concat(F.transform(pairs, lambda p: fact(of, "reason", p["key"], p["n"])), F.transform(pairs, lambda p: fact(None, "reason", p["key"], p["n"])))

    def each(inner) -> Column:
        """Facts of the items that have a formula."""
        return F.flatten(F.transform(items(row), lambda x: F.when(formula(x, here).isNotNull(), inner(x, formula(x, here))).otherwise(none)))

    smoke = lambda x, name: F.when(F.try_variant_get(x, "$.smoke_summary", "map<string,variant>").isNotNull(), number(x, f"smoke_summary.{name}")).otherwise(0)
    seconds = lambda x: F.try_variant_get(x, "$.total_duration_seconds", "double")
    plan = each(lambda x, f: flat(seen(f), F.array(fact(f, "status", F.lit("planned")))))
    ready = F.when(F.coalesce(~text(row, "ready_for_generation").isin("false", "0"), F.lit(False)), "validated_ready").otherwise("in_progress")
    blocking = texts(row, "blocking_reasons")
    validated = flat(F.transform(blocking, lambda k: fact(None, "reason", k)), each(lambda x, f: flat(seen(f), F.array(fact(f, "status", ready)), F.transform(blocking, lambda k: fact(f, "reason", k)))))
    bulk = each(
        lambda x, f: flat(
            seen(f), F.array(fact(f, "status", F.coalesce(F.try_variant_get(x, "$.status", "string"), F.lit("unknown")))),
            only(text(x, "error").isNotNull(), fact(f, "reason", text(x, "error"))), only(text(x, "error").isNotNull(), fact(None, "reason", text(x, "error"))),
            F.array(fact(f, "candidates", value=smoke(x, "candidate_count")), fact(f, "eligible", value=smoke(x, "dpo_eligible_count")), fact(f, "pairs", value=smoke(x, "preference_pair_count"))),
            F.transform(counted(x, "smoke_summary.preference_skip_reasons"), lambda p: fact(None, "reason", p["key"], p["n"])), only(seconds(x).isNotNull(), fact(f, "seconds", value=seconds(x))),
        )
    )
    failures = F.transform(F.filter(items(row, "top_failure_reasons"), lambda x: text(x, "reason").isNotNull()), lambda x: F.struct(text(x, "reason").alias("key"), F.when(F.try_variant_get(x, "$.count", "variant").isNull(), F.lit(1).cast("long")).otherwise(number(x, "count")).alias("n")))
    audit = flat(
        seen(own), F.array(fact(own, "status", F.lit("completed")), fact(own, "candidates", value=number(row, "total_candidates")), fact(own, "audited", value=number(row, "total_candidates")), fact(own, "eligible", value=number(row, "dpo_eligible_count"))), numbers(own, failures)
    )
    preferences = flat(seen(own), F.array(fact(own, "status", F.lit("completed")), fact(own, "pairs", value=number(row, "pair_count"))), *(numbers(own, counted(row, g)) for g in SKIPS))
    named = F.col("artifact")
    found = (
        F.when(named == "bulk_plan.json", plan).when(named == "bulk_validation_summary.json", validated).when(named == "bulk_summary.json", bulk)
        .when((named == "audit_summary.json") & own.isNotNull(), audit).when((named == "preference_summary.json") & own.isNotNull(), preferences)
        .when(named.isin("report.md", "validate_report.md") & here.isNotNull(), seen(here).cast(FACT))
    )
    return rows.where("form != 'lines'").select(F.explode(found).alias("fact"), "_ord").select("fact.*", "_ord")


def top_reasons(reasons: DataFrame) -> DataFrame:
    """(formula, top_reasons): the TOP (reason, count) of each, most frequent first, ties by name."""
    place = F.row_number().over(Window.partitionBy("formula").orderBy(F.desc("n"), "key"))
    few = reasons.withColumn("_place", place).where(F.col("_place") <= TOP)
    ranked = F.transform(F.array_sort(F.collect_list(F.struct("_place", F.col("key").alias("reason"), F.col("n").alias("count")))), lambda x: F.struct(x["reason"].alias("reason"), x["count"].alias("count")))
    return few.groupBy("formula").agg(ranked.alias("top_reasons"))


def collect(rows: DataFrame, errors: DataFrame, include_in_progress: bool = True) -> tuple[DataFrame, DataFrame]:
    """(formulas, reasons): the state of each formula, and what blocks over all of them, with counts.

    ``rows`` and ``errors`` as ``artifact_tree`` returns them. Rows of files
    with an error count nothing; their errors are reasons. Ids count once for
    each root; a summary's figure counts where it is larger than the ids found.
    """
    rows = rows.where("ok")
    said = checkpointed(file_facts(rows))
    wrong = errors.where("formula is not null")
    error = lambda kind, key: fact(F.col("formula"), kind, F.col(key))
    issues = wrong.select(F.explode(F.concat(F.array(error("reason", "issue")), F.when(F.col("issue") != "missing_artifact", F.array(error("path", "path"))).otherwise(F.array().cast(FACT)))).alias("fact")).select("fact.*")
    keyed = line_facts(rows).unionByName(said.drop("_ord")).unionByName(issues).groupBy("formula", "kind", "key").agg(F.sum("n").alias("n"), F.max("value").alias("most"))
    keyed = checkpointed(keyed)
    # The last duration said, apart from the others: an order would sort all facts.
    last = said.where("kind = 'seconds' and formula is not null").groupBy("formula").agg(F.max_by("value", "_ord").alias("total_duration_seconds"))
    own = keyed.where("formula is not null")
    ids = lambda kind: F.count_if((F.col("kind") == kind) & F.col("key").isNotNull())
    size = lambda kind: F.greatest(ids(kind), F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("most"))), F.lit(0.0)).cast("long"))
    names = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("key"))))
    has = lambda values: F.coalesce(F.bool_or((F.col("kind") == "status") & F.col("key").isin(*values)), F.lit(False))
    out = own.groupBy("formula").agg(
        F.when(has(FAILED), "failed").when(has(COMPLETED), "completed").otherwise("in_progress").alias("status"), names("root").alias("roots"), names("path").alias("artifact_paths"),
        size("candidates").alias("candidate_count"), size("audited").alias("audit_candidate_count"), size("eligible").alias("dpo_eligible_count"), size("pairs").alias("preference_pair_count"), names("status").alias("status_sources"),
        (ids("candidates") + ids("audited") + ids("pairs") > 0).alias("_ids"),
    )
    if not include_in_progress:
        out = out.where("_ids or status != 'in_progress'")
    whose = F.when(F.col("kind") == SHARED, F.array("formula", F.lit(None))).otherwise(F.array("formula"))
    reasons = keyed.where(F.col("kind").isin("reason", SHARED)).select(F.explode(whose).alias("formula"), "key", "n").groupBy("formula", "key").agg(F.sum("n").alias("n"))
    out = out.drop("_ids").join(last, "formula", "left").join(top_reasons(reasons.where("formula is not null")), "formula", "left")
    return out, reasons.where("formula is null").select(F.col("key").alias("reason"), F.col("n").alias("count"))


def collection_summary(formulas: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: formulas by status, totals of the counts, and artifacts missing, empty and corrupt."""
    totals = {"total_candidates": "candidate_count", "total_audit_candidates": "audit_candidate_count", "total_dpo_eligible": "dpo_eligible_count", "total_preference_pairs": "preference_pair_count"}
    by = lambda s: F.count_if(F.col("status") == s).alias(f"{s}_formula_count")
    left = formulas.agg(F.count("*").alias("formula_count"), by("completed"), by("failed"), by("in_progress"), *(F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in totals.items()))
    issue = lambda *names: F.count_if(F.col("issue").isin(*names))
    right = errors.agg(issue("missing_artifact").alias("missing_artifact_count"), issue("corrupt_json", "malformed_jsonl").alias("corrupt_artifact_count"), issue("empty_artifact").alias("empty_artifact_count"))
    return left.crossJoin(right)  # one row each
