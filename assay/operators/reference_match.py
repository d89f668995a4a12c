"""The first reference that fits a task, with few calls of an expensive kernel.

References of a formula have a fixed order, and the plain definition tries them
one after the other until one fits. Here all tasks go along at once: the open
ones take their next references (1, 2, 4, ... of them), pairs that cheap
invariants rule out are dropped, the kernel judges the rest, and tasks that
have found their reference, or have come to the end of their formula, leave.
Both a formula's references and a round's pairs may be hot: references are
numbered over ranges, and a round joins on a reference's number, of which hot
ones are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import join_keyed
from ..functions.numbering import numbered
from ..functions.session import checkpointed

#: Outcomes, and the confidence each is given.
NO_BUCKET, MATCH, NO_MATCH = "no_exact_formula_reference", "structure_matcher_formula_bucket_match", "structure_matcher_formula_bucket_no_match"
CONFIDENCE = {NO_BUCKET: 0.0, MATCH: 0.95, NO_MATCH: 0.75}


def match_references(
    tasks: DataFrame, references: DataFrame, fits: Callable[[DataFrame], DataFrame], may_fit: Callable[[], Column] | None = None, order: str = "ref_ord", id_col: str = "candidate_id", formula: str = "formula", step: int = 1, confidence: dict[str, float] | None = None
) -> DataFrame:
    """Each task with its first reference, by ``order``, of the same formula for which ``fits``.

    ``references``: reference_id, formula, ``order`` and whatever the kernel
    reads, all but formula under names of their own. ``fits`` gets the pairs to
    judge and returns them with a boolean ``fits`` (built-in functions, or an
    external kernel through ``runs.evaluated``). ``may_fit`` is a condition on a
    pair that must hold wherever ``fits`` does (site count, volume): such pairs
    alone reach the kernel.

    Adds reference_id, match_type, f4_novelty_leakage, confidence,
    formula_bucket_size, checked_reference_count (references up to the match,
    or all of them) and kernel_calls. Tasks need a unique ``id_col``; a null
    formula has no references; a kernel's null means no. Ties in ``order`` go
    to the smaller reference_id.
    """
    weights = CONFIDENCE | (confidence or {})
    placed = numbered(references.where(F.col(formula).isNotNull()), formula, order, "reference_id", name="_place", start=0)
    buckets = placed.groupBy(formula).agg(F.min("_place").alias("_first"), F.count("*").alias("formula_bucket_size"))
    rows = checkpointed(join_keyed(tasks, buckets, [formula], "left"))
    shown = placed.drop(formula)
    open_, settled, at = rows.where("_first is not null").withColumn("kernel_calls", F.lit(0).cast("long")), [], 0
    while not open_.isEmpty():
        near = open_.withColumn("_at", F.explode(F.sequence(F.lit(at), F.least(F.lit(at + step), F.col("formula_bucket_size")).cast("int") - 1))).withColumn("_place", F.col("_first") + F.col("_at"))
        pairs = join_keyed(near, shown, ["_place"])
        judged = fits(pairs if may_fit is None else pairs.where(may_fit()))
        found = judged.groupBy(id_col).agg(F.count("*").alias("_calls"), F.min(F.when(F.coalesce("fits", F.lit(False)), F.struct("_at", "reference_id"))).alias("_hit"))
        after = open_.join(found, id_col, "left").withColumn("kernel_calls", F.col("kernel_calls") + F.coalesce("_calls", F.lit(0))).drop("_calls")
        at, step = at + step, step * 2
        after = checkpointed(after)
        done = F.col("_hit").isNotNull() | (F.col("formula_bucket_size") <= at)
        settled.append(after.where(done).select(id_col, "kernel_calls", F.col("_hit.reference_id").alias("reference_id"), F.col("_hit._at").alias("_at")))
        open_ = after.where(~done).drop("_hit")
    none = shown.schema["reference_id"].dataType
    result = settled[0] if settled else rows.select(id_col, F.lit(0).cast("long").alias("kernel_calls"), F.lit(None).cast(none).alias("reference_id"), F.lit(None).cast("int").alias("_at")).limit(0)
    for part in settled[1:]:
        result = result.unionByName(part)
    kind = F.when(F.col("_first").isNull(), NO_BUCKET).when(F.col("reference_id").isNotNull(), MATCH).otherwise(NO_MATCH)
    size = F.coalesce("formula_bucket_size", F.lit(0))
    score = F.lit(None).cast("double")
    for name, value in weights.items():
        score = F.when(F.col("match_type") == name, F.lit(value)).otherwise(score)
    out = rows.join(result, id_col, "left").withColumn("match_type", kind)
    return out.withColumns({
        "f4_novelty_leakage": (F.col("match_type") == MATCH).cast("double"), "confidence": score, "formula_bucket_size": size,
        "checked_reference_count": F.coalesce(F.col("_at") + 1, size).cast("long"), "kernel_calls": F.coalesce("kernel_calls", F.lit(0)),
    }).drop("_first", "_at")
