"""Screening, utility ranking and Pareto layers.

Input columns: candidate_id, _ord, atoms, f1, f2, f3 (nullable), confidence,
is_valid, and optionally novelty and diversity (0.5 where absent).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbering import numbered
from ..functions.session import checkpointed

#: Weights of the utility score.
WEIGHTS = {"success": 0.4, "confidence": 0.2, "validity": 0.15, "novelty": 0.15, "diversity": 0.1, "cost": 0.05}
MAXIMISED = ("success", "confidence", "validity", "novelty", "diversity")


def normalized_failure() -> Column:
    return (F.col("f1") + F.col("f2") + F.least(F.coalesce("f3", F.lit(1.0)), F.lit(1.0))) / 3.0


def screen(df: DataFrame, max_failure: float = 0.55) -> DataFrame:
    """Add screen_score, screen_status and screen_reason."""
    ok = F.coalesce(F.col("is_valid"), F.lit(False)) & (F.col("screen_score") <= max_failure)
    return df.withColumn("screen_score", normalized_failure()).withColumns({
        "screen_status": F.when(ok, "pass").otherwise("reject"),
        "screen_reason": F.when(ok, "valid_low_failure").otherwise("invalid_or_high_failure"),
    })


def objectives(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Add the objectives and their utility; invalid rows are left out."""
    w = WEIGHTS | (weights or {})
    given = lambda c: F.coalesce(c, F.lit(0.5)) if c in df.columns else F.lit(0.5)
    df = df.where("is_valid").withColumns({
        "success": F.greatest(F.lit(0.0), 1.0 - normalized_failure()),
        "validity": F.lit(1.0), "novelty": given("novelty"), "diversity": given("diversity"),
        "cost": F.coalesce(F.col("atoms").cast("double"), F.lit(10.0)) / F.lit(100.0),
    })
    utility = sum((w[k] * F.col(k) for k in MAXIMISED[1:]), w["success"] * F.col("success")) - w["cost"] * F.col("cost")
    return df.withColumn("utility", utility)


def rank_by_utility(df: DataFrame, weights: dict[str, float] | None = None, top_k: int | None = None) -> DataFrame:
    """Add rank (1 is best; ties by input order); with ``top_k`` only the first rows.

    The top rows are found by a distributed top-k before they are numbered.
    """
    rows = objectives(df, weights)
    if top_k is None:
        return numbered(rows, F.desc("utility"), "_ord", name="rank").withColumn("rank", F.col("rank").cast("int"))
    rows = rows.orderBy(F.desc("utility"), "_ord").limit(top_k)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("utility"), "_ord")))  # top_k rows


def validation_tasks(ranked: DataFrame, top_k: int = 3) -> DataFrame:
    top = ranked.where(F.col("rank") <= top_k)
    return top.select(F.concat(F.lit("mock-validation-"), F.col("candidate_id").cast("string")).alias("task_id"), "candidate_id", F.col("rank").alias("priority"), F.lit("cheap").alias("budget_tier"), "utility")


def feedback_records(tasks: DataFrame) -> DataFrame:
    return tasks.select(
        F.concat(F.lit("feedback-"), F.col("candidate_id").cast("string")).alias("feedback_id"), "candidate_id",
        F.col("priority").alias("selected_rank"), F.lit("selected").alias("decision"), F.lit("top_k_mock_ranking").alias("reason"),
    )


#: Vectors that a round of the skyline settles and broadcasts (of seven numbers each).
ROUND = 8192


def local_front(x):
    """Which rows of a matrix (larger is better) no other row dominates."""
    import numpy as np

    keep = np.ones(len(x), bool)
    for i in np.lexsort(x.T):
        if keep[i]:
            keep &= ~((x <= x[i]).all(axis=1) & (x < x[i]).any(axis=1))
    return keep


def pareto_front(vectors: DataFrame) -> DataFrame:
    """Rows that no row dominates.

    Rows are settled in order of the sum of their objectives, the next ROUND of
    them at a time: a row's dominators have no smaller sum (ties go by the
    objectives in turn), so the front of these rows belongs to the whole front
    once all before them have been compared. It is broadcast, and one pass
    drops what it dominates. No two rows meet in a join; each partition is
    reduced to its own front first, as dominance is transitive.
    """
    import numpy as np
    import pandas as pd

    names = [*MAXIMISED, "cost"]

    def objectives_of(frame: pd.DataFrame) -> np.ndarray:
        x = frame[names].to_numpy(float).copy()
        x[:, -1] *= -1
        return x

    def local(frames):
        kept: pd.DataFrame | None = None
        for frame in frames:
            both = frame if kept is None else pd.concat([kept, frame], ignore_index=True)
            kept = both[local_front(objectives_of(both))]
        if kept is not None:
            yield kept

    total = sum((F.col(c) for c in MAXIMISED[1:]), F.col(MAXIMISED[0])) - F.col("cost")
    order = [F.desc("_sum"), *(F.desc(c) for c in MAXIMISED), "cost", "vector"]
    left, fronts, spark = checkpointed(vectors.mapInPandas(local, vectors.schema).withColumn("_sum", total)), [], vectors.sparkSession
    while True:
        best = left.orderBy(*order).limit(ROUND).toPandas()
        if best.empty:
            break
        front = best[local_front(objectives_of(best))]
        fronts.append(checkpointed(spark.createDataFrame(front.drop(columns="_sum"), vectors.schema)))
        shared = spark.sparkContext.broadcast((objectives_of(front), set(best["vector"])))

        def rest(frames, shared=shared):
            strong, settled = shared.value
            for frame in frames:
                frame = frame[~frame["vector"].isin(settled)]
                x, open_ = objectives_of(frame), np.ones(len(frame), bool)
                for row in strong:
                    at = np.flatnonzero(open_)
                    if not len(at):
                        break
                    open_[at] = ~((x[at] <= row).all(axis=1) & (x[at] < row).any(axis=1))
                yield frame[open_]

        left = checkpointed(left.mapInPandas(rest, left.schema))
    out = fronts[0] if fronts else vectors.limit(0)
    for part in fronts[1:]:
        out = out.unionByName(part)
    return out


def pareto_layers(df: DataFrame, weights: dict[str, float] | None = None, max_layers: int | None = None) -> DataFrame:
    """Add pareto_layer and rank (layer, then utility, then input order).

    Equal objective vectors never dominate each other, so layers are peeled off
    the distinct vectors. Each round is written to the checkpoint folder.
    """
    rows = objectives(df, weights)
    keys = [*MAXIMISED, "cost"]
    vector = F.xxhash64(*keys)
    left = checkpointed(rows.select(*keys).distinct().withColumn("vector", vector))
    layers, layer = None, 0
    while not left.isEmpty() and (max_layers is None or layer < max_layers):
        front = checkpointed(pareto_front(left).select("vector").withColumn("pareto_layer", F.lit(layer)))
        layers = front if layers is None else layers.union(front)
        left = checkpointed(left.join(front.select("vector"), "vector", "left_anti"))
        layer += 1
    if layers is None:
        return rows.withColumns({"pareto_layer": F.lit(0), "rank": F.lit(1)}).limit(0)
    rows = rows.withColumn("vector", vector).join(layers, "vector").drop("vector")
    return numbered(rows, "pareto_layer", F.desc("utility"), "_ord", name="rank").withColumn("rank", F.col("rank").cast("int"))
