"""Mixing sources to target weights by Pareto order sampling.

Method: a source's target is shared out over its documents as expected copies.
The whole copies are certain; what is left over, below one, is a document's
inclusion probability. Documents are ranked by the odds of a random number
divided by the odds of their inclusion, and the smallest ranks are drawn while
they fit the words that are still missing: the size of the sample is fixed, in
words, as targets are. Of the rest, the row that fits the last gap best is drawn
too, if that brings the sum nearer to the target.

No document is shuffled and no source is gathered: sources are summed with
map-side combining, the rank at which a source's draw ends is found by counting
words in 4,096 ranges of ranks, then within the range that holds the end, until
few rows are left there, and every row is judged where it is. Sources' rows
(one each) are joined by broadcast up to a counted limit.

Defined results: a null text has no words and takes none; null is a source of
its own, the last one; a source without words has target 0. A row with a null
id draws by its text. Rows that share id and text share their random number and
are told apart by their place, so any number of them may be drawn and their
multiset is the same in every run. An empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assay.functions.numbering import numbered

from .common import join_hot, stored

#: Words of the contracts.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a rank, and bits looked at in one pass.
BITS, STEP = 48, 12
#: Rows of one source that a window may order at the end of a draw.
LAST_ROWS = 20_000
#: Sources broadcast at most.
BROADCAST_SOURCES = 200_000
#: The columns that order a draw: the Pareto rank, the text, the row's place.
RANKS = ["rank", "print", "place"]


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, cap: float = 3) -> DataFrame:
    """(source, source_size, target): ``share`` of all words dealt to the sources by weight.

    Sources in code point order, null last, take ``weights`` in turn. A target
    above ``cap`` times its source stops there, and the excess goes to the
    others by weight until none is above.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = numbered(sources, F.col("source").asc_nulls_last(), name="turn", start=0)
    turn = F.col("turn") % len(weights) + 1
    placed = stored(placed.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int")).cast("double").alias("weight")), "sources")
    limit, level = F.col("source_size") * F.lit(float(cap)), None
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    while True:
        stopped = F.lit(False) if level is None else limit < F.col("weight") * level
        used, weight, n = placed.agg(F.sum(F.when(stopped, limit)), F.sum(F.when(~stopped, F.col("weight"))), F.count(F.when(stopped, 1))).first()
        if level is not None and n == before or not weight:
            break
        level, before = (total * share - (used or 0.0)) / weight, n
    return placed.select("source", "source_size", F.least(limit, F.col("weight") * F.lit(level or 0.0)).alias("target"))


def with_source(rows: DataFrame, sources: DataFrame, key: str = "key") -> DataFrame:
    """``rows`` joined with the one row of their source; hot sources never meet in a task."""
    if sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(sources), key)
    weighted = rows.groupBy(key).agg(F.count("*").alias("_rows")).join(sources, key)
    return join_hot(rows, weighted, key, "_rows").drop("_rows")


def digit(level: int) -> Column:
    """The ``level``-th group of STEP bits in the order of RANKS."""
    column, place = RANKS[level // (BITS // STEP)], level % (BITS // STEP)
    return F.shiftright(column, BITS - STEP * (place + 1)).bitwiseAND(F.lit((1 << STEP) - 1))


def draw_ends(rows: DataFrame, missing: DataFrame) -> DataFrame:
    """(key, end_rank, end_print, end_place, gap): the last row each source draws in order of rank.

    ``rows`` are (key, size, RANKS) of all that may be drawn, ``missing`` the
    words (key, rest) a source still needs, ``gap`` what is left of them.
    """
    levels, level = len(RANKS) * BITS // STEP, 0
    state = missing.select("key", "rest")
    while True:
        found = [f"d{i}" for i in range(level)]
        inside = with_source(rows, state)
        for i, name in enumerate(found):
            inside = inside.where(digit(i) == F.col(name))
        counts = inside.groupBy("key", *found, "rest", digit(level).alias(f"d{level}")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        running = counts.withColumn("sum", F.sum("words").over(Window.partitionBy("key").orderBy(f"d{level}").rowsBetween(Window.unboundedPreceding, 0)))
        # The first range that reaches the rest; where rounding leaves none, the last one.
        reached = running.groupBy("key").agg(F.coalesce(F.min(F.when(F.col("sum") >= F.col("rest"), F.struct(f"d{level}", *found, "sum", "words", "rest", "n"))), F.max(F.struct(f"d{level}", *found, "sum", "words", "rest", "n"))).alias("at"))
        state = stored(reached.select("key", "at.*").select("key", *found, f"d{level}", "n", (F.col("rest") - (F.col("sum") - F.col("words"))).alias("rest")), "draw")
        level += 1
        most = state.agg(F.max("n")).first()[0]
        if most is None or most <= LAST_ROWS or level == levels:
            break
    inside = with_source(rows, state.drop("n"))
    for i in range(level):
        inside = inside.where(digit(i) == F.col(f"d{i}"))
    order = Window.partitionBy("key").orderBy(*RANKS).rowsBetween(Window.unboundedPreceding, 0)
    sums = inside.withColumn("sum", F.sum("size").over(order))
    last = sums.where("sum <= rest").groupBy("key").agg(F.max(F.struct(*RANKS, "sum")).alias("at"))
    # Where not even the first row of the range is drawn, all ranges before it are.
    low = [sum((F.col(f"d{i}") * F.lit(1 << (BITS - STEP * (i % (BITS // STEP) + 1))) for i in range(level) if i // (BITS // STEP) == k), F.lit(0)) for k in range(len(RANKS))]
    low[-1] = low[-1] - 1
    return state.join(last, "key", "left").select("key", *(F.coalesce(F.col(f"at.{r}"), low[k]).alias(f"end_{r}") for k, r in enumerate(RANKS)), (F.col("rest") - F.coalesce("at.sum", F.lit(0))).alias("gap"))


def is_drawn() -> Column:
    """Whether a row stands before its source's end."""
    return F.col("end_rank").isNotNull() & (F.struct(*RANKS) <= F.struct(*(F.col(f"end_{r}").alias(r) for r in RANKS)))


def closing(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """Add to ``ends`` the row (last_rank, last_print, last_place) that fits the gap best, if one makes it smaller."""
    off = F.abs(F.col("size") - F.col("gap"))
    best = with_source(rows, ends).where(~is_drawn() & (off < F.col("gap"))).groupBy("key").agg(F.min(F.struct(off.alias("off"), *RANKS)).alias("at"))
    return ends.join(best, "key", "left").select(*ends.columns, *(F.col(f"at.{r}").alias(f"last_{r}") for r in RANKS))


def copies(rows: DataFrame, cap: float) -> DataFrame:
    """Add ``copies``: importance times a factor of the source, at most ``cap``, such that the expected words meet the target."""
    factors = rows.groupBy("key").agg(F.first("target").alias("goal"), F.sum(F.col("size") * F.col("importance")).alias("mass"))
    factors = stored(factors.select("key", "goal", F.when(F.col("mass") > 0, F.col("goal") / F.col("mass")).alias("factor"), F.lit(0).cast("long").alias("full")), "factors")
    while True:
        full = F.col("importance") * F.col("factor") >= cap
        seen = with_source(rows.select("key", "size", "importance"), factors).groupBy("key", "goal").agg(
            F.coalesce(F.sum(F.when(full, F.col("size"))), F.lit(0)).alias("full"),
            F.sum(F.when(~full, F.col("size") * F.col("importance"))).alias("mass"),
            F.first("factor").alias("factor"),
        )
        ratio = (F.col("goal") - F.col("full") * F.lit(float(cap))) / F.col("mass")
        new = stored(seen.select("key", "goal", F.when((F.col("full") > 0) & (F.col("mass") > 0), F.greatest("factor", ratio)).otherwise(F.col("factor")).alias("factor"), "full"), "factors")
        same = factors.select("key", F.col("full").alias("was")).join(new, "key").where("full != was").isEmpty()
        factors = new
        if same:
            return with_source(rows, factors.select("key", "factor")).withColumn("copies", F.coalesce(F.least(F.lit(float(cap)), F.col("importance") * F.col("factor")), F.lit(0.0))).drop("factor")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, cap: int = 3, seed: int = 2024, importance: Column | None = None
) -> DataFrame:
    """(id, source, size, source_size, target, copies, n_copies, taken) of every row.

    ``importance`` (a column of ``docs``, none: all alike, null: 0) says how
    copies are shared out within a source; a source whose rows all have
    importance 0 takes nothing. ``copies`` is what a row expects, ``n_copies``
    what the mix takes of it, at most ``cap``, and ``taken`` the words of that.
    """
    known = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("~"), F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)))
    sizes = stored(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            (F.lit(1.0) if importance is None else F.greatest(F.coalesce(importance.cast("double"), F.lit(0.0)), F.lit(0.0))).alias("importance"),
            F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), known).cast("binary"), 256), 1, BITS // 4), 16, 10).cast("long").alias("random"),
            F.shiftrightunsigned(F.xxhash64(text_col), 64 - BITS).alias("print"),
            F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - BITS).alias("place"),
        ),
        "mix-sizes",
    ).withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")))
    targets = source_targets(sizes, weights, share, cap)
    targets = stored(targets.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))).drop("source"), "targets")
    rows = with_source(sizes, targets)
    if importance is None:
        rows = rows.withColumn("copies", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    else:
        rows = copies(rows, cap)
    # The odds of the random number over the odds of inclusion, q, as q / (1 + q), which lies between 0 and 1.
    chance, random = F.col("copies") - F.col("whole"), (F.col("random") + 0.5) / float(1 << BITS)
    above, below = random * (1 - F.col("chance")), (1 - random) * F.col("chance")
    rank = F.least(F.floor(above / (above + below) * float(1 << BITS)), F.lit((1 << BITS) - 1))
    rows = rows.withColumn("whole", F.floor("copies")).withColumn("chance", chance).withColumn("rank", F.when(F.col("chance") > 0, rank))
    may = rows.where("chance > 0 AND size > 0")
    missing = rows.groupBy("key").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("rest"))
    may = may.select("key", "size", *RANKS)
    ends = stored(draw_ends(may, stored(missing.where("rest > 0"), "missing")), "draw-ends")
    sources = stored(targets.select("key").join(closing(may, ends), "key", "left"), "ends")
    last = F.struct(*RANKS).eqNullSafe(F.struct(*(F.col(f"last_{r}").alias(r) for r in RANKS)))
    n = F.col("whole") + F.when((F.col("chance") > 0) & (is_drawn() | last), 1).otherwise(0)
    return with_source(rows, sources).select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", n.alias("n_copies"), (n * F.col("size")).alias("taken"))
