"""Cluster nodes from scheduler text: parsing, eligibility and choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Node states that rule a node out.
BAD_STATES = ("DOWN", "DRAIN", "DRAINED", "DRAINING", "FAIL", "MAINT", "RESERVED", "UNKNOWN", "NOT_RESPONDING")


def field(name: str) -> Column:
    found = F.regexp_extract("block", rf"(?:^|\s){name}=(\S+)", 1)
    return F.when(found != "", found)


def gpus(text: Column) -> Column:
    """Number of GPUs in a GRES or TRES text."""
    number = F.regexp_extract(text, r"gpu(?::[A-Za-z_][\w.-]*)?[:=](\d+)", 1)
    return F.coalesce(number.try_cast("int"), F.lit(0))


def memory_mb(text: Column) -> Column:
    """Memory in MB from a number with an optional unit."""
    unit = F.upper(F.regexp_extract(text, r"([KMGT])", 1))
    scale = F.when(unit == "K", 1 / 1024).when(unit == "G", 1024.0).when(unit == "T", 1048576.0).otherwise(1.0)
    return F.regexp_extract(text, r"([\d.]+)", 1).try_cast("double") * scale


def minutes(duration: Column) -> Column:
    """Minutes (rounded up) of a duration D-HH:MM:SS, HH:MM:SS, MM:SS or MM."""
    part = lambda pattern: F.coalesce(F.regexp_extract(duration, pattern, 1).try_cast("int"), F.lit(0))
    colons = F.size(F.split(duration, ":"))
    days = part(r"^(\d+)-")
    clock = F.split(F.regexp_replace(duration, r"^\d+-", ""), ":")
    at = lambda i: F.coalesce(F.try_element_at(clock, F.lit(i)).try_cast("int"), F.lit(0))
    seconds = F.when(colons == 3, at(1) * 3600 + at(2) * 60 + at(3)).when((colons == 2) & (days == 0), at(1) * 60 + at(2)).when(colons == 2, at(1) * 3600 + at(2) * 60).when(days > 0, at(1) * 3600).otherwise(at(1) * 60)
    return F.ceil((days * 86400 + seconds) / 60.0)


def from_blocks(text: DataFrame) -> DataFrame:
    """Node table from (value): the whole text of blocks of Key=value pairs."""
    block = F.explode(F.split("value", r"\n\s*\n|(?=NodeName=)")).alias("block")
    rows = text.select(block).where("block rlike 'NodeName='")
    total = F.greatest(gpus(F.coalesce(field("CfgTRES"), F.lit(""))), gpus(F.coalesce(field("Gres"), F.lit(""))))
    return rows.select(
        field("NodeName").alias("node"), F.upper(field("State")).alias("state"), F.split(F.coalesce(field("Partitions"), F.lit("")), ",").alias("partitions"),
        total.alias("gpus"), gpus(F.coalesce(field("AllocTRES"), F.lit(""))).alias("gpus_used"), F.coalesce(field("Gres"), F.lit("")).alias("gres"),
        field("CPUTot").try_cast("int").alias("cpus"), field("CPUAlloc").try_cast("int").alias("cpus_used"), memory_mb(F.coalesce(field("RealMemory"), F.lit(""))).alias("memory_mb"),
    ).withColumns({"gpus_free": F.greatest(F.col("gpus") - F.col("gpus_used"), F.lit(0)), "cpus_free": F.greatest(F.col("cpus") - F.col("cpus_used"), F.lit(0))})


def from_rows(text: DataFrame) -> DataFrame:
    """Node table from (value) lines node|partition|state|gres|cpus, grouped by node."""
    p = F.split("value", r"\|")
    rows = text.where("value rlike '[|]'").select(F.trim(p[0]).alias("node"), F.trim(p[1]).alias("partition"), F.upper(F.trim(p[2])).alias("state"), F.trim(p[3]).alias("gres"))
    return rows.groupBy("node").agg(F.first("state").alias("state"), F.array_sort(F.collect_set(F.regexp_replace("partition", r"\*$", ""))).alias("partitions"), F.max(gpus(F.col("gres"))).alias("gpus"), F.max("gres").alias("gres"))


def usable_state(state: Column | str = "state") -> Column:
    c = F.col(state) if isinstance(state, str) else state
    words = F.split(c, r"[+*~#$@^-]+")
    return (F.size(F.array_intersect(words, F.array(*(F.lit(s) for s in BAD_STATES)))) == 0) & (F.size(F.array_intersect(words, F.array(F.lit("IDLE"), F.lit("MIXED"), F.lit("MIX")))) > 0)


def eligible(nodes: DataFrame, need: int = 1, allow: list[str] | None = None, block: list[str] | None = None) -> DataFrame:
    """Nodes with enough free GPUs in a permitted partition (one row for each)."""
    rows = nodes.where(usable_state() & (F.col("gpus_free") >= need)).withColumn("partition", F.explode("partitions"))
    if allow:
        rows = rows.where(F.col("partition").isin(allow))
    return rows.where(~F.col("partition").isin(block)) if block else rows


def best_node(rows: DataFrame, weights: dict[str, float] | None = None, test: tuple[str, ...] = ("test",)) -> DataFrame:
    """The node with the highest weight x free GPUs; test partitions only as a last resort."""
    weight = F.lit(1.0)
    for name, value in (weights or {}).items():
        weight = F.when(F.col("gres").contains(name), F.lit(value)).otherwise(weight)
    rows = rows.withColumns({"score": weight * F.col("gpus_free"), "is_test": F.col("partition").isin(*test)})
    return rows.orderBy("is_test", F.desc("score"), F.desc("gpus_free"), "partition", "node").limit(1)


def queueable(nodes: DataFrame, test: tuple[str, ...] = ("test",)) -> DataFrame:
    """Distinct partitions with the most GPUs of a node, test partitions last."""
    rows = nodes.where("gpus > 0").select(F.explode("partitions").alias("partition"), "gpus")
    rows = rows.groupBy("partition").agg(F.max("gpus").alias("max_gpus"), F.count("*").alias("nodes"))
    return rows.withColumn("choice", F.row_number().over(Window.orderBy(F.col("partition").isin(*test), F.desc("max_gpus"), F.desc("nodes"), "partition")))


def plan_gpu_job(nodes: DataFrame, minimum: int = 1, queue_minimum: int = 1, weights: dict[str, float] | None = None) -> DataFrame:
    """One decision row: run on the best free node, else queue, else not ready."""
    best = best_node(eligible(nodes, minimum), weights).select("node", "partition", "gpus_free")
    queue = queueable(nodes).where("choice = 1").select(F.col("partition").alias("queue"))
    one = nodes.sparkSession.range(1, numPartitions=1).select(F.lit(1).alias("k"))
    rows = one.join(best, F.lit(True), "left").join(queue, F.lit(True), "left")  # one row each
    mode = F.when(F.col("node").isNotNull(), "free_node").when(F.col("queue").isNotNull(), "auto_queue").otherwise("not_ready")
    request = F.when(F.col("node").isNotNull(), F.least(F.greatest(F.lit(minimum), F.lit(queue_minimum)), F.col("gpus_free")))
    return rows.select(mode.alias("mode"), "node", F.coalesce("partition", "queue").alias("partition"), request.alias("request"))


def plan_cpu_job(nodes: DataFrame, job_minutes: int, forced: str | None = None, test: str = "test", test_minutes: int = 30, reserve: int = 2) -> DataFrame:
    """Forced partition, else the test partition for short jobs, else the first idle one, else any."""
    rows = nodes.withColumn("partition", F.explode("partitions"))
    idle = rows.where(usable_state() & (F.col("cpus_free") > 0))
    pick = idle.agg(
        F.max(F.col("partition") == test).alias("test_idle"), F.min(F.when(F.col("partition") != test, F.col("partition"))).alias("first_idle"),
        F.max("cpus_free").alias("most_free"),
    )
    every = rows.agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("partition") != test, F.col("partition")))), ",").alias("all_partitions"))
    choice = F.when(F.lit(forced is not None), F.lit(forced)).when(F.lit(job_minutes <= test_minutes) & F.coalesce("test_idle", F.lit(False)), F.lit(test)).otherwise(F.coalesce("first_idle", "all_partitions"))
    return pick.crossJoin(every).select(choice.alias("partition"), F.greatest(F.coalesce("most_free", F.lit(0)) - reserve, F.lit(1)).alias("core_budget"))
