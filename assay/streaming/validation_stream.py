"""New validation files as a stream: each batch updates the audit's latest votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.validate import last_wins
from ..sources import files

SCHEMA = "candidate_id string, formula string, validator string, validation_status string, is_stable boolean, e_above_hull double, force_max double, ts timestamp"


def validation_files(spark: SparkSession, folder: str, schema: str = SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).json(folder)


def rate_by_window(stream: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Stable rate by validator and event-time window; later rows than ``late`` are left out."""
    rows = stream.withWatermark("ts", late).groupBy(F.window("ts", window), "validator")
    return rows.agg(F.count("*").alias("n"), F.count_if("is_stable").alias("stable"))


KEYS, ORDER = ["candidate_id", "validator"], ["ts", "validation_status"]


def bucket_paths(spark: SparkSession, target: str, before: int | None = None) -> dict[int, str]:
    """Where the current version of each bucket lies: in the last finished batch that wrote it."""
    found: dict[int, str] = {}
    for folder in files.matching(spark, f"{target}/batch=*"):
        number = int(folder.rpartition("=")[2])
        if (before is None or number < before) and files.exists(spark, f"{folder}/_SUCCESS"):
            found |= {int(p.rpartition("=")[2]): p for p in files.matching(spark, f"{folder}/bucket=*")}
    return found


def read_latest(spark: SparkSession, target: str, schema: str = SCHEMA) -> DataFrame:
    """The table that ``keep_latest`` maintains."""
    paths = list(bucket_paths(spark, target).values())
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def keep_latest(stream: DataFrame, target: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Merge each batch into a table of the last row of each (candidate, validator).

    The table lies in ``buckets`` of the key's hash, and a batch reads and
    writes only those it touches, below ``batch=n``; all others stay where an
    earlier batch has left them. A batch that is repeated reads what stood
    before it and replaces its own folder, and a folder counts once it is
    finished, so a restart loses and doubles nothing. Superseded versions may
    be removed by ``remove_superseded``.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        names = batch.columns
        new = batch.withColumn("bucket", F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int"))
        touched = {r.bucket for r in new.select("bucket").distinct().collect()}  # at most ``buckets``
        if not touched:
            return
        old = [p for b, p in bucket_paths(spark, target, number).items() if b in touched]
        rows = batch.unionByName(spark.read.schema(batch.schema).parquet(*old)) if old else batch
        latest = last_wins(rows, KEYS, ORDER).select(*names).withColumn("bucket", F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int"))
        latest.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/batch={number:012d}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def remove_superseded(spark: SparkSession, target: str) -> list[str]:
    """Delete bucket versions that a later batch has replaced; not while a batch or a reader is at work."""
    current = set(bucket_paths(spark, target).values())
    gone = [p for p in files.matching(spark, f"{target}/batch=*/bucket=*") if p not in current]
    for path in gone:
        files.remove(spark, path)
    return gone
