"""Shared helpers: intermediate tables, word splitting and stable hashes."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of an Arrow batch that Python gets while a table is written, and of a row group of that table.
BATCH_BYTES, GROUP_BYTES = 1 << 20, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only where the setting is absent and all tasks run in this process (tests),
    a temporary folder is made the context's checkpoint folder and used from
    then on; on a cluster a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context.getCheckpointDir():
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="assay-"))
        folder = context.getCheckpointDir()
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark hands Python batches of at most BATCH_BYTES, however long the texts are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    The lineage ends here: a lost executor costs a re-read, not a recomputation.
    """
    path = new_path(df.sparkSession, label)
    with small_batches(df.sparkSession):
        df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kind_of(df: DataFrame, column: str) -> str:
    """A column's type, as schema strings write it."""
    return df.schema[column].dataType.simpleString()


def only_ids(docs: DataFrame, ids: DataFrame, id_col: str = "id", broadcast_ids: int = 4_000_000) -> DataFrame:
    """Rows of ``docs`` whose id is in ``ids``.

    The ids (8 bytes each) are broadcast up to a counted limit, joined beyond it.
    """
    few = ids.limit(broadcast_ids + 1).count() <= broadcast_ids
    return docs.join(F.broadcast(ids) if few else ids, id_col, "left_semi")


_slot: list = [None, None]


def held(key: object, make: Callable[[], object]) -> object:
    """What this Python worker keeps from task to task: one object, under one key.

    Workers outlive stages, so an operator that asks for its own object lets go
    of what another one has left.
    """
    if _slot[0] != key:
        _slot[:] = None, None
        gc.collect()
        _slot[:] = key, make()
    return _slot[1]


def lower_ascii(text: Column | str) -> Column:
    """Lower-case A-Z only; every other character stays."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def words_of(raw: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes, A-Z lower-cased.

    ``bytes.lower`` and ``bytes.split`` touch ASCII only, which is exactly the
    rule of the contracts.
    """
    return raw.lower().split() if raw else []


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, filled on demand and emptied at ``limit`` entries."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class TwoAgeCache(dict):
    """A dict with a bound: when full, its entries become the old age.

    An entry found in the old age is taken over, so what is in use survives and
    at most ``2 * limit`` entries are held.
    """

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str, hot: int = 1000, limit: int = 200_000) -> DataFrame:
    """``left`` inner-joined with ``right``, which has one row for each ``key``.

    Keys with more than ``hot`` rows on the left, as ``weight`` says, are
    broadcast, so that no task gathers one; if there are more than ``limit`` of
    them, none of them is large beside the rest and all are shuffled.
    """
    large = right.where(F.col(weight) > hot)
    n = large.limit(limit + 1).count()
    if not 0 < n <= limit:
        return left.join(right, key)
    rest = left.join(F.broadcast(large.select(key)), key, "left_anti").join(right.where(F.col(weight) <= hot), key)
    return left.join(F.broadcast(large), key).unionByName(rest)


def crc32_mod(column: str, n: int) -> Column:
    """crc32 of the value written as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def without(docs: DataFrame, dropped: DataFrame, id_col: str, broadcast_ids: int = 4_000_000) -> DataFrame:
    """``docs`` less the rows whose id is in ``dropped``.

    The ids (8 bytes each) are broadcast up to a counted limit, joined beyond it.
    """
    ids = stored(dropped.select(id_col).distinct(), "dropped")
    few = ids.limit(broadcast_ids + 1).count() <= broadcast_ids
    return docs.join(F.broadcast(ids) if few else ids, id_col, "left_anti")
