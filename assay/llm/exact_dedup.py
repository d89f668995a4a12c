"""Exact deduplication by a log-structured merge index of text digests.

Two texts are equal when they are identical after deleting white space
(space and U+0009 to U+000D). Method:

1. each task puts (digest -> smallest identifier, count) in a memtable; a full
   memtable is flushed as a run sorted by digest, with a Bloom filter;
2. compaction merges the runs by digest and keeps the smallest identifier;
   an identifier is (-code points of the original text, id), so the longest
   original wins and ties go to the smallest id;
3. the filters of the compacted runs pick the rows whose digest may be
   repeated; these hits are compared byte for byte with the row that stays.
   Rows that share a digest but not the bytes form groups of their own.

A memtable holds one entry for each digest, so a text that makes up a third of
all rows reaches compaction as one entry for each memtable. Rows learn of their
group from a broadcast list: of all repeated digests if they are few, else of
those with many rows, the others being joined. Texts are compared where they
are, with broadcast texts if those that stay are few and short, else dealt to
salted tasks; so no digest gathers in one task.

Defined results: a null text counts as empty, and all empty texts are equal;
repeated rows (same id and text) are counted one by one and marked alike; a row
with a null id stays only where all its copies have none, and then all do; ids
may be of any type that compares; an empty table gives an empty table; other
columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SPACES, kind_of, stored

DELETED = SPACES.encode()
#: Bits of a filter for each digest, and the hash functions that set them.
FILTER_BITS, FILTER_HASHES = 12, 6
#: Filters are broadcast up to this many bytes; beyond, all rows are joined.
FILTER_LIMIT = 64 << 20
#: Repeated digests (about 50 bytes each) that are broadcast; rows of a digest that is broadcast in any case.
BROADCAST_GROUPS, HOT_ROWS = 500_000, 100_000
#: Bytes of texts that are broadcast, and rows of a digest that are compared in one task beyond it.
BROADCAST_TEXTS, SALTED = 16 << 20, 1000
RUN = "run string, digest binary, neg_points long, id {}, n long, filter binary"


#: What the smallest identifier is the smallest of; a null id comes last.
IDENTIFIER = "struct(neg_points, id is null as no_id, id)"


def squeeze(raw: bytes | None) -> bytes:
    return (raw or b"").translate(None, DELETED)


def filter_slots(digests: np.ndarray, bits: int) -> np.ndarray:
    """Slots of each digest (rows of 32 bytes) in a filter, by double hashing."""
    words = digests.view("<u8")
    first, step = words[:, 1], words[:, 2] | np.uint64(1)
    k = np.arange(FILTER_HASHES, dtype=np.uint64)
    return (first[:, None] + k * step[:, None]) % np.uint64(bits)


def as_rows(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)


def make_filter(digests: list[bytes]) -> bytes:
    bits = 8 * max(8, math.ceil(len(digests) * FILTER_BITS / 8))
    table = np.zeros(bits, np.uint8)
    table[filter_slots(as_rows(digests), bits).ravel().astype(np.int64)] = 1
    return np.packbits(table, bitorder="little").tobytes()


def in_filter(digests: np.ndarray, packed: bytes) -> np.ndarray:
    bits = np.frombuffer(packed, np.uint8)
    slots = filter_slots(digests, 8 * len(bits)).astype(np.int64)
    return ((bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1).all(axis=1)


def digest_log(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, neg_points) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column(1).cast(pa.binary()).to_pylist()
            digests = [hashlib.sha256(squeeze(x)).digest() for x in raws]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), batch.column(2)], names=["id", "digest", "neg_points"])

    points = -F.coalesce(F.char_length(text_col), F.lit(0)).cast("long")
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), points.alias("neg_points"))
    return chosen.mapInArrow(run, f"id {kind_of(chosen, 'id')}, digest binary, neg_points long")


def flush_runs(log: DataFrame, memtable_rows: int) -> DataFrame:
    """Sorted runs of at most ``memtable_rows`` digests, each with its filter row."""
    order = lambda points, id_: (points, id_ is None, id_)
    kind = to_arrow_schema(log.select("id").schema).field("id").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        def flush(memtable: dict) -> pa.RecordBatch:
            name, digests = uuid.uuid4().hex, sorted(memtable)
            best = [memtable[d] for d in digests]
            filters = [None] * len(digests) + [make_filter(digests)]
            return pa.RecordBatch.from_arrays([
                pa.array([name] * len(filters)),
                pa.array([*digests, None], pa.binary()),
                pa.array([*(b[0] for b in best), None], pa.int64()),
                pa.array([*(b[1] for b in best), None], kind),
                pa.array([*(b[2] for b in best), None], pa.int64()),
                pa.array(filters, pa.binary()),
            ], names=["run", "digest", "neg_points", "id", "n", "filter"])

        memtable: dict[bytes, tuple] = {}
        for batch in batches:
            for id_, digest, points in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen = memtable.get(digest)
                if seen is None:
                    if len(memtable) >= memtable_rows:
                        yield flush(memtable)
                        memtable = {}
                    memtable[digest] = points, id_, 1
                else:
                    memtable[digest] = *min(seen[:2], (points, id_), key=lambda x: order(*x)), seen[2] + 1
        if memtable:
            yield flush(memtable)

    return log.mapInArrow(run, RUN.format(kind_of(log, "id")))


def compact(runs: DataFrame) -> DataFrame:
    """Merge runs: the smallest identifier and the number of rows of each digest."""
    best = F.min(F.expr(IDENTIFIER))
    merged = runs.where(F.col("digest").isNotNull()).groupBy("digest").agg(best.alias("best"), F.sum("n").alias("n"))
    return merged.select("digest", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"))


def shard_filters(index: DataFrame) -> dict[int, bytes] | None:
    """Filters of the repeated digests by first byte; None if they exceed FILTER_LIMIT."""
    repeated = index.where("group_size > 1")
    if repeated.count() * FILTER_BITS // 8 > FILTER_LIMIT:
        return None

    def build(group: pa.Table) -> pa.Table:
        digests = group.column("digest").to_pylist()
        return pa.table({"shard": pa.array([digests[0][0]], pa.int32()), "filter": pa.array([make_filter(digests)], pa.binary())})

    rows = repeated.select("digest").groupBy(F.substring("digest", 1, 1)).applyInArrow(build, "shard int, filter binary")
    return {r.shard: bytes(r.filter) for r in rows.collect()}


def suspects(docs: DataFrame, id_col: str, text_col: str, filters: dict[int, bytes] | None) -> DataFrame:
    """(id, digest, squeezed bytes) of rows whose digest may be repeated."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = shared.value
        for batch in batches:
            raws = [squeeze(x) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            digests = [hashlib.sha256(x).digest() for x in raws]
            keep = np.ones(len(raws), bool)
            if shards is not None and raws:
                rows = as_rows(digests)
                keep[:] = False
                for shard in np.unique(rows[:, 0]):
                    if (packed := shards.get(int(shard))) is not None:
                        own = np.flatnonzero(rows[:, 0] == shard)
                        keep[own] = in_filter(rows[own], packed)
            at = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(at)),
                pa.array([digests[i] for i in at], pa.binary()),
                pa.array([raws[i] for i in at], pa.binary()),
            ], names=["id", "digest", "bytes"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, f"id {kind_of(chosen, 'id')}, digest binary, bytes binary")


def with_groups(rows: DataFrame, index: DataFrame) -> DataFrame:
    """``rows`` with keep_id and group_size of their digest, null where it is not repeated."""
    groups = index.where("group_size > 1")
    if groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), "digest", "left")
    first = rows.join(F.broadcast(groups.where(F.col("group_size") > HOT_ROWS)), "digest", "left")
    rest = first.where("group_size is null").select(*rows.columns).join(groups.where(F.col("group_size") <= HOT_ROWS), "digest", "left")
    return first.where("group_size is not null").unionByName(rest)


def mismatches(docs: DataFrame, index: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Hits whose bytes differ from those of the row that stays (id, digest, bytes)."""
    maybe = suspects(docs, id_col, text_col, shard_filters(index))
    hits = stored(with_groups(maybe, index).where("group_size is not null"), "dedup-hits")
    stays = hits.where("id <=> keep_id").groupBy("digest", "group_size").agg(F.min("bytes").alias("kept_bytes"))
    stays = stored(stays, "dedup-stays")
    size = stays.agg(F.coalesce(F.sum(F.octet_length("kept_bytes") + 64), F.lit(0))).first()[0]
    if size <= BROADCAST_TEXTS:
        both = hits.join(F.broadcast(stays.drop("group_size")), "digest")
    else:
        salts = F.ceil(F.col("group_size") / SALTED).cast("int")
        spread = stays.select("digest", "kept_bytes", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        both = hits.withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int")).join(spread, ["digest", "salt"])
    return both.where("bytes != kept_bytes").select("id", "digest", "bytes")


def corrected(log: DataFrame, odd: DataFrame) -> DataFrame:
    """Groups of rows that share a digest with other bytes, one row for each id."""
    best = F.min(F.expr(IDENTIFIER))
    rows = odd.join(log.dropDuplicates(["id", "digest"]), ["id", "digest"])
    groups = rows.groupBy("digest", "bytes").agg(best.alias("best"), F.count("*").alias("own_size"))
    own = rows.join(groups, ["digest", "bytes"])
    return own.select("id", "digest", F.col("best.id").alias("own_keep"), "own_size").distinct()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memtable_rows: int = 200_000) -> DataFrame:
    """Return (id_col, keep_id, group_size, kept, text_sha256), a row for each row."""
    log = stored(digest_log(docs, id_col, text_col), "dedup-log")
    index = stored(compact(stored(flush_runs(log, memtable_rows), "dedup-runs")), "dedup-index")
    odd = stored(mismatches(docs, index, id_col, text_col), "dedup-odd")
    out = with_groups(log, index)
    if not odd.isEmpty():
        fixes = corrected(log, odd)
        gone = odd.groupBy("digest").agg(F.count("*").alias("gone"))
        out = out.join(fixes, ["id", "digest"], "left").join(gone, "digest", "left")
        size = F.coalesce("own_size", F.col("group_size") - F.coalesce("gone", F.lit(0)))
        out = out.withColumns({"keep_id": F.coalesce("own_keep", "keep_id"), "group_size": size})
    keep = F.coalesce("keep_id", "id")
    return out.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(keep == F.col("id"), keep.isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
