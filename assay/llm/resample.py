"""Importance resampling towards a target distribution of hashed n-grams.

Method: words of a block of texts become word ids; a suffix array of the id
sequence, ordered to the length of the longest n-gram, puts equal n-grams next
to each other. The lengths of common prefixes of neighbours (LCP) cut it into
runs; each run is one distinct n-gram, is hashed once, and its bucket is
scattered back to all places of the run. The buckets of a document's features
are stored, counted by Spark, and turned into gains, one for each bucket.
A document's score is its mean gain plus a Gumbel number that depends on seed
and id only; the highest scores are drawn, ranked over ranges of scores.

What reaches the driver is one row for each bucket (a parameter).

Defined results: null and empty texts have no features and weight 0; a row with
a null id has the Gumbel number of an empty id and comes last among ties;
repeated rows are judged alike and may all be drawn. An empty table gives an
empty table; with no target text all gains follow from its zero counts. Other
columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions.numbering import numbered

from .common import kind_of, stored

#: Bytes of text in a block; a longer text is cut between words.
BLOCK_BYTES = 1 << 20
#: A-Z become a-z, other ASCII characters that are no digits or letters become blanks.
CLEAN = bytes(b if chr(b).isalnum() or b > 0x7F else 0x20 for b in range(256)).lower()
BLANK = re.compile(b" ")


class WordIds(dict):
    """word -> 1, 2, 3, ... in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self) + 1
        return value


def suffix_order(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``ids`` in the order of what begins there, compared to ``depth`` elements, by doubling."""
    rank, h = ids.astype(np.int64), 1
    while h < depth:
        after = np.zeros_like(rank)
        after[:-h] = rank[h:] + 1
        distinct, rank = np.unique(rank * (int(rank.max(initial=0)) + 2) + after, return_inverse=True)
        h *= 2
        if len(distinct) == len(rank):
            break
    return np.argsort(rank, kind="stable")


def common_prefixes(ids: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """LCP array: how many elements (``depth`` at most) each suffix shares with the one before; 0 ends a text."""
    padded = np.concatenate([ids, np.zeros(depth, ids.dtype)])
    lengths, same = np.zeros(len(order), np.int64), np.ones(max(len(order) - 1, 0), bool)
    for k in range(depth):
        left = padded[order[:-1] + k]
        same &= (left == padded[order[1:] + k]) & (left != 0)
        lengths[1:] += same
    return lengths


def feature_buckets(pieces: list[list[bytes]], before: list[int], n_max: int, buckets: int) -> list[np.ndarray]:
    """Buckets of the n-grams of each piece, shorter n-grams first.

    The first ``before[i]`` words of a piece end the piece before it; n-grams
    that lie within them were counted there.
    """
    known = WordIds()
    ids = np.fromiter((i for words in pieces for i in [*map(known.__getitem__, words), 0]), np.int64)
    names = [b"", *known]
    ends = np.flatnonzero(ids == 0)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    left = np.repeat(ends, ends - starts + 1) - np.arange(len(ids))
    seen = np.repeat(starts + np.array(before, np.int64), ends - starts + 1) - np.arange(len(ids))
    order = suffix_order(ids, n_max)
    prefix = common_prefixes(ids, order, n_max)
    out: list[list[np.ndarray]] = [[] for _ in pieces]
    for n in range(1, n_max + 1):
        begins = np.flatnonzero(prefix < n)
        at = order[begins]
        whole = left[at] >= n
        runs = np.zeros(len(begins), np.int64)
        grams = zip(*(ids[at[whole] + k].tolist() for k in range(n)), strict=True)
        runs[whole] = [zlib.crc32(b" ".join([names[i] for i in gram])) % buckets for gram in grams]
        spread = np.empty(len(ids), np.int64)
        spread[order] = np.repeat(runs, np.diff(begins, append=len(order)))
        valid = (left >= n) & (seen < n)
        for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            out[i].append(spread[a:b][valid[a:b]])
    return [np.concatenate(parts) for parts in out]


def cut_text(text: str | None) -> Iterator[list[bytes]]:
    """Words of a text, in pieces of about BLOCK_BYTES."""
    raw = (text or "").encode().translate(CLEAN)
    at = 0
    while at < len(raw) or at == 0:
        stop = BLANK.search(raw, at + BLOCK_BYTES) if len(raw) - at > BLOCK_BYTES else None
        end = stop.end() if stop else len(raw)
        yield raw[at:end].split()
        at = max(end, 1)


def features(docs: DataFrame, n_max: int = 1, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, buckets) of every document, stored; buckets of 2 bytes each, or 4."""
    kind, width = kind_of(docs, id_col), "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            n_words, found = [0] * batch.num_rows, [[] for _ in range(batch.num_rows)]
            owner, pieces, before, filled = [], [], [], 0

            def flush() -> None:
                for row, part in zip(owner, feature_buckets(pieces, before, n_max, buckets), strict=True):
                    found[row].append(part.astype(width).tobytes())
                for kept in (owner, pieces, before):
                    kept.clear()

            for row in range(batch.num_rows):
                tail: list[bytes] = []
                for words in cut_text(column[row].as_py()):
                    owner.append(row)
                    pieces.append(tail + words)
                    before.append(len(tail))
                    n_words[row] += len(words)
                    tail = pieces[-1][max(0, len(pieces[-1]) - n_max + 1) :]
                    filled += len(words) * 6
                    if filled > BLOCK_BYTES:
                        flush()
                        filled = 0
            flush()
            joined = [b"".join(parts) for parts in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array([len(x) // int(width[2]) for x in joined], pa.int64()), pa.array(joined, pa.binary())], names=["id", "n_words", "n_features", "buckets"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return stored(chosen.mapInArrow(run, f"id {kind}, n_words long, n_features long, buckets binary"), "features")


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all documents fall into each bucket; a task sends one row for each bucket at most."""
    width = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                counts += np.bincount(np.frombuffer(raw, width), minlength=buckets)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["bucket", "n"])

    counts = np.zeros(buckets, np.int64)
    table = found.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return counts


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log of the smoothed target share over the smoothed source share) of each bucket."""
    n, total, goal = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(total + n) / (float(s + 1) * float(goal + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(found: DataFrame, gains: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight): the floored mean gain of each document's features."""
    shared = found.sparkSession.sparkContext.broadcast(gains)
    width = "<u2" if len(gains) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = (np.frombuffer(raw, width) for raw in batch.column("buckets").to_pylist())
            weights = [int(shared.value[x].sum()) // len(x) if len(x) else 0 for x in ids]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "n_words", "n_features")), pa.array(weights, pa.int64())], names=["id", "n_words", "n_features", "weight"])

    return found.mapInArrow(run, f"id {kind_of(found, 'id')}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, n_max: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank) of every document; rank is null where it is not drawn.

    ``percent`` of the documents with ``least_words`` words are drawn, the
    highest scores first, ties to the smaller id.
    """
    found = features(docs, n_max, buckets, id_col, text_col)
    wanted = features(target.select(F.lit(0).alias("id"), F.col(text_col).alias("text")), n_max, buckets, "id", "text")
    gains = bucket_gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets))
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0))).cast("long")
    scored = stored(weigh(found, gains).withColumn("score", F.col("weight") + gumbel).withColumn("row", F.monotonically_increasing_id()), "scores")
    fits = F.col("n_words") >= least_words
    n = scored.where(fits).count() * percent // 100
    order = [F.when(fits, F.col("score")).desc_nulls_last(), F.col("id").asc_nulls_last(), F.col("row").asc()]
    ranked = numbered(scored, *order, name="place")
    rank = F.when(fits & (F.col("place") <= n), F.col("place")).cast("long")
    return ranked.select(F.col("id").alias(id_col), "n_features", "weight", "score", rank.alias("rank"))
