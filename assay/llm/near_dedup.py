"""Near-duplicate components by MinHash bands and odd sketches.

A document's set holds the distinct shingles (of 3 words, unless ``width`` says
otherwise) of its whole text (A-Z lower-cased); fewer words form one shingle,
no words none. Two documents are linked when 100 * |A and B| >= 85 * |A or B|
(or another ``percent``). Method:

1. documents with the same set collapse into a class, so exact copies never
   meet one another again;
2. each class has MinHash samples, folded into an odd sketch: sample i toggles
   bit h(i, value), so the population count of two sketches' XOR estimates how
   many samples differ; bands of six samples give the buckets, as many as the
   threshold needs (30 at 85 %, 46 at 80 %);
3. every member of a bucket is held against the bucket's smallest member
   (a row for each member, never all pairs). The sketches drop what is far too
   different; full sets decide the rest;
4. buckets whose members are not yet in one component are examined once more:
   members outside the smallest member's component meet all others, in blocks,
   on sketches of 2048 samples. First each of them offers its best partner in
   another component to the full sets, which connects most; then all pairs that
   still lie in different components are offered. Pairs that are already
   connected are passed over, which loses no component.

A pair at the threshold is missed by all bands with a probability below 1e-6, and by a sketch (five standard deviations) below 1e-6.

Defined results: a null or empty text has an empty set, size 0, and is linked
with nothing; repeated rows are returned as often as they occur; a row with a
null id is never dropped and drops nothing (its component is that of its exact
copies that have an id, else null); an empty table gives an empty table; ids
may be of any type that compares and are taken as unique, rows that share an id
share a component; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, held, join_hot, kind_of, mix64, only_ids, stored, words_of
from .components import components

#: Samples of a band, and how likely all bands may miss a pair at the threshold.
ROWS, MISS = 6, 1e-6
#: Sketch bits of the first pass; samples and sketch bits of the precise pass.
COARSE_BITS, FINE = 512, (2048, 8192)
#: Members of a block of a mixed bucket.
BLOCK = 512
#: Members of a bucket whose full sets are held against its smallest member in one task.
SALTED = 256
SIGNATURE = "id {}, n long, print binary, bands array<long>, sketch binary"


def bands_for(percent: int) -> int:
    """How many bands find a pair at the threshold but for a chance of MISS."""
    same = (percent / 100) ** ROWS
    bands = 1 if same >= 1 else math.ceil(math.log(MISS) / math.log1p(-same)) if same > 0 else FINE[0]
    if bands * ROWS > FINE[0]:
        raise ValueError(f"a threshold of {percent} % needs more than {FINE[0]} samples")
    return bands


def coarse(percent: int) -> tuple[int, int]:
    """(samples, sketch bits) of the first pass."""
    return bands_for(percent) * ROWS, COARSE_BITS


def shingle_set(raw: bytes | None, width: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    h = held("near dedup", lambda: WordHashes(100_000)).of(words_of(raw))
    if not len(h):
        return h
    size = min(width, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k])
    return np.unique(out)


def min_samples(shingles: np.ndarray, samples: int) -> np.ndarray:
    """MinHash: the least value of each of ``samples`` hash functions."""
    rng = np.random.default_rng(20240229)
    pairs = rng.integers(0, 2**32, (FINE[0], 2), dtype=np.uint32)[:samples]
    flip, factor = pairs[:, :1], pairs[:, 1:] | np.uint32(1)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(samples, 0xFFFFFFFF, np.uint32)
    step = max(64, (1 << 18) // samples)
    for at in range(0, len(x), step):
        np.minimum(least, ((x[None, at : at + step] ^ flip) * factor).min(axis=1), out=least)
    return least


def odd_sketch(least: np.ndarray, bits: int) -> bytes:
    """Parity bitmap of the samples: each (index, value) toggles one bit."""
    slots = mix64(least.astype(np.uint64) + (np.arange(1, len(least) + 1, dtype=np.uint64) << np.uint64(32))) % np.uint64(bits)
    return np.packbits((np.bincount(slots.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def band_keys(least: np.ndarray, bands: int) -> list[int]:
    import xxhash

    raw = least[: bands * ROWS].reshape(bands, ROWS)
    return [xxhash.xxh3_64_intdigest(raw[b].tobytes(), seed=b) - (1 << 63) for b in range(bands)]


def xor_limit(size: tuple[int, int], percent: int, sigmas: float = 5.0) -> int:
    """The largest XOR population count that a linked pair shows."""
    samples, bits = size
    differ = 1 - percent / 100
    worst = samples * differ + sigmas * math.sqrt(samples * differ * (1 - differ))
    mean = bits / 2 * (1 - (1 - 2 / bits) ** (2 * worst))
    return math.ceil(mean + 2 * math.sqrt(mean))


def signatures(docs: DataFrame, size: tuple[int, int], width: int, bands: int) -> DataFrame:
    """Set size, fingerprint, bands and sketch of each row of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch.column(1).cast(pa.binary()).to_pylist():
                shingles = shingle_set(raw, width)
                least = min_samples(shingles, size[0])
                some = len(shingles) > 0
                rows.append((len(shingles), hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), band_keys(least, bands) if some else [], odd_sketch(least, size[1])))
            n, prints, keys, sketches = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary()),
            ], names=["id", "n", "print", "bands", "sketch"])

    return docs.select("id", "text").mapInArrow(run, SIGNATURE.format(kind_of(docs, "id")))


def pair_kind(df: DataFrame) -> str:
    return "a {0}, b {0}".format(kind_of(df, df.columns[0]))


def popcount_pairs(batches: Iterator[pa.RecordBatch], limit: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for k in (2, 3))
        n, m = (batch.column(k).to_numpy() for k in (4, 5))
        near = np.bitwise_count(left ^ right).sum(axis=1) <= limit
        alike = np.minimum(n, m) * 100 >= np.maximum(n, m) * percent
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near & alike))


def star_pairs(classes: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Distinct (member, smallest member) pairs that the sketches let through."""
    pairs = members.where("id != head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct()
    left = classes.select(F.col("id").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na"))
    right = classes.select(F.col("id").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb", "na", "nb")
    limit = xor_limit(coarse(percent), percent)
    return rows.mapInArrow(lambda batches: popcount_pairs(batches, limit, percent), pair_kind(pairs))


def verified(pairs: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs whose full sets reach the threshold.

    The pairs of a b that has many are salted, so its text goes once to each of
    several tasks instead of all its partners to one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for batch in batches:
            keep = []
            b = batch.column(1).to_pylist()
            for k, (ra, rb) in enumerate(zip(batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary()), strict=True)):
                if b[k] != last:  # rows of a b come together
                    last, known = b[k], shingle_set(rb.as_py(), width)
                own = shingle_set(ra.as_py(), width)
                both = len(np.intersect1d(own, known, assume_unique=True))
                keep.append(100 * both >= percent * (len(own) + len(known) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ids = stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "near-ids")
    texts = only_ids(docs, ids)
    salts = pairs.groupBy("b").agg(F.ceil(F.count("*") / SALTED).cast("int").alias("salts"))
    rows = pairs.join(salts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"))
    rows = rows.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    spread = salts.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    spread = spread.select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "tb")
    return rows.join(spread, ["b", "salt"]).select("a", "b", "ta", "tb").mapInArrow(run, pair_kind(pairs))


def compare_blocks(key: tuple, both: pa.Table, limit: int, percent: int, best_only: bool) -> pa.Table:
    """Pairs of a left and a right block of one bucket that may be links.

    ``best_only``: each left member's nearest sketch only. Otherwise a pair that
    shares several bands is returned in the first of them.
    """
    bucket = key[0].as_py()

    def parts(t: pa.Table):
        sketches = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(t.num_rows, -1)
        bands = np.array(t.column("bands").to_pylist(), np.int64).reshape(t.num_rows, -1)
        return *(np.asarray(t.column(c)) for c in ("id", "n", "comp", "outside")), sketches, bands

    ids, n, comp, _, sketches, bands = parts(both.filter(pc.field("side") == 0))
    ids2, n2, comp2, outside2, sketches2, bands2 = parts(both.filter(pc.field("side") == 1))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(ids), 32):
        s = slice(at, at + 32)
        differ = np.bitwise_count(sketches[s, None, :] ^ sketches2[None, :, :]).sum(axis=2, dtype=np.int32)
        small, large = np.minimum(n[s, None], n2[None]), np.maximum(n[s, None], n2[None])
        once = ~outside2[None].astype(bool) | (ids[s, None] < ids2[None])
        may = (differ <= limit) & (small * 100 >= large * percent) & (comp[s, None] != comp2[None])
        if best_only:
            j = np.where(may, differ, np.iinfo(np.int32).max).argmin(axis=1)
            i = np.flatnonzero(may[np.arange(len(j)), j])
            found.append((ids[i + at], ids2[j[i]]))
            continue
        i, j = np.nonzero(may & once)
        first = (bands[i + at] == bands2[j]).argmax(axis=1) if len(i) else i
        own = bands[i + at, first] == bucket
        found.append((ids[i + at][own], ids2[j][own]))
    kind = both.schema.field("id").type
    a, b = (pa.array(np.concatenate([f[k] for f in found]) if found else [], kind) for k in (0, 1))
    return pa.table({"a": a, "b": b})


def mixed_buckets(heads: DataFrame, members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that still span components, with their component.

    ``lefts`` and ``rights`` say into how many blocks the bucket is cut.
    """
    # An id meets its label once, with all its buckets (at most one for each band).
    inside = members.where("size > 2").groupBy("id").agg(F.collect_list("key").alias("keys"))
    inside = inside.join(labels.withColumnRenamed("label", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    inside = inside.select(F.explode("keys").alias("key"), "id", "comp")
    anchors = heads.where("size > 2").join(labels.select(F.col("id").alias("head"), F.col("label").alias("anchor")), "head", "left")
    inside = join_hot(inside, stored(anchors.select("key", "size", F.coalesce("anchor", "head").alias("anchor")), "near-anchors"), "key", "size")
    inside = stored(inside.select("key", "id", "comp", (F.col("comp") != F.col("anchor")).alias("outside")), "near-inside")
    sizes = inside.groupBy("key").agg(F.count_if("outside").alias("u"), F.count("*").alias("size")).where("u > 0")
    blocks = sizes.select("key", "size", F.ceil(F.col("u") / BLOCK).cast("int").alias("lefts"), F.ceil(F.col("size") / BLOCK).cast("int").alias("rights"))
    return stored(join_hot(inside, stored(blocks, "near-blocks"), "key", "size").drop("size"), "near-mixed")


def mixed_pairs(rows: DataFrame, fine: DataFrame, percent: int, best_only: bool) -> DataFrame:
    """Possible links between different components within a bucket."""
    rows = rows.join(fine.select("id", "n", "bands", "sketch"), "id")
    place = lambda count, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    columns = ["id", "n", "comp", "outside", "bands", "sketch"]
    left = rows.where("outside").select("key", place("lefts", 1).alias("l"), each("rights").alias("r"), F.lit(0).alias("side"), *columns)
    right = rows.select("key", each("lefts").alias("l"), place("rights", 2).alias("r"), F.lit(1).alias("side"), *columns)
    limit = xor_limit(FINE, percent)
    groups = left.union(right).groupBy("key", "l", "r")
    return groups.applyInArrow(lambda key, both: compare_blocks(key, both, limit, percent, best_only), pair_kind(rows.select("id"))).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, width: int = 3) -> DataFrame:
    """Return (id_col, n_shingles, component_id, kept), a row for each row."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    every = stored(signatures(docs, coarse(percent), width, bands_for(percent)), "near-signatures")
    reps = stored(every.where("n > 0").groupBy("print").agg(F.min("id").alias("rep")), "near-classes")
    classes = every.where("n > 0").join(reps.select(F.col("rep").alias("id"), "print"), ["id", "print"], "left_semi")
    classes = stored(classes.dropDuplicates(["id"]), "near-representatives")

    members = classes.select(F.explode("bands").alias("key"), "id")
    heads = members.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("size")).where("size > 1")
    heads = stored(heads, "near-heads")
    members = stored(join_hot(members, heads, "key", "size"), "near-members")

    links = stored(verified(stored(star_pairs(classes, members, percent), "near-stars"), docs, percent, width), "near-links")
    labels, fine = components(links), None
    for best_only in (True, False):
        rows = mixed_buckets(heads, members, labels)
        if fine is None:
            fine = stored(signatures(only_ids(docs, rows.select("id").distinct()), FINE, width, bands_for(percent)).dropDuplicates(["id"]), "near-fine")
        more = stored(mixed_pairs(rows, fine, percent, best_only), "near-more")
        if more.isEmpty():
            break
        links = links.union(stored(verified(more, docs, percent, width), "near-links"))
        labels = components(links)

    whole = every.select("id", "n", "print").join(reps, "print", "left")
    whole = whole.join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left")
    component = F.coalesce("label", "rep", "id")
    return whole.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept")
    )
