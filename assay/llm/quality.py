"""Quality classifier: perplexity under a modified Kneser-Ney model of trusted text.

Method: an interpolated modified Kneser-Ney model over character 4-grams is
trained on documents known to be good.

1. A hash of the id splits the trusted documents: one half trains, the other
   half, which the model has not seen, sets the thresholds.
2. Counts, continuation counts, discounts, back-off weights and the
   interpolation of each order with the next lower one are aggregations and
   joins sharded by gram; no table of the model is collected.
3. The distinct grams of all documents are joined with the sharded tables,
   lowest order first, which gives each gram its log probability.
4. These are summed over each whole text. Up to ``broadcast_grams`` distinct
   grams (12 bytes each) the looked-up values are broadcast; beyond it,
   documents are dealt to blocks by a hash of their id and each block gets the
   values of its own grams by a join.
5. A document is rejected when the logarithm of its perplexity, less what
   chance adds to a text of its length, is beyond the quantile of the
   thresholding half in its language.

Only the upper edge is used: a text that the model predicts unusually well is a
copy or a fixed phrase, which is for deduplication to judge.

Grams hold whole code points (digits count as one digit, white space as one
blank), so no script loses characters. Nothing is sampled: all trusted
documents are used and all documents are scored.

Defined results: a null or empty text has no perplexity (null) and is rejected;
a document whose language is null or has too few thresholding documents is held
against the quantile of all languages; without any trusted document all texts
are kept; repeated rows are judged one by one, rows with a null id too; ids may
be of any type; an empty table gives an empty table; other columns are ignored
unless they are asked for with ``carry``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, kind_of, only_ids, stored

ORDER = 4
#: Bytes of a code point in a gram, and the symbol before a text, beyond all code points.
WIDE, START = 3, 0x110000
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Characters that are scored at once, and bytes of text in a block.
CHUNK, BLOCK_BYTES = 1 << 20, 12 << 20
PAD = np.full(ORDER - 1, START, np.uint32).tobytes()


def chunks(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts in lists of about CHUNK characters."""
    part, size = [], 0
    for text in texts:
        part.append(text or "")
        size += len(part[-1])
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points with START before each text, where each character is, the
    64-bit key of the gram that ends there, and the texts' lengths."""
    raws = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    lengths = np.array([len(r) // 4 for r in raws], np.int64)
    points = np.frombuffer(b"".join(x for r in raws for x in (PAD, r)), np.uint32).copy()
    points[(points >= 0x30) & (points <= 0x39)] = 0x30
    points[(points >= 0x09) & (points <= 0x0D)] = 0x20
    ends = np.flatnonzero(points != START)
    keys = points[: len(points) - ORDER + 1].astype(np.uint64)
    for k in range(1, ORDER):
        keys *= FACTOR
        keys += points[k : len(points) - ORDER + 1 + k]
    return points, ends, keys[ends - ORDER + 1].view(np.int64), lengths


def distinct_windows(texts: list[str]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Keys, grams (ORDER code points of WIDE bytes, oldest first) and counts."""
    points, ends, keys, _ = windows(texts)
    coded = pc.dictionary_encode(pa.array(keys))
    at = coded.indices.to_numpy()
    first = np.empty(len(coded.dictionary), np.int64)
    first[at[::-1]] = np.arange(len(at) - 1, -1, -1)
    wide = points[ends[first][:, None] + np.arange(1 - ORDER, 1)].astype(">u4").view(np.uint8)
    raw = np.ascontiguousarray(wide.reshape(len(first), ORDER, 4)[:, :, 4 - WIDE :])
    offsets = np.arange(0, ORDER * WIDE * (len(first) + 1), ORDER * WIDE, dtype=np.int32)
    grams = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    return coded.dictionary.to_numpy(), grams, np.bincount(at, minlength=len(first))


def gram_counts(texts: DataFrame) -> DataFrame:
    """(gram, key, n): occurrences of each gram in (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch.column(0).to_pylist()):
                keys, grams, n = distinct_windows(part)
                yield pa.RecordBatch.from_arrays([grams, pa.array(keys), pa.array(n, pa.int64())], names=["gram", "key", "n"])

    rows = texts.select("text").mapInArrow(run, "gram binary, key long, n long")
    return rows.groupBy("gram").agg(F.first("key").alias("key"), F.sum("n").alias("n"))


def older(gram: Column | str, k: int) -> Column:
    """All but the newest symbol of a gram of k."""
    return F.substring(gram, 1, WIDE * (k - 1))


def newer(gram: Column | str, k: int) -> Column:
    """All but the oldest symbol of a gram of k."""
    return F.substring(gram, WIDE + 1, WIDE * (k - 1))


def discounts(table: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the counts of counts."""
    row = table.agg(*(F.count_if(F.col("n") == k).alias(f"n{k}") for k in range(1, 5))).first()
    n1, n2, n3, n4 = (row[f"n{k}"] for k in range(1, 5))
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.9  # too little text for an estimate
    y = n1 / (n1 + 2 * n2)
    d = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1))


class Model:
    """Sharded tables of each order k: ``grams`` (gram, p) and ``contexts``
    (context, back); ``floor`` is the probability of an unknown character."""

    def __init__(self, grams: dict[int, DataFrame], contexts: dict[int, DataFrame], floor: float):
        self.grams, self.contexts, self.floor = grams, contexts, floor


def train(texts: DataFrame) -> Model:
    """Kneser-Ney model of (text), by joins sharded by gram."""
    orders = {ORDER: stored(gram_counts(texts).select("gram", "n"), "kn-counts")}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct left neighbours
        lower = orders[k + 1].groupBy(newer("gram", k + 1).alias("gram")).agg(F.count("*").alias("n"))
        orders[k] = stored(lower, "kn-counts")
    types = orders[1].count()
    grams: dict[int, DataFrame] = {}
    backs: dict[int, DataFrame] = {}
    floor = 1.0 / (types + 1)
    for k in range(1, ORDER + 1):
        d1, d2, d3 = discounts(orders[k])
        discount = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        rows = orders[k].withColumn("context", older("gram", k))
        sums = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum(discount).alias("freed"))
        sums = stored(sums.select("context", "total", (F.col("freed") / F.col("total")).alias("back")), "kn-contexts")
        rows = rows.join(sums, "context")
        if k == 1:
            rows = rows.withColumn("lower", F.lit(floor))
            floor *= sums.first().back if types else 1.0
        else:
            lower = grams[k - 1].select(F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            rows = rows.withColumn("suffix", newer("gram", k)).join(lower, "suffix")
        p = (F.col("n") - discount) / F.col("total") + F.col("back") * F.col("lower")
        grams[k] = stored(rows.select("gram", p.alias("p")), "kn-order")
        backs[k] = sums.select("context", "back")
    return Model(grams, backs, floor)


def gram_chances(need: DataFrame, model: Model) -> DataFrame:
    """(gram, p): probability of the newest symbol of each distinct gram of ``need``."""
    wanted = {ORDER: need.select("gram")}
    for k in range(ORDER - 1, 0, -1):
        wanted[k] = wanted[k + 1].select(newer("gram", k + 1).alias("gram")).distinct()
    known = wanted[1].join(model.grams[1], "gram", "left").select("gram", F.coalesce("p", F.lit(model.floor)).alias("p"))
    for k in range(2, ORDER + 1):
        known = stored(known, "kn-known") if k == ORDER else known
        rows = wanted[k].join(model.grams[k], "gram", "left").withColumns({"suffix": newer("gram", k), "context": older("gram", k)})
        rows = rows.join(known.select(F.col("gram").alias("suffix"), F.col("p").alias("lower")), "suffix")
        rows = rows.join(model.contexts[k], "context", "left")
        known = rows.select("gram", F.coalesce("p", F.coalesce("back", F.lit(1.0)) * F.col("lower")).alias("p"))
    return known


def surprise(texts: list[str | None], keys: pa.Array, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of negative logs and number of characters of each text."""
    sums, lengths = [], []
    for part in chunks(texts):
        _, _, own, n = windows(part)
        at = pc.index_in(pa.array(own), value_set=keys).to_numpy()
        running = np.concatenate([[0.0], np.cumsum(-logs[at])])
        ends = np.cumsum(n)
        sums.append(running[ends] - running[ends - n])
        lengths.append(n)
    return (np.concatenate(sums), np.concatenate(lengths)) if sums else (np.zeros(0), np.zeros(0, np.int64))


def scored(part: pa.RecordBatch | pa.Table, keys: pa.Array, logs: np.ndarray) -> list[pa.Array]:
    """The columns before the text, the lengths and the perplexities."""
    sums, n = surprise(part.column("text").to_pylist(), keys, logs)
    values = np.exp(sums / np.maximum(n, 1))
    kept = [part.column(c) for c in ("id", "lang", "row")]
    return [*kept, pa.array(n, pa.int64()), pa.array(values, pa.float64(), mask=n == 0)]


def block_grams(dealt: DataFrame) -> DataFrame:
    """(block, key, gram): the distinct grams of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, texts = batch.column("block").to_numpy(), batch.column("text")
            for block in np.unique(blocks):
                for part in chunks(texts.filter(pa.array(blocks == block)).to_pylist()):
                    keys, grams, _ = distinct_windows(part)
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(keys), pa.int64()), pa.array(keys), grams], names=["block", "key", "gram"])

    return dealt.mapInArrow(run, "block long, key long, gram binary").groupBy("block", "key").agg(F.first("gram").alias("gram"))


def perplexities(docs: DataFrame, model: Model, broadcast_grams: int) -> DataFrame:
    """(id, lang, row, chars, perplexity) of each row of (id, lang, row, text)."""
    names = ["id", "lang", "row", "chars", "perplexity"]
    schema = f"id {kind_of(docs, 'id')}, lang string, row {kind_of(docs, 'row')}, chars long, perplexity double"
    need = stored(gram_counts(docs.select("text")), "quality-grams")
    chances = stored(gram_chances(need, model), "quality-chances")
    if need.limit(broadcast_grams + 1).count() <= broadcast_grams:
        got = need.join(chances, "gram").select("key", F.ln("p").alias("log")).toArrow()
        shared = docs.sparkSession.sparkContext.broadcast((got.column("key").to_numpy(), got.column("log").to_numpy()))
        mark = "quality", uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, logs = held(mark, lambda: (pa.array(shared.value[0]), shared.value[1]))
            for batch in batches:
                yield pa.RecordBatch.from_arrays(scored(batch, keys, logs), names=names)

        return docs.select("id", "lang", "row", "text").mapInArrow(run, schema)

    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # By id and text: rows without an id, or that share one, do not gather in one block.
    block = F.pmod(F.xxhash64("id", "text"), F.lit(1 + size // BLOCK_BYTES)).cast("long")
    dealt = docs.select("id", "lang", "row", "text", block.alias("block")).repartition("block")
    values = block_grams(dealt).join(chances, "gram").select(F.col("block").alias("b"), "key", F.ln("p").alias("log"))

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, logs = right.column("key").combine_chunks(), right.column("log").to_numpy()
        return pa.table(scored(left, keys, logs), names=names)

    return dealt.groupBy("block").cogroup(values.groupBy("b")).applyInArrow(look_up, schema)


def classify(
    docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    high: float = 0.995, least: int = 20, slack: float = 2.0, broadcast_grams: int = 2_000_000, carry: list[str] | None = None,
) -> DataFrame:
    """Return (id_col, perplexity, upper, kept), a row for each row.

    ``trusted`` has the ids of good documents. The log perplexity of a text of
    n characters counts less slack / sqrt(n), as the perplexity of a few words
    says little; ``upper`` is the largest perplexity at which a document of its
    length and language is kept, from the quantile ``high`` of those of the
    thresholding half. A language with fewer than ``least`` of them takes the
    quantile of all languages. ``carry`` names columns to return in a struct
    ``row``.
    """
    row = F.struct(*carry) if carry else F.lit(None).cast("string")
    docs = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), row.alias("row"), F.col(text_col).cast("string").alias("text"))
    trusted = stored(trusted.select(F.col(id_col).cast(kind_of(docs, "id")).alias("id")).where("id is not null").distinct(), "trusted")
    half = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    sample = only_ids(docs, trusted.where(half)).where("text != ''")
    scores = stored(perplexities(docs, train(sample), broadcast_grams), "quality-scores")
    reach = F.ln("perplexity") - F.try_divide(F.lit(slack), F.sqrt("chars"))
    good = scores.where("perplexity is not null").join(trusted.where(~half), "id", "left_semi")
    edge = F.percentile_approx(reach, F.lit(high), F.lit(20_000)).alias("edge")
    each = good.where("lang is not null").groupBy("lang").agg(edge, F.count("*").alias("n")).where(F.col("n") >= least).drop("n")
    whole = good.agg(edge).first().edge
    out = scores.join(each, "lang", "left").withColumn("edge", F.coalesce("edge", F.lit(whole).cast("double")))
    spare = F.exp(F.col("edge") + F.try_divide(F.lit(slack), F.sqrt("chars")))
    kept = F.coalesce(reach <= F.col("edge"), F.col("perplexity").isNotNull())
    rest = ["row"] if carry else []
    return out.select(F.col("id").alias(id_col), "perplexity", F.when(F.col("chars") > 0, spare).alias("upper"), kept.alias("kept"), *rest)
