"""Language-model scoring: a hashed maximum-entropy model over whole texts.

A token's probability is factored over classes: P(class | history) times
P(token | class). The most frequent training tokens are classes of their own;
all others fall into hash classes, within which they follow their smoothed
counts. Classes lie in groups of alike frequency, and P(class | history) is
P(group | history) times P(class | group, history). Both are softmaxes over
hashed features of the two tokens before: the bigram, the skip and the trigram
feature, and a bias.

1. Documents are tokenised once, where they lie: a piece's row holds some
   texts' vocabulary (64-bit hashes) and the texts as indices into it. A few
   pieces that follow one another are a block.
2. Counts of all training tokens are summed by hash over the blocks.
3. Weights are trained by rounds of distributed gradient updates: each task
   runs minibatches over its share of all training texts, and the weights of
   all tasks are averaged, weighted by tokens.
4. Each block gets the counts of its own words by a join (those of the
   ``FREQUENT`` most frequent words are broadcast, so no word that occurs in
   every block gathers in one task) and is scored in numpy batches.

Size: counts grow with the corpus and are never collected. Hash slots of each
feature kind grow with the square root of the training tokens, between
SLOTS_FROM and SLOTS_TO (28 MB of weights), beyond which contexts share slots.
A task trains on at least twice as many tokens as there are weights, so what
the rounds send grows with the corpus and not with its square.

Words are told apart by their 64-bit hash. Defined results: a null or empty text
consists of the end token; without any training token every count is 0 and the
model is uniform over classes; repeated rows are scored one by one, rows with a
null id too (they are learned from); ids may be of any type; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import crc32_mod, kind_of, mix64, small_batches, stored

#: No word contains white space, so these stand for no word.
END, BEGIN = b"\n", b"\t"
OWN, HASHED = 64, 64
CLASSES = OWN + HASHED
#: Classes of a group; group and class weights stand side by side in a row.
WITHIN = 8
GROUPS = CLASSES // WITHIN
WIDTH = GROUPS + CLASSES
#: Hash slots of each of the three feature kinds; the bias is a last row.
SLOTS_FROM, SLOTS_TO = 1 << 10, 1 << 14
ROUNDS, MINIBATCH, RATE = 3, 16384, 0.05
ALPHA = 0.1
#: Bytes of text of a piece, and pieces of a block, whose words are looked up together.
PIECE_BYTES, PIECES = 1 << 20, 4
#: Factor of the hash of a word's bytes.
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Words that a task holds before it passes them on.
HELD_WORDS = 1 << 20
#: Rows of the weight matrix that are summed in one task.
SHARD = 128
#: Words whose counts are broadcast (16 bytes each).
FREQUENT = 1 << 16
TOKENS = "block long, ids array<{}>, away array<boolean>, lengths binary, vocabulary binary, tokens binary"


def hashes_of(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words: a polynomial of the bytes, then mixed."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    if not len(words) or offsets[-1] == offsets[0]:
        return np.zeros(len(words), np.uint64)
    lengths = np.diff(offsets)
    raw = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1)
    powers = np.full(int(lengths.max()), FACTOR)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    raw *= powers[np.arange(len(raw)) - np.repeat(offsets[:-1] - offsets[0], lengths)]
    sums = np.add.reduceat(raw, np.minimum(offsets[:-1] - offsets[0], len(raw) - 1))
    return mix64(np.where(lengths > 0, sums, np.uint64(0)) + lengths.astype(np.uint64))


def hash_of(word: bytes) -> int:
    return int(hashes_of(pa.array([word], pa.binary()))[0])


def slots_for(tokens: int) -> int:
    """A power of two near half the square root of the training tokens."""
    return int(np.clip(1 << max(0, int(np.log2(max(1.0, tokens**0.5 / 2)))), SLOTS_FROM, SLOTS_TO))


def token_kind(words: int) -> type:
    """The type of a place in a vocabulary of this size."""
    return np.uint16 if words <= 1 << 16 else np.uint32


class Piece:
    """Some texts: each text's length, and all tokens as places in a vocabulary of hashes."""

    def __init__(self, lengths: np.ndarray, vocabulary: np.ndarray, tokens: np.ndarray):
        self.lengths, self.vocabulary, self.tokens = lengths, vocabulary, tokens

    @classmethod
    def of(cls, texts: pa.Array) -> Piece:
        """Tokens of texts: words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then END."""
        words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        flat, full = words.flatten(), pc.list_value_length(words).to_numpy(zero_copy_only=False)
        real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
        text = np.repeat(np.arange(len(full)), full)[real]
        coded = flat.filter(pa.array(real)).dictionary_encode()
        known = coded.dictionary
        vocabulary = np.append(hashes_of(known), np.uint64(hash_of(END)))
        lengths = np.bincount(text, minlength=len(full))
        tokens = np.full(len(text) + len(full), len(known), token_kind(len(vocabulary)))  # END where no word is put
        tokens[np.arange(len(text)) + text] = coded.indices.to_numpy(zero_copy_only=False)
        return cls(lengths + 1, vocabulary, tokens)

    @classmethod
    def load(cls, batch: pa.RecordBatch | pa.Table, k: int) -> Piece:
        raw = [batch.column(c)[k].as_py() for c in ("lengths", "vocabulary", "tokens")]
        vocabulary = np.frombuffer(raw[1], np.uint64)
        return cls(np.frombuffer(raw[0], np.int64), vocabulary, np.frombuffer(raw[2], token_kind(len(vocabulary))))

    def of_texts(self, chosen: np.ndarray) -> Piece:
        return Piece(self.lengths[chosen], self.vocabulary, self.tokens[np.repeat(chosen, self.lengths)])

    def minibatches(self, classes: Classes, slots: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(tokens, feature rows, class labels) of MINIBATCH tokens at a time."""
        labels, none = classes.of(self.vocabulary), np.uint64(hash_of(BEGIN))
        place = np.arange(len(self.tokens)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        for low in range(0, len(self.tokens), MINIBATCH):
            here = slice(low, low + MINIBATCH)
            own = self.vocabulary[self.tokens[max(0, low - 2) : low + MINIBATCH]]
            own = np.concatenate([np.full(max(0, 2 - low), none), own])  # two tokens of history first
            one, two = own[1:-1].copy(), own[:-2].copy()
            one[place[here] < 1], two[place[here] < 2] = none, none
            yield here, feature_rows(one, two, slots), labels[self.tokens[here]]


class Classes:
    """Token hash -> class."""

    def __init__(self, own: np.ndarray):
        self.order = np.argsort(own)
        self.hashes = own[self.order]

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = OWN + (hashes & np.uint64(HASHED - 1)).astype(np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes
            out[hit] = self.order[at[hit]]
        return out


def feature_rows(one: np.ndarray, two: np.ndarray, slots: int) -> np.ndarray:
    """Weight rows (n x 3) of histories: the token before and the one before that."""
    size = np.uint64(slots)
    both = mix64(one * np.uint64(0x9E3779B97F4A7C15) + two)
    return np.stack([mix64(one) % size, mix64(two) % size + size, both % size + np.uint64(2) * size], 1).astype(np.int64)


def softmax(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        e = np.exp(z)
        sums = e @ np.ones(e.shape[1], e.dtype)
    if not np.isfinite(sums).all() or not sums.all():  # very large or small
        e = np.exp(z - z.max(axis=1, keepdims=True))
        sums = e.sum(axis=1)
    e /= sums[:, None]
    return e


class Weights:
    """Views of a (3 * slots + 1 x WIDTH) matrix: group weights, class weights by (row, group)."""

    def __init__(self, matrix: np.ndarray):
        self.slots = len(matrix) // 3
        self.groups = np.ascontiguousarray(matrix[:, :GROUPS])
        self.classes = np.ascontiguousarray(matrix[:, GROUPS:]).reshape(-1, WITHIN)

    def matrix(self) -> np.ndarray:
        return np.hstack([self.groups, self.classes.reshape(-1, CLASSES)])

    def chances(self, rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Softmax over the groups, and over the classes of each token's ``group``."""
        out = []
        for table, at, bias in ((self.groups, rows, self.groups[-1]), (self.classes, rows * GROUPS + group[:, None], self.classes[-GROUPS:][group])):
            z = table[at[:, 0]]
            z += table[at[:, 1]]
            z += table[at[:, 2]]
            z += bias
            out.append(softmax(z))
        return out[0], out[1]

    def chance(self, rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Probability of each label's class."""
        group, within = np.divmod(labels, WITHIN)
        top, inner = self.chances(rows, group)
        at = np.arange(len(labels))
        return top[at, group] * inner[at, within]


def summed(values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``keys`` (sorted) and the sums of their rows."""
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(values, first, axis=0)


class Trainer:
    """Minibatch gradient steps, scaled by each row's summed squared gradients."""

    def __init__(self, matrix: np.ndarray):
        self.weights = Weights(matrix)
        self.squares = [np.full(len(t), 1e-8, np.float32) for t in (self.weights.groups, self.weights.classes)]
        self.tokens = 0

    def step(self, rows: np.ndarray, labels: np.ndarray) -> None:
        """Tokens are sorted by group, then stably by slot: short keys sort by radix,
        and one order serves the group rows and the class rows of a feature kind."""
        group, within = np.divmod(labels, WITHIN)
        top, inner = self.weights.chances(rows, group)
        at = np.arange(len(labels))
        top[at, group] -= 1
        inner[at, within] -= 1
        order = np.argsort(group.astype(np.uint8), kind="stable")
        slots = self.weights.slots
        self.move(0, np.array([3 * slots]), top.sum(axis=0, keepdims=True))
        keys, sums = summed(inner[order], group[order])
        self.move(1, 3 * slots * GROUPS + keys, sums)
        for k in range(3):
            own = order[np.argsort((rows[order, k] - k * slots).astype(np.uint16), kind="stable")]
            row = rows[own, k]
            self.move(0, *summed(top[own], row))
            self.move(1, *summed(inner[own], row * GROUPS + group[own]))
        self.tokens += len(labels)

    def move(self, k: int, at: np.ndarray, sums: np.ndarray) -> None:
        squares, table = self.squares[k], (self.weights.groups, self.weights.classes)[k]
        width = sums.shape[1]
        new = squares[at] + (sums * sums) @ np.full(width, 1 / width, np.float32)
        squares[at] = new
        sums *= (-np.float32(RATE) / np.sqrt(new))[:, None]
        table[at] += sums


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about PIECE_BYTES of text, or one longer text."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    number = np.cumsum(sizes) // PIECE_BYTES
    first = np.flatnonzero(np.diff(number, prepend=-1))
    for low, high in zip(first, [*first[1:], len(sizes)], strict=True):
        yield batch.slice(low, high - low)


def tokenised(docs: DataFrame) -> DataFrame:
    """A row of TOKENS for each piece of (id, text, held_out).

    A block's number tells the task that made it and its place there. The rows
    must be written before they are used: another run may cut them otherwise.
    """
    kind = to_arrow_schema(docs.select("id").schema).field("id").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part in pieces(batch):
                piece = Piece.of(part.column("text"))
                values = [base + made // PIECES], [part.column("id").to_pylist()], [part.column("held_out").to_pylist()], [piece.lengths.astype(np.int64).tobytes()], [piece.vocabulary.tobytes()], [piece.tokens.tobytes()]
                kinds = pa.int64(), pa.list_(kind), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(values, kinds, strict=True)], names=["block", "ids", "away", "lengths", "vocabulary", "tokens"])
                made += 1

    return docs.mapInArrow(run, TOKENS.format(kind_of(docs, "id")))


def away_of(batch: pa.RecordBatch | pa.Table, k: int) -> np.ndarray:
    return np.array(batch.column("away")[k].as_py(), bool)


def merged(hashes: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and the sums of ``n``."""
    known, at = np.unique(np.concatenate(hashes), return_inverse=True)
    return known.view(np.int64), np.bincount(at, np.concatenate(n)).astype(np.int64)


def token_counts(blocks: DataFrame) -> DataFrame:
    """(hash, n) of all training tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = [], []
        for batch in batches:
            for k in range(batch.num_rows):
                piece = Piece.load(batch, k).of_texts(~away_of(batch, k))
                n = np.bincount(piece.tokens, minlength=len(piece.vocabulary))
                hashes.append(piece.vocabulary[n > 0])
                counts.append(n[n > 0])
            if sum(map(len, hashes)) > HELD_WORDS:
                yield pa.RecordBatch.from_arrays([*map(pa.array, merged(hashes, counts))], names=["hash", "n"])
                hashes, counts = [], []
        if hashes:
            yield pa.RecordBatch.from_arrays([*map(pa.array, merged(hashes, counts))], names=["hash", "n"])

    return blocks.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def averaged(updates: DataFrame, tasks: int) -> DataFrame:
    """(shard, part, tokens): means of the tasks' weights by tokens, in two levels of about
    sqrt(tasks) rows. Weights travel in half precision, far finer than what rounds differ by."""

    def add(group: pa.Table) -> pa.Table:
        tokens = group.column("tokens").to_pylist()
        values = [np.frombuffer(raw, np.float16).astype(np.float64) * n for raw, n in zip(group.column("part").to_pylist(), tokens, strict=True)]
        part = (sum(values) / sum(tokens)).astype(np.float16).tobytes()
        return pa.table({"shard": group.column("shard").slice(0, 1), "bunch": pa.array([0], pa.int32()), "part": pa.array([part], pa.binary()), "tokens": pa.array([sum(tokens)], pa.int64())})

    schema = "shard int, bunch int, part binary, tokens long"
    if tasks > 64:
        updates = updates.groupBy("shard", "bunch").applyInArrow(add, schema)
    return updates.groupBy("shard").applyInArrow(add, schema)


def train(blocks: DataFrame, own: np.ndarray, tokens: int) -> np.ndarray:
    """Weights after ROUNDS rounds over disjoint shares of all training texts."""
    context = blocks.sparkSession.sparkContext
    slots = slots_for(tokens)
    rows = 3 * slots + 1
    weights = np.zeros((rows, WIDTH), np.float32)
    tasks = max(1, min(blocks.rdd.getNumPartitions(), tokens // ROUNDS // (2 * weights.size)))
    bunches = max(1, round(tasks**0.5))
    shares = blocks.coalesce(tasks)
    for round_ in range(ROUNDS):
        start = context.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch], start=start, round_=round_) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            classes, trainer = Classes(own), Trainer(start.value)
            for batch in batches:
                for k in range(batch.num_rows):
                    learn = ~away_of(batch, k)
                    learn &= np.arange(len(learn)) % ROUNDS == round_
                    for _, features, labels in Piece.load(batch, k).of_texts(learn).minibatches(classes, slots):
                        trainer.step(features, labels)
            if trainer.tokens:
                held = trainer.weights.matrix().astype(np.float16)
                parts = [held[low : low + SHARD].tobytes() for low in range(0, rows, SHARD)]
                bunch, n = TaskContext.get().partitionId() % bunches, len(parts)
                yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([bunch] * n, pa.int32()), pa.array(parts, pa.binary()), pa.array([trainer.tokens] * n, pa.int64())], names=["shard", "bunch", "part", "tokens"])

        updates = shares.mapInArrow(run, "shard int, bunch int, part binary, tokens long")
        weights = weights.copy()
        with small_batches(blocks.sparkSession):
            rows_of_shards = averaged(updates, tasks).collect()
        for row in rows_of_shards:
            part = np.frombuffer(row.part, np.float16).reshape(-1, WIDTH)
            weights[row.shard * SHARD : row.shard * SHARD + len(part)] = part
        start.unpersist()
    return weights


def own_counts(parts: list[tuple[Piece, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the words of a block's pieces, how often they occur in
    its training texts, and whether they do in a held-out one; (piece, away)."""
    hashes, inside, outside = [], [], []
    for piece, away in parts:
        size = len(piece.vocabulary)
        hashes.append(piece.vocabulary)
        inside.append(np.bincount(piece.of_texts(~away).tokens, minlength=size))
        outside.append(np.bincount(piece.of_texts(away).tokens, minlength=size))
    known, at = np.unique(np.concatenate(hashes), return_inverse=True)
    sums = (np.bincount(at, np.concatenate(x), len(known)) for x in (inside, outside))
    return known, next(sums).astype(np.int64), next(sums) > 0


def rare_words(blocks: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(block, hash, own): each block's words that are not ``frequent``.

    own: how often its training texts have the word; -1 if a held-out text has
    it. A word may come more than once if several tasks read a block's pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if parts:
                words, own, away = own_counts(parts)
                rare = counts_of(words, *frequent) == 0
                own = np.where(away, -1, own)[rare]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block)), pa.array(words[rare].view(np.int64)), pa.array(own)], names=["block", "hash", "own"])
            parts.clear()

        for batch in batches:
            for k in range(batch.num_rows):
                if block != batch.column("block")[k].as_py():
                    yield from flush()
                    block = batch.column("block")[k].as_py()
                parts.append((Piece.load(batch, k), away_of(batch, k)))
        yield from flush()

    return blocks.mapInArrow(run, "block long, hash long, own long")


def in_order(hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes)
    return hashes[order], n[order]


def counts_of(vocabulary: np.ndarray, hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Count of each word, 0 where the sorted ``hashes`` lack it."""
    if not len(hashes):
        return np.zeros(len(vocabulary))
    at = np.minimum(np.searchsorted(hashes, vocabulary), len(hashes) - 1)
    return np.where(hashes[at] == vocabulary, n[at], 0).astype(np.float64)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held: int = 0) -> DataFrame:
    """Return (id_col, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Documents whose crc32(id as text) mod ``folds`` is ``held`` are not learned
    from. Scores are log10 probabilities of the whole text.
    """
    context = docs.sparkSession.sparkContext
    away = F.coalesce(crc32_mod(id_col, folds) == held, F.lit(False))
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), away.alias("held_out"))
    blocks = stored(tokenised(docs), "lm-tokens")
    counts = stored(token_counts(blocks), "lm-counts")
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = counts.orderBy(F.desc("n"), "hash").limit(FREQUENT).toArrow()
    words, n = top.column("hash").to_numpy(), top.column("n").to_numpy()
    own = words[np.lexsort((words, -n))][:OWN].view(np.uint64)
    frequent = in_order(words.view(np.uint64), n)
    inner = np.zeros((CLASSES, 2))
    others = counts.where(~F.col("hash").isin(own.view(np.int64).tolist())) if len(own) else counts
    for r in others.groupBy(F.col("hash").bitwiseAND(F.lit(HASHED - 1)).alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        inner[OWN + r.c] = r.n, r.v
    shared = context.broadcast((train(blocks, own, totals.n), own, inner, totals.n, totals.v, frequent))
    names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = f"id {kind_of(docs, 'id')}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        matrix, own, inner, total, types, frequent = shared.value
        model, classes, parts = Weights(matrix), Classes(own), []
        rare = in_order(right.column("hash").to_numpy().view(np.uint64), right.column("n").to_numpy())
        loaded = [(Piece.load(left, k), away_of(left, k)) for k in range(left.num_rows)]
        words, own_n, _ = own_counts(loaded)
        for k, (piece, away) in enumerate(loaded):
            counts = counts_of(piece.vocabulary, *frequent) + counts_of(piece.vocabulary, *rare)
            # A count that is not sent is that of the block's own training texts.
            counts = np.where(counts > 0, counts, counts_of(piece.vocabulary, words, own_n))
            c = counts[piece.tokens]
            labels = classes.of(piece.vocabulary)[piece.tokens]
            logs = np.log10((c + ALPHA) / (inner[labels, 0] + ALPHA * (inner[labels, 1] + 1)))
            logs[labels < OWN] = 0
            for here, features, own_labels in piece.minibatches(classes, model.slots):
                logs[here] += np.log10(np.maximum(model.chance(features, own_labels), 1e-30))
            base = np.log10((c + ALPHA) / (total + ALPHA * (types + 1)))
            first = np.cumsum(piece.lengths) - piece.lengths
            sums = (np.add.reduceat(x, first) if len(first) else x for x in ((c > 0).astype(np.int64), base, logs))
            known, base, logs = sums
            n = len(first)
            parts.append(pa.table([left.column("ids")[k].values, pa.array(away), pa.array(piece.lengths), pa.array(known), pa.array(np.full(n, total), pa.int64()), pa.array(base), pa.array(logs)], names=names))
        return pa.concat_tables(parts)

    values = rare_words(blocks, frequent).join(counts, "hash").where("n != own").select(F.col("block").alias("b"), "hash", "n")
    scored = blocks.groupBy("block").cogroup(values.groupBy("b")).applyInArrow(run, schema)
    return stored(scored, "lm-scores").withColumnRenamed("id", id_col)
