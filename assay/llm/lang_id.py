"""Language identification: families first, then one-versus-one linear SVMs.

Features are hashed character 1- to 3-grams of the whole text (letters
lower-cased, everything else one blank), as square roots of relative
frequencies. Languages are grouped into families by the similarity of their
mean vectors. One-versus-one support vector machines separate the families,
then the languages within the family; each machine is trained in a task of its
own by dual coordinate descent.

Bounds: about ``per_lang`` labelled documents of each language are learned
from (a hash of the id picks them), and about ``per_machine`` of them by one
machine, so its input grows neither with the corpus nor with the languages of
its families. Every document is predicted from its whole text.

Defined results: a text that is null or has no letter is ``und`` with score 0;
so is every text if nothing can be learned; with a single language all other
texts get it with score 1; ties of votes go to the larger sum of margins, then
to the language first in alphabetical order; repeated rows are predicted one by
one; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod, mix64, stored

DIMS = 1 << 12
CHUNK = 1 << 19
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def letters_only() -> np.ndarray:
    """Code point -> itself if it is a letter or a mark of the BMP, else a blank."""
    import unicodedata

    kinds = [unicodedata.category(chr(c))[0] for c in range(1 << 16)]
    keep = np.array([k in "LM" for k in kinds])
    return np.where(keep, np.arange(1 << 16), 0x20).astype(np.uint32)


class Features:
    def __init__(self):
        self.letters = letters_only()

    def rows(self, texts: list[str]) -> np.ndarray:
        """A row of DIMS features for each text."""
        out, at = np.zeros((len(texts), DIMS), np.float32), 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < CHUNK):
                size += len(texts[end])
                end += 1
            out[at:end] = self.counts(texts[at:end])
            at = end
        sums = out.sum(axis=1, keepdims=True)
        return np.sqrt(out / np.maximum(sums, 1))

    def counts(self, texts: list[str]) -> np.ndarray:
        raws = [t.lower().encode("utf-32-le", "surrogatepass") for t in texts]
        points = np.frombuffer(b"".join(raws), np.uint32)
        points = np.where(points < 1 << 16, self.letters[np.minimum(points, 0xFFFF)], points).astype(np.uint64)
        doc = np.repeat(np.arange(len(texts)), [len(r) // 4 for r in raws])
        total = np.zeros(len(texts) * DIMS)
        gram = np.zeros(len(points), np.uint64)
        for n in range(min(3, len(points))):
            here = points[n:]
            gram = gram[: len(here)]  # the gram that ends one character earlier
            gram = gram * np.uint64(0x100000001B3) + here + np.uint64(n + 1)
            use = doc[n:] == doc[: len(doc) - n]
            if n == 0:
                use &= here != 0x20
            slot = (mix64(gram) >> np.uint64(52)).astype(np.int64) + doc[n:] * DIMS
            total += np.bincount(slot[use], minlength=len(total))
        return total.reshape(len(texts), DIMS)


def train_machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Weights (and a bias at the end) of a linear SVM, squared hinge loss."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    extra = 1 / (2 * cost)
    norms = (x * x).sum(axis=1) + extra
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            slope = y[i] * (x[i] @ w) - 1 + extra * alpha[i]
            new = max(alpha[i] - slope / norms[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def families_of(means: dict[str, np.ndarray]) -> list[list[str]]:
    """Join the most similar groups until about the square root of them is left."""
    groups = [[k] for k in sorted(means)]
    target = max(1, round(len(groups) ** 0.5))
    middle = lambda g: np.mean([means[k] for k in g], axis=0)

    def alike(pair) -> float:
        a, b = middle(groups[pair[0]]), middle(groups[pair[1]])
        return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))

    while len(groups) > target:
        i, j = max(combinations(range(len(groups)), 2), key=alike)
        groups[i] = sorted(groups[i] + groups.pop(j))
    return sorted(groups)


def duel(options: int, machines: dict[tuple[int, int], np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winner of each row and its mean chance against the others."""
    votes, sums, chance = (np.zeros((len(x), options)) for _ in range(3))
    for (a, b), w in machines.items():
        margin = x @ w[:-1] + w[-1]
        sure = 1 / (1 + np.exp(-3 * np.clip(margin, -50, 50)))
        votes[:, a] += margin > 0
        votes[:, b] += margin <= 0
        sums[:, a] += margin
        sums[:, b] -= margin
        chance[:, a] += sure
        chance[:, b] += 1 - sure
    best = np.lexsort((-np.arange(options)[None, :].repeat(len(x), 0), sums, votes), axis=1)[:, -1] if len(x) else np.zeros(0, int)
    return best, chance[np.arange(len(x)), best] / max(1, options - 1) if options > 1 else np.ones(len(x))


class Model:
    def __init__(self, families: list[list[str]], machines: dict[str, np.ndarray]):
        pairs = lambda names, at: {(i, j): machines[f"{at}:{i}:{j}"] for i, j in combinations(range(len(names)), 2)}
        self.families = families
        self.top = pairs(families, "top")
        self.inner = [pairs(f, k) for k, f in enumerate(families)]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        family, sure = duel(len(self.families), self.top, x)
        names = np.empty(len(x), object)
        score = sure.copy()
        for k, members in enumerate(self.families):
            own = np.flatnonzero(family == k)
            best, inner = duel(len(members), self.inner[k], x[own])
            names[own] = np.array(members, object)[best]
            score[own] *= inner
        return names.tolist(), score


def vectors(rows: DataFrame) -> DataFrame:
    """(lang, x) of (lang, text); x holds DIMS float32 values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                x = features.rows(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])

    return rows.select("lang", "text").mapInArrow(run, "lang string, x binary")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, DIMS)


def train(learn: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int, per_machine: int) -> Model | None:
    spark = learn.sparkSession
    rows = learn.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(r"lang is not null and text rlike '\\p{L}'")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, per_lang / n))) for k, n in sorted(counts.items())))
    # By id and text: rows without an id, or that share one, are drawn each on its own.
    chosen = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < share * (1 << 30))
    sample = stored(vectors(chosen), "lang-sample")

    def mean(group: pa.Table) -> pa.Table:
        return pa.table({"lang": group.column("lang").slice(0, 1), "x": pa.array([matrix(group.column("x")).mean(axis=0).tobytes()], pa.binary())})

    means = {r.lang: np.frombuffer(r.x, np.float32) for r in sample.groupBy("lang").applyInArrow(mean, "lang string, x binary").collect()}
    families = families_of(means)
    sides = []  # (machine, lang, side)
    for (i, f), (j, g) in combinations(enumerate(families), 2):
        sides += [(f"top:{i}:{j}", k, 1) for k in f] + [(f"top:{i}:{j}", k, -1) for k in g]
    for n, f in enumerate(families):
        for (i, a), (j, b) in combinations(enumerate(f), 2):
            sides += [(f"{n}:{i}:{j}", a, 1), (f"{n}:{i}:{j}", b, -1)]
    if not sides:
        return Model(families, {})

    def fit(group: pa.Table) -> pa.Table:
        x, y = matrix(group.column("x")), group.column("side").to_numpy().astype(np.float64)
        order = np.lexsort((x[:, 0], x.sum(axis=1), y))  # the same order in every run
        w = train_machine(x[order], y[order])
        return pa.table({"machine": group.column("machine").slice(0, 1), "w": pa.array([w.tobytes()], pa.binary())})

    langs = Counter(machine for machine, _, _ in sides)
    shares = [(*x, min(1.0, per_machine / (per_lang * langs[x[0]]))) for x in sides]
    plan = spark.createDataFrame(shares, "machine string, lang string, side int, share double")
    rows = sample.join(F.broadcast(plan), "lang").where(F.pmod(F.xxhash64("machine", "x"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    fitted = rows.groupBy("machine").applyInArrow(fit, "machine string, w binary")
    return Model(families, {r.machine: np.frombuffer(r.w, np.float64) for r in fitted.collect()})


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held: int = 1, per_lang: int = 500, per_machine: int = 4000) -> DataFrame:
    """Return (id_col, held_out, lang_pred, score), a row for each row.

    Documents whose crc32(id as text) mod ``folds`` is ``held`` are held out of
    the training.
    """
    away = F.coalesce(crc32_mod(id_col, folds) == held, F.lit(False))
    shared = docs.sparkSession.sparkContext.broadcast(train(docs.where(~away), id_col, text_col, lang_col, per_lang, per_machine))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, features = shared.value, Features()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(2).to_pylist()
                ready = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
                names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if ready:
                    got, sure = model.predict(features.rows([texts[i] for i in ready]))
                    for i, name, score in zip(ready, got, sure, strict=True):
                        names[i], scores[i] = name, float(score)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names), pa.array(scores, pa.float64())], names=[id_col, "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col), away.alias("held_out"), F.col(text_col))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")
