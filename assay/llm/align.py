"""Alignment of the tokens of two vocabularies, by the bytes they cover.

Method: each text is encoded twice; ``np.repeat`` of the token places over the
tokens' sizes gives the owner of every byte in A and in B. Where the pair of
owners changes a new overlap (link) begins; where both change at once, the text
is cut into groups of tokens that cover the same bytes.

How often a pair of ids is linked is counted over the corpus: a task counts the
documents of each pair for its rows, Spark adds the counts. The commonest pairs
(at most PAIRS of them, their counts are looked up in a broadcast array) and,
where there are more, the others (joined with the distinct pairs of each block
of documents, so a document's links are never exploded) are then summed for
each document. Which counts are "common" is settled by their distribution, so no
pair that is joined has more rows than there are documents behind the rarest
broadcast one.

Defined results: a null or empty text, and one whose tokens do not give the
text back in either vocabulary, has no tokens, zeros and an empty digest. Rows
that repeat, or have no id, are documents of their own and count as such. An
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import BYTE_LEVEL, byte_letters, read_spec
from .common import held, kind_of, stored
from .token_files import ChunkedEncoder, Pieces

#: Pairs whose counts are broadcast: 17 bytes each.
PAIRS = 1 << 20
#: Bytes of text in a block of documents, unless one document has more.
BLOCK_BYTES = 4 << 20
#: Bytes whose owners are held at once.
WINDOW = 1 << 20
#: Texts encoded at once; a stretch without blanks beyond STRETCH characters is not remembered.
BATCH, STRETCH = 128, 400
#: Distinct pairs that a task holds before it hands counts on.
HELD_PAIRS = 1 << 21
#: What follows an id in the digest: another of its side, the other side, the next group, nothing.
AFTER = (",", "|", ";", "")


class ByteEncoder(ChunkedEncoder):
    """Byte-level vocabulary (A): special tokens in a text are plain text."""

    def __init__(self, spec: str):
        super().__init__(spec)
        self.tokenizer.encode_special_tokens = True
        self.special = []
        byte = {letter: bytes([i]) for i, letter in enumerate(byte_letters())}
        self.bytes = [b""] * len(self.sizes)
        for string, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = b"".join(byte.get(c, c.encode()) for c in string)
        self.sizes = np.array(list(map(len, self.bytes)), np.int64)
        #: Stretches that their ids do not give back.
        self.bad: set[str] = set()
        self.quick = self.by_ranks(json.loads(spec))

    def by_ranks(self, spec: dict):
        """The same vocabulary as ranks, whose library is faster with short texts; none where ids are not in order of the merges."""
        import tiktoken

        vocab, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = [vocab[a + b] for a, b in merges]
        before = spec.get("pre_tokenizer") or {}
        if made != sorted(set(made)) or spec.get("normalizer") or before.get("type") != "ByteLevel" or not before.get("use_regex", True) or max(vocab[c] for c in byte_letters()) >= made[0]:
            return None
        special = {t["id"] for t in spec.get("added_tokens", ())}
        return tiktoken.Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks={self.bytes[i]: i for i in vocab.values() if i not in special}, special_tokens={})

    def learn(self, parts: list[str]) -> None:
        # Where all rules on characters agree: letters, and ASCII.
        easy = [p for p in parts if p and (p.isalpha() or p.isascii()) and not p[0].isspace()] if self.quick else []
        for at in range(0, len(easy), 400):
            bunch = easy[at : at + 400]
            ids = np.array(self.quick.encode_ordinary(" " + " ".join(bunch)), np.uint32)
            raw, ends = ids.tobytes(), np.cumsum(self.sizes[ids])
            cuts = [0, *(np.searchsorted(ends, np.cumsum([1 + len(p.encode()) for p in bunch])) + 1).tolist()]
            self.pieces.update((p, raw[4 * i : 4 * j]) for p, i, j in zip(bunch, cuts, cuts[1:], strict=False))
        super().learn([p for p in parts if p not in self.pieces] if easy else parts)
        if not gives_back(self.bytes, b"".join(map(self.pieces.__getitem__, parts)), b"".join([b" " + p.encode() for p in parts])):
            self.bad.update(p for p in parts if not gives_back(self.bytes, self.pieces[p], b" " + p.encode()))


class PieceEncoder:
    """Vocabulary of pieces (B). No piece holds a blank behind another character,
    which is checked, so the stretches between single blanks are independent and
    each distinct one is encoded once, many at a time."""

    def __init__(self, model: bytes, limit: int = 250_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.sizes = np.array(list(map(len, self.bytes)), np.int64)
        self.apart = not any("▁" in p.lstrip("▁") for p in names)
        self.pieces, self.limit = Pieces({}), limit
        self.bad: set[str] = set()

    def library(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, np.uint32).tobytes() for ids in self.model.encode(texts, num_threads=1)] if texts else []

    def learn(self, parts: list[str]) -> None:
        """Ids of new stretches; a bunch is encoded joined, and one that its ids do not give back piece by piece."""
        for at in range(0, len(parts), 400):
            bunch = parts[at : at + 400]
            raw = self.library([" ".join(bunch)])[0] if all(bunch) else b""
            sizes = [1 + len(p.encode()) for p in bunch]
            if raw and gives_back(self.bytes, raw, b" " + " ".join(bunch).encode()):
                ends = np.cumsum(self.sizes[np.frombuffer(raw, np.uint32)])
                cuts = [0, *(np.searchsorted(ends, np.cumsum(sizes)) + 1).tolist()]
                self.pieces.update((p, raw[4 * i : 4 * j]) for p, i, j in zip(bunch, cuts, cuts[1:], strict=False))
            else:
                self.pieces.update(zip(bunch, self.library(bunch), strict=True))
                self.bad.update(p for p in bunch if not gives_back(self.bytes, self.pieces[p], b" " + p.encode()))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.pieces) > self.limit:
            self.pieces = Pieces(dict(self.pieces))
        known = self.pieces
        split = [t.split(" ") if self.apart and in_stretches(t) else None for t in texts]
        whole = iter(self.library([t for t, parts in zip(texts, split, strict=True) if parts is None]))
        known.lacks = []
        found = [b"" if parts is None else b"".join(map(known.__getitem__, parts)) for parts in split]
        if known.lacks:
            new = set(known.lacks)
            self.learn(list(new))
            found = [f if parts is None or new.isdisjoint(parts) else b"".join(map(known.__getitem__, parts)) for f, parts in zip(found, split, strict=True)]
        return [next(whole) if parts is None else f for f, parts in zip(found, split, strict=True)]


def gives_back(table: list[bytes], ids: bytes, raw: bytes) -> bool:
    return b"".join(map(table.__getitem__, np.frombuffer(ids, np.uint32).tolist())) == raw


def in_stretches(text: str) -> bool:
    """Whether single blanks cut a text into stretches short enough to be remembered."""
    return text != "" and text[0] != " " and text[-1] != " " and "  " not in text and max(map(len, text.split(" "))) <= STRETCH


class Aligner:
    """Both encoders, and what turns two sequences of ids into links and groups."""

    def __init__(self, spec: str, model: bytes):
        self.a, self.b = ByteEncoder(spec), PieceEncoder(model)
        self.strings: list[str] = []

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids in A and B of each text; none where they do not give it back."""
        some = [t or "" for t in texts]
        out = []
        for text, a, b in zip(some, self.a.encode([" " + t for t in some]), self.b.encode(some), strict=True):
            # Stretches were judged when they were learnt.
            if self.a.bad or self.b.bad or not in_stretches(text):
                raw = b" " + text.encode()
                if not text or not gives_back(self.a.bytes, a, raw) or not gives_back(self.b.bytes, b, raw):
                    a = b = b""
            out.append((np.frombuffer(a, np.uint32).astype(np.int64), np.frombuffer(b, np.uint32).astype(np.int64)))
        return out

    def groups(self, encoded: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, int, int, str]]:
        """(n_a, n_b, n_groups, n_links, digest) of each text, all texts aligned as one: their ends are cuts."""
        n_a, n_b = (np.array([len(x[i]) for x in encoded], np.int64) for i in (0, 1))
        a, b = (np.concatenate([x[i] for x in encoded]) for i in (0, 1))
        owner = np.repeat(np.arange(len(encoded)), n_a)
        links, cuts = np.zeros(len(encoded), np.int64), [np.empty((2, 0), np.int64)]
        for x, y, begins in overlaps(self.a.sizes[a], self.b.sizes[b]):
            links += np.bincount(owner[x], minlength=len(encoded))
            cuts.append(np.stack([x[begins], y[begins]]))
        first_a, first_b = np.concatenate(cuts, axis=1)
        n_groups = np.bincount(owner[first_a], minlength=len(encoded))
        digests = self.digests(a, b, first_a, first_b, n_a, n_b)
        return list(zip(n_a.tolist(), n_b.tolist(), n_groups.tolist(), links.tolist(), digests, strict=True))

    def digests(self, a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list[str]:
        """SHA-256 of each text's groups as text; ``first_a`` and ``first_b`` are the first tokens of the groups."""
        if not len(a):
            return [""] * len(n_a)
        if not self.strings:
            self.strings = [f"{i}{s}" for i in range(max(len(self.a.sizes), len(self.b.sizes))) for s in AFTER]
        end_a, end_b = np.append(first_a[1:], len(a)), np.append(first_b[1:], len(b))
        after_a, after_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        after_a[end_a - 1], after_b[end_b - 1] = 1, 2
        last = np.cumsum(n_b)[n_b > 0] - 1
        after_b[last] = 3
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.repeat(first_b, end_a - first_a)] = a * len(AFTER) + after_a
        order[np.arange(len(b)) + np.repeat(end_a, end_b - first_b)] = b * len(AFTER) + after_b
        out, at = [], 0
        for n in (n_a + n_b).tolist():
            sha = hashlib.sha256()
            for i in range(at, at + n, 1 << 18):
                sha.update("".join(map(self.strings.__getitem__, order[i : min(i + (1 << 18), at + n)].tolist())).encode())
            out.append(sha.hexdigest() if n else "")
            at += n
        return out


def overlaps(sizes_a: np.ndarray, sizes_b: np.ndarray, window: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Links of two sequences of tokens that cover the same bytes, window by window.

    Yields the places of the A tokens and of the B tokens of each link, and
    whether a group begins there. Owners are kept for ``window`` bytes at once.
    """
    window = window or WINDOW
    ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    total, last = int(ends_a[-1]) if len(ends_a) else 0, (-1, -1)

    def owners(ends: np.ndarray, low: int, high: int) -> np.ndarray:
        first, stop = np.searchsorted(ends, [low, high - 1], "right")
        inside = np.minimum(ends[first : stop + 1], high)
        return np.repeat(np.arange(first, stop + 1), np.diff(inside, prepend=low))

    for low in range(0, total, window):
        high = min(low + window, total)
        a, b = owners(ends_a, low, high), owners(ends_b, low, high)
        new_a, new_b = np.diff(a, prepend=last[0]) != 0, np.diff(b, prepend=last[1]) != 0
        last = a[-1], b[-1]
        at = np.flatnonzero(new_a | new_b)
        yield a[at], b[at], (new_a & new_b)[at]


def link_codes(aligner: Aligner, a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
    """A id << 32 | B id of each link of a document, window by window."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    for x, y, _ in overlaps(aligner.a.sizes[a], aligner.b.sizes[b]):
        yield a[x] << 32 | b[y]


def unique_codes(aligner: Aligner, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    found = [np.unique(codes) for codes in link_codes(aligner, a, b)]
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def aligner_of(shared) -> Aligner:
    """One aligner, with what it remembers, for each Python worker and pair of vocabularies."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return held(("align", shared.value[2]), lambda: Aligner(*shared.value[:2]))


def align(docs: DataFrame, vocabulary_a: str, vocabulary_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, block, n_a, n_b, n_groups, n_links, groups_sha256, a, b) of every document, stored.

    ``a`` and ``b`` are the ids as little-endian unsigned integers of 16 bits,
    or 32 where a vocabulary is larger; ``block`` numbers stretches of
    documents of about BLOCK_BYTES of text.
    """
    spark = docs.sparkSession
    shared, width = share(spark, vocabulary_a, vocabulary_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(shared)
        block, filled = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                texts = part.column(1).to_pylist()
                encoded, blocks = aligner.encode(texts), []
                for text in texts:
                    if filled and filled + len(text or "") > BLOCK_BYTES:
                        block, filled = block + 1, 0
                    filled += len(text or "")
                    blocks.append(block)
                rows = [(block, *counts, a.astype(width).tobytes(), b.astype(width).tobytes()) for block, counts, (a, b) in zip(blocks, aligner.groups(encoded), encoded, strict=True)]
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["id", *NAMES])

    kind = kind_of(docs, id_col)
    schema = f"id {kind}, block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a binary, b binary"
    return stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema), "aligned")


NAMES = ["block", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b"]
TYPES = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.binary()]


def share(spark, vocabulary_a: str, vocabulary_b: str):
    """Both vocabulary files, broadcast (their size is a tokenizer's, whatever the corpus), and the width of an id."""
    import sentencepiece
    from tokenizers import Tokenizer

    spec = read_spec(vocabulary_a)
    with open(vocabulary_b, "rb") as file:
        model = file.read()
    n = max(Tokenizer.from_str(spec).get_vocab_size(), sentencepiece.SentencePieceProcessor(model_proto=model).get_piece_size())
    digest = hashlib.sha256(spec.encode() + model).hexdigest()
    return spark.sparkContext.broadcast((spec, model, digest)), "<u2" if n <= 1 << 16 else "<u4"


def pair_counts(aligned: DataFrame, shared, width: str) -> DataFrame:
    """(pair, n, best): in how many documents each pair of ids is linked, and whether that is its A id's most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(shared)
        pairs, counts, waiting, size = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            codes = np.concatenate([pairs, *waiting])
            n = np.concatenate([counts, np.ones(len(codes) - len(pairs), np.int64)])
            keys, place = np.unique(codes, return_inverse=True)
            return keys, np.bincount(place, n, len(keys)).astype(np.int64)

        def rows() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(pairs), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[at : at + (1 << 16)]), pa.array(counts[at : at + (1 << 16)])], names=["pair", "n"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                waiting.append(unique_codes(aligner, np.frombuffer(a, width), np.frombuffer(b, width)))
                size += len(waiting[-1])
                if size > HELD_PAIRS:
                    pairs, counts = merged()
                    waiting, size = [], 0
                    if len(pairs) > HELD_PAIRS:
                        yield from rows()
                        pairs, counts = pairs[:0], counts[:0]
        pairs, counts = merged()
        yield from rows()

    counts = stored(aligned.where("n_links > 0").select("a", "b").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    # An A id has at most as many pairs as B has ids.
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    return stored(counts.join(most, F.shiftright("pair", 32) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-best")


def common_from(counts: DataFrame, limit: int) -> int:
    """The smallest power of two such that at most ``limit`` pairs are counted that often."""
    by_size = dict(counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).count().collect())
    power, total = max(by_size, default=0) + 1, 0
    while power > 0 and total + by_size.get(power - 1, 0) <= limit:
        power -= 1
        total += by_size.get(power, 0)
    return 1 << power


class Counts:
    """Sorted pairs with their counts; a pair that is absent counts nothing here."""

    def __init__(self, pairs: np.ndarray, n: np.ndarray, best: np.ndarray):
        order = np.argsort(pairs)
        self.pairs, self.n, self.best = pairs[order], n[order], best[order]

    def places(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.pairs, codes)
        at[at == len(self.pairs)] = 0
        return at, self.pairs[at] == codes if len(self.pairs) else np.zeros(len(codes), bool)

    def sums(self, codes: np.ndarray) -> tuple[int, int]:
        at, found = self.places(codes)
        at = at[found]
        return int(self.best[at].sum()), int(self.n[at].sum())


def alignments(docs: DataFrame, vocabulary_a: str, vocabulary_b: str, id_col: str = "doc_id", text_col: str = "text", pairs: int | None = None) -> DataFrame:
    """A row for each document: sizes and digest of its alignment, and how well its links agree with the corpus.

    ``n_best`` counts the links whose pair is their A id's commonest in the
    corpus, ``count_sum`` adds the counts of all links.
    """
    spark = docs.sparkSession
    limit = PAIRS if pairs is None else pairs
    shared, width = share(spark, vocabulary_a, vocabulary_b)
    aligned = align(docs, vocabulary_a, vocabulary_b, id_col, text_col)
    counts = pair_counts(aligned, shared, width)
    least = common_from(counts, limit)
    table = counts.where(F.col("n") >= least).toArrow()
    common = spark.sparkContext.broadcast(tuple(table.column(i).to_numpy() for i in range(3)))
    rare = counts.where(F.col("n") < least)
    kept = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kind = kind_of(aligned, "id")
    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"

    def scored(a: list[bytes], b: list[bytes], tables: list[Counts]) -> tuple[list[int], list[int]]:
        aligner, out = aligner_of(shared), []
        for x, y in zip(a, b, strict=True):
            found = [t.sums(codes) for codes in link_codes(aligner, np.frombuffer(x, width), np.frombuffer(y, width)) for t in tables]
            out.append((sum(f[0] for f in found), sum(f[1] for f in found)))
        return [o[0] for o in out], [o[1] for o in out]

    def by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [Counts(*common.value)]
        for batch in batches:
            best, total = scored(batch.column("a").to_pylist(), batch.column("b").to_pylist(), tables)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ["id", *kept]), pa.array(best, pa.int64()), pa.array(total, pa.int64())], names=["id", *kept, "n_best", "count_sum"])

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct pairs of each block that are not broadcast."""
        aligner, known = aligner_of(shared), Counts(*common.value)
        block, found = None, []

        def rows() -> Iterator[pa.RecordBatch]:
            codes = np.unique(np.concatenate(found))
            codes = codes[~known.places(codes)[1]]
            for at in range(0, len(codes), 1 << 16):
                part = codes[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block, np.int64)), pa.array(part)], names=["block", "pair"])

        for batch in batches:
            for b, x, y in zip(*(batch.column(c).to_pylist() for c in ("block", "a", "b")), strict=True):
                if found and b != block:
                    yield from rows()
                    found = []
                block = b
                found.append(unique_codes(aligner, np.frombuffer(x, width), np.frombuffer(y, width)))
        if found:
            yield from rows()

    def by_block(key: tuple, rows: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        own = more.drop_duplicates("pair")
        tables = [Counts(*common.value), Counts(own["pair"].to_numpy(), own["n"].to_numpy(), own["best"].to_numpy(bool))]
        best, total = scored(rows["a"].tolist(), rows["b"].tolist(), tables)
        return rows[["id", *kept]].assign(n_best=best, count_sum=total)

    if rare.isEmpty():
        done = aligned.mapInArrow(by_row, schema)
    else:
        asked = stored(aligned.where("n_links > 0").select("block", "a", "b").mapInArrow(wanted, "block long, pair long"), "asked-pairs")
        answers = asked.join(rare, "pair").select("block", "pair", "n", "best")
        done = aligned.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(by_block, schema)
    return stored(done, "alignments").withColumnRenamed("id", id_col)
