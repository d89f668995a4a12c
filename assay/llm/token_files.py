"""Token-id files: one id array and Elias-Fano coded document boundaries.

A file holds the ids of consecutive documents back to back (16 bits each when
the vocabulary fits) and two Elias-Fano sequences, the documents' ends and
their ids. A sequence of n values below u takes about n * (2 + log2(u / n))
bits: the low bits lie in a packed array, the high bits are unary in a bitmap,
and the position of every 256th one is stored, so select(i) scans a short
stretch of the bitmap. There are no 64-bit tables.

Documents are dealt to files by ranges of their id and sorted within, so the
files in name order hold all documents in ascending order of id. A task writes
each file under a name of its own and renames it, so a repeated task replaces
a whole file by the same bytes. The manifest has a row for each file.

Defined results: a null text counts as empty and consists of the end id only;
documents with a null id come first; repeated rows are stored as often as they
occur, ordered by text; an empty table gives an empty manifest; other columns
are ignored.
"""

from __future__ import annotations

import array
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import read_spec
from .common import held, new_path, stored

MAGIC = b"EFTOKENS"
HEAD = struct.Struct("<8sBxxxxxxxQQQqQQ")
PART = struct.Struct("<QQBxxxxxxxQQQ")
#: Ones between two stored positions of the bitmap.
SAMPLE = 256
#: Ids of a file at most, unless one document has more.
IDS_PER_FILE = 16 << 20
#: Texts encoded at once.
BATCH = 256


class EliasFano:
    """A non-decreasing sequence of integers in [0, universe)."""

    def __init__(self, n: int, universe: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.width = n, universe, width
        self.low, self.high, self.samples = low, high, samples

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        width = max(0, int(math.log2(universe / n))) if n and universe > n else 0
        values = values.astype(np.uint64)
        bits = ((values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        places = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        marks = np.zeros(n + (universe >> width) + 1, np.uint8)
        marks[places] = 1
        pack = lambda b: np.packbits(b.ravel(), bitorder="little")
        return cls(n, universe, width, pack(bits), pack(marks), places[::SAMPLE].astype(np.uint32))

    def dumps(self) -> bytes:
        parts = [self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()]
        return PART.pack(self.n, self.universe, self.width, *map(len, parts)) + b"".join(parts)

    @classmethod
    def loads(cls, raw: memoryview) -> EliasFano:
        n, universe, width, *sizes = PART.unpack_from(raw)
        ends = np.cumsum([PART.size, *sizes])
        low, high, samples = (raw[a:b] for a, b in zip(ends, ends[1:], strict=False))
        return cls(n, universe, width, np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8), np.frombuffer(samples, np.uint32))

    def select(self, i: int) -> int:
        """The i-th value, from the nearest stored position on."""
        at = int(self.samples[i // SAMPLE])
        byte, left = at >> 3, i % SAMPLE + 1
        left += int(self.high[byte] & ((1 << (at & 7)) - 1)).bit_count()
        while left > (ones := int(self.high[byte]).bit_count()):
            left -= ones
            byte += 1
        bits = int(self.high[byte])
        for _ in range(left - 1):
            bits &= bits - 1
        place = 8 * byte + (bits & -bits).bit_length() - 1
        return (place - i) << self.width | self.low_bits(i)

    def low_bits(self, i: int) -> int:
        start = i * self.width
        stretch = self.low[start >> 3 : (start + self.width + 7) >> 3].tobytes()
        return int.from_bytes(stretch, "little") >> (start & 7) & ((1 << self.width) - 1)

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.width)
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.width].reshape(self.n, self.width)
        low = (bits.astype(np.uint64) << np.arange(self.width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return (high | low).astype(np.int64)


def dump_file(doc_ids: list[int | None], ends: list[int], ids: bytes, wide: bool) -> bytes:
    """A file's bytes; ``ids`` are little-endian unsigned 32-bit integers."""
    known = [i for i in doc_ids if i is not None]
    first = known[0] if known else 0
    names = EliasFano.of(np.array(known, np.int64) - first, known[-1] - first + 1 if known else 1).dumps()
    bounds = EliasFano.of(np.array(ends, np.int64), len(ids) // 4 + 1).dumps()
    body = ids if wide else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
    head = HEAD.pack(MAGIC, 4 if wide else 2, len(doc_ids), len(ids) // 4, len(doc_ids) - len(known), first, len(names), len(bounds))
    return head + names + bounds + body


class TokenFile:
    """Random access to the documents of a file."""

    def __init__(self, raw: bytes):
        magic, size, self.n, self.n_ids, nulls, first, names, bounds = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token file")
        view = memoryview(raw)
        at = HEAD.size
        self.doc_ids = [None] * nulls + (EliasFano.loads(view[at:]).all() + first).tolist()
        self.ends = EliasFano.loads(view[at + names :])
        self.ids = np.frombuffer(view[at + names + bounds :], f"<u{size}")

    def span(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        start, end = self.span(i)
        return self.ids[start:end]


class Pieces(dict):
    """Stretch of text after a blank -> ids; notes the stretches it lacks."""

    def __init__(self, old: dict[str, bytes]):
        super().__init__()
        self.old, self.lacks = old, []

    def __missing__(self, part: str) -> bytes:
        found = self.old.get(part)
        if found is None:
            self.lacks.append(part)
            return b""
        self[part] = found
        return found


class ChunkedEncoder:
    """The tokenizers library, asked once for each distinct stretch of text.

    A blank that follows no other blank begins a new piece in the library's
    splitting rule, whatever stands before it, so such stretches are encoded
    once and remembered. New stretches go to the library joined, and tokens are
    told apart by their lengths. Texts with two blanks in a row or with a
    special token are encoded whole.
    """

    def __init__(self, spec: str, limit: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        strings = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(strings.values()) + 1, np.int64)
        self.sizes[list(strings.values())] = [len(s) for s in strings]  # a letter for each byte
        self.pieces = Pieces({})
        self.limit = limit

    def library(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array.array("I", x.ids).tobytes() for x in got]

    def learn(self, parts: list[str]) -> None:
        """Ids of new stretches: those that begin with text are joined."""
        plain = [p for p in parts if p and not p[0].isspace()]
        alone = [p for p in parts if not p or p[0].isspace()]
        self.pieces.update(zip(alone, self.library([" " + p for p in alone]), strict=True))
        bunches = [plain[at : at + 400] for at in range(0, len(plain), 400)]
        for bunch, raw in zip(bunches, self.library(["".join([" " + p for p in b]) for b in bunches]), strict=True):
            ends = np.cumsum(self.sizes[np.frombuffer(raw, np.uint32)])
            cuts = np.searchsorted(ends, np.cumsum([1 + len(p.encode("utf-8")) for p in bunch])) + 1
            at = 0
            for part, cut in zip(bunch, cuts.tolist(), strict=True):
                self.pieces[part] = raw[4 * at : 4 * cut]
                at = cut

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.pieces) > self.limit:
            self.pieces = Pieces(dict(self.pieces))
        known = self.pieces
        split = [None if "  " in t or any(s in t for s in self.special) else t.split(" ") for t in texts]
        heads = iter(self.library([t if parts is None else parts[0] for t, parts in zip(texts, split, strict=True)]))
        known.lacks = []
        rests = [b"" if parts is None else b"".join(map(known.__getitem__, parts[1:])) for parts in split]
        if known.lacks:
            new = set(known.lacks)
            self.learn(list(new))
            rests = [r if parts is None or new.isdisjoint(parts) else b"".join(map(known.__getitem__, parts[1:])) for r, parts in zip(rests, split, strict=True)]
        return [next(heads) + rest for rest in rests]


def encoder_of(shared) -> ChunkedEncoder:
    """One encoder, with what it remembers, for each Python worker and vocabulary."""
    return held(("token files", hash(shared.value)), lambda: ChunkedEncoder(shared.value))


def put_file(folder: str, name: str, raw: bytes) -> None:
    """Write a whole file or none: under a name of its own, then renamed."""
    from uuid import uuid4

    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    own = f"{path}/.{name}.{uuid4().hex}"
    with system.open_output_stream(own) as out:
        out.write(raw)
    try:
        system.move(own, f"{path}/{name}")
    except OSError:  # some stores do not move onto a file; an earlier try of this task has left the same one
        if system.get_file_info(f"{path}/{name}").type != fs.FileType.File:
            raise
        system.delete_file(own)


def get_file(folder: str, name: str) -> bytes:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    with system.open_input_stream(f"{path}/{name}") as file:
        return file.read()


def write_tokens(docs: DataFrame, vocabulary: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, ids_per_file: int = IDS_PER_FILE) -> DataFrame:
    """Encode and write all documents; return the manifest (folder, name, n_docs, n_ids)."""
    import json

    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-files")
    text = read_spec(vocabulary)
    spec = spark.sparkContext.broadcast(text)
    known = json.loads(text)
    wide = max([*known["model"]["vocab"].values(), *(t["id"] for t in known.get("added_tokens", ()))]) >= 1 << 16
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = encoder_of(spec)
        doc_ids, ends, ids, files = [], [], bytearray(), 0

        def flush() -> pa.RecordBatch:
            name = f"part-{TaskContext.get().partitionId():06d}-{files:05d}.eft"
            put_file(folder, name, dump_file(doc_ids, ends, bytes(ids), wide))
            return pa.RecordBatch.from_pydict({"folder": [folder], "name": [name], "n_docs": [len(doc_ids)], "n_ids": [len(ids) // 4]})

        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                for doc_id, raw in zip(part.column(0).to_pylist(), encoder.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    if doc_ids and len(ids) // 4 + len(raw) // 4 >= ids_per_file:
                        yield flush()
                        doc_ids, ends, ids, files = [], [], bytearray(), files + 1
                    ids += raw
                    ids += end
                    doc_ids.append(doc_id)
                    ends.append(len(ids) // 4)
        if doc_ids:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("print"))
    # Rows that share an id, or have none, spread over ranges by their texts.
    rows = rows.repartitionByRange(max(1, docs.rdd.getNumPartitions()), "id", "print").sortWithinPartitions("id", "print").select("id", "text")
    return stored(rows.mapInArrow(run, "folder string, name string, n_docs long, n_ids long"), "token-manifest")


def read_tokens(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, ids) of every document, read back from the files.

    ``start`` counts the ids of all documents before it; ``ids`` are
    little-endian unsigned 32-bit integers. The running sum is over the
    manifest's rows, one for each file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = TokenFile(get_file(row["folder"], row["name"]))
                ends = file.ends.all()
                starts = np.concatenate([[0], ends[:-1]])
                for at in range(0, file.n, 1024):
                    pairs = list(zip(starts[at : at + 1024].tolist(), ends[at : at + 1024].tolist(), strict=True))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(file.doc_ids[at : at + 1024], pa.int64()),
                        pa.array([row["before"] + a for a, _ in pairs], pa.int64()),
                        pa.array([file.ids[a:b].astype("<u4").tobytes() for a, b in pairs], pa.binary()),
                    ], names=[id_col, "start", "ids"])

    order = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
    spread = files.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism), "name")
    return spread.mapInArrow(run, f"`{id_col}` long, start long, ids binary")


def digests(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return tokens.select(id_col, "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
