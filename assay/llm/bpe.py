"""Byte-pair encoding and decoding of whole texts.

Method: the symbols of a word form a doubly linked list; a priority queue holds
(merge rank, position) of every adjacent pair that can merge. Popped entries
whose pair has changed meanwhile are stale and are skipped. Decoding
concatenates the vocabulary's strings.

The vocabulary file is read once on the driver and broadcast: its size is that
of a tokenizer file (a few MB), whatever the corpus.

Defined results: a null text counts as empty; an empty text has no ids and an
empty decoded text; repeated rows give repeated rows; an empty table gives an
empty table. Extra columns are ignored: only the named ones are read.
"""

from __future__ import annotations

import array
import json
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TwoAgeCache, held

#: White space that normalisers collapse: the Unicode property White_Space.
WHITE = "\t-\r \x85\xa0  -     　"
#: str.split() also cuts at these four, which are not White_Space.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Bytes of byte-level vocabularies that stand for themselves.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Splitting rule of byte-level vocabularies that name none of their own.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    letters, extra = [], 0x100
    for byte in range(256):
        if byte in PRINTABLE:
            letters.append(chr(byte))
        else:
            letters.append(chr(extra))
            extra += 1
    return letters


class BpeCodec:
    """Encoder and decoder of one tokenizer file (type BPE)."""

    def __init__(self, spec: dict):
        import regex

        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        #: left id << 32 | right id -> rank; rank -> merged id
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks[self.vocab[left] << 32 | self.vocab[right]] = rank
            self.merged.append(self.vocab[left + right])
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        self.special = special
        self.strings = {i: s for s, i in {**self.vocab, **special}.items()}
        self.strings = [self.strings.get(i, "") for i in range(max(self.strings, default=-1) + 1)]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        normal = spec.get("normalizer") or {}
        steps = normal.get("normalizers", [normal] if normal else [])
        self.nfc = any(s["type"] == "NFC" for s in steps)
        self.lower = any(s["type"] == "Lowercase" for s in steps)
        self.collapse = any(s["type"] == "Replace" for s in steps)
        before = spec.get("pre_tokenizer") or {}
        rules = before.get("pretokenizers", [before] if before else [])
        own = next((s["pattern"]["Regex"] for s in rules if s["type"] == "Split"), BYTE_LEVEL)
        self.pattern = regex.compile(own.replace(r"\s", f"[{WHITE}]").replace(f"[^[{WHITE}]", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]"))
        self.space = regex.compile(f"[{WHITE}]+")
        self.letters = byte_letters()
        self.inner = [self.vocab[x] for x in self.letters]
        self.final = [self.vocab[x + self.suffix] for x in self.letters]
        self.bytes_of = {letter: byte for byte, letter in enumerate(self.letters)}
        self.byte_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        #: White space never joins a piece, so chunks between it stand alone.
        self.by_chunk = own != BYTE_LEVEL
        self.pieces = TwoAgeCache(self.merge_word, 100_000)
        self.chunks = TwoAgeCache(self.encode_chunk, 100_000)

    def merge_word(self, piece: str) -> bytes:
        """Merge one word by a heap of ranks over a doubly linked list."""
        raw, rank_of = piece.encode("utf-8", "surrogatepass"), self.ranks.get
        ids = [self.inner[b] for b in raw[:-1]]
        ids.append(self.final[raw[-1]])
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # An entry is rank << 32 | position: the lowest rank first, then the leftmost.
        heap = [rank << 32 | i for i in range(n - 1) if (rank := rank_of(ids[i] << 32 | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            j = after[i]
            if ids[i] < 0 or j >= n or rank_of(ids[i] << 32 | ids[j]) != rank:
                continue  # stale: one of the two symbols has merged since
            ids[i] = new = self.merged[rank]
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (rank := rank_of(new << 32 | ids[k])) is not None:
                    heappush(heap, rank << 32 | i)
            if (h := before[i]) >= 0 and (rank := rank_of(ids[h] << 32 | new)) is not None:
                heappush(heap, rank << 32 | h)
        return array.array("I", [x for x in ids if x >= 0]).tobytes()

    def normalise(self, text: str) -> str:
        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.collapse and not text.isalnum():
            text = self.space.sub(" ", text)
        if self.lower:
            # One character at a time: no final form of sigma.
            text = text.replace("Σ", "σ").lower()
        return text

    def encode_chunk(self, chunk: str) -> bytes:
        """Ids of a text without special tokens."""
        word = self.normalise(chunk)
        if self.by_chunk and word.isalpha():
            return self.pieces[word]  # letters only: one piece
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(word)))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        out, at = [], 0
        spots = self.cut.finditer(text) if self.cut else ()
        for spot in spots:
            out.append(self.encode_between(text[at : spot.start()]))
            out.append(self.special[spot.group()].to_bytes(4, "little"))
            at = spot.end()
        out.append(self.encode_between(text[at:] if at else text))
        return b"".join(out)

    def encode_between(self, text: str) -> bytes:
        if self.by_chunk and not any(c in text for c in SEPARATORS):
            return b"".join(map(self.chunks.__getitem__, text.split()))
        return self.encode_chunk(text)

    def decode(self, ids) -> str:
        """Concatenate the vocabulary's strings, special tokens included."""
        strings = map(self.strings.__getitem__, ids)
        if self.byte_decoder:
            raw = bytearray()
            for s in strings:
                raw += bytes(self.bytes_of[c] for c in s) if all(c in self.bytes_of for c in s) else s.encode()
            return raw.decode("utf-8", "replace")
        return " ".join(strings)


def read_spec(path: str) -> str:
    """The tokenizer file's text, read on the driver."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def codec_of(shared) -> BpeCodec:
    """One codec, with its caches, for each Python worker and vocabulary."""
    return held(("bpe", hash(shared.value)), lambda: BpeCodec(json.loads(shared.value)))


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, then decode the ids again.

    Returns (id_col, ids, decoded): ``ids`` is a binary of little-endian
    unsigned 32-bit integers, ``decoded`` the text the ids stand for.
    No shuffle: each row is a function of its own text.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(vocabulary))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(spec)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [codec.encode(x or "") for x in part.column(1).to_pylist()]
                texts = [codec.decode(array.array("I", x)) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], names=[id_col, "ids", "decoded"])

    chosen = docs.select(F.col(id_col), F.col(text_col))
    return chosen.mapInArrow(run, f"`{id_col}` {kind}, ids binary, decoded string")


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of ``encode_decode``'s rows, on the JVM."""
    return encoded.select(
        F.col(id_col),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
