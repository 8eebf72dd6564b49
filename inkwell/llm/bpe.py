"""Byte-level BPE by a sentencepiece model that is written straight from a table of ranks."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.words import kept

CACHE = 500_000
#: Bytes are shown to sentencepiece as the 256 characters from here on; none is white space.
SHOWN = 0x100


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def show(token: bytes) -> str:
    return "".join([chr(SHOWN + b) for b in token])


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def field(number: int, value: bytes | int | float | str) -> bytes:
    """One field of a protocol buffer."""
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def serialised(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model: piece i has rank i and score -i, then the unknown piece; no normalisation.

    The ranks must be 0 .. n-1 without gaps and hold every single byte.
    """
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))) or not all(bytes([b]) in ranks for b in range(256)):
        raise ValueError("ranks must run from 0 without gaps and hold all bytes")
    pieces = [field(1, field(1, show(t)) + field(2, float(-i)) + field(3, 1)) for i, t in enumerate(tokens)]  # 3, 1: a normal piece
    pieces.append(field(1, field(1, "<unk>") + field(2, 0.0) + field(3, 2)))  # 3, 2: the unknown piece
    trainer = field(3, 2) + field(4, len(pieces)) + field(40, len(tokens)) + field(41, 2**64 - 1) + field(42, 2**64 - 1) + field(43, 2**64 - 1)  # BPE; no marks
    normaliser = field(1, "identity") + field(3, 0) + field(4, 0) + field(5, 0)  # no space in front, none taken out, none escaped
    return b"".join(pieces) + field(2, trainer) + field(3, normaliser)


class Codec:
    """Encodes pre-tokens, each once, and keeps what it has seen."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        self.ranks = read_ranks(path)
        self.tokens = sorted(self.ranks, key=self.ranks.__getitem__)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised(self.ranks))
        self.pattern = regex.compile(pattern)
        self.edge = regex.compile(r"\s")
        self.chunks: dict[str, bytes] = {}
        self.pretokens: dict[str, bytes] = {}

    def learn(self, pretokens: list[str]) -> None:
        rest = []
        for p in pretokens:
            raw = p.encode("utf-8", "replace")
            if raw in self.ranks:
                self.pretokens[p] = struct.pack("<i", self.ranks[raw])
            else:
                rest.append((p, show(raw)))
        for (p, _), ids in zip(rest, self.model.encode([x for _, x in rest], out_type=int, num_threads=1) if rest else [], strict=True):
            self.pretokens[p] = struct.pack(f"<{len(ids)}i", *ids)

    def of(self, pretokens: list[str]) -> bytes:
        if new := set(pretokens).difference(self.pretokens):
            self.learn(list(new))
        return b"".join([self.pretokens[p] for p in pretokens])

    def learn_chunks(self, chunks: list[str]) -> None:
        split = [(c, self.pattern.findall(c)) for c in chunks]
        self.of(list({p for _, ps in split for p in ps}))
        for c, ps in split:
            self.chunks[c] = self.of(ps)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit bytes.

        Where single spaces part chunks that neither begin nor end with white space, no pre-token
        crosses from one to the next, so that each distinct chunk (with its space) is split once.
        """
        for cache in (self.chunks, self.pretokens):
            if len(cache) > CACHE:
                cache.clear()
        parts: list[list[str] | None] = []
        for t in texts:
            words = t.split(" ")
            rough = "  " in t or t[:1].isspace() or t[-1:].isspace() or self.ROUGH.search(t)
            parts.append(None if rough else [words[0], *[" " + w for w in words[1:]]])
        if new := set().union(*[p for p in parts if p]).difference(self.chunks):
            self.learn_chunks(list(new))
        get = self.chunks.__getitem__
        return [self.of(self.pattern.findall(t)) if p is None else b"".join(map(get, p)) for t, p in zip(texts, parts, strict=True)]

    #: A space beside other white space: what a pre-token takes depends on more than one chunk.
    ROUGH = regex.compile(r" [^\S ]|[^\S ] ")


_CODECS: dict[tuple[str, str], Codec] = kept()


def codec(path: str, pattern: str) -> Codec:
    """Of this worker; it outlives the task."""
    return _CODECS.get((path, pattern)) or _CODECS.setdefault((path, pattern), Codec(path, pattern))


def encode(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids (array<int>) of each whole text, every match of the pattern encoded by itself.

    A null or empty text has no ids; other columns are ignored; rows stay one for one, repeated ones and those without an id too.  A text
    of any length is encoded whole; one task holds its ids.  An empty table gives an empty result.
    """
    path, pattern = ranks or vocabulary_path(), pattern or split_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = own.encode([t or "" for t in part.column(1).to_pylist()])
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4"), pa.int32()))
                yield pa.record_batch([part.column(0), ids], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, ids and decoded (binary): the bytes of the ids, one after another.

    Null ids count as none; an id without a token is an error; rows stay one for one; an empty table gives an empty result.
    """
    path = ranks or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = codec(path, split_pattern()).tokens
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                column = part.column(1)
                data = [b"".join([tokens[i] for i in ids.values.to_numpy().tolist()]) if ids.is_valid else b"" for ids in column]
                yield pa.record_batch([part.column(0), column, pa.array(data, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
