"""Best-fit packing: texts become token pieces, and pieces share sequences of a fixed length."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.shared import free, numbered
from inkwell.llm.words import kept

MAX_TOKENS = 2048
END = 0
#: Pieces that one task packs; each block leaves about one sequence that is not full.
BLOCK_PIECES = 16_384
#: Entries at which a worker empties its cache of words.
CACHE = 600_000

PIECES = "doc_id long, piece int, start long, length long, ids binary"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, word by word and each word once.

    The tokenizer composes characters, turns white space into single spaces, lower-cases and never lets
    a token cross white space, so the words of a text can be encoded apart.  Words of plain Latin
    letters are normalised and split here and only their parts go through the BPE model; any other
    word goes through the whole tokenizer.
    """

    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\n")
    ODD = re.compile("[^\x21-\x7e\xa1-ɏ]")
    EDGE = b"\xff" * 4  #: in no row of ids, as each has two zero bytes

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.model.normalizer = None
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # as byte-level vocabularies show bytes
        hidden = iter(range(256))
        self.chars = {b: chr(b) if b in set(shown) else chr(256 + next(hidden)) for b in range(256)}
        size = self.whole.get_vocab_size()
        self.final = np.array([(self.whole.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def learn_parts(self, parts: list[str]) -> None:
        for at in range(0, len(parts), 200):
            some = parts[at : at + 200]
            shown = " ".join(x if x.isascii() else "".join(self.chars[b] for b in x.encode()) for x in some)
            ids = np.array(self.model.encode_batch_fast([shown], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.final[ids]) + 1
            if len(ends) == len(some):
                raw, a = ids.tobytes(), 0
                for part, b in zip(some, ends.tolist(), strict=True):
                    self.parts[part] = raw[4 * a : 4 * b]
                    a = b
            else:
                for part in some:
                    self.parts[part] = np.array(self.whole.encode(part, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[bytes]) -> None:
        if len(self.parts) > CACHE:
            self.parts.clear()
        odd = self.ODD.search
        pairs = list(zip(words, b"\n".join(words).decode("utf-8", "replace").split("\n"), strict=True))  # no word has white space
        other, plain = [x for x in pairs if odd(x[1])], [x for x in pairs if not odd(x[1])]
        # all at once, parted by newlines; no character of these is lower-cased by what stands beside it
        parts = self.SPLIT.findall(unicodedata.normalize("NFC", "\n".join([t for _, t in plain])).lower())
        self.learn_parts(list(set(parts).difference(self.parts, "\n")))
        self.parts["\n"] = self.EDGE
        self.words.update(zip([w for w, _ in plain], b"".join(map(self.parts.__getitem__, parts)).split(self.EDGE), strict=False))
        for (word, _), found in zip(other, self.whole.encode_batch_fast([t for _, t in other], add_special_tokens=False), strict=True):
            self.words[word] = np.array(found.ids, "<u4").tobytes()

    def ids(self, texts: list[list[bytes]]) -> list[bytes]:
        """texts: each text's words."""
        if len(self.words) > CACHE:
            self.words.clear()
        new = set().union(*texts).difference(self.words)
        if new:
            self.learn(list(new))
        get = self.words.__getitem__
        return [b"".join(map(get, words)) for words in texts]


_ENCODERS: dict[str, Encoder] = kept()


def encoder(path: str) -> Encoder:
    """Of this worker; it outlives the task."""
    return _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))


def token_pieces(docs: DataFrame, tokenizer: str | None = None, max_tokens: int = MAX_TOKENS, end: int = END) -> DataFrame:
    """Each text's token ids and the end id, cut into pieces only where they exceed max_tokens.

    docs: doc_id, text; other columns are ignored.  Returns PIECES: piece counts from 0, start is the
    number of the document's ids before it, ids are unsigned little-endian 32-bit integers.
    A null or empty text is the end id alone.  Rows that share a doc_id, or have none, each give their pieces.  A text of any length
    is encoded whole; one task holds its ids.  An empty table gives an empty result.
    """
    path = tokenizer or tokenizer_path()
    tail = np.array([end], "<u4").tobytes()
    step = 4 * max_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).cast(pa.binary()).to_pylist()
                out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids": []}
                for doc, raw in zip(part.column(0).to_pylist(), own.ids([(t or b"").split() for t in texts]), strict=True):
                    raw += tail
                    for k, a in enumerate(range(0, len(raw), step)):
                        piece = raw[a : a + step]
                        out["doc_id"].append(doc)
                        out["piece"].append(k)
                        out["start"].append(a // 4)
                        out["length"].append(len(piece) // 4)
                        out["ids"].append(piece)
                yield pa.record_batch([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=list(out))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The bin and the offset of each item, placed in the given order, and the number of bins.

    counts[g] is the number of open bins with gap g.  An item goes where the sum of counts[g]**2 becomes
    smallest; a new bin is opened only when no open one can hold it.  Full bins count as closed.
    """
    counts = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    never = np.int64(1) << 60
    for i, size in enumerate(lengths.tolist()):
        gap, best = capacity, never
        if size < capacity:
            if counts[size]:
                gap, best = size, 1 - 2 * counts[size]
            open_bins = counts[size + 1 : capacity]
            if len(open_bins):
                change = 2 * (counts[1 : capacity - size] - open_bins + 1)
                change[open_bins == 0] = never
                k = int(change.argmin())
                if change[k] < best:
                    gap, best = size + 1 + k, change[k]
        if best == never:
            gap, bins[i] = capacity, used
            used += 1
        else:
            bins[i] = stacks[gap].pop()
            counts[gap] -= 1
        offsets[i] = capacity - gap
        if gap > size:
            counts[gap - size] += 1
            stacks[gap - size].append(int(bins[i]))
    return bins, offsets, used


def pack(pieces: DataFrame, items: int | None = None, max_tokens: int = MAX_TOKENS, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """A sequence and a gapless place in it for each piece of at most max_tokens.

    pieces: doc_id, piece, length, and any other columns, which stay.  items: about how many pieces are
    shorter than max_tokens (counted if not given); blocks of about block_pieces, dealt by a hash of a row's number, so
    evenly whatever ids there are, are packed apart, the longest piece first, by sum_of_squares().  Where rows stand must be
    reproducible, as in files; pieces that come from a shuffle are stored first.  Returns
    the columns of pieces, then sequence_id and offset, both long, each with underscores behind it where pieces has the name already.
    An empty table gives an empty result; a repeated row is one more piece; null ids are allowed.  Equal lengths come in the order
    of doc_id and piece.
    """
    if items is None:
        items = pieces.where(F.col("length") < max_tokens).count()
    blocks = max(1, -(-items // block_pieces))
    block, to, at = free(["_block", "sequence_id", "offset"], pieces.columns)
    given, last = pieces.columns, f"c{len(pieces.columns)}"
    schema = T.StructType([*pieces.schema.fields, T.StructField(to, T.LongType()), T.StructField(at, T.LongType())])

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns([last]).rename_columns(given)
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]))
        bins, offsets, _ = sum_of_squares(rows.column("length").to_numpy(), max_tokens)
        return rows.append_column(to, pa.array(bins + (key[0].as_py() << 40), pa.int64())).append_column(at, pa.array(offsets, pa.int64()))

    return numbered(pieces.withColumn(block, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("long"))).groupBy(last).applyInArrow(run, schema)


def sequences(placed: DataFrame) -> DataFrame:
    """The token sequences themselves: sequence_id, n_tokens and ids, from pieces with length, ids, sequence_id and offset as pack() places them.

    Other columns are ignored, but those that pack() had to name otherwise (sequence_id_) are not sought.  Pieces of one sequence are
    few, as it has a fixed length; equal rows stand twice, as pack() gave them places of their own.  Null ids add nothing to the bytes, whatever
    their length.  An empty table gives an empty result.
    """
    rows = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    return rows.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n_tokens"), F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, F.coalesce(x["ids"], F.lit(b"")))).alias("ids"))
