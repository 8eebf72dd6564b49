"""Language ID: unigram models over a public vocabulary, each word's probability summed over all segmentations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.words import forget, mix, powers, slices, span_hashes, text_buffers

#: Most texts of one language that are learnt from, taken in the order of a hash of doc_id.
MOST_TEXTS = 600
#: Languages whose sums are held at a time, and bytes of words whose lattices are held between rounds of training; beyond, they are made again.
AT_ONCE, HELD = 32, 4 << 20
#: Words of more bytes, or whose probabilities may be below what a double can hold, are summed over in logarithms.
RUN = 32
#: Words of one pass over a lattice, and their padded bytes if they are longer than RUN (a longer word comes alone).
WORDS, CELLS = 16_384, 1 << 20
#: Rounds of expectation maximisation, and what each piece counts in every language before any text.
ROUNDS, PSEUDO = 4, 0.02
BASE = 0x9E3779B97F4A7C15

#: What parts words: all but letters and the marks on them.  It goes before the worker, where then every byte of a longer character is a letter's.
GAP = r"[^\p{L}\p{M}]+"
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_pieces(path: str) -> list[bytes]:
    """The vocabulary's pieces of lower-case letters without their word marks, and all single bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {bytes([b]) for b in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            piece = model.id_to_piece(i).lstrip("▁")
            if piece.isalpha() and piece == piece.lower():
                found.add(piece.encode())
    return sorted(found)


def string_hashes(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Polynomial hashes of byte strings padded to one width; the length counts."""
    with np.errstate(over="ignore"):
        used = np.arange(rows.shape[1]) < sizes[:, None]
        terms = (rows.astype(np.uint64) + np.uint64(1)) * powers(BASE, rows.shape[1])
        return np.where(used, terms, 0).sum(axis=1, dtype=np.uint64)


def padded(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(s) for s in strings], np.int64)
    out = np.zeros((len(strings), int(sizes.max(initial=1))), np.uint8)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(strings), np.uint8)
    return out, sizes


class Vocabulary:
    """Finds pieces by the hashes of byte strings, in two gathers."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        rows, sizes = padded(pieces)
        self.hashes = mix(string_hashes(rows, sizes))
        if len(np.unique(self.hashes)) < len(pieces):
            raise ValueError("two pieces share a hash")
        self.sorted = np.argsort(self.hashes)
        self.table = self.hashes[self.sorted]
        top = (self.table >> np.uint64(46)).astype(np.int64)
        self.begin = np.searchsorted(top, np.arange(1 << 18)).astype(np.int32)  # pieces whose hashes begin alike: one or none as a rule
        self.most = int(np.bincount(top).max())

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The index of each hash's piece, or -1."""
        with np.errstate(over="ignore"):
            hashes = mix(hashes)
        at = self.begin[(hashes >> np.uint64(46)).astype(np.int64)]
        out = np.full(len(hashes), -1)
        for k in range(self.most):
            to = np.minimum(at + k, len(self.table) - 1)
            hit = self.table[to] == hashes
            out[hit] = self.sorted[to[hit]]
        return out


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    return _VOCABULARIES.get(path) or _VOCABULARIES.setdefault(path, Vocabulary(read_pieces(path)))


def lattice(rows: np.ndarray, sizes: np.ndarray, vocab: Vocabulary) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each end and length: the strings in which a piece of this length ends there, and the pieces; few strings take many ends at once."""
    power = powers(BASE, rows.shape[1] + 1)
    inverse = powers(pow(BASE, -1, 1 << 64), rows.shape[1] + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros((len(rows), rows.shape[1] + 1), np.uint64)
        np.cumsum((rows.astype(np.uint64) + np.uint64(1)) * power[: rows.shape[1]], axis=1, out=sums[:, 1:])
        step = max(1, 8192 // max(len(rows), 1))
        for first in range(1, rows.shape[1] + 1, step):
            ends, hits = np.arange(first, min(first + step, rows.shape[1] + 1)), []
            row, at = np.nonzero(sizes[:, None] >= ends)
            at = ends[at]
            for n in range(1, min(int(ends[-1]), vocab.longest) + 1):
                here, end = (row, at) if n <= first else (row[at >= n], at[at >= n])
                piece = vocab.find((sums[here, end] - sums[here, end - n]) * inverse[end - n])
                hit = piece >= 0
                if hit.any():
                    hits.append((end[hit], np.full(int(hit.sum()), n), here[hit], piece[hit]))
                    if step == 1:
                        yield first, n, *hits.pop()[2:]
            if hits:
                end, n, here, piece = map(np.concatenate, zip(*hits, strict=True))
                order = np.argsort(end, kind="stable")  # by n already
                end, n, here, piece = end[order], n[order], here[order], piece[order]
                cuts = np.flatnonzero((np.diff(end) != 0) | (np.diff(n) != 0)) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(end)], strict=True):
                    yield int(end[a]), int(n[a]), here[a:b], piece[a:b]


def forward(rows: np.ndarray, sizes: np.ndarray, vocab: Vocabulary, chances: np.ndarray) -> np.ndarray:
    """Probability of each prefix of each string, over all segmentations: strings x (width + 1) x languages."""
    alpha = np.zeros((len(rows), rows.shape[1] + 1, chances.shape[1]))
    alpha[:, 0] = 1
    for end, n, where, piece in lattice(rows, sizes, vocab):
        alpha[where, end] += alpha[where, end - n] * chances[piece]
    return alpha


def log_forward(rows: np.ndarray, sizes: np.ndarray, vocab: Vocabulary, chances: np.ndarray) -> np.ndarray:
    """Logarithm of forward's probability of each whole string, from a window as long as the longest piece: strings x languages."""
    logs, span = np.log(chances), vocab.longest + 1
    alpha = np.full((len(rows), span, chances.shape[1]), -np.inf)
    alpha[:, 0] = 0
    for end, n, where, piece in lattice(rows, sizes, vocab):
        more = alpha[where, (end - n) % span] + logs[piece]
        # each byte is a piece, so n = 1 comes first and for all strings; those that have ended keep their last sum
        alpha[where, end % span] = more if n == 1 else np.logaddexp(alpha[where, end % span], more)
    return alpha[np.arange(len(rows)), sizes % span]


def plain_bytes(chances: np.ndarray) -> int:
    """Of words of so many bytes at most, no sum can be too small for a double: it is at least the product of their bytes' chances."""
    least = chances.min()
    return RUN if least >= 1 else min(RUN, int(290 / -np.log10(least)))


def passes(sizes: np.ndarray, plain: int = RUN) -> Iterator[np.ndarray]:
    """All strings by their sizes, in parts for one pass each; none has strings of plain bytes at most and longer ones."""
    order = np.argsort(sizes, kind="stable")
    short, at = int((sizes <= plain).sum()), 0
    while at < len(order):
        to = min(at + WORDS, short if at < short else len(order))
        if at >= short:
            to = at + max(1, int((np.arange(1, to - at + 1) * sizes[order[at:to]] <= CELLS).sum()))
        yield order[at:to]
        at = to


def word_logs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, vocab: Vocabulary, chances: np.ndarray) -> np.ndarray:
    """Logarithm of the sum over all segmentations of each word of data: words x languages."""
    logs, plain = np.zeros((len(sizes), chances.shape[1])), plain_bytes(chances)
    for some in passes(sizes, plain):
        own, columns = sizes[some], np.arange(int(sizes[some].max()))
        rows = np.where(columns < own[:, None], data[np.minimum(starts[some, None] + columns, len(data) - 1)], 0)
        if len(columns) > plain:
            logs[some] = log_forward(rows, own, vocab, chances)
        else:
            logs[some] = np.log(forward(rows, own, vocab, chances)[np.arange(len(some)), own])
    return logs


def expected(width: np.ndarray, n: np.ndarray, edges: list[tuple[int, int, np.ndarray, np.ndarray]], now: np.ndarray) -> np.ndarray:
    """How often each piece is expected in strings that occur n times, in logarithms, given their lattice."""
    logs, last = np.log(now), np.arange(len(width))
    alpha, beta = (np.full((len(width), int(width.max()) + 1), -np.inf) for _ in range(2))
    alpha[:, 0] = 0
    beta[last, width] = 0
    for end, m, where, piece in edges:
        alpha[where, end] = np.logaddexp(alpha[where, end], alpha[where, end - m] + logs[piece])
    for end, m, where, piece in reversed(edges):
        beta[where, end - m] = np.logaddexp(beta[where, end - m], beta[where, end] + logs[piece])
    total, seen = alpha[last, width], np.zeros(len(now))
    for end, m, where, piece in edges:
        np.add.at(seen, piece, np.exp(alpha[where, end - m] + logs[piece] + beta[where, end] - total[where]) * n[where])
    return seen


def maximised(words: list[bytes], counts: list[int], vocab: Vocabulary, start: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The pieces' chances after rounds of expectation maximisation over words that occur so often."""
    chunks, held = [], sum(map(len, words)) <= HELD
    for some in passes(np.array([len(w) for w in words], np.int64)):
        rows, width = padded([words[w] for w in some])
        chunks.append((rows, width, np.array([counts[w] for w in some], float), list(lattice(rows, width, vocab)) if held else None))
    now = start.copy()
    for _ in range(rounds):
        seen, plain = np.zeros(len(vocab.pieces)), plain_bytes(now)
        for rows, width, n, edges in chunks:
            edges = edges if held else list(lattice(rows, width, vocab))
            if rows.shape[1] > plain:
                seen += expected(width, n, edges, now)
                continue
            alpha, beta = np.zeros((len(rows), rows.shape[1] + 1)), np.zeros((len(rows), rows.shape[1] + 1))
            alpha[:, 0] = 1
            beta[np.arange(len(rows)), width] = 1
            for end, m, where, piece in edges:
                alpha[where, end] += alpha[where, end - m] * now[piece]
            for end, m, where, piece in reversed(edges):
                beta[where, end - m] += beta[where, end] * now[piece]
            share = n / alpha[np.arange(len(rows)), width]
            for end, m, where, piece in edges:
                seen += np.bincount(piece, alpha[where, end - m] * now[piece] * beta[where, end] * share[where], len(seen))
        now = (seen + PSEUDO) / (seen.sum() + PSEUDO * len(seen))
    return now


def distinct_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and distinct word of each word of the rows; where the distinct words start, and their sizes."""
    inside = LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    _, first, word = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    return np.searchsorted(offsets, starts, "right") - 1, word, starts[first], (ends - starts)[first]


@dataclass
class Model:
    languages: list[str]
    chances: np.ndarray  # pieces x languages
    priors: np.ndarray


def lowered(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text in lower case with a space for all that is no letter, and more."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_replace(F.lower("text"), GAP, " ").alias("text"), *more)


def first_chances(vocab: Vocabulary) -> np.ndarray:
    """Before training: longer pieces are likelier."""
    start = np.array([4.0 ** min(len(p), 6) for p in vocab.pieces])
    return start / start.sum()


def train(docs: DataFrame, known: DataFrame, vocabulary_file: str | None = None, most_texts: int = MOST_TEXTS) -> Model:
    """Piece probabilities of each language by expectation maximisation over whole texts.

    known: doc_id, lang; rows with a null in either don't count, and of several languages of one doc_id the first by name does.
    most_texts documents of each language at most, in the order of a hash of doc_id, of all languages.  Spark counts their
    words and deals them by language; a task fits one language's model and the driver gets its chances, 8 bytes a piece (some
    250 kB).  Without any row the model knows no language.
    """
    path = vocabulary_file or vocabulary_path()
    known = known.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("lang").alias("lang"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, 0)), np.zeros(0))
    # the first of each language; hashes that are far beyond them, by the language's number of documents, need not be sorted
    shares = {lang: min(1.0, (most_texts + 10 * most_texts**0.5 + 100) / n) for lang, n in sizes.items()}
    ends = {lang: 2**63 - 1 if share == 1 else int(share * 2.0**64) - 2**63 for lang, share in shares.items()}
    last = F.create_map(*[x for lang, end in ends.items() for x in (F.lit(lang), F.lit(end).cast("long"))])
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    near = known.where(F.xxhash64("doc_id") <= F.try_element_at(last, F.col("lang")))
    chosen = near.withColumn("place", place).where(F.col("place") <= most_texts).select("doc_id", "lang")

    codes = {lang: k for k, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                langs = part.column(2).to_pylist()
                data, offsets = text_buffers(part.column(1))
                row, word, starts, width = distinct_words(data, offsets)
                code = np.array([codes[x] for x in langs])[row] if len(row) else row
                both, n = np.unique(word * len(languages) + code, return_counts=True)
                names = [data[starts[w] : starts[w] + width[w]].tobytes() for w in both // len(languages)]
                yield pa.record_batch([pa.array(both % len(languages), pa.int32()), pa.array(names, pa.binary()), pa.array(n, pa.int64())], names=["code", "word", "n"])

    texts = lowered(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "lang")  # most_texts ids of each language at most
    counted = texts.mapInArrow(count, "code int, word binary, n long").groupBy("code", "word").agg(F.sum("n").alias("n"))

    def fit(key: tuple, rows: pa.Table) -> pa.Table:
        forget()
        rows = rows.sort_by("word")  # sums don't depend on who sent what first
        own = vocabulary(path)
        found = maximised(rows.column("word").to_pylist(), rows.column("n").to_pylist(), own, first_chances(own))
        return pa.table({"code": pa.array([key[0].as_py()], pa.int32()), "chances": pa.array([found.tobytes()], pa.binary())})

    vocab = vocabulary(path)
    chances = np.repeat(first_chances(vocab)[:, None], len(languages), axis=1)
    for row in counted.groupBy("code").applyInArrow(fit, "code int, chances binary").toLocalIterator():
        chances[:, row["code"]] = np.frombuffer(row["chances"])
    total = sum(sizes.values())
    return Model(languages, chances, np.array([sizes[x] / total for x in languages]))


def predict(docs: DataFrame, model: Model, vocabulary_file: str | None = None) -> DataFrame:
    """doc_id, lang_pred and score (the language's posterior, 0 to 1) of each whole text.

    A text's probability is the product over its words (runs of letters and marks, lower-cased) of the forward sum
    over all segmentations.  A null text, one without a letter, or a model without languages gives und and 0.  Of equal posteriors the
    first language by name is taken.  A text of any length is read whole, by one task; rows stay one for one; an empty table gives an empty result.
    """
    path = vocabulary_file or vocabulary_path()
    languages, chances, priors = model.languages, model.chances, model.priors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        vocab = vocabulary(path)
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_buffers(part.column(1))
                row, word, starts, sizes = distinct_words(data, offsets)
                total = np.tile(np.log(priors), (part.num_rows, 1))
                for a in range(0, len(languages), AT_ONCE):
                    logs = word_logs(data, starts, sizes, vocab, chances[:, a : a + AT_ONCE])
                    for k in range(logs.shape[1]):
                        total[:, a + k] += np.bincount(row, logs[word, k], part.num_rows)
                total -= total.max(axis=1, keepdims=True)
                best = total.argmax(axis=1)
                score = 1 / np.exp(total).sum(axis=1)
                yield pa.record_batch([part.column(0), pa.array([languages[b] for b in best], pa.string()), pa.array(score, pa.float64()), part.column(2)], names=["doc_id", "lang_pred", "score", "letter"])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")
    if not languages:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    out = lowered(docs, lettered).mapInArrow(run, "doc_id long, lang_pred string, score double, letter boolean")
    return out.select("doc_id", F.when(F.col("letter"), F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(F.col("letter"), F.col("score")).otherwise(0.0).alias("score"))
