"""Toxicity: a linear classifier learnt from toxic examples and unlabelled text (non-negative PU learning)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.shared import numbered, saved
from inkwell.llm.words import LOWER, forget, slices, span_hashes, text_buffers

#: Buckets of hashed features; bounds what a model can hold.
BUCKETS = 1 << 20
#: A word counts as itself and by its beginnings of so many bytes: inflected and compounded words share them.
BEGINNINGS = (4, 5)
#: Most toxic examples and most unlabelled texts that are learnt from, taken in the order of a hash of doc_id.
MOST_TOXIC, MOST_UNLABELLED = 2_000, 6_000
#: Features that tell the two samples apart best; all others weigh nothing.  A bound on what the driver gets: the least strength leaves fewer as a rule.
FEATURES = 512

SCORED = "doc_id long, score double"

#: What a word is here: letters, digits and all bytes of longer characters.
INSIDE = np.zeros(256, bool)
INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each word of the rows, and of each longer word's beginnings."""
    inside = INSIDE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    row, data = np.searchsorted(offsets, starts, "right") - 1, LOWER[data]
    rows, hashes = [row], [span_hashes(data, starts, ends)]
    for n in BEGINNINGS:
        longer = ends - starts > n
        rows.append(row[longer])
        hashes.append(span_hashes(data, starts[longer], starts[longer] + n) + np.uint64(n))
    return np.concatenate(rows), (np.concatenate(hashes) % np.uint64(BUCKETS)).astype(np.int64)


def word_sets(docs: DataFrame) -> DataFrame:
    """doc_id and the buckets of its distinct words, as little-endian 32-bit integers, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_buffers(part.column(1))
                row, bucket = hashed_words(data, offsets)
                both = np.unique(row * BUCKETS + bucket)
                cuts = np.searchsorted(both, np.arange(1, part.num_rows) * BUCKETS)
                sets = [x.astype("<u4").tobytes() for x in np.split(both % BUCKETS, cuts)]
                yield pa.record_batch([part.column(0), pa.array(sets, pa.binary())], names=["doc_id", "words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, words binary")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def presence(rows: list[bytes], width: int) -> np.ndarray:
    """A row of 0 and 1 for each row's columns, which are 16-bit integers."""
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, np.frombuffer(r, "<u2")] = 1
    return out


def risk(w: np.ndarray, b: float, toxic: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """prior * L(toxic, +), L(unlabelled, -) - prior * L(toxic, -), and the gradients of both by w and b; L: the mean sigmoid loss.

    The second part estimates the loss on clean text: all text's less the toxic share of it, which may turn out negative.
    """

    def slope(x: np.ndarray, sign: float) -> tuple[float, np.ndarray]:
        """Mean of the loss sigmoid(-sign * g) and its gradient."""
        loss = sigmoid(-sign * (x @ w + b))
        d = -sign * loss * (1 - loss) / len(x)
        return loss.mean(), np.append(d @ x, d.sum())

    (lp, up), (ln, down), (lu, away) = slope(toxic, 1), slope(toxic, -1), slope(unlabelled, -1)
    return prior * lp, lu - prior * ln, prior * up, away - prior * down


def fit(toxic: np.ndarray, unlabelled: np.ndarray, start: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise prior * L(toxic, +) + max(0, L(unlabelled, -) - prior * L(toxic, -)).

    If the second part turns negative, the step goes against its gradient instead (Kiryo and others, 2017).
    start: the signs of the weights at the beginning.
    """
    w, b = 3 * start, -2.0  # not zero: the sigmoid loss is flat for what scores far below 0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        _, clean, up, other = risk(w, b, toxic, unlabelled, prior)
        gradient = up + other if clean >= 0 else -other
        gradient[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def telling(sets: DataFrame, toxic: int, unlabelled: int) -> DataFrame:
    """bucket and sign of the FEATURES buckets whose share of texts differs most, in standard errors, between the samples: by more than 4, and in 5 texts at least.

    sets: words, p and u (1: of the toxic or the unlabelled sample); toxic, unlabelled: rows of each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [np.frombuffer(x, "<u4") for x in batch.column(0).to_pylist()]
            if words:
                counts = [np.repeat(batch.column(k).to_numpy(), [len(x) for x in words]) for k in (1, 2)]
                bucket, at = np.unique(np.concatenate(words).astype(np.int64), return_inverse=True)
                yield pa.record_batch([pa.array(bucket), *(pa.array(np.bincount(at, c, len(bucket)).astype(np.int64)) for c in counts)], names=["bucket", "p", "u"])

    counted = sets.select("words", "p", "u").mapInArrow(run, "bucket long, p long, u long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    both = (F.col("p") + F.col("u")) / (toxic + unlabelled)
    apart = F.col("p") / toxic - F.col("u") / unlabelled
    strength = F.abs(apart) / (F.sqrt(both * (1 - both) * (1 / toxic + 1 / unlabelled)) + 1e-12)
    told = counted.where("p + u >= 5").select("bucket", F.signum(apart).alias("sign"), strength.alias("strength")).where("strength > 4")
    return told.orderBy(F.desc("strength"), "bucket").limit(FEATURES).select("bucket", "sign")


def train(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_unlabelled: int = MOST_UNLABELLED) -> Model:
    """Learn from labelled documents that are not held out.

    Toxic: rows with toxic = 1. Unlabelled: rows of labels whatever they say, their labels not read,
    but for the class prior, the share of toxic rows; so labels should be of documents drawn at random.  Both samples are bounded by the
    parameters, their texts count whole.  Words are counted in Spark; the driver gets FEATURES buckets and, for each text of the
    samples, which of them it holds: FEATURES * 2 bytes a text at most.

    Labels without a doc_id or a value, or of missing documents, don't count; of repeated labels of one document the largest counts, and rows
    of one doc_id are texts of their own.  Without toxic rows, or from empty tables, the model calls nothing toxic.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    prior = known.agg(F.avg("toxic")).first()[0] or 0.0
    order = F.xxhash64("doc_id")
    some = known.where("toxic = 1").orderBy(order).limit(most_toxic).select("doc_id", F.lit(1).alias("kind"))
    some = some.unionAll(known.orderBy(order).limit(most_unlabelled).select("doc_id", F.lit(0).alias("kind")))
    kinds = some.groupBy("doc_id").agg(F.max("kind").alias("p"), (1 - F.min("kind")).alias("u"))
    chosen = docs.select("doc_id", "text").join(F.broadcast(kinds.select("doc_id")), "doc_id", "left_semi")  # most_toxic + most_unlabelled ids at most
    sets = saved(word_sets(chosen).join(F.broadcast(kinds), "doc_id"))
    sizes = sets.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("p"), F.coalesce(F.sum("u"), F.lit(0)).alias("u")).first()
    weights = np.zeros(BUCKETS, np.float32)
    if not sizes["p"] or not sizes["u"]:
        return Model(weights, -5.0)
    features = sorted(telling(sets, sizes["p"], sizes["u"]).collect())
    buckets = np.array([r["bucket"] for r in features], np.int64)

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.flatnonzero(np.isin(buckets, np.frombuffer(x, "<u4"))).astype("<u2").tobytes() for x in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array(held, pa.binary()), batch.column(1), batch.column(2)], names=["held", "p", "u"])

    rows = sets.select("words", "p", "u").mapInArrow(columns, "held binary, p int, u int").collect()
    toxic, unlabelled = (presence(sorted(r["held"] for r in rows if r[kind]), len(features)) for kind in ("p", "u"))
    w, b = fit(toxic, unlabelled, np.array([r["sign"] for r in features]), prior)
    weights[buckets] = w
    return Model(weights, b)


def scorer(model: Model):
    """A function of a column of texts that gives their scores."""
    chosen = np.flatnonzero(model.weights)
    values, bias = model.weights[chosen].astype(float), model.bias

    def run(column: pa.Array) -> np.ndarray:
        weigh = np.zeros(BUCKETS)
        weigh[chosen] = values
        data, offsets = text_buffers(column)
        row, bucket = hashed_words(data, offsets)
        counts = weigh[bucket] != 0
        both = np.unique(row[counts] * BUCKETS + bucket[counts])
        return sigmoid(np.bincount(both // BUCKETS, weigh[both % BUCKETS], len(column)) + bias)

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, 0 to 1, of each whole text, whatever its length; only its words count, each once.

    A null or empty text scores by the bias alone; rows stay one for one, equal texts score alike; an empty table gives an empty result.
    """
    of = scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.record_batch([part.column(0), pa.array(of(part.column(1)), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORED)


def below(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows of docs, all columns whatever their names, whose text scores below the threshold; cases as for score()."""
    of, given, at = scorer(model), docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part in slices(batch, f"c{at}"):
                yield pa.RecordBatch.from_arrays(part.filter(pa.array(of(part.column(at)) < threshold)).columns, names=given)

    return numbered(docs).mapInArrow(run, docs.schema)
