"""Substring dedup: word windows that occur earlier in the corpus are cut out of later texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkwell.llm.blocks import answered, blocked, bucket_of, ranked, seen_before, send
from inkwell.llm.words import ROLL, slices, span_hashes, text_buffers, window_hashes, word_bounds

WINDOW = 20
SCHEMA = "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept string"


def all_windows(rows: pa.Table, k: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and bucket of each window of the rows, and each row's windows and words."""
    parts = []
    for batch in rows.combine_chunks().to_batches():
        for piece in slices(batch, "text"):
            data, offsets = text_buffers(piece.column("text"))
            starts, ends, before = word_bounds(data, offsets)
            words, counts = span_hashes(data, starts, ends), np.diff(before)
            h, windows = window_hashes(words, counts, k, ROLL[0])
            second, _ = window_hashes(words, counts, k, ROLL[1])
            parts.append((h, bucket_of(second, buckets), windows, counts))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(0, int), np.zeros(0, int)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def intervals(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Cut each word that a window covers whose words occur earlier as well.

    docs: doc_id long, text string; other columns are ignored.  Earlier: in a smaller doc_id, or in the
    same document at an earlier start; all windows are judged on the input.  Rabin-Karp hashes of every
    window are counted in Spark (see blocks.py); overlapping repeated windows merge into maximal
    intervals of words.  Returns SCHEMA, one row per input row; kept: the other words, joined by one space.

    A null, empty or blank text has no words and nothing removed.  A text shorter than the window is kept.
    A text of any length is read whole, by one task.  A null doc_id counts as smallest; rows of one doc_id, equal ones too, count in
    the order of a hash of their texts, each a document of its own.  An empty table gives an empty result.
    """

    def sender(rows: pa.Table, block: int, buckets: int) -> pa.Table:
        h, b, _, _ = all_windows(rows, window, buckets)
        order, cuts = ranked(h, b)
        at = order[cuts]
        return send(block, h[at], b[at], None)

    def finish(rows: pa.Table, codes: np.ndarray, buckets: int) -> pa.Table:
        h, b, windows, counts = all_windows(rows, window, buckets)
        order, cuts = ranked(h, b)
        repeated = np.ones(len(h), bool)
        if len(h):
            repeated[np.minimum.reduceat(order, cuts)] = codes.astype(bool)  # the block's first of each window
        at = np.cumsum(windows) - windows
        kept, starts, ends, removed, sizes = [], [], [], [], []
        text = rows.column("text").cast(pa.large_binary())
        where = np.flatnonzero(repeated)
        lo, hi = np.searchsorted(where, at), np.searchsorted(where, at + windows)
        for i, value in enumerate(text):
            words = (value.as_py() or b"").split()
            if lo[i] == hi[i]:
                kept.append(b" ".join(words))
                removed.append(0)
                sizes.append(0)
                continue
            hit = where[lo[i] : hi[i]] - at[i]
            edges = np.zeros(len(words) + 1, np.int64)
            np.add.at(edges, hit, 1)
            np.add.at(edges, hit + window, -1)
            covered = np.cumsum(edges)[:-1] > 0
            a, b_ = intervals(covered)
            starts.append(a)
            ends.append(b_)
            sizes.append(len(a))
            removed.append(int(covered.sum()))
            kept.append(b" ".join([words[j] for j in np.flatnonzero(~covered)]))
        spans = pa.StructArray.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (starts, ends)], ["start", "end"])
        return pa.table({
            "doc_id": rows.column("doc_id").cast(pa.int64()),
            "n_words": pa.array(counts, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "removed": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), spans),
            "kept": pa.array(kept, pa.binary()).cast(pa.string()),
        })

    rows, size = blocked(docs)
    return answered(rows, size, sender, seen_before, finish, SCHEMA)
