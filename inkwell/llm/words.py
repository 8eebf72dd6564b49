"""Words, lines and hashes of whole texts, vectorised over Arrow buffers.

A word is a maximal run of bytes other than ASCII white space (``[^\\x20\\x09-\\x0D]+``).  UTF-8
never uses those bytes inside a longer character, so bytes can be cut without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes hashed at a time; bounds the working memory whatever a text's length.
SEGMENT = 1 << 20
#: Odd multipliers of the two word hashes and of the two rolling window hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
ROLL = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)

#: What operators keep in a worker beyond a task; each is emptied where a task needs the room.
KEPT: list[dict] = []


def kept() -> dict:
    KEPT.append({})
    return KEPT[-1]


def forget() -> None:
    for held in KEPT:
        held.clear()


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base and of its inverse modulo 2**64, at least n of each."""
    have, n = _TABLES.get(base), max(n, SEGMENT + 2)
    if have is None or len(have[0]) < n:
        have = _TABLES[base] = (powers(base, n), powers(pow(base, -1, 1 << 64), n))
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, one after another, and the rows' offsets; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the number of words before it (length rows + 1)."""
    inside = ~SPACE[data]
    before = np.zeros(len(data), bool)
    after = np.zeros(len(data), bool)
    if len(data):
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        filled = offsets[:-1] < offsets[1:]
        before[offsets[:-1][filled]] = False
        after[offsets[1:][filled] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """A mixed polynomial hash of each span of bytes; spans are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            origin = starts[at]
            to = max(at + 1, int(np.searchsorted(ends, origin + SEGMENT, "right")))
            piece = data[origin : ends[to - 1]]
            total = np.uint64(0)
            if to == at + 1 and len(piece) > SEGMENT:  # one very long word
                power, _ = power_tables(base, SEGMENT)
                for i in range(0, len(piece), SEGMENT):
                    part = piece[i : i + SEGMENT].astype(np.uint64) + np.uint64(1)
                    total += np.uint64(pow(base, i, 1 << 64)) * (part * power[: len(part)]).sum(dtype=np.uint64)
                out[at] = total
            else:
                power, inverse = power_tables(base, len(piece) + 1)
                sums = np.zeros(len(piece) + 1, np.uint64)
                np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * power[: len(piece)], out=sums[1:])
                a, b = starts[at:to] - origin, ends[at:to] - origin
                out[at:to] = (sums[b] - sums[a]) * inverse[a]
            at = to
        return mix(out ^ (ends - starts).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def window_hashes(words: np.ndarray, counts: np.ndarray, k: int, roll: int = ROLL[0]) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of all windows of k words, row by row, and the number of windows of each row.

    counts: words of each row.  The hash of words i .. i+k-1 is sum(w[i+j] * roll**j), got from the
    one before by taking out the first word and adding the next: as prefix sums, so in one pass.
    """
    windows = np.maximum(counts - k + 1, 0)
    if not windows.sum():
        return np.zeros(0, np.uint64), windows
    with np.errstate(over="ignore"):
        n = len(words)
        out = np.zeros(n - k + 1, np.uint64)
        factor = 1
        for j in range(k):
            out += words[j : n - k + 1 + j] * np.uint64(factor)
            factor = factor * roll & 0xFFFFFFFFFFFFFFFF
        out = mix(out)
    first = np.cumsum(counts) - counts
    keep = np.repeat(first - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    return out[keep], windows


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about limit bytes at most (a longer row comes alone)."""
    if not batch.num_rows:
        return
    _, offsets = text_buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
