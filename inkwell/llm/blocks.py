"""Whether, where first and how often a 64-bit hash occurs in the corpus, without a row per hash.

Documents are dealt to blocks, by ranges of their id where their order counts, else by a hash.  A block sorts its hashes, keeps each once and
sends them to buckets as packed deltas (about 6 bytes a hash); a bucket merges what all blocks sent and
answers each with a byte string, one code per hash in the same order.  So a hash that a third of all
rows share costs one entry per block, the answer needs no keys, and the text is dealt out only once
(both passes read one exchange).  The bucket is taken from a second, independent hash, so two different
items are taken for one only if 64 bits and the bucket agree: with B buckets and n items about
n**2 / (B * 2**65) pairs, below one at 10**13 items in 10**7 buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.shared import tasks, text_size
from inkwell.llm.words import forget

#: Text bytes of a block and hashes of a bucket: some hundred MB of a worker's memory at most.
BLOCK_BYTES = 8 << 20
BUCKET_ITEMS = 2 << 20
#: Ranges of ids whose bounds the driver gets, about; a range is divided evenly if there are more blocks.
MOST_RANGES = 1 << 16
#: Bytes of text for each hash, about a word.
ITEM_BYTES = 6

SENT = "bucket int, block int, n int, width int, first long, packed binary, counts binary"
ANSWER = "block int, bucket int, codes binary"


#: Bytes that a row counts as besides its text.
ROW_BYTES = 64


def ladder(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are <= value, all of them long: a binary search as one expression."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    table = F.lit(bounds).cast("array<long>")

    def step(at: Column, by: Column) -> Column:
        to = at + by
        return F.when((to <= len(bounds)) & (F.try_element_at(table, F.least(to, F.lit(len(bounds)))) <= value), to).otherwise(at)

    return F.aggregate(F.lit(steps), F.lit(0), step)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and t, a hash of the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t"))


def hash_part(t: Column, parts: Column | int) -> Column:
    """0 .. parts - 1, ascending with the hash."""
    return F.least(F.floor((t.cast("double") / 2.0**64 + 0.5) * parts), F.lit(parts) - 1 if isinstance(parts, int) else parts - 1).cast("long")


def scattered(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """keyed() and block, by a hash of id and text, for what needs no order; bytes of text.

    So neither one id nor rows without an id meet in one block; equal rows do.
    """
    _, size = text_size(docs)
    n = max(1, -(-size // block_bytes))
    return keyed(docs).withColumn("block", F.pmod(F.xxhash64("t", "doc_id"), F.lit(n)).cast("int")), size


def range_edges(sized: DataFrame, block_bytes: int) -> list[tuple[int, int]]:
    """Ids, ascending, at which ranges of about block_bytes begin, and for an id of more bytes than that how many; from sized: doc_id, size, not null.

    Ids are added up, dealt by ranges and sorted; each task cuts its own where the bytes are full, so the driver gets a row for each range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = -1
        for batch in batches:
            ids, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            total = np.concatenate([[0], np.cumsum(sizes)])
            large = np.append(np.flatnonzero(sizes > block_bytes), len(ids))
            out: list[tuple[int, int]] = []
            i = 0
            while i < len(ids):
                if sizes[i] > block_bytes:
                    out.append((int(ids[i]), int(sizes[i])))
                    i, room = i + 1, -1
                    continue
                if room < sizes[i]:
                    out.append((int(ids[i]), 0))
                    room = block_bytes
                j = min(int(np.searchsorted(total, total[i] + room, "right")) - 1, int(large[np.searchsorted(large, i)]))
                room -= int(total[j] - total[i])
                i = j
            yield pa.record_batch([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["edge", "size"])

    ids = sized.groupBy("doc_id").agg(F.sum("size").alias("size"))
    ranges = ids.repartitionByRange(tasks(sized.sparkSession), "doc_id").sortWithinPartitions("doc_id").mapInArrow(run, "edge long, size long").toArrow()
    return sorted(zip(ranges.column("edge").to_pylist(), ranges.column("size").to_pylist(), strict=True))


def blocked(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """keyed() and block, ascending with doc_id (null first), then t; bytes of text.

    Ranges of doc_id have about block_bytes each, up to MOST_RANGES of them; beyond, a range is divided evenly by id.  An id
    that has more, and null ids by their bytes, get blocks of their own, dealt by t.  Equal rows meet in one block.  Ids are compared as integers.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    weight = F.col("size") + ROW_BYTES
    row = sized.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum(weight), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), weight)), F.lit(0)).alias("nulls"), F.max("doc_id").alias("z")).first()
    if row["all"] <= block_bytes:
        return keyed(docs).withColumn("block", F.lit(0)), row["size"]
    nulls = max(1, -(-row["nulls"] // block_bytes))
    null_block = hash_part(F.col("t"), nulls)
    if row["z"] is None:
        return keyed(docs).withColumn("block", null_block.cast("int")), row["size"]
    each = -(-row["all"] // (block_bytes * MOST_RANGES))
    found = range_edges(sized.where("doc_id is not null").select("doc_id", weight.alias("size")), block_bytes * each)
    edges = [edge for edge, _ in found]
    own = [-(-size // block_bytes) for _, size in found]  # blocks of the edge's id alone
    first = [nulls, *(nulls + k for k in accumulate(max(n, each) for n in own))][: len(own)]
    of = lambda values: F.element_at(F.lit(values), F.col("at"))
    block = of(first)
    if any(own):
        block = block + F.when(of(own) > 0, hash_part(F.col("t"), F.greatest(of(own), F.lit(1)))).otherwise(0)
    if each > 1:  # doubles, which keep the order of ids, if not all differences
        low, high = (of([float(e) for e in x]) for x in (edges, [*edges[1:], row["z"]]))
        share = F.floor((F.col("doc_id").cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * each)
        block = block + F.when(of(own) > 0, 0).otherwise(F.greatest(F.least(share, F.lit(each - 1)), F.lit(0)))
    at = F.coalesce(ladder(F.col("doc_id"), edges), F.lit(1))
    return keyed(docs).withColumn("at", F.greatest(at, F.lit(1))).withColumn("block", F.when(F.col("doc_id").isNull(), null_block).otherwise(block).cast("int")).drop("at"), row["size"]


def in_order(rows: pa.Table) -> pa.Table:
    """By doc_id, a null first; rows of one doc_id by the hash of their text."""
    return rows.take(pc.sort_indices(rows, sort_keys=[("doc_id", "ascending"), ("t", "ascending"), ("text", "ascending")], null_placement="at_start"))


def ranked(hashes: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the items by bucket and hash, and the places there where another item begins."""
    order = np.argsort(hashes)
    order = order[np.argsort(buckets[order], kind="stable")]
    h, b = hashes[order], buckets[order]
    return order, np.flatnonzero(np.concatenate([np.ones(min(len(h), 1), bool), (h[1:] != h[:-1]) | (b[1:] != b[:-1])]))


def bucket_of(second: np.ndarray, buckets: int) -> np.ndarray:
    return ((second >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)


def send(block: int, hashes: np.ndarray, buckets: np.ndarray, counts: np.ndarray | None) -> pa.Table:
    """Rows of SENT; hashes: sorted in each bucket, none twice; counts: how often each occurs in the block, 255 for more, which is enough to rank by."""
    cuts = np.flatnonzero(np.concatenate([np.ones(min(len(buckets), 1), bool), buckets[1:] != buckets[:-1]]))
    rows: dict[str, list] = {name.split()[0]: [] for name in SENT.split(", ")}
    for a, b in zip(cuts, [*cuts[1:], len(hashes)], strict=True):
        own = hashes[a:b]
        gaps = np.diff(own)
        width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
        rows["bucket"].append(int(buckets[a]))
        rows["block"].append(block)
        rows["n"].append(len(own))
        rows["width"].append(width)
        rows["first"].append(int(own[:1].view(np.int64)[0]))
        rows["packed"].append(np.ascontiguousarray(gaps).view(np.uint8).reshape(-1, 8)[:, :width].tobytes())
        rows["counts"].append(None if counts is None else np.minimum(counts[a:b], 255).astype(np.uint8).tobytes())
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.table({k: pa.array(v, kind) for (k, v), kind in zip(rows.items(), kinds, strict=True)})


def unpack(n: int, width: int, first: int, packed: bytes) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    out[:1] = np.array([first], np.int64).view(np.uint64)
    out[1:].view(np.uint8).reshape(-1, 8)[:, :width] = np.frombuffer(packed, np.uint8).reshape(-1, width)
    return np.cumsum(out, dtype=np.uint64)


def gathered(rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's rows by block; all hashes, the row each came from, their order and where groups begin."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("block", "ascending")]))
    parts = [unpack(*x) for x in zip(*(rows.column(c).to_pylist() for c in ("n", "width", "first", "packed")), strict=True)]
    hashes = np.concatenate(parts)
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(x) for x in parts])
    order = np.argsort(hashes)
    h = hashes[order]
    return rows, hashes, owner, order, np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))


def replies(rows: pa.Table, codes: np.ndarray) -> pa.Table:
    cuts = np.cumsum(rows.column("n").to_numpy())[:-1]
    return pa.table({"block": rows.column("block").combine_chunks(), "bucket": rows.column("bucket").combine_chunks(), "codes": pa.array([x.tobytes() for x in np.split(codes, cuts)], pa.binary())})


def seen_before(rows: pa.Table) -> pa.Table:
    """Code 1 for a hash that an earlier block has as well, else 0."""
    rows, hashes, owner, order, cuts = gathered(rows)
    own = owner[order]
    first = np.minimum.reduceat(own, cuts)
    later = own > np.repeat(first, np.diff(np.append(cuts, len(own))))
    codes = np.zeros(len(hashes), np.uint8)
    codes[order] = later
    return replies(rows, codes)


def how_common(rows: pa.Table) -> pa.Table:
    """Code: the bit length of the hash's count over all blocks (1: it occurs once)."""
    rows, hashes, _, order, cuts = gathered(rows)
    counts = np.concatenate([np.frombuffer(x, np.uint8) for x in rows.column("counts").to_pylist()]).astype(np.int64)
    total = np.add.reduceat(counts[order], cuts)
    level = (np.floor(np.log2(total)) + 1).astype(np.uint8)
    codes = np.zeros(len(hashes), np.uint8)
    codes[order] = np.repeat(level, np.diff(np.append(cuts, len(hashes))))
    return replies(rows, codes)


def answered(docs: DataFrame, size: int, sender: Callable, reducer: Callable, finish: Callable, schema: str) -> DataFrame:
    """docs: of blocked() or scattered(). sender(rows, block, buckets) makes SENT; finish(rows, codes, buckets) the result.

    codes: a block's answers by bucket, so in the order in which ranked() has its items.
    """
    buckets = max(1, -(-size // (BUCKET_ITEMS * ITEM_BYTES)))

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        forget()
        return sender(in_order(rows.select(["doc_id", "text", "t"])), key[0].as_py(), buckets)

    def last(rows: pa.Table, answer: pa.Table) -> pa.Table:
        forget()
        answer = answer.take(pc.sort_indices(answer, sort_keys=[("bucket", "ascending")]))
        codes = np.frombuffer(b"".join(answer.column("codes").to_pylist()), np.uint8)
        return finish(in_order(rows.select(["doc_id", "text", "t"])), codes, buckets)

    sent = docs.groupBy("block").applyInArrow(pack, SENT)
    answer = sent.groupBy("bucket").applyInArrow(reducer, ANSWER)
    return docs.groupBy("block").cogroup(answer.groupBy("block")).applyInArrow(last, schema)
