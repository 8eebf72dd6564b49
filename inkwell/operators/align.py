"""Exports read back: entries of a numbered text, and edited entries aligned with the original ones."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import spare
from inkwell.sources.stored import stored

#: Segments of a file that are aligned together, and lines of all files that one call of Python takes, about.
SEGMENTS, LINES = 64, 20_000

KINDS = ("same", "changed", "deleted", "inserted")


def numbered_entries(texts: DataFrame, by: Sequence[str], text: str = "text", mark: str = r"(?m)^\d+\. ", header: bool = False) -> DataFrame:
    """by, n (from 1, as they stand) and text of the entries of texts in which each begins with a mark, as styles.numbered_text() writes them.

    What stands before the first mark is a header: left out, or entry 0 where header is set.  The numbers in the marks are not
    trusted: an editor may have changed them.  The line end before a mark belongs to no entry.  A null text has no entry.
    """
    cut = F.split(F.regexp_replace(text, mark, "\x00"), "\x00", -1)
    rows = texts.select(*by, F.posexplode(cut).alias("n", "text")).where((F.col("n") > 0) | F.lit(header))
    return rows.withColumn("text", F.regexp_replace("text", r"\r?\n\z", ""))


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs in which both numbers grow; of several the one whose last numbers are least."""
    from bisect import bisect_left

    ends: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    pairs = sorted(pairs)
    for k, (_, j) in enumerate(pairs):
        place = bisect_left(ends, j)
        before[k] = at[place - 1] if place else -1
        ends[place : place + 1] = [j]
        at[place : place + 1] = [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, by rows of bits: a bit of a row is 0 where the length grows at that place of a.

    Each row is one whole number, so a row costs len(a) / 64 steps, and all are kept for the way back.
    """
    where: dict[str, int] = {}
    for i, line in enumerate(a):
        where[line] = where.get(line, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows, row = [], full
    for line in b:
        hit = row & where.get(line, 0)
        row = (row + hit | row - hit) & full
        rows.append(row)
    out, i, j = [], len(a) - 1, len(b) - 1
    while i >= 0 and j >= 0:
        if rows[j] >> i & 1:  # the length up to i is that up to i - 1
            i -= 1
        elif j and length(rows[j - 1], i, full) == length(rows[j], i, full):
            j -= 1
        else:
            out.append((i, j))
            i, j = i - 1, j - 1
    return out[::-1]


def files(rows: pa.Table, columns: Sequence[str]) -> dict[tuple[str, ...], list[int]]:
    """The places of each file's rows, in their order; a file is known by how its columns' values are written, so that NaN is one value."""
    out: dict[tuple[str, ...], list[int]] = defaultdict(list)
    for k, values in enumerate(zip(*(map(repr, rows.column(c).to_pylist()) for c in columns), strict=True) if columns else [()] * rows.num_rows):
        out[values].append(k)
    return out


def length(row: int, i: int, full: int) -> int:
    """Of the longest common subsequence up to place i, as a row has it."""
    return ((row ^ full) & ((2 << i) - 1)).bit_count()


def aligned(a: list[str], b: list[str]) -> list[tuple[int | None, int | None, str]]:
    """Places and kind of each entry; between two that are the same, deleted and inserted ones are paired as changed as far as they go."""
    out: list[tuple[int | None, int | None, str]] = []
    i = j = 0
    for x, y in [*common(a, b), (len(a), len(b))]:
        both = min(x - i, y - j)
        out += [(i + k, j + k, "changed") for k in range(both)]
        out += [(k, None, "deleted") for k in range(i + both, x)]
        out += [(None, k, "inserted") for k in range(j + both, y)]
        if x < len(a) or y < len(b):
            out.append((x, y, "same"))
        i, j = x + 1, y + 1
    return out


def align(original: DataFrame, edited: DataFrame, by: Sequence[str], order: str = "n", text: str = "text") -> DataFrame:
    """by, place, was, now, kind, text and edited: how each entry of edited came from the original ones of the same by (nulls are equal here).

    was and now: the entry's number among the original and the edited ones, in the order of order (ties by text), from 1.  kind is one of KINDS;
    place (from 1) is the order in which all stand.  A null text is one of its own kind of line, equal to other nulls.

    Lines that occur once on both sides are anchors; of those the longest chain that is in order on both sides stays, found from numbers
    alone.  It cuts a file into segments, of which only what is no anchor is aligned, each apart, by a longest common subsequence: SEGMENTS
    of a file at a time.  A by that one side lacks is all deleted or all inserted.  Python is called for about LINES lines at a time, of as many files as
    have them; the anchors that stay are stored, as both sides read them.
    """
    keys = spare([f"k{i}" for i in range(len(by))], [])

    def numbered(rows: DataFrame) -> DataFrame:
        own = rows.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(order).alias("n"), F.col(text).alias("t"))
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("n", "t")).cast("long")
        return own.select(*keys, place.alias("i"), "t")

    def once(rows: DataFrame, to: str) -> DataFrame:
        return rows.groupBy(*keys, "t").agg(F.count(F.lit(1)).alias("c"), F.min("i").alias(to)).where("c = 1").drop("c")

    a, b = numbered(original), numbered(edited)
    pairs = once(a, "i").unionByName(once(b, "j"), allowMissingColumns=True).groupBy(*keys, "t").agg(F.max("i").alias("i"), F.max("j").alias("j")).where("i is not null and j is not null").select(*keys, "i", "j")
    kinds = ", ".join(f"{k} {a.schema[k].dataType.simpleString()}" for k in keys)

    calls = max(1, -(-(original.count() + edited.count()) // LINES))
    bucket = lambda *also: F.pmod(F.xxhash64(F.lit(0), *keys, *also), F.lit(calls)).cast("int").alias("bucket")

    def chain(rows: pa.Table) -> pa.Table:
        i, j = rows.column("i").to_pylist(), rows.column("j").to_pylist()
        at, kept = [], []
        for own in files(rows, keys).values():
            found = increasing([(i[k], j[k]) for k in own])
            kept += found
            at += own[:1] * len(found)
        head = {k: rows.column(k).take(pa.array(at, pa.int64())) for k in keys}
        return pa.table(head | {"i": pa.array([x for x, _ in kept], pa.int64()), "j": pa.array([y for _, y in kept], pa.int64())})

    anchors = stored(pairs.select(bucket(), "*").groupBy("bucket").applyInArrow(chain, f"{kinds}, i long, j long"), "anchors")

    def segmented(rows: DataFrame, column: str, other: str) -> DataFrame:
        """rows with segment: how many anchors stand before or at each; an anchor, which opens its segment, has its place on the other side."""
        marks = anchors.select(*keys, F.col(column).alias("i"), F.col(other).alias("other"))
        both = rows.unionByName(marks, allowMissingColumns=True).groupBy(*keys, "i").agg(F.max("t").alias("t"), F.max("other").alias("other"))
        window = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
        return both.select(*keys, "i", "t", "other", F.count("other").over(window).alias("segment"))

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        """Segments of some files: what their anchors leave."""
        sides = []
        for rows in (left, right):
            rows = rows.sort_by("i")
            i, t = rows.column("i").to_pylist(), rows.column("t").to_pylist()
            sides.append({name: [(i[k], t[k]) for k in own] for name, own in files(rows, [*keys, "segment"]).items()})
        both = pa.concat_tables([left.select([*keys, "segment"]), right.select([*keys, "segment"])])
        out: list[tuple] = []
        places: list[int] = []
        for name, spots in files(both, [*keys, "segment"]).items():
            own, new = (side.get(name, []) for side in sides)
            segment = int(name[-1])
            for at, (i, j, kind) in enumerate(aligned([t for _, t in own], [t for _, t in new]), 1):
                out.append((segment, at, *((None, None) if i is None else own[i]), *((None, None) if j is None else new[j]), kind))
                places.append(spots[0])
        head = {k: both.column(k).take(pa.array(places, pa.int64())) for k in keys}
        kinds_ = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
        return pa.table(head | {n: pa.array([r[k] for r in out], kind) for k, (n, kind) in enumerate(zip(("segment", "at", "was", "text", "now", "edited", "kind"), kinds_, strict=True))})

    left, right = segmented(a, "i", "j"), segmented(b, "j", "i")
    same = left.where("other is not null").select(*keys, "segment", F.lit(0).cast("long").alias("at"), F.col("i").alias("was"), F.col("t").alias("text"), F.col("other").alias("now"), F.col("t").alias("edited"), F.lit("same").alias("kind"))
    rest = [rows.where("other is null").select(*keys, bucket(F.floor(F.col("segment") / SEGMENTS)), "segment", "i", "t") for rows in (left, right)]
    parts = [rows.groupBy("bucket") for rows in rest]
    done = same.unionByName(parts[0].cogroup(parts[1]).applyInArrow(settle, f"{kinds}, segment long, at long, was long, text string, now long, edited string, kind string"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("segment", "at"))
    return done.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], place.alias("place"), "was", "now", "kind", "text", "edited")


def applied(alignment: DataFrame, by: Sequence[str], accept: Column | None = None) -> DataFrame:
    """by, n and text: the edited entries where accept holds (everywhere, if not given), the original ones elsewhere, numbered anew."""
    take = F.coalesce(accept, F.lit(False)) if accept is not None else F.lit(True)
    kept = alignment.where(F.when(take, F.col("kind") != "deleted").otherwise(F.col("kind") != "inserted"))
    return kept.select(*by, F.row_number().over(Window.partitionBy(*by).orderBy("place")).alias("n"), F.when(take, F.col("edited")).otherwise(F.col("text")).alias("text"))
