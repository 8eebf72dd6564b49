"""Notes and the text they stand at: nearest matches along one axis by union, sort and windows, never by pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import spare
from inkwell.operators.exports import Entry, joined
from inkwell.operators.layout import PAGE
from inkwell.operators.order import dealt, tasks_for


def nearest(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, to: str, values: Sequence[str], reach: float | None = None, direction: str = "nearest", tasks: int | None = None) -> DataFrame:
    """left with the values of the row of right whose to is nearest to its at, among those with equal by (nulls are equal here).

    direction: nearest, backward (the last that is not after it) or forward (the first that is not before it).  Of two that are as near, that
    before it is taken; of several at one place, that with the smallest values.  Further than reach nothing matches, and a null at, or nothing to match, gives null values; a
    null to matches nothing.

    Both sides are put together, dealt by by to tasks (as many as their counted rows need, if not given) and sorted there and back; the last row of right that
    each window has seen is what a row of left can match, so the work is that of two sorts, however many rows are near or share a by.
    """
    if direction not in ("nearest", "backward", "forward"):
        raise ValueError("direction is nearest, backward or forward")
    where, side, row, value, last, following, pick = spare(["_where", "_side", "_row", "_value", "_last", "_next", "_pick"], [*by, *left.columns])
    packed = F.struct(F.col(to).cast("double").alias("to"), *[F.col(c) for c in values])
    a = left.select(*by, F.col(at).cast("double").alias(where), F.lit(1).alias(side), F.struct(*[F.col(c) for c in left.columns]).alias(row))
    b = right.where(F.col(to).isNotNull()).select(*by, F.col(to).cast("double").alias(where), F.lit(0).alias(side), packed.alias(value))
    both = dealt(a.unionByName(b, allowMissingColumns=True), by, tasks or tasks_for(left, right))
    # of several at one place the smallest is seen last either way; what is at the very place is seen on the way there, but not on the way back
    there = Window.partitionBy(*by).orderBy(F.asc_nulls_last(where), F.asc(side), F.desc(value))
    back_ = Window.partitionBy(*by).orderBy(F.desc_nulls_first(where), F.desc(side), F.desc(value))
    for to_, order in ((last, there), (following, back_)):
        both = both.withColumn(to_, F.last(value, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = both.where(F.col(side) == 1)
    back, fore = F.col(where) - F.col(last)["to"], F.col(following)["to"] - F.col(where)
    here = back == 0
    chosen = {
        "backward": F.col(last),
        "forward": F.when(here, F.col(last)).otherwise(F.col(following)),
        "nearest": F.when(fore.isNull() | (back <= fore), F.col(last)).otherwise(F.col(following)),
    }[direction]
    near = F.abs(F.col(pick)["to"] - F.col(where)) <= reach if reach is not None else F.lit(True)
    out = found.withColumn(pick, F.when(F.col(where).isNotNull(), chosen))
    kept = [c for c in left.columns if c not in values]
    return out.select(*[F.col(row)[c].alias(c) for c in kept], *[F.when(near, F.col(pick)[c]).alias(c) for c in values])


def note_styles(notes: DataFrame, runs: DataFrame, by: Sequence[str] = PAGE, values: Sequence[str] = ("font", "size"), reach: float | None = None, line_gap: float = 4.0, tasks: int | None = None) -> DataFrame:
    """notes with the font and size (values) of the run they stand at; columns of these names are written over.

    notes: by, x, y and any others; runs: of layout.style_runs(), whose x and y are their anchors.  Anchors whose y differ by no more than
    line_gap from one to the next are a line.  First the nearest line is sought, then the nearest anchor on it, across; reach bounds
    both.  A note without a place, on a page without runs, or out of reach has nulls.  tasks: as for nearest().
    """
    n = tasks or tasks_for(notes, runs)
    names = spare(["_line", "_low", "_high", "_back", "_fore", "_until", "_from"], [*notes.columns, *runs.columns])
    line, low, high, back, fore, until, begin = names
    kept = [c for c in notes.columns if c not in values]
    order = Window.partitionBy(*by).orderBy("y")
    anchored = dealt(runs.where(F.col("y").isNotNull()), by, n)
    fresh = anchored.withColumn(low, F.coalesce((F.col("y") - F.lag("y").over(order) > line_gap).cast("int"), F.lit(0)))
    numbered = fresh.withColumn(line, F.sum(low).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop(low)
    lines = numbered.groupBy(*by, line).agg(F.min("y").alias(low), F.max("y").alias(high))
    # lines lie apart, so the last that begins before a note and the next one are all that can be nearest
    placed = nearest(notes.select(*kept), lines.select(*by, low, F.col(line).alias(back), F.col(high).alias(until)), by, "y", low, [back, until], direction="backward", tasks=n)
    placed = nearest(placed, lines.select(*by, low, F.col(line).alias(fore), F.col(low).alias(begin)), by, "y", low, [fore, begin], direction="forward", tasks=n)
    above, below = F.greatest(F.col("y") - F.col(until), F.lit(0.0)), F.col(begin) - F.col("y")
    nearer = below.isNull() | (above <= below)
    far = F.when(nearer, above).otherwise(below) > reach if reach is not None else F.lit(False)
    chosen = F.when(~F.coalesce(far, F.lit(False)), F.when(nearer, F.col(back)).otherwise(F.col(fore)))
    return nearest(placed.select(*kept, chosen.alias(line)), numbered, [*by, line], "x", "x", values, reach, tasks=n).select(*kept, *values)


def export_styled(notes: DataFrame, runs: DataFrame, by: Sequence[str] = ("path",), order: Sequence[str] = ("page", "idx"), page: Sequence[str] = PAGE, text: str = "contents", entry: Entry | None = None, header: Column | None = None) -> DataFrame:
    """by and text: each file's notes, a line each, led by the font and size of the text they stand at, parted by tabs; what is null is left out."""
    n = tasks_for(notes, runs)
    said = dealt(note_styles(notes, runs, page, tasks=n), by, n)
    return joined(said, by, order, F.concat_ws("\t", "font", F.col("size").cast("string"), F.coalesce(text, F.lit(""))), entry, header)
