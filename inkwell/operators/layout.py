"""Operators on the geometry of pages: reading order, runs of a style, the size that parts notes from text, small text and the text it belongs to.

A glyph has a box: x0, x1 from the left edge, top, bottom from the upper one.  Windows here are those of one page, so Spark deals
pages; what has no such bound (files, cells) is summed in part before it is dealt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import spare
from inkwell.operators.order import dealt, tasks_for

#: A page's cuts, outermost first: (axis, gap). An axis is x or y, led by a minus where it is read from its end.  None: the gap of lines.
HORIZONTAL, VERTICAL = (("y", 20.0), ("x", 20.0), ("y", None)), (("y", 20.0), ("-x", 20.0), ("-x", None))
PAGE = ("path", "page")


def boxed() -> Column:
    return F.col("x0").isNotNull() & F.col("x1").isNotNull() & F.col("top").isNotNull() & F.col("bottom").isNotNull()


def edges(axis: str) -> tuple[Column, Column]:
    """Where a box begins and ends along an axis; what has no full box comes last."""
    low, high = (F.col("x0"), F.col("x1")) if axis[-1] == "x" else (F.col("top"), F.col("bottom"))
    low, high = (-high, -low) if axis[0] == "-" else (low, high)
    return F.when(boxed(), low).otherwise(float("inf")), F.when(boxed(), F.greatest(high, low)).otherwise(float("inf"))


def cut(glyphs: DataFrame, by: Sequence[str], begin: Column, end: Column, gap: Column, to: str) -> DataFrame:
    """glyphs with to, a number that grows by one wherever a gap wider than gap opens between all boxes before and all after."""
    begins, opens = spare(["_begin", "_opens"], glyphs.columns)
    order = Window.partitionBy(*by).orderBy(begins)
    until = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = glyphs.withColumn(begins, begin).withColumn(opens, F.coalesce((F.col(begins) > until + gap).cast("int"), F.lit(0)))
    return marked.withColumn(to, F.sum(opens).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop(begins, opens)


def writing_direction(glyphs: DataFrame, by: Sequence[str] = PAGE, order: str = "ord") -> DataFrame:
    """by, n_down, n_across and vertical: whether a page is written from top to bottom, by how its glyphs follow each other in order.

    A file's order is none of lines and columns as a rule, but inside a line one glyph follows the other.  A step is one down where the boxes overlap across
    and not down the page, one across where it is the other way round, none else; a page is vertical if it has more steps
    down.  A glyph without a full box takes no step, nor do those beside it in the order.  A page with as many of both, or none, is not vertical.
    """
    window = Window.partitionBy(*by).orderBy(order)
    before = lambda c: F.lag(c).over(window)
    across = F.greatest(F.col("x0") - before("x1"), before("x0") - F.col("x1"))
    down = F.greatest(F.col("top") - before("bottom"), before("top") - F.col("bottom"))
    full = boxed() & before("x0").isNotNull() & before("x1").isNotNull() & before("top").isNotNull() & before("bottom").isNotNull()
    to = spare(["_down", "_across"], by)
    steps = glyphs.select(*by, (full & (down > 0) & (across <= 0)).cast("int").alias(to[0]), (full & (across > 0) & (down <= 0)).cast("int").alias(to[1]))
    counts = steps.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in zip(to, ("n_down", "n_across"), strict=True)])
    return counts.withColumn("vertical", F.col("n_down") > F.col("n_across"))


def reading_order(glyphs: DataFrame, by: Sequence[str] = PAGE, vertical: Column | None = None, horizontal_cuts: Sequence[tuple] = HORIZONTAL, vertical_cuts: Sequence[tuple] = VERTICAL, line_gap: float = 0.0, shrink: float = 0.5, tasks: int | None = None) -> DataFrame:
    """glyphs with block, line and ord: where each stands when its page is read; an ord that is there breaks ties and is replaced.

    glyphs: by, x0, top, x1, bottom and any others.  vertical: whether a glyph's page is written from top to bottom, in lines
    from right to left (null or not given: it is not).  A page is cut along one axis after the other, wherever no box bridges a gap: into bands, columns
    and lines, or tiers, panels and lines.  The last cut is that into lines: there boxes are shrunk to so much of their
    width about the middle, so that lines may overlap a little, and what is further apart than line_gap is another line.
    Within a line, glyphs follow their beginnings.  block counts the outer cuts' parts, line the lines, both from 1 on each page.

    A glyph without a full box comes last on its page, in a block of its own, by its given ord.  Boxes that are equal follow
    their ord, then their text if they have these columns.  An empty table gives an empty result.

    Pages are dealt once, to so many tasks (as many as the counted glyphs need, if not given) that each sorts about order.ROWS_A_TASK glyphs.
    """
    if len(horizontal_cuts) != len(vertical_cuts):
        raise ValueError("both directions have as many cuts")
    down = F.coalesce(vertical, F.lit(False)) if vertical is not None else F.lit(False)
    flag, *names = spare(["_down", *(f"_cut{k}" for k in range(len(horizontal_cuts) + 1))], glyphs.columns)
    out = dealt(glyphs, by, tasks or tasks_for(glyphs)).withColumn(flag, down).withColumn(names[0], (~boxed()).cast("int"))
    last = len(horizontal_cuts) - 1
    for k, (across, along) in enumerate(zip(horizontal_cuts, vertical_cuts, strict=True)):
        (a, b), (c, d) = edges(across[0]), edges(along[0])
        begin, end = F.when(F.col(flag), c).otherwise(a), F.when(F.col(flag), d).otherwise(b)
        if k == last:
            slack = (end - begin) * ((1 - shrink) / 2)
            begin, end, gap = F.when(boxed(), begin + slack).otherwise(begin), F.when(boxed(), end - slack).otherwise(end), F.lit(line_gap)
        else:
            gap = F.when(F.col(flag), along[1]).otherwise(across[1])
        out = cut(out, [*by, flag, *names[: k + 1]], begin, end, gap, names[k + 1])
    ties = [c for c in ("ord", "text") if c in glyphs.columns]
    start = F.when(boxed(), F.when(F.col(flag), F.col("top")).otherwise(F.col("x0")))
    page = Window.partitionBy(*by)
    order = page.orderBy(flag, *names, F.asc_nulls_last(start), *ties)
    ordered = out.withColumns({"block": F.dense_rank().over(page.orderBy(flag, *names[:-1])), "line": F.dense_rank().over(page.orderBy(flag, *names)), "_ord": F.row_number().over(order)})
    return ordered.drop(flag, *names, "ord").withColumnRenamed("_ord", "ord")


def reading_text(ordered: DataFrame, by: Sequence[str] = PAGE, pages: DataFrame | None = None, block: str = "\n\n", line: str = "\n", word: str = "") -> DataFrame:
    """by and text of what reading_order() gives: glyphs in their order, with line, block or word between those that such a cut parts or none.

    A null text is empty.  pages: by of all pages; with it, a page without glyphs has an empty text instead of no row.
    """
    n, sep, said = spare(["_n", "_sep", "_said"], ordered.columns)
    order = Window.partitionBy(*by).orderBy("ord")
    gap = F.when(F.lag("block").over(order).isNull(), "").when(F.lag("block").over(order) != F.col("block"), block).when(F.lag("line").over(order) != F.col("line"), line).otherwise(word)
    rows = ordered.select(*by, F.col("ord").alias(n), gap.alias(sep), F.coalesce("text", F.lit("")).alias(said))
    parts = F.array_sort(F.collect_list(F.struct(n, sep, said)))
    out = rows.groupBy(*by).agg(F.array_join(F.transform(parts, lambda r: F.concat(r[sep], r[said])), "").alias("text"))
    if pages is None:
        return out
    return pages.select(*by).distinct().join(out, list(by), "left").withColumn("text", F.coalesce("text", F.lit("")))


def style_runs(ordered: DataFrame, by: Sequence[str] = PAGE, distance: float | None = None, separator: str = "") -> DataFrame:
    """by, run (from 1), font, size, text, n_glyphs, the run's box (x0, top, x1, bottom), its anchor (x, y: the upper right corner) and label.

    ordered: glyphs with ord.  A run is as many glyphs as follow each other in one style: another font or size begins a new one, and so does a gap
    to the glyph before that is wider than distance (if given), across or down.  So a style that occurs twice on a page gives two runs and two
    notes.  Null fonts are alike, and so are null sizes; the label has what is not null of both.  A glyph without a box
    belongs to the run by its style alone.
    """
    names = spare(["_new", "_run", "_t"], ordered.columns)
    order = Window.partitionBy(*by).orderBy("ord")
    before = lambda c: F.lag(c).over(order)
    new = ~(F.col("font").eqNullSafe(before("font")) & F.col("size").eqNullSafe(before("size"))) | before("ord").isNull()
    if distance is not None:
        across = F.greatest(F.col("x0") - before("x1"), before("x0") - F.col("x1"))
        down = F.greatest(F.col("top") - before("bottom"), before("top") - F.col("bottom"))
        new = new | F.coalesce(F.greatest(across, down) > distance, F.lit(False))
    marked = ordered.withColumn(names[0], new.cast("int"))
    numbered = marked.withColumn(names[1], F.sum(names[0]).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("text", F.lit("")).alias(names[2])))), lambda r: r[names[2]])
    runs = numbered.groupBy(*by, names[1]).agg(
        F.first("font").alias("font"), F.first("size").alias("size"), F.array_join(texts, separator).alias("text"), F.count(F.lit(1)).alias("n_glyphs"),
        F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"),
    )
    label = F.concat_ws(" ", "font", F.col("size").cast("string"))
    return runs.withColumnRenamed(names[1], "run").withColumns({"x": F.col("x1"), "y": F.col("top"), "label": label})


def size_threshold(glyphs: DataFrame, by: Sequence[str] = ("path",), scale: int = 100) -> DataFrame:
    """by, threshold, n_small and n_large: the size that parts small text from the text itself, found in each file's own sizes.

    Characters are counted by size, rounded to a scale-th, before they are dealt.  Among all cuts that leave fewer characters below than above, that
    with the least variance within both parts is taken (the most between them); ties go to the smaller size.  threshold is the smallest size
    above the cut; it is null, and all text is large, where a file has one size alone or no such cut.  A null size counts nowhere; a file without any size has a row
    with zeros; an empty table has none.
    """
    sizes = glyphs.groupBy(*by, F.round(F.col("size") * scale).cast("long").alias("size")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("n"))
    known = sizes.withColumn("n", F.when(F.col("size").isNull(), 0).otherwise(F.col("n")))
    whole = Window.partitionBy(*by)
    until = whole.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    mass = F.coalesce(F.col("n") * F.col("size"), F.lit(0))
    sums = known.withColumns({"n0": F.coalesce(F.sum("n").over(until), F.lit(0)), "s0": F.coalesce(F.sum(mass).over(until), F.lit(0)), "all_n": F.sum("n").over(whole), "all_s": F.sum(mass).over(whole)})
    n1 = F.col("all_n") - F.col("n0")
    apart = (F.col("s0") * n1 - (F.col("all_s") - F.col("s0")) * F.col("n0")).cast("double")
    between = F.when((F.col("n0") > 0) & (F.col("n0") < n1), apart * apart / (F.col("n0").cast("double") * n1.cast("double")))
    scored = sums.withColumn("between", between)
    best = F.max(F.when(F.col("between").isNotNull(), F.struct("between", (-F.col("size")).alias("less"), "n0"))).alias("best")
    found = scored.groupBy(*by).agg(best, F.max("all_n").alias("all_n"))
    small = F.coalesce(F.col("best.n0"), F.lit(0))
    return found.select(*by, (-F.col("best.less") / float(scale)).alias("threshold"), small.alias("n_small"), (F.col("all_n") - small).alias("n_large"))


def split_sizes(glyphs: DataFrame, by: Sequence[str] = ("path",), scale: int = 100) -> DataFrame:
    """glyphs with small: whether the size is below the file's threshold; a null size is not, nor any in a file without threshold or with a null in by."""
    threshold = size_threshold(glyphs.select(*by, "size", "text"), by, scale).select(*by, F.col("threshold").alias("_threshold"))
    below = F.round(F.col("size") * scale) < F.round(F.col("_threshold") * scale)
    return glyphs.join(threshold, list(by), "left").withColumn("small", F.coalesce(below, F.lit(False))).select(*[c for c in glyphs.columns if c != "small"], "small")


def keep_text(glyphs: DataFrame, by: Sequence[str] = ("path",)) -> DataFrame:
    """glyphs without those that are small for their file: how annotations beside the text are dropped where no size is given."""
    return split_sizes(glyphs, by).where(~F.col("small")).select(*glyphs.columns)


#: Rows of small text in a tile that are compared with the tile's text in one task, and cells along a tile's side.
CELL_ROWS, TILE = 4096, 4


def base_of_small(small: DataFrame, text: DataFrame, key: str, by: Sequence[str] = PAGE, reach: float = 12.0, cell: float = 48.0, tasks: int | None = None) -> DataFrame:
    """small with base (the key of the nearest text within reach, null if there is none) and distance.

    small and text: by, x0, top, x1, bottom; text has key besides, small any others.  The distance is that from the middle of a small box to
    a text's box, 0 inside it; ties go to the smaller key.  A box without all its edges reaches nothing, and nothing reaches it; nulls in by
    match nothing.

    Pages are laid out in tiles of TILE by TILE cells; a text stands in all tiles that it reaches, a small box's middle in one, so only what shares a tile
    is compared.  A tile with more than CELL_ROWS small boxes is divided among as many parts as they need, with its text in each; there is a row for
    each such tile, and all tasks get these.  Both sides are dealt once, by tile and part, to tasks (as many as their counted rows need, if not given); all
    else is done where they meet, also for small boxes that nothing reaches.
    """
    keep, (row, cx, cy, part, parts, copies) = small.columns, spare(["_row", "_cx", "_cy", "_part", "_parts", "_copies"], [*small.columns, *text.columns])
    n = tasks or tasks_for(small, text)
    at = lambda v: F.floor(v / (cell * TILE)).cast("long")
    mx, my = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    tiles, keys = [*by, cx, cy], [*by, cx, cy, part]
    spots = small.select(*by, F.when(boxed(), at(mx)).alias(cx), F.when(boxed(), at(my)).alias(cy), F.when(boxed(), mx).alias("_mx"), F.when(boxed(), my).alias("_my"), F.struct(*[F.col(c) for c in keep]).alias(row))
    crowded = F.broadcast(spots.where(F.col(cx).isNotNull()).groupBy(*tiles).agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias(parts)).where(F.col(parts) > 1))
    boxes = text.where(boxed()).select(*by, F.col(key).alias("_base"), *(F.col(c).alias(f"_{c}") for c in ("x0", "top", "x1", "bottom")))
    across = F.explode(F.sequence(at(F.col("_x0") - reach), at(F.col("_x1") + reach)))
    down = F.explode(F.sequence(at(F.col("_top") - reach), at(F.col("_bottom") + reach)))
    spread = boxes.where("_x0 <= _x1 and _top <= _bottom").withColumn(cx, across).withColumn(cy, down)
    spread = spread.join(crowded, tiles, "left").withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1))).drop(parts)
    # what has no tile meets nothing, so its part only deals it out
    own = F.pmod(F.xxhash64(row), F.when(F.col(cx).isNull(), F.lit(n)).otherwise(F.coalesce(parts, F.lit(1)))).cast("int")
    spots = dealt(spots.join(crowded, tiles, "left").withColumn(part, own).drop(parts), keys, n)
    once = spots.groupBy(*keys, row).agg(F.first("_mx").alias("_mx"), F.first("_my").alias("_my"), F.count(F.lit(1)).alias(copies))
    there = [f"{c}_" for c in spare([f"_key{i}" for i in range(len(keys))], [*small.columns, *text.columns])]
    met = dealt(spread, keys, n).select(*(F.col(c).alias(t) for c, t in zip(keys, there, strict=True)), "_base", "_x0", "_top", "_x1", "_bottom")
    dx = F.greatest(F.col("_x0") - F.col("_mx"), F.col("_mx") - F.col("_x1"), F.lit(0.0))
    dy = F.greatest(F.col("_top") - F.col("_my"), F.col("_my") - F.col("_bottom"), F.lit(0.0))
    far = F.sqrt(dx * dx + dy * dy)
    same = far <= reach
    for c, t in zip(keys, there, strict=True):
        same = same & (F.col(c) == F.col(t))
    joined = once.join(met, same, "left").withColumn("_d", F.when(F.col(there[-1]).isNotNull(), far))
    least = F.min(F.when(F.col("_d").isNotNull(), F.struct(F.col("_d").alias("d"), F.col("_base").alias("base"))))
    found = joined.groupBy(*keys, row).agg(least.alias("_n"), F.first(copies).alias(copies))
    out = found.withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    return out.select(*[F.col(row)[c].alias(c) for c in keep], F.col("_n.base").alias("base"), F.col("_n.d").alias("distance"))


def with_readings(text: DataFrame, attached: DataFrame, key: str, by: Sequence[str] = PAGE, opening: str = "《", closing: str = "》", tasks: int | None = None) -> DataFrame:
    """text with its small text behind it in brackets, in the order of its ord; attached: of base_of_small(); tasks: as there, for text."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("text", F.lit("")).alias("t")))), lambda r: r["t"])
    readings = attached.where("base is not null").groupBy(*by, F.col("base").alias(key)).agg(F.array_join(parts, "").alias("_reading"))
    joined = dealt(text, [*by, key], tasks or tasks_for(text)).join(readings, [*by, key], "left")
    said = F.when(F.col("_reading").isNotNull(), F.concat(F.coalesce("text", F.lit("")), F.lit(opening), F.col("_reading"), F.lit(closing))).otherwise(F.col("text"))
    return joined.withColumn("text", said).select(*text.columns)
