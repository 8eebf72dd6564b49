"""Operators on glyphs: style filters, plain text, labels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import spare


def keep_styles(glyphs: DataFrame, min_size: float | None = None, drop_fonts: Sequence[str] = (), keep_fonts: Sequence[str] = ()) -> DataFrame:
    """Glyphs of at least min_size whose font is kept: how small annotations beside the text are dropped.

    A null size or font says nothing about style, so such a glyph stays.  All conditions are plain predicates,
    which Parquet scans take over.
    """
    if min_size is not None:
        glyphs = glyphs.where(F.col("size").isNull() | (F.col("size") >= min_size))
    if drop_fonts:
        glyphs = glyphs.where(F.col("font").isNull() | ~F.col("font").isin(*drop_fonts))
    if keep_fonts:
        glyphs = glyphs.where(F.col("font").isNull() | F.col("font").isin(*keep_fonts))
    return glyphs


def dominant_style(glyphs: DataFrame, by: Sequence[str] = ("path", "page")) -> DataFrame:
    """by, font, size and n_chars of the style with most characters; ties go to the smaller font, then size."""
    totals = glyphs.groupBy(*by, "font", "size").agg(F.sum(F.length("text")).alias("n_chars"))
    order = Window.partitionBy(*by).orderBy(F.desc("n_chars"), "font", "size")
    k, = spare(["_k"], totals.columns)
    return totals.withColumn(k, F.row_number().over(order)).where(F.col(k) == 1).drop(k)


def keep_dominant(glyphs: DataFrame, share: float = 0.75, by: Sequence[str] = ("path", "page")) -> DataFrame:
    """Glyphs of at least share of the size of their page's dominant style."""
    m, = spare(["_main"], glyphs.columns)
    main = dominant_style(glyphs, by).select(*by, F.col("size").alias(m))
    return glyphs.join(main, list(by)).where(F.col("size").isNull() | F.col(m).isNull() | (F.col("size") >= share * F.col(m))).select(*glyphs.columns)


def plain_text(glyphs: DataFrame, pages: DataFrame | None = None, separator: str = "", by: Sequence[str] = ("path", "page")) -> DataFrame:
    """by and text: the glyphs' texts in their order.

    pages: by of all pages; with it, a page that has no glyph left gets an empty text instead of no row.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("text", F.lit("")).alias("text")))), lambda g: g["text"]), separator)
    out = glyphs.groupBy(*by).agg(text.alias("text"))
    if pages is None:
        return out
    return pages.select(*by).distinct().join(out, list(by), "left").withColumn("text", F.coalesce("text", F.lit("")))


def numbered_text(rows: DataFrame, by: Sequence[str], order: Sequence[str], text: Column, entry: Callable[[Column, Column], Column] | None = None, header: Column | None = None) -> DataFrame:
    """by and text: entries numbered from 1, one after another, each on lines of its own.

    entry(number, text) formats an entry, header what stands before the first; so a format with headers and numbered
    entries is a pair of them.  Without entry: the number, a full stop, a space and the text.
    """
    entry = entry or (lambda n, t: F.concat(n.cast("string"), F.lit(". "), t))
    n, t = spare(["_n", "_t"], by)
    rows = rows.select(*by, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).alias(n), F.coalesce(text, F.lit("")).alias(t))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(n, t))), lambda r: entry(r[n], r[t]))
    out = rows.groupBy(*by).agg(F.array_join(lines, "\n").alias("text"))
    return out if header is None else out.withColumn("text", F.concat(header, F.lit("\n"), F.col("text")))


def style_labels(glyphs: DataFrame, by: Sequence[str] = ("path", "page", "font", "size")) -> DataFrame:
    """by, a note's label (font and size) and its anchor, the upper right corner of the run.  A null font leaves the size alone."""
    return glyphs.groupBy(*by).agg(F.max("x1").alias("x"), F.min("top").alias("y")).withColumn("label", F.concat_ws(" ", "font", F.col("size").cast("string")))
