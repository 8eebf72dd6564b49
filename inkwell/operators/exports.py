"""Operators on annotations and files: exports, ordering, merging."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import bold_marked, natural_key, sibling_name, spare
from inkwell.operators.order import positions

#: Formats an annotation of its number and text.
Entry = Callable[[Column, Column], Column]


def export_plain(annotations: DataFrame, by: Sequence[str] = ("path",), order: Sequence[str] = ("page", "idx"), text: str = "contents", entry: Entry | None = None, header: Column | None = None) -> DataFrame:
    """by and text: the contents of each file's annotations, a line each, in their order; null contents are an empty line.

    entry(number, text) formats each, numbered from 1, and header is what stands before the first, as for styles.numbered_text().
    """
    return joined(annotations, by, order, F.coalesce(text, F.lit("")), entry, header)


def export_bold(annotations: DataFrame, by: Sequence[str] = ("path",), order: Sequence[str] = ("page", "idx"), entry: Entry | None = None, header: Column | None = None) -> DataFrame:
    """As export_plain(), bold parts in brackets; an annotation without runs gives its contents."""
    return joined(annotations, by, order, F.coalesce(bold_marked(F.col("runs")), "contents", F.lit("")), entry, header)


def export_info(annotations: DataFrame, by: Sequence[str] = ("path",), order: Sequence[str] = ("page", "idx"), author: str = "author", subject: str | None = "subject", text: str = "contents") -> DataFrame:
    """As export_plain(), each line led by its number, author and subject (those that are not null), parted by tabs."""
    n, = spare(["_n"], annotations.columns)
    ranked = annotations.withColumn(n, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    fields = [F.col(n).cast("string"), F.col(author), *([F.col(subject)] if subject else []), F.coalesce(text, F.lit(""))]
    return joined(ranked, by, [n], F.concat_ws("\t", *fields))


def joined(rows: DataFrame, by: Sequence[str], order: Sequence[str], text: Column, entry: Entry | None = None, header: Column | None = None) -> DataFrame:
    """by and text: a line for each row, in order; rows that tie follow their texts.  No rows, no text; columns of any names pass."""
    t, = spare(["_t"], rows.columns)
    parts = F.array_sort(F.collect_list(F.struct(*order, text.alias(t))))
    lines = F.transform(parts, lambda r, k: entry(k + 1, r[t])) if entry else F.transform(parts, lambda r: r[t])
    out = rows.groupBy(*by).agg(F.array_join(lines, "\n").alias("text"))
    return out if header is None else out.withColumn("text", F.concat(header, F.lit("\n"), F.col("text")))


def with_output_name(exports: DataFrame) -> DataFrame:
    """exports with out, the path of the text beside each PDF; null where the path is no PDF's."""
    return exports.withColumn("out", sibling_name(F.col("path")))


def merge_order(files: DataFrame, name: str = "path", by: Sequence[str] = ()) -> DataFrame:
    """files with position, from 1, in the natural order of their names; a column named position is written over.

    by: folders, or whatever is merged apart.  Without it all files get one order.  Either way ranges of the order are tasks of their own (see
    order.positions()).  Names that tie follow the other columns.  An empty table gives an empty result.
    """
    columns = [c for c in files.columns if c != "position"]
    return positions(files, by, [natural_key(F.col(name)), *map(F.col, dict.fromkeys([name, *columns]))])


def merge_text(files: DataFrame, by: Sequence[str], name: str, ties: Sequence[str], text: str, separator: str = "\n") -> DataFrame:
    """by and text: the texts of each group's files one after another, in the natural order of their names.

    One value for each group; merge_chunks() has none that long.  A null text is empty, rows that tie follow their texts, an empty table gives an empty result.
    """
    k, t = spare(["_k", "_t"], files.columns)
    keyed = files.withColumn(k, natural_key(F.col(name)))
    parts = F.array_sort(F.collect_list(F.struct(k, name, *ties, F.coalesce(text, F.lit("")).alias(t))))
    return keyed.groupBy(*by).agg(F.array_join(F.transform(parts, lambda r: r[t]), separator).alias("text"))


def merge_pieces(files: DataFrame, by: Sequence[str], name: str, ties: Sequence[str], text: str | None = None, separator: str = "\n", length: Column | None = None) -> DataFrame:
    """files with position, from 1, and start: where each text stands if its group's are one after another, as in merge_text(); columns of these names are written over.

    text: their column, or length its characters, where the texts themselves need not come along.
    A row for each file, so that a merged text may be longer than a value can be; ranges of a group's order are tasks of their own (see
    order.positions()).  A null text is empty.  Rows that tie in name and ties follow each other in any order.  An empty table gives an empty result.
    """
    size = F.coalesce(F.length(text) if length is None else length, F.lit(0)).cast("long") + len(separator)
    return positions(files, by, [natural_key(F.col(name)), F.col(name), *map(F.col, ties)], size)


def merge_chunks(files: DataFrame, by: Sequence[str], name: str, ties: Sequence[str], text: str, separator: str = "\n", chunk: int = 1 << 24) -> DataFrame:
    """by, chunk, start and text: merge_text()'s text in pieces of about chunk characters, none in need of the others.

    A file's text is in the chunk in which it starts, with the separator before it unless it is the first of all; so the chunks of a group, one after
    another by their number (some may be missing), are its merged text, and no task holds more than a chunk and the text that
    crosses its end.  start is where the chunk's text begins.  Rows that tie in name and ties follow each other in any order; an empty table gives an empty result.
    """
    own = files.select(*by, F.col(name).alias("_name"), *ties, F.coalesce(text, F.lit("")).alias("text"))
    k, = spare(["chunk"], [*by, *ties])
    placed = merge_pieces(own, by, "_name", ties, "text", separator).withColumn(k, F.floor(F.col("start") / chunk))
    said = F.when(F.col("start") > 0, F.concat(F.lit(separator), "text")).otherwise(F.col("text"))
    first = F.when(F.col("start") > 0, F.col("start") - len(separator)).otherwise(F.col("start"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("position", said.alias("t")))), lambda r: r["t"])
    return placed.groupBy(*by, k).agg(F.min(first).alias("start"), F.array_join(parts, "").alias("text"))
