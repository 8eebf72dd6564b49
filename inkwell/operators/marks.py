"""Bold in markup that nests: depths as running sums, maximal intervals, brackets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import CLOSE, OPEN, spare

#: A tag, or the text up to the next one; a < that begins no tag is text.
TOKEN = r"(?s)<[/a-zA-Z!][^>]*>|(?:[^<]|<(?![/a-zA-Z!][^>]*>))+"
BOLD = ("b", "strong")


def bold_intervals(rows: DataFrame, by: Sequence[str], markup: str, names: Sequence[str] = BOLD) -> DataFrame:
    """by, interval (from 1), bold and text: each row's text without tags, cut where bold begins or ends.

    A text is bold where the tags of names that are open outnumber those that are closed; a closing tag without an opening one counts
    nothing, one that is never closed holds to the end.  Texts that touch are one interval if they are alike, whatever tags stand
    between them, so nested and adjacent marks give one.  Empty marks give none.  by tells the rows apart: rows that share it are one text in
    no certain order.  A null or empty markup, or one of tags alone, has no row.

    The depth is a running sum over the row's tokens, less the least that it has been below zero; intervals are numbered where
    it enters or leaves zero.
    """
    at, token, step, depth, new = spare(["_at", "_token", "_step", "_depth", "_new"], rows.columns)
    tokens = rows.select(*by, F.posexplode(F.regexp_extract_all(markup, F.lit(TOKEN), F.lit(0))).alias(at, token))
    one = "|".join(names)
    opens, closes = F.col(token).rlike(rf"(?is)^<({one})(\s[^>]*)?>$") & ~F.col(token).rlike(r"(?s)/>$"), F.col(token).rlike(rf"(?is)^</({one})\s*>$")
    order = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    summed = tokens.withColumn(step, F.when(opens, 1).when(closes, -1).otherwise(0)).withColumn(depth, F.sum(step).over(order))
    deep = summed.withColumn(depth, F.col(depth) - F.least(F.min(depth).over(order), F.lit(0)))
    texts = deep.where(~F.col(token).rlike(r"(?s)^<[/a-zA-Z!][^>]*>$")).withColumn("bold", F.col(depth) > 0)
    inside = Window.partitionBy(*by).orderBy(at)
    fresh = texts.withColumn(new, (~F.col("bold").eqNullSafe(F.lag("bold").over(inside))).cast("int"))
    numbered = fresh.withColumn("interval", F.sum(new).over(inside.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(at, token))), lambda r: r[token])
    return numbered.groupBy(*by, "interval", "bold").agg(F.array_join(parts, "").alias("text"))


def bold_text(rows: DataFrame, by: Sequence[str], markup: str, names: Sequence[str] = BOLD, opening: str = OPEN, closing: str = CLOSE) -> DataFrame:
    """by and text: each row's text without tags, its bold intervals in brackets; a row without text has an empty one.  Brackets that stand in the text stay as they are."""
    cut = bold_intervals(rows, by, markup, names)
    said = F.when(F.col("bold"), F.concat(F.lit(opening), "text", F.lit(closing))).otherwise(F.col("text"))
    texts = cut.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("interval", said.alias("t")))), lambda r: r["t"]), "").alias("text"))
    own = spare([f"_by{i}" for i in range(len(by))], [*by, "text"])
    same: Column = F.lit(True)
    for c, o in zip(by, own, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(o))
    return rows.select(*by).distinct().join(texts.select(*(F.col(c).alias(o) for c, o in zip(by, own, strict=True)), "text"), same, "left").select(*by, F.coalesce("text", F.lit("")).alias("text"))
