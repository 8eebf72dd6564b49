"""Column functions for styled text and file names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, CLOSE = "【", "】"
FULL_WIDTH, ASCII = "０１２３４５６７８９", "0123456789"


def spare(names: Sequence[str], taken: Sequence[str]) -> list[str]:
    """Each name with as many underscores behind it as it takes to differ from all names taken, in lower case as Spark compares them."""
    used, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def natural_key(name: Column) -> Column:
    """A key whose string order is the natural order of names: p2 before p10.

    Each run of digits is led by its length without leading zeros (four digits); full-width digits count as digits.
    Names that differ in leading zeros only tie, so sort by the name as well.  Null stays null.
    """
    parts = F.regexp_extract_all(F.translate(name, FULL_WIDTH, ASCII), F.lit("([0-9]+|[^0-9]+)"), F.lit(0))

    def keyed(t: Column) -> Column:
        bare = F.regexp_replace(t, "^0+", "")
        return F.when(t.rlike("^[0-9]+$"), F.concat(F.lpad(F.length(bare).cast("string"), 4, "0"), bare)).otherwise(t)

    return F.array_join(F.transform(parts, keyed), "")


def bold_marked(runs: Column) -> Column:
    """The text of runs, bold ones in brackets.  A run without text gives nothing; null runs give null."""
    return F.array_join(F.transform(runs, lambda r: F.when(F.coalesce(r["bold"], F.lit(False)) & (F.coalesce(r["text"], F.lit("")) != ""), F.concat(F.lit(OPEN), r["text"], F.lit(CLOSE))).otherwise(F.coalesce(r["text"], F.lit("")))), "")


def bold_marked_markup(markup: Column) -> Column:
    """Markup with the text after each <b>, up to the next tag, in brackets."""
    return F.regexp_replace(markup, "<b>([^<]+)", f"{OPEN}$1{CLOSE}")


def sibling_name(path: Column, extension: str = ".txt") -> Column:
    """path with the extension in place of .pdf; null if it does not end in .pdf, so that no input is ever written over."""
    return F.when(path.rlike(r"(?i)\.pdf$"), F.regexp_replace(path, r"(?i)\.pdf$", extension))


def bold_merged(runs: Column) -> Column:
    """As bold_marked(), with one pair of brackets around bold runs that touch; runs without text part nothing.  Null runs give null."""
    said = F.transform(runs, lambda r: F.struct(F.coalesce(r["text"], F.lit("")).alias("text"), F.coalesce(r["bold"], F.lit(False)).alias("bold")))
    full = F.filter(said, lambda r: r["text"] != "")

    def marked(r: Column, i: Column) -> Column:
        before, after = F.get(full, i - 1)["bold"], F.get(full, i + 1)["bold"]
        opens, closes = r["bold"] & ~F.coalesce(before, F.lit(False)), r["bold"] & ~F.coalesce(after, F.lit(False))
        return F.concat(F.when(opens, OPEN).otherwise(""), r["text"], F.when(closes, CLOSE).otherwise(""))

    return F.array_join(F.transform(full, marked), "")
