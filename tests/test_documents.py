"""Operators on hand-written glyphs and annotations, and the proxies against DuckDB."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from inkwell.functions.text import bold_marked, bold_marked_markup, natural_key, sibling_name
from inkwell.operators import exports, styles
from inkwell.plans import proxies
from inkwell.schema import ANNOTATIONS, GLYPHS

SF = "/root/testdata/sf0.001"


def glyph(ord_, text, font="F1", size=12.0, page=1, x1=0.0, top=0.0):
    return ("a.pdf", page, ord_, text, font, size, 0.0, top, x1, 0.0)


@pytest.fixture(scope="module")
def glyphs(spark):
    rows = [glyph(3, "字"), glyph(0, "漢"), glyph(1, "か", size=6.0), glyph(2, "ん", size=6.0), glyph(4, "x", font="F2"), glyph(5, "?", font=None, size=None), glyph(0, "r", size=5.0, page=2)]
    return spark.createDataFrame(rows, GLYPHS)


def test_small_annotations_go_by_size_and_font(glyphs):
    kept = styles.keep_styles(glyphs, min_size=8.0, drop_fonts=["F2"])
    texts = {r["page"]: r["text"] for r in styles.plain_text(kept, pages=glyphs).collect()}
    assert texts == {1: "漢字?", 2: ""}
    assert [r["page"] for r in styles.plain_text(kept).collect()] == [1]


def test_dominant_style(glyphs):
    main = {r["page"]: (r["font"], r["size"]) for r in styles.dominant_style(glyphs).collect()}
    assert main == {1: ("F1", 6.0), 2: ("F1", 5.0)}  # two against two: the smaller size
    assert styles.keep_dominant(glyphs, 1.0).count() == 7


def test_labels(spark):
    rows = [glyph(0, "a", x1=10.0, top=5.0), glyph(1, "b", x1=22.0, top=7.0), glyph(2, "c", font=None, size=6.0)]
    labels = {(r["label"], r["x"], r["y"]) for r in styles.style_labels(spark.createDataFrame(rows, GLYPHS)).collect()}
    assert labels == {("F1 12.0", 22.0, 5.0), ("6.0", 0.0, 0.0)}


def test_numbered_text(glyphs):
    out = styles.numbered_text(glyphs.where("size > 8"), ["path"], ["page", "ord"], F.col("text"), header=F.lit("head"))
    assert out.first()["text"] == "head\n1. 漢\n2. 字\n3. x"


@pytest.fixture(scope="module")
def annotations(spark):
    run = lambda *parts: [(t, b) for t, b in parts]
    rows = [
        ("b.PDF", 1, 1, "ann", "F1 12.0", "a b c", run(("a", False), ("b", True), ("c", False))),
        ("b.PDF", 1, 0, None, "s", "xy", run(("x", True), ("y", True))),
        ("b.PDF", 2, 0, "bob", None, "no runs", None),
        ("c", 1, 0, None, None, None, run((None, True))),
    ]
    return spark.createDataFrame(rows, ANNOTATIONS)


def test_exports(annotations):
    of = lambda df: {r["path"]: r["text"] for r in df.collect()}
    assert of(exports.export_plain(annotations)) == {"b.PDF": "xy\na b c\nno runs", "c": ""}
    assert of(exports.export_bold(annotations)) == {"b.PDF": "【x】【y】\na【b】c\nno runs", "c": ""}
    entry = lambda n, t: F.concat(F.lit("["), n.cast("string"), F.lit("]\n"), t)
    assert of(exports.export_bold(annotations, entry=entry, header=F.col("path"))) == {"b.PDF": "b.PDF\n[1]\n【x】【y】\n[2]\na【b】c\n[3]\nno runs", "c": "c\n[1]\n"}
    assert of(exports.export_info(annotations)) == {"b.PDF": "1\ts\txy\n2\tann\tF1 12.0\ta b c\n3\tbob\tno runs", "c": "1\t"}
    assert {r["path"]: r["out"] for r in exports.with_output_name(exports.export_plain(annotations)).collect()} == {"b.PDF": "b.txt", "c": None}


def test_column_functions(spark):
    one = spark.range(1)
    assert one.select(bold_marked(F.expr("cast(array() as array<struct<text:string,bold:boolean>>)"))).first()[0] == ""
    assert one.select(bold_marked_markup(F.lit("a<b>x\ny</b>z"))).first()[0] == "a【x\ny】</b>z"
    assert [one.select(sibling_name(F.lit(p))).first()[0] for p in ("x.pdf.pdf", "x.PdF", "x")] == ["x.pdf.txt", "x.txt", None]


def test_natural_order(spark):
    names = ["p10.pdf", "p2.pdf", "第１０話", "第２話", "a01", "a1", "9" * 24, "00", "", None]
    rows = spark.createDataFrame([(n,) for n in names], "path string")
    got = [r["path"] for r in exports.merge_order(rows).orderBy("position").collect()]
    assert got == [None, "", "00", "9" * 24, "a01", "a1", "p2.pdf", "p10.pdf", "第２話", "第１０話"]
    assert rows.select(natural_key(F.col("path"))).where("path is null").first()[0] is None


@pytest.mark.parametrize("name", [*proxies.QUERIES, *proxies.FILE_QUERIES])
def test_proxy_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = (proxies.QUERIES | proxies.FILE_QUERIES)[name](spark, SF).toPandas(), con.execute((proxies.SQL | proxies.FILE_SQL)[name]).df()
    assert len(got) and sorted(got.columns) == sorted(want.columns)
    got, want = (x[sorted(x.columns)].astype(str).sort_values(sorted(x.columns)).reset_index(drop=True) for x in (got, want))
    assert got.equals(want)
