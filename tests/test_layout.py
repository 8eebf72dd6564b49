"""Reading order, runs, thresholds and readings against brute force and hand-made pages."""

import random

import pytest
from pyspark.sql import functions as F

from inkwell.operators import layout

GLYPHS = "path string, page int, ord int, text string, font string, size double, x0 double, top double, x1 double, bottom double"


def glyph(page, ord_, text, x0, top, w=8.0, h=10.0, font="M", size=10.0, path="f"):
    x0, top = (None if v is None else float(v) for v in (x0, top))
    return (path, page, ord_, text, font, size, x0, top, None if x0 is None else x0 + w, None if top is None else top + h)


def texts(df):
    return {r["page"]: r["text"] for r in df.collect()}


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        # two columns under a headline; the file's order is by line across both columns
        glyph(1, 0, "H", 0, 0, w=200, h=14, size=14.0),
        *(glyph(1, 1 + 2 * i + c, "abcdef"[3 * c + i], 120 * c, 50 + 14 * i) for i in range(3) for c in range(2)),
        # vertical: lines from the right
        *(glyph(2, i, t, x, y) for i, (t, x, y) in enumerate([("3", 60, 0), ("1", 80, 0), ("4", 60, 12), ("2", 80, 12)])),
        # boxes that overlap down the page by less than half are lines of their own; equal boxes follow ord; no box comes last
        glyph(3, 5, "b", 0, 8), glyph(3, 4, "a", 0, 0), glyph(3, 1, "z", None, None), glyph(3, 0, "y", 5, None), glyph(3, 3, "d", 20, 8), glyph(3, 2, "c", 20, 8),
        (None, 4, 0, None, None, None, 0.0, 0.0, 1.0, 1.0), (None, 4, 1, "x", None, None, 5.0, 0.0, 6.0, 1.0),
    ]
    return spark.createDataFrame(rows, GLYPHS).repartition(3)


def test_reading_order(spark, pages):
    got = layout.reading_order(pages, vertical=F.col("page") == 2)
    assert set(got.columns) == {*pages.columns, "block", "line"}
    assert texts(layout.reading_text(got, line="/", block="|")) == {1: "H|a/b/c|d/e/f", 2: "12/34", 3: "a/bcd|yz", 4: "x"}
    assert layout.reading_order(pages.limit(0)).count() == 0
    assert texts(layout.reading_text(got.where("page = 1"), pages=pages.select("path", "page"), line="", block=""))[2] == ""


def test_writing_direction(spark, pages):
    rows = [glyph(1, k, "x", 10.0 * (k % 3), 12.0 * (k // 3)) for k in range(9)] + [glyph(2, k, "x", 90 - 14.0 * (k // 3), 12.0 * (k % 3)) for k in range(9)] + [glyph(3, 0, "x", 0, 0), glyph(4, 0, "x", 0, 0), glyph(4, 1, "x", None, 20), glyph(4, 2, "x", 0, 40)]
    got = {r["page"]: (r["n_down"], r["n_across"], r["vertical"]) for r in layout.writing_direction(spark.createDataFrame(rows, GLYPHS).repartition(2)).collect()}
    assert got == {1: (0, 6, False), 2: (6, 0, True), 3: (0, 0, False), 4: (0, 0, False)}
    assert layout.writing_direction(pages.limit(0)).count() == 0


def test_names_that_are_taken(spark, pages):
    more = pages.withColumns({"_down": F.lit("d"), "_cut0": F.lit("c"), "_begin": F.lit("b"), "_n": F.lit("n")})
    got = layout.reading_order(more, vertical=F.col("page") == 2)
    assert {r["_down"] + r["_cut0"] + r["_begin"] for r in got.collect()} == {"dcb"}
    assert texts(layout.reading_text(got, line="/", block="|"))[1] == "H|a/b/c|d/e/f"


def test_random_columns(spark):
    rng, rows, want = random.Random(5), [], {}
    for page in range(12):
        k, said, left = 0, [], 0.0
        for _ in range(rng.randint(1, 4)):
            width = rng.randint(40, 90)
            for line in range(rng.randint(1, 6)):
                x = left
                while x < left + width - 12:
                    rows.append(glyph(page, rng.random() * 1e6 // 1, chr(97 + k % 26), x, 16.0 * line + rng.random() * 2, w=9, h=11))
                    said.append(chr(97 + k % 26))
                    k, x = k + 1, x + 10
            left += width + 30
        want[page] = "".join(said)
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r[:2], int(r[2]), *r[3:]) for r in rows], GLYPHS)
    assert texts(layout.reading_text(layout.reading_order(df), line="", block="")) == want


def test_a_style_that_comes_twice_is_two_runs(spark):
    rows = [glyph(1, i, t, 10.0 * i, 0.0, font=f, size=s) for i, (t, f, s) in enumerate([("a", "M", 10.0), ("b", "M", 10.0), ("c", "G", 10.0), ("d", "M", 10.0), ("e", "M", 12.0), ("f", None, None), (None, None, None)])]
    got = layout.style_runs(spark.createDataFrame(rows, GLYPHS)).orderBy("run").collect()
    assert [(r["run"], r["text"], r["label"], r["n_glyphs"], r["x"], r["y"]) for r in got] == [(1, "ab", "M 10.0", 2, 18.0, 0.0), (2, "c", "G 10.0", 1, 28.0, 0.0), (3, "d", "M 10.0", 1, 38.0, 0.0), (4, "e", "M 12.0", 1, 48.0, 0.0), (5, "f", "", 2, 68.0, 0.0)]
    far = [*rows[:1], glyph(1, 1, "b", 100.0, 0.0), glyph(1, 2, "c", 110.0, 0.0), glyph(1, 3, "d", 100.0, 90.0)]
    got = layout.style_runs(spark.createDataFrame(far, GLYPHS), distance=20.0)
    assert sorted(r["text"] for r in got.collect()) == ["a", "bc", "d"]
    assert layout.style_runs(spark.createDataFrame([], GLYPHS)).count() == 0


def best_cut(sizes):
    """By definition: the cut with fewer characters below and the least variance within."""
    found = []
    for t in sorted(set(sizes))[1:]:
        a, b = [s for s in sizes if s < t], [s for s in sizes if s >= t]
        if len(a) < len(b):
            found.append((sum((x - sum(g) / len(g)) ** 2 for g in (a, b) for x in g), t, len(a)))
    return min(found)[1:] if found else (None, 0)


def test_thresholds(spark):
    rng, rows, want = random.Random(3), [], {}
    for f in range(30):
        kinds = rng.sample([5.0, 6.0, 9.0, 10.0, 10.5, 12.0, 20.0], rng.randint(1, 4))
        sizes = [rng.choice(kinds) for _ in range(rng.randint(1, 60))]
        rows += [glyph(i % 3, i, "x", 0.0, 0.0, size=s, path=f"f{f}") for i, s in enumerate(sizes)]
        want[f"f{f}"] = best_cut(sizes)
    rows += [glyph(0, 0, "x", 0.0, 0.0, size=None, path="none"), glyph(0, 0, None, 0.0, 0.0, size=5.0, path="blank"), glyph(0, 0, "x", 0.0, 0.0, size=5.0, path=None)]
    df = spark.createDataFrame(rows, GLYPHS).repartition(4)
    got = {r["path"]: r for r in layout.size_threshold(df).collect()}
    for path, (t, n) in want.items():
        assert (got[path]["threshold"], got[path]["n_small"]) == (t, n), path
    assert [got[p]["threshold"] for p in ("none", "blank", None)] == [None] * 3 and got["none"]["n_large"] == 0
    kept = layout.keep_text(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - sum(n for _, n in want.values())
    assert layout.size_threshold(df.limit(0)).count() == 0


def test_readings_go_to_the_nearest_text(spark, monkeypatch):
    monkeypatch.setattr(layout, "CELL_ROWS", 7)  # so that cells are divided
    rng = random.Random(9)
    text = [glyph(p, i, f"t{i}", rng.random() * 300, rng.random() * 300, w=rng.random() * 90, h=rng.random() * 40) for p in range(2) for i in range(60)]
    small = [glyph(p, i, f"s{i}", rng.choice([rng.random() * 300, 100.0]), rng.choice([rng.random() * 300, 100.0]), w=4, h=3, size=5.0) for p in range(2) for i in range(80)]
    small += [small[0], glyph(0, 999, "q", None, 1.0), glyph(7, 0, "q", 0.0, 0.0)]
    text += [glyph(0, 70, "t", None, None), ("f", 0, 71, "t", "M", 10.0, 9.0, 0.0, 1.0, 5.0)]
    a, b = spark.createDataFrame(small, GLYPHS), spark.createDataFrame(text, GLYPHS)
    out = layout.base_of_small(a, b, "ord", reach=11.0, cell=30.0)
    got = sorted((r["page"], r["ord"], r["x0"] or -1.0, r["base"], None if r["distance"] is None else round(r["distance"], 9)) for r in out.collect())
    want = []
    for s in small:
        found = []
        for t in text:
            if s[1] == t[1] and None not in (*s[6:], *t[6:]) and t[6] <= t[8]:
                x, y = (s[6] + s[8]) / 2, (s[7] + s[9]) / 2
                d = (max(t[6] - x, x - t[8], 0) ** 2 + max(t[7] - y, y - t[9], 0) ** 2) ** 0.5
                if d <= 11:
                    found.append((d, t[2]))
        d, base = min(found, default=(None, None))
        want.append((s[1], s[2], s[6] or -1.0, base, None if d is None else round(d, 9)))
    assert got == sorted(want) and any(w[3] is not None for w in want) and any(w[3] is None for w in want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    read = layout.with_readings(spark.createDataFrame([glyph(1, 3, "漢", 0.0, 10.0), glyph(1, 4, "字", 10.0, 10.0)], GLYPHS), spark.createDataFrame([("f", 1, 8, "ん", 3), ("f", 1, 7, "か", 3), ("f", 1, 9, "x", None)], "path string, page int, ord int, text string, base int"), "ord")
    assert {r["ord"]: r["text"] for r in read.collect()} == {3: "漢《かん》", 4: "字"}


def test_pages_are_dealt_to_as_many_tasks_as_their_glyphs_need(spark, monkeypatch):
    monkeypatch.setattr("inkwell.operators.order.ROWS_A_TASK", 20)
    rows = [glyph(p, i, f"t{i}", 10.0 * i, 0.0) for p in range(40) for i in range(5)]
    df = spark.createDataFrame(rows, GLYPHS)
    runs = layout.style_runs(layout.reading_order(df), separator=" ")
    assert runs.rdd.getNumPartitions() == 10 and {r["text"] for r in runs.collect()} == {"t0 t1 t2 t3 t4"}


def test_readings_meet_their_text_once(spark):
    a, b = (spark.createDataFrame([glyph(1, i, "x", 9.0 * i, 0.0) for i in range(n)], GLYPHS) for n in (3, 9))
    plan = layout.base_of_small(a, b, "ord")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2 and plan.count("Join") == 3
