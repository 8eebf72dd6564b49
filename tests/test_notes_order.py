"""Positions by ranges, nearest matches and nested bold against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from inkwell.functions.text import bold_merged
from inkwell.operators import anchors, exports, marks, order, styles
from inkwell.sources import stored


@pytest.mark.parametrize("by", [["g"], []])
def test_positions(spark, by):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1, 2, 3, rng.randint(0, 99)]), rng.choice([None, rng.randint(0, 9)]), i) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, k int, n int, position int").repartition(5)
    out = order.positions(df.withColumnRenamed("position", "id"), by, [F.col("k"), F.col("id")], F.col("n"), tasks=6)
    assert out.columns == ["g", "k", "n", "id", "position", "start"]
    want, seen = {}, {}
    for g, k, n, i in sorted(rows, key=lambda r: ((r[0] is not None, r[0] or "") if by else 0, (r[1] is not None, r[1] or 0), r[3])):
        key = g if by else 0
        p, s = seen.get(key, (0, 0))
        want[i] = (p + 1, s)
        seen[key] = (p + 1, s + (n or 0))
    assert {r["id"]: (r["position"], r["start"]) for r in out.collect()} == want
    assert order.positions(df.limit(0), by, [F.col("k")]).count() == 0


def test_what_is_stored_can_be_deleted(spark):
    held = len(stored.MADE)
    out = order.positions(spark.range(9), [], [F.col("id")])
    assert out.count() == 9 and len(stored.MADE) == held + 1
    stored.delete(spark, stored.MADE[held:])
    assert len(stored.MADE) == held
    with pytest.raises(Exception, match="(?i)exist|not found"):
        out.count()


def test_equal_rows_are_divided_and_no_task_has_all(spark):
    df = spark.createDataFrame([("a", "x")] * 600, "g string, name string")
    out = order.positions(df, ["g"], [F.col("name")], tasks=4)
    assert sorted(r["position"] for r in out.collect()) == list(range(1, 601))
    assert max(r["count"] for r in out.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()) <= 600
    merged = exports.merge_order(df, "name")  # over all files
    plan = merged._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window" in line]
    assert windows and all("_own" in line for line in windows)  # of one row for each range


def test_pieces_are_where_the_merged_text_has_them(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b"]), f"p{rng.randint(1, 30)}", i, rng.choice([None, "", "x" * rng.randint(1, 9), "é字"])) for i in range(80)]
    df = spark.createDataFrame(rows, "g string, name string, id int, text string")
    merged = {r["g"]: r["text"] for r in exports.merge_text(df, ["g"], "name", ["id"], "text").collect()}
    for pieces in (exports.merge_pieces(df, ["g"], "name", ["id"], "text"), exports.merge_pieces(df, ["g"], "name", ["id"], length=F.length("text"))):
        for r in pieces.collect():
            t = r["text"] or ""
            assert merged[r["g"]][r["start"] : r["start"] + len(t)] == t


def test_chunks_are_the_merged_text(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", None]), f"p{rng.randint(1, 30)}", i, rng.choice([None, "", "x" * rng.randint(1, 40), "é字"])) for i in range(90)]
    df = spark.createDataFrame(rows, "g string, name string, id int, text string")
    merged = {r["g"]: r["text"] for r in exports.merge_text(df, ["g"], "name", ["id"], "text", "--").collect()}
    chunks = exports.merge_chunks(df, ["g"], "name", ["id"], "text", "--", chunk=50).orderBy("chunk").collect()
    for g, text in merged.items():
        own = [r for r in chunks if r["g"] == g]
        assert "".join(r["text"] for r in own) == text and len(own) > 5 and max(len(r["text"]) for r in own) <= 50 + 42
        assert all(text[r["start"] :].startswith(r["text"]) for r in own)
    assert exports.merge_chunks(df.limit(0), ["g"], "name", ["id"], "text").count() == 0


def test_names_that_operators_use_themselves_pass(spark):
    df = spark.createDataFrame([("f", 1, 0, "A", "s", "t", "n", "k", 12.0, "F")], "path string, page int, idx int, author string, subject string, contents string, _n string, _k string, size double, font string").withColumns({"_t": F.lit("t"), "_main": F.lit("m"), "name": F.lit("p2"), "text": F.col("contents"), "ord": F.lit(1)})
    assert exports.export_info(df, by=["path", "_n"]).first()["text"] == "1\tA\ts\tt"
    assert exports.export_plain(df, by=["path"], order=["_t", "idx"]).first()["text"] == "t"
    assert exports.merge_text(df, ["_k"], "name", ["_t"], "text").first()["text"] == "t"
    assert styles.keep_dominant(df).columns == df.columns and styles.dominant_style(df, ["_k"]).first()["size"] == 12.0
    assert styles.numbered_text(df, ["_n"], ["idx"], F.col("text")).first()["text"] == "1. t"


def test_nearest(spark):
    rng = random.Random(4)
    left = [(rng.choice(["a", "b", None]), rng.choice([None, float(rng.randint(0, 40))]), i) for i in range(150)]
    right = [(rng.choice(["a", "b", None, "c"]), rng.choice([None, float(rng.randint(0, 40))]), rng.choice(["u", "v", "w"])) for _ in range(25)]
    a, b = spark.createDataFrame([*left, left[0]], "g string, at double, id int"), spark.createDataFrame(right, "g string, to double, v string")
    for direction in ("nearest", "backward", "forward"):
        got = sorted((r["id"], r["v"]) for r in anchors.nearest(a, b, ["g"], "at", "to", ["v"], 6.0, direction).collect())
        want = []
        for g, at, i in [*left, left[0]]:
            near = [(abs(to - at), to > at, v) for h, to, v in right if h == g and to is not None and at is not None and abs(to - at) <= 6]
            near = [n for n in near if direction == "nearest" or n[0] == 0 or n[1] == (direction == "forward")]
            want.append((i, min(near)[2] if near else None))
        assert sorted(got, key=str) == sorted(want, key=str), direction
    plan = anchors.nearest(a, b, ["g"], "at", "to", ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert anchors.nearest(a.limit(0), b, ["g"], "at", "to", ["v"]).count() == 0 and anchors.nearest(a, b.limit(0), ["g"], "at", "to", ["v"]).where("v is not null").count() == 0


def test_notes_get_the_style_they_stand_at(spark):
    runs = spark.createDataFrame([("f", 1, 50.0, 10.0, "A", 9.0), ("f", 1, 90.0, 12.0, "B", 8.0), ("f", 1, 50.0, 30.0, "C", None), ("f", 2, 1.0, None, "D", 1.0)], "path string, page int, x double, y double, font string, size double")
    notes = spark.createDataFrame([("f", 1, 51.0, 11.0, "n1", 0), ("f", 1, 80.0, 10.0, "n2", 1), ("f", 1, 52.0, 29.0, "n3", 2), ("f", 1, None, 29.0, "n4", 3), ("f", 2, 1.0, 1.0, None, 4), ("f", 1, 50.0, 21.0, "n5", 5), (None, 1, 50.0, 10.0, "n6", 6)], "path string, page int, x double, y double, contents string, idx int")
    got = {r["idx"]: (r["font"], r["size"]) for r in anchors.note_styles(notes, runs).collect()}
    assert got == {0: ("A", 9.0), 1: ("B", 8.0), 2: ("C", None), 3: (None, None), 4: (None, None), 5: ("A", 9.0), 6: (None, None)}
    assert {r["idx"] for r in anchors.note_styles(notes, runs, reach=5.0).where("font is not null").collect()} == {0, 2}
    text = anchors.export_styled(notes.where("idx < 3"), runs).collect()[0]["text"]
    assert text == "A\t9.0\tn1\nB\t8.0\tn2\nC\tn3"


@pytest.mark.parametrize(("html", "want"), [
    ("a<b>x</b><b>y</b>c", "a【xy】c"), ("<b>a<strong>b</strong>c</b>d", "【abc】d"), ("a<b>b", "a【b】"), ("a</b>b<b>c</b>", "ab【c】"), ("a<b></b>c", "ac"), ("<b>x</b><i> </i><b>y</b>", "【x】 【y】"),
    ("", ""), (None, ""), ("<p>", ""), ("1 < 2 <b>3</b>", "1 < 2 【3】"), ("【a】<b>c</b>", "【a】【c】"), ("<B class='k'>x</B >y", "【x】y"), ("<b/>x", "x"), ("<br>x<body>y", "xy"), ("<b>a</b></b><b>c</b>", "【ac】"),
])
def test_nested_bold(spark, html, want):
    df = spark.createDataFrame([(1, html), (None, html)], "id int, html string")
    assert {r["id"]: r["text"] for r in marks.bold_text(df, ["id"], "html").collect()} == {1: want, None: want}


def test_runs_that_touch_share_brackets(spark):
    rows = [([("x", True), ("y", True), ("z", False)], "【xy】z"), ([("x", True), (None, False), ("", None), ("y", True)], "【xy】"), ([("a", None), (None, True)], "a"), ([], ""), (None, None), ([("x", True), ("y", False), ("z", True)], "【x】y【z】")]
    df = spark.createDataFrame(rows, "runs array<struct<text:string,bold:boolean>>, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", bold_merged(F.col("runs"))).collect())


def test_nearest_is_linear_and_dealt_by_its_rows(spark, monkeypatch):
    """No frame reaches to the end of a page, which would be read once for each row."""
    monkeypatch.setattr("inkwell.operators.order.ROWS_A_TASK", 10)
    left = spark.createDataFrame([(p, float(x)) for p in range(6) for x in range(10)], "p int, x double")
    right = spark.createDataFrame([(p, x + 0.25, f"{v}{x}") for p in range(6) for x in range(0, 10, 3) for v in "ba"], "p int, to double, v string")
    out = anchors.nearest(left, right, ["p"], "x", "to", ["v"])
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower() and out.rdd.getNumPartitions() == 11
    got = {(r["p"], r["x"]): r["v"] for r in out.collect()}
    assert got == {(p, float(x)): "a" + str(min(range(0, 10, 3), key=lambda y: (abs(y + 0.25 - x), y))) for p in range(6) for x in range(10)}
