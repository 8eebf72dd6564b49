"""Alignment of edited entries against brute force."""

import random

from pyspark.sql import functions as F

from inkwell.operators import align, styles


def longest(a, b):
    """Length of a longest common subsequence, by definition."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_is_a_longest_subsequence():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 14))] for _ in range(2))
        got = align.common(a, b)
        assert all(a[i] == b[j] for i, j in got) and got == sorted(set(got)) and len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
        assert len(got) == longest(a, b), (a, b, got)


def test_chain_is_the_longest():
    rng = random.Random(2)
    for _ in range(100):
        js = list(range(rng.randint(0, 9)))
        rng.shuffle(js)
        got = align.increasing(list(enumerate(js)))
        assert got == sorted(got) and [j for _, j in got] == sorted(j for _, j in got) and len(got) == longest(js, sorted(js))


def check(rows, a, b):
    """Whether rows (by place) tell how a became b."""
    assert [r["place"] for r in rows] == list(range(1, len(rows) + 1))
    assert [(r["was"], r["text"]) for r in rows if r["was"]] == list(enumerate(a, 1)) and [(r["now"], r["edited"]) for r in rows if r["now"]] == list(enumerate(b, 1))
    for r in rows:
        assert r["kind"] == ("inserted" if r["was"] is None else "deleted" if r["now"] is None else "same" if r["text"] == r["edited"] else "changed")


def test_align(spark):
    rng, a, b = random.Random(3), {}, {}
    for f in range(25):
        lines = [f"line {k}" for k in range(rng.randint(0, 30))]
        new = []
        for line in lines:
            new += rng.choice([[line]] * 6 + [[], [line + "!"], [line, f"new {rng.random()}"]])
        a[f"f{f}"], b[f"f{f}"] = lines, new
    for f in range(15):  # few kinds of lines, moved ones, nulls
        a[f"g{f}"], b[f"g{f}"] = ([rng.choice(["x", "y", "", None, f"only {rng.randint(0, 9)}"]) for _ in range(rng.randint(0, 20))] for _ in range(2))
    a["gone"], b["come"], a[None], b[None] = ["p", "q"], ["r"], ["s", "t"], ["t", "s"]
    make = lambda files: spark.createDataFrame([(f, n, t) for f, lines in files.items() for n, t in enumerate(lines)], "f string, n int, text string").repartition(3)
    found = {}
    for r in align.align(make(a), make(b), ["f"]).orderBy("f", "place").collect():
        found.setdefault(r["f"], []).append(r)
    for f in a.keys() | b.keys():
        check(found.get(f, []), a.get(f, []), b.get(f, []))
        if f and f[0] == "f":  # nothing has moved, so the anchors cost no match
            assert sum(r["kind"] == "same" for r in found.get(f, [])) == longest(a[f], b[f])
    assert align.align(make({}), make({}), ["f"]).count() == 0


def test_read_back_and_applied(spark):
    entries = spark.createDataFrame([("f", 1, "one\nmore"), ("f", 2, "two"), ("f", 3, ""), ("g", 1, "12. odd")], "path string, n int, text string")
    texts = styles.numbered_text(entries, ["path"], ["n"], F.col("text"), header=F.lit("head"))
    read = align.numbered_entries(texts, ["path"])
    assert {(r["path"], r["n"], r["text"]) for r in read.collect()} == {("f", 1, "one\nmore"), ("f", 2, "two"), ("f", 3, ""), ("g", 1, "12. odd")}
    assert align.numbered_entries(texts, ["path"], header=True).where("n = 0").first()["text"] == "head"
    assert align.numbered_entries(texts.withColumn("text", F.lit(None).cast("string")), ["path"]).count() == 0
    edited = spark.createDataFrame([("f", 1, "one\nmore"), ("f", 2, "new"), ("f", 3, "")], "path string, n int, text string")
    found = align.align(entries.where("path = 'f'"), edited, ["path"])
    assert [(r["n"], r["text"]) for r in align.applied(found, ["path"]).orderBy("n").collect()] == [(1, "one\nmore"), (2, "new"), (3, "")]
    assert [(r["n"], r["text"]) for r in align.applied(found, ["path"], F.col("kind") == "inserted").orderBy("n").collect()] == [(1, "one\nmore"), (2, "two"), (3, "")]


def test_files_share_calls_and_stay_apart(spark, monkeypatch):
    nan = float("nan")
    names = [None, nan, *map(float, range(30))]
    a = [(f, n, f"line {n % 4} {n // 4}") for f in names for n in range(9)]
    b = [(f, n, "new" if n == 4 else t) for f, n, t in a if n != 2]
    kind = "f double, n int, text string"
    found = []
    for lines in (2, 10**6):  # a file to a call and all files in one
        monkeypatch.setattr(align, "LINES", lines)
        out = align.align(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), ["f"])
        found.append(sorted((str(r["f"]), r["place"], r["was"] or 0, r["now"] or 0, r["kind"]) for r in out.collect()))
    want = [(1, 1, 1, "same"), (2, 2, 2, "same"), (3, 3, 0, "deleted"), (4, 4, 3, "same"), (5, 5, 4, "changed"), *((k, k, k - 1, "same") for k in range(6, 10))]
    assert found[0] == found[1] == sorted((str(f), *w) for f in names for w in want)
