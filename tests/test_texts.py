"""The text folders: commit, abort, retries, pruning."""

import os

import pytest
from pyspark.sql import functions as F

from inkwell.sources import texts


def files(folder):
    return sorted(os.path.relpath(f"{d}/{n}", folder) for d, _, names in os.walk(folder) for n in names)


def test_round_trip(spark, tmp_path):
    rows = [("a.txt", "one\r\ntwo\n"), (f"{tmp_path}/sub/b.txt", "é字"), (f"file://{tmp_path}/c%20d.txt", ""), ("e.txt", None), (None, "lost")]
    df = spark.createDataFrame(rows, "out string, text string").repartition(3)
    texts.write_texts(df, str(tmp_path))
    assert files(tmp_path) == ["a.txt", "c d.txt", "e.txt", "sub/b.txt"]
    got = {r["name"]: (r["length"], r["text"]) for r in texts.read_texts(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": (9, "one\r\ntwo\n"), "b.txt": (5, "é字"), "c d.txt": (0, ""), "e.txt": (0, "")}
    texts.write_texts(df.where("out = 'a.txt'").withColumn("text", F.lit("new")), str(tmp_path))
    assert texts.read_texts(spark, str(tmp_path)).where("name = 'a.txt'").first()["text"] == "new" and len(files(tmp_path)) == 4
    texts.write_texts(df.limit(0), str(tmp_path))
    assert len(files(tmp_path)) == 4


def test_a_failing_job_leaves_nothing(spark, tmp_path):
    (tmp_path / "f1.txt").write_text("old")
    df = spark.range(40).repartition(4).select(F.concat(F.lit("f"), "id", F.lit(".txt")).alias("out"), F.when(F.col("id") == 33, F.raise_error(F.lit("broken"))).otherwise("x").alias("text"))
    with pytest.raises(Exception, match="broken"):
        texts.write_texts(df, str(tmp_path))
    assert files(tmp_path) == ["f1.txt"] and (tmp_path / "f1.txt").read_text() == "old"
    for bad in (["x.txt", "x.txt"], ["../x.txt"], ["s3://b/x.txt"]):
        with pytest.raises(Exception, match="one name|not below|mounted"):
            texts.write_texts(spark.createDataFrame([(b, "t") for b in bad], "out string, text string"), str(tmp_path))
    assert files(tmp_path) == ["f1.txt"] and not [d for d in os.listdir(tmp_path) if d.startswith(texts.HIDDEN)]


def test_a_task_that_runs_twice_leaves_one(tmp_path):
    import pyarrow as pa

    writer = texts.Writer({"path": str(tmp_path)})
    batch = pa.record_batch([pa.array(["a.txt", "b.txt"]), pa.array(["1", "2"])], names=["out", "text"])

    def broken():
        yield batch
        raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        writer.write(broken())
    writer.write(iter([batch]))  # one that has been given up
    done = writer.write(iter([batch]))
    assert not [f for f in files(tmp_path) if not f.startswith(texts.HIDDEN)]
    writer.commit([done, None])
    assert files(tmp_path) == ["a.txt", "b.txt"]


def test_filters_prune(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"n{i:02}.txt").write_text("x" * i)
    (tmp_path / ".hidden.txt").write_text("h")
    (tmp_path / "other.csv").write_text("c")
    df = texts.read_texts(spark, str(tmp_path), partition_bytes=5 * (texts.OPEN_BYTES + 30))
    assert df.count() == 30 and df.rdd.getNumPartitions() == 6
    some = df.where("length >= 20 and name like 'n2%' and name <> 'n25.txt' and text <> ''")
    assert some.rdd.getNumPartitions() == 2 and {r["name"] for r in some.collect()} == {f"n2{i}.txt" for i in range(10) if i != 5}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "length" not in plan.split("Filter", 1)[1].split("\n")[0] and "text" in plan.split("Filter", 1)[1].split("\n")[0]
    assert df.where("length in (1, 2)").count() == 2 and df.where("length < 0").count() == 0 and df.where("path is null").count() == 0
    with pytest.raises(Exception, match="missing"):
        texts.read_texts(spark, f"{tmp_path}/missing").count()
