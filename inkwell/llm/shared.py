"""What the operators share: tables, the shared folder, sizes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    Where the session names none: on one machine a temporary folder, as in tests; on a cluster one beside the tables of the warehouse.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not folder and not re.match(r"local(\[|$)", context.master):
            folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_inkwell"
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="inkwell-checkpoint-"))
    return folder or context._jsc.sc().getCheckpointDir().get()


#: Folders that operators have made in the shared folder and not deleted, as the DataFrames that they return read them.
MADE: list[str] = []


def folder(spark: SparkSession, what: str) -> str:
    """A new folder's path in the shared folder."""
    MADE.append(f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}")
    return MADE[-1]


def remove(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def delete(spark: SparkSession, folders: Iterable[str]) -> None:
    """Folders that nothing reads any more."""
    for name in list(folders):
        remove(spark, name)
        MADE.remove(name)


class Scratch:
    """Tables that the steps of one operator write in the shared folder and read again; drop() deletes those that nothing reads any more."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.path, self.tables = spark, folder(spark, what), 0

    def store(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """df written and read again, in as many files as rows need if they are known; a lost executor costs nothing of it."""
        self.tables += 1
        path = f"{self.path}/{self.tables}"
        (df if rows is None else few(df, rows)).write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        delete(self.spark, [self.path])


def free(names: Iterable[str], taken: Iterable[str]) -> list[str]:
    """Each name with as many underscores behind it as it takes to differ from all names taken, in lower case as Spark compares them."""
    used, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def quoted(names: Iterable[str]) -> list[str]:
    """Names as Spark reads them whatever characters they hold, a full stop too."""
    return ["`" + x.replace("`", "``") + "`" for x in names]


def numbered(df: DataFrame) -> DataFrame:
    """df with columns c0, c1, ...: what goes to Arrow is sought by name, which a full stop or a backtick in it would break."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


#: Narrow rows that one task takes of a table whose size has been counted.
ROWS_A_TASK = 200_000


def few(df: DataFrame, rows: int) -> DataFrame:
    """df in as many partitions as that many rows need, so that small steps don't leave a file for each of a large table's partitions."""
    return df.coalesce(max(1, -(-rows // ROWS_A_TASK)))


def tasks(spark: SparkSession) -> int:
    """Tasks for what takes longer than its bytes say; a number that is asked for is kept, where a default may be lowered to fit the bytes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def saved(df: DataFrame) -> DataFrame:
    """df cut from its lineage, in the shared folder; a lost executor costs nothing of it."""
    checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    kept = out._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if kept.isDefined():
        MADE.append(kept.get())
    return out


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet under the shared folder and read again; for wide rows, which it compresses."""
    path = folder(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Words of 64 bits of a sieve: some tens of MB in each executor at most, whatever the tables.
SIEVE = 1 << 19


def sieved(df: DataFrame, marks: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of df that marks may have by keys, among them all that it has, and the other rows, which a join needs not be dealt for.

    A key of marks is a bit of a table of SIEVE words at most, which all tasks get; keys, none of them null, are columns of both.
    With more keys than bits nearly all rows may be in marks, so the join still has to tell.
    """
    place, word, bits = free(["place", "word", "bits"], df.columns)
    at = F.pmod(F.xxhash64(*keys), F.lit(SIEVE << 6))
    table = marks.select(at.alias(place)).groupBy(F.shiftright(place, 6).alias(word)).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({place} & 63 as int))")).alias(bits))
    table = saved(few(table, SIEVE))
    placed = df.withColumn(place, at).withColumn(word, F.shiftright(place, 6)).join(F.broadcast(table), word, "left")
    met = F.coalesce(F.expr(f"shiftright({bits}, cast({place} & 63 as int)) & 1"), F.lit(0)) == 1
    return placed.where(met).select(*quoted(df.columns)), placed.where(~met).select(*quoted(df.columns))


def text_size(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and bytes of text, measured."""
    row = docs.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0)).alias("bytes")).first()
    return row["rows"], row["bytes"]
