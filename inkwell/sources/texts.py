"""Folders of text files as a data source: a reader that skips files by path and length, a writer that commits all files or none.

``spark.read.format("texts").load(folder)`` and ``df.write.format("texts").mode("append").save(folder)`` after register(spark).
The folder is one that the driver and all executors have mounted; a Python data source has no other file systems.
"""

from __future__ import annotations

import os
import shutil
import time
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

READ = "path string, name string, length long, text string"
#: Bytes of a partition, and what opening a file counts as.
PARTITION_BYTES, OPEN_BYTES = 64 << 20, 64 << 10
HIDDEN = ".texts-"


def local(path: str) -> str:
    """A path of the file system; file: and percent signs are read, other schemes are refused."""
    found = urllib.parse.urlparse(path)
    if found.scheme not in ("", "file"):
        raise ValueError(f"{path}: only mounted folders can be read or written")
    return os.path.abspath(urllib.parse.unquote(found.path) if found.scheme else path)


@dataclass
class Slice(ds.InputPartition):
    """Files of one task: path and length."""

    files: list[tuple[str, int]]


#: Filters that a file's path, name and length decide; a null value or another kind is left to Spark.
TESTS = {
    ds.EqualTo: lambda a, b: a == b, ds.EqualNullSafe: lambda a, b: a == b, ds.GreaterThan: lambda a, b: a > b, ds.GreaterThanOrEqual: lambda a, b: a >= b, ds.LessThan: lambda a, b: a < b, ds.LessThanOrEqual: lambda a, b: a <= b,
    ds.In: lambda a, b: a in b, ds.StringStartsWith: lambda a, b: a.startswith(b), ds.StringEndsWith: lambda a, b: a.endswith(b), ds.StringContains: lambda a, b: b in a,
}


def decided(found: ds.Filter) -> tuple[str, object] | None:
    """The column and a test of its value, if the listing decides the filter."""
    negated = isinstance(found, ds.Not)
    inner = found.child if negated else found
    if isinstance(inner, ds.IsNotNull) and not negated and inner.attribute[0] in ("path", "name", "length"):
        return inner.attribute[0], lambda _: True
    test = TESTS.get(type(inner))
    if test is None or len(inner.attribute) != 1 or inner.attribute[0] not in ("path", "name", "length"):
        return None
    value = inner.value
    if value is None or isinstance(value, (list, tuple)) and None in value:
        return None
    return inner.attribute[0], (lambda v: not test(v, value)) if negated else (lambda v: test(v, value))


class Reader(ds.DataSourceReader):
    """Rows of READ, one for each file whose name ends in suffix, below the folder at any depth; hidden names are left out."""

    def __init__(self, options: dict):
        self.root = local(options.get("path") or "")
        self.suffix = options.get("suffix", ".txt")
        self.most = int(options.get("partitionbytes", PARTITION_BYTES))
        self.tests: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:  # noqa: N802
        for f in filters:
            test = decided(f)
            if test is None:
                yield f
            else:
                self.tests.append(test)

    def listed(self) -> Iterator[tuple[str, int]]:
        if not os.path.isdir(self.root):
            raise FileNotFoundError(self.root)
        for folder, inner, names in os.walk(self.root):
            inner[:] = sorted(x for x in inner if x[0] not in "._")
            for name in sorted(names):
                path = f"{folder}/{name}"
                if name[0] not in "._" and name.endswith(self.suffix):
                    length = os.path.getsize(path)
                    if all(test({"path": path, "name": name, "length": length}[c]) for c, test in self.tests):
                        yield path, length

    def partitions(self) -> list[Slice]:
        """As many files together as have about partitionBytes; no files, no partition but an empty one."""
        out, total = [Slice([])], 0
        for path, length in self.listed():
            if total and total + length + OPEN_BYTES > self.most:
                out.append(Slice([]))
                total = 0
            out[-1].files.append((path, length))
            total += length + OPEN_BYTES
        return out

    def read(self, partition: Slice) -> Iterator[tuple]:
        for path, length in partition.files:
            with open(path, encoding="utf-8", newline="") as file:
                yield path, os.path.basename(path), length, file.read()


@dataclass
class Written(ds.WriterCommitMessage):
    """Of one task: where each text waits, where it belongs, and its bytes."""

    files: list[tuple[str, str, int]] = field(default_factory=list)


class Writer(ds.DataSourceArrowWriter):
    """Each row's text becomes the file that out names, below the folder; a null out is left alone, a null text is an empty file.

    A task writes into a hidden folder of the job beside the files; the commit moves all into place and deletes that folder.  A task that fails or runs twice leaves
    nothing else, and where the job fails no file appears and none is changed.  A file that is there already is replaced.
    Two rows with one out, or an out that is not below the folder, fail the job.
    """

    def __init__(self, options: dict):
        self.root = local(options.get("path") or "")
        self.job = f"{self.root}/{HIDDEN}{uuid.uuid4().hex}"
        os.makedirs(self.job)  # here, on the driver, so that a task which outlives the job can't make it again

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        done = Written()
        own = f"{self.job}/{uuid.uuid4().hex}"
        os.mkdir(own)
        for batch in batches:
            for out, text in zip(batch.column("out").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if out is None:
                    continue
                place = local(out if "/" in out else f"{self.root}/{out}")
                if not place.startswith(f"{self.root}/"):
                    raise ValueError(f"{out} is not below {self.root}")
                data = (text or "").encode()
                part = f"{own}/{len(done.files)}"
                with open(part, "wb") as file:
                    file.write(data)
                done.files.append((part, place, len(data)))
        return done

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m for f in m.files]
        if len({place for _, place, _ in files}) < len(files):
            self.abort(messages)
            raise ValueError("two texts have one name")
        for part, place, _ in files:
            os.makedirs(os.path.dirname(place), exist_ok=True)
            os.replace(part, place)
        self.clear()

    def abort(self, messages: list[Written | None]) -> None:
        self.clear()

    def clear(self) -> None:
        for _ in range(20):  # a task that is being stopped may still add to it
            shutil.rmtree(self.job, ignore_errors=True)
            if not os.path.exists(self.job):
                return
            time.sleep(0.1)


class Texts(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "texts"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known; filters reach a Python data source only where Spark is told to pass them on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Texts)


def read_texts(spark: SparkSession, folder: str, suffix: str = ".txt", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """path, name, length (bytes) and text (UTF-8) of the text files below a folder; filters on the first three are decided before any file is opened."""
    register(spark)
    return spark.read.format("texts").option("suffix", suffix).option("partitionBytes", partition_bytes).load(folder)


def write_texts(exports: DataFrame, folder: str, text: str = "text", out: str = "out") -> None:
    """Writes each text to the file below folder that out names (a path, or a name in the folder): all files, or none where a task fails for good."""
    register(exports.sparkSession)
    exports.selectExpr(f"`{out}` as out", f"`{text}` as text").write.format("texts").mode("append").save(folder)
