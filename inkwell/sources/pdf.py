"""PDF files as DataFrames: scan, decode, annotate, merge."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators.exports import merge_order
from inkwell.schema import ANNOTATIONS, GLYPHS
from inkwell.sources import pdf_file


def scan(spark: SparkSession, path: str, pattern: str = "*.{pdf,PDF}", recursive: bool = False) -> DataFrame:
    """path, modificationTime, length and content of a PDF file or of all PDFs of a folder.

    Filters on path and length belong here, before decoding: Spark takes a filter on length to the scan,
    and reads no content where none is asked for, but it moves no filter through a decoder.
    """
    reader = spark.read.format("binaryFile")
    if not path.lower().endswith(".pdf"):
        reader = reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path)


def decoded(files: DataFrame, rows_of: Callable, schema, password: str, errors: str) -> DataFrame:
    """rows_of(pdf) for each file; a file that can't be read fails the job, or is left out with errors="skip"."""
    if errors not in ("fail", "skip"):
        raise ValueError("errors is fail or skip")
    kinds = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows = [(path, *row) for row in rows_of(pdf_file.Pdf(content.as_py() or b"", password))]
                except Exception as error:
                    if errors == "skip":
                        continue
                    raise pdf_file.PdfError(f"{path}: {error}") from error
                yield pa.RecordBatch.from_pylist([dict(zip(kinds, r, strict=True)) for r in rows], schema=to_arrow(schema))

    return dealt(files.select("path", "content")).mapInArrow(run, schema)


def dealt(files: DataFrame) -> DataFrame:
    """files in as many partitions as shuffles have: what a file costs is not its bytes, by which small partitions are put together."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def to_arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def glyphs_of(pdf) -> list[tuple]:
    return [(k + 1, i, *g) for k, (_, page) in enumerate(pdf.pages()) for i, g in enumerate(pdf_file.page_glyphs(pdf, page))]


def annotations_of(pdf) -> list[tuple]:
    out = []
    for k, (_, page) in enumerate(pdf.pages()):
        for i, (author, subject, contents, runs) in enumerate(pdf_file.page_annotations(pdf, page)):
            out.append((k + 1, i, author, subject, contents, [{"text": t, "bold": b} for t, b in runs]))
    return out


def glyphs(files: DataFrame, password: str = "", errors: str = "fail") -> DataFrame:
    """The characters of the files' pages with font, size and place, top and bottom from the upper edge; pages count from 1."""
    return decoded(files, glyphs_of, GLYPHS, password, errors)


def annotations(files: DataFrame, password: str = "", errors: str = "fail") -> DataFrame:
    """The files' annotations with their author, subject, contents and runs; bold comes from the rich contents."""
    return decoded(files, annotations_of, ANNOTATIONS, password, errors)


def annotate(files: DataFrame, notes: DataFrame, password: str = "") -> DataFrame:
    """path and content of each file with notes added; files without notes stay as they are.

    notes: path, page (from 1), x, y, author, subject, label: what style_labels() gives, with an author and a subject.
    """
    per_file = notes.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("page", "y", "x", "author", "subject", "label"))).alias("notes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if own:
                    content = pdf_file.annotated(content, [(n["page"] - 1, n["x"], n["y"], n["author"] or "", n["subject"] or "", n["label"] or "") for n in own], password)
                yield pa.record_batch([pa.array([path]), pa.array([content], pa.binary())], names=["path", "content"])

    return files.select("path", "content").join(per_file, "path", "left").mapInArrow(run, "path string, content binary")


def merge(files: DataFrame, by: Column | None = None, password: str = "") -> DataFrame:
    """by and content: one PDF of each group's files in their natural order; by: the folder, if not given.

    A merged file is one value, so one task makes it, and its parts must fit in that task's memory.
    """
    folder = by if by is not None else F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    ordered = merge_order(files.select(folder.alias("by"), "path"), "path", ["by"]).join(files.select("path", "content"), "path")

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("position")
        content = pdf_file.merged(rows.column("content").to_pylist(), [password] * rows.num_rows)
        return pa.table({"by": rows.column("by")[:1].cast(pa.string()), "content": pa.array([content], pa.binary())})

    return ordered.select("by", "position", "content").groupBy("by").applyInArrow(run, "by string, content binary")
