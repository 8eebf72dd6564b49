"""The corpus pipeline: toxic documents go, repeated lines go, one document of each group of near copies stays, secrets are masked, the rest is packed.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns the columns of
documents, but for the last, which returns the packed pieces.  n_chars follows the text where a stage changes it.
Null and empty texts pass through the first four stages as they are; no stage fails on an empty table, on repeated rows or ids,
or on columns of any names besides.  Rows that share a doc_id are judged each by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import jaccard, lines, packing, secrets, shared, toxicity

#: Documents scored at least this are rejected.
TOXIC = 0.5


def with_text(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The columns of docs, n_chars as long as the text."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*shared.quoted(docs.columns))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from labels of the documents of the input."""
    model = toxicity.train(docs, shared.table(spark, sf_dir, "labels"))
    return toxicity.below(docs, model, TOXIC)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated lines; a document of which no line is left goes, as all of it stands elsewhere."""
    out = lines.remove_repeated_lines(docs)
    n_lines, n_removed = (out[c] for c in out.columns[len(docs.columns) :][:2])
    return with_text(docs, out.where((n_removed == 0) | (n_removed < n_lines)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The text with the smallest id of each group of near copies, at five words and 0.8; rows without an id stay."""
    return jaccard.without_copies(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return with_text(docs, secrets.mask_secrets(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = packing.token_pieces(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(pieces, items=docs.count())


STAGES = [("toxicity", toxic), ("line dedup", repeated_lines), ("near copies", near_copies), ("secret scan", secret_scan), ("packing", pack)]

#: The first stage is a learnt classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written as Parquet in the shared folder and read again.

    What a stage's operator kept there goes when its result is written, and so does the result before it.  The last one, which the returned pieces are read from,
    stays in shared.MADE, for shared.delete() once the pieces are written.
    """
    docs, results = shared.table(spark, sf_dir, "documents"), shared.folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        before = len(shared.MADE)
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{results}/{k}")
            shared.delete(spark, shared.MADE[before:])
            if k:
                shared.remove(spark, f"{results}/{k - 1}")
            docs = spark.read.schema(docs.schema).parquet(f"{results}/{k}")
    return docs
