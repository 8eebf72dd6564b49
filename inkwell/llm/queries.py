"""The subpackage's queries, thin over its operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import codes, langid, merkle, pitmanyor
from inkwell.llm.bpe import decode, encode
from inkwell.llm.jaccard import JACCARD_SQL, similar_documents
from inkwell.llm.lines import LINES_SQL, remove_repeated_lines
from inkwell.llm.neardup import NEAR_SQL, near_duplicates
from inkwell.llm.packing import pack, token_pieces
from inkwell.llm.quality import HOST_SQL, judge
from inkwell.llm.secrets import KINDS, listed, scan, scan_sql
from inkwell.llm.shared import table
from inkwell.llm.substring import remove_repeats
from inkwell.llm.toxicity import held_out, score, train


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = token_pieces(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(pieces, items=docs.count())  # a document has one piece that is not full at most


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decode(encode(table(spark, sf_dir, "documents")))
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    return out.select("doc_id", *map(count, range(3)), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("host", "host_rate")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", "longest_run", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"), shingle=3, percent=90)


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, docs.where(~held_out(F.col("doc_id"))).select("doc_id", "lang"))
    out = langid.predict(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), pitmanyor.held_out(F.col("doc_id"))
    model = pitmanyor.train(docs.where(~out))
    return pitmanyor.score(docs, model).withColumns({"held_out": out, "train_tokens": F.lit(model.n_tokens).cast("long")})


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = codes.compress(table(spark, sf_dir, "embeddings"))
    return out.drop("label").withColumn("codebooks_sha256", F.lit(codes.digest(books)))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = [F.col(c) for c in merkle.FIELDS]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    other = F.when(F.coalesce(tampered, F.lit(False)), merkle.leaf(*first, merkle.lower_ascii(F.col("text"))))
    leaves = table(spark, sf_dir, "documents").select("doc_id", "lang", merkle.leaf(*first, F.col("text")).alias("leaf"), other.alias("tampered"))
    out = merkle.manifest(leaves)
    ended = out.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return ended.select("doc_id", "leaf", "subroot", "root", merkle.sha(merkle.siblings(F.col("proof"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


SUBSTRING_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, words, unnest(range(1, greatest(len(words) - 18, 1))) AS i FROM w
), named AS (
  SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS win FROM windows
), firsts AS (
  SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM named
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM firsts WHERE k > 1
), cut AS (
  SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_transform(list_filter(range(1, len(words) + 1), lambda j: js IS NULL OR NOT list_contains(js, j)), lambda j: words[j]), ' ')) AS kept_sha256
FROM w LEFT JOIN cut USING (doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_secret_scan": op2_secret_scan,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_quality_rules": op5_quality_rules,
    "op6_line_dedup": op6_line_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_language_id": op10_language_id,
    "op11_pitman_yor": op11_pitman_yor,
    "op12_vector_codes": op12_vector_codes,
    "op13_merkle_manifest": op13_merkle_manifest,
}

SQL: dict[str, str] = {
    "op2_secret_scan": scan_sql(),
    "op3_substring_dedup": SUBSTRING_SQL,
    "op5_quality_rules": HOST_SQL,
    "op6_line_dedup": LINES_SQL,
    "op8_jaccard_join": JACCARD_SQL,
    "op9_embedding_near_dedup": NEAR_SQL,
    "op12_vector_codes": codes.codes_sql(),
    "op13_merkle_manifest": merkle.manifest_sql(),
}
