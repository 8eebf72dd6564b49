"""Queries of the document operators over the driver's tables, which hold no PDFs: what stands in for what is said at each."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.text import bold_marked_markup, natural_key, sibling_name
from inkwell.operators import exports, styles
from inkwell.plans import typeset
from inkwell.sources import pdf, pdf_file, texts
from inkwell.sources.stored import shared_folder

#: A tag of any kind, or the text's beginning, and the text up to the next tag; of the tag its name, led by a slash if it closes.
RUN, TAG = r"(^|<[^>]*>)([^<]+)", r"^<(/?[a-zA-Z][a-zA-Z0-9]*)"
BODY = ("p", "b", "h1", "/b", "/a")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as glyphs: a tag is the font, the text up to the next tag a run, the tag's length the size; all text is in a run."""
    runs = F.posexplode(F.regexp_extract_all("html", F.lit(RUN), F.lit(0))).alias("ord", "run")
    tag, text = F.regexp_extract(F.regexp_extract("run", RUN, 1), TAG, 1), F.regexp_extract("run", RUN, 2)
    return table(spark, sf_dir, "pages").select("page_id", runs).select("page_id", "ord", tag.alias("font"), F.length(tag).cast("double").alias("size"), text.alias("text"))


PASSWORD = "open"


def files(spark: SparkSession, sf_dir: str, locked: bool = False) -> DataFrame:
    """path and content: conversations as PDF files, each turn a page with its text, a line for each of its lines, and a note of role, turn and text."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pages = [[(line, "Body" if k else "Head", 10.0 if k else 12.0) for k, line in enumerate(t["text"].split("\n")) if line] for t in own]
                objects = pdf_file.text_file(pages, [[(t["role"] or "", f"turn {t['turn']}", t["text"])] for t in own])
                content = pdf_file.encrypted(objects, 1, PASSWORD, "owner", name.encode()) if locked else pdf_file.file_of(objects, 1)
                yield pa.record_batch([pa.array([name]), pa.array([content], pa.binary())], names=["path", "content"])

    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))  # of one conversation
    return grouped.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".pdf")).alias("path"), "turns").mapInArrow(run, "path string, content binary")


def conv_of(path: str = "path"):
    return F.regexp_extract(path, r"c(\d+)", 1).cast("long").alias("conv_id")


def locked_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a password, read by it: the characters of each page, and how many are of the first line's size."""
    glyphs_ = pdf.glyphs(files(spark, sf_dir, locked=True), password=PASSWORD)
    large = glyphs_.groupBy("path", "page").agg(F.count(F.when(F.col("size") == 12, 1)).alias("n_head"))
    return styles.plain_text(glyphs_).join(large, ["path", "page"]).select(conv_of(), "page", "text", "n_head")


def annotation_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files' notes with author and subject."""
    return exports.export_info(pdf.annotations(files(spark, sf_dir))).select(conv_of(), "text")


def annotation_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes that say font and size, put into the files and read from them again."""
    given = files(spark, sf_dir)
    labels = styles.style_labels(pdf.glyphs(given)).select("path", "page", "x", "y", F.lit("style").alias("author"), F.col("font").alias("subject"), "label")
    return pdf.annotations(pdf.annotate(given, labels)).where("author = 'style'").select(conv_of(), "page", "subject", "contents")


def merged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files of a tenth of the conversations' numbers merged in natural order: what each page of the merged file says."""
    tenth = F.regexp_extract("path", r"(\d)\.pdf$", 1)
    merged = pdf.merge(files(spark, sf_dir), by=tenth).select(F.col("by").alias("path"), "content")
    return styles.plain_text(pdf.glyphs(merged)).select(F.col("path").alias("digit"), "page", "text")


def scan_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of the files in the folder of the tables, as a scan of a folder finds them."""
    return pdf.scan(spark, sf_dir, pattern="*.parquet").select(F.regexp_extract("path", r"([^/]+)\.parquet$", 1).alias("name"))


def style_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glyphs(spark, sf_dir)


def dominant_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return styles.dominant_style(glyphs(spark, sf_dir), ["page_id"])


def dominant_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size is the tag's length here; runs of at least the page's main size stay."""
    return styles.keep_dominant(glyphs(spark, sf_dir), 1.0, ["page_id"])


def style_filter_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = styles.keep_styles(glyphs(spark, sf_dir), keep_fonts=BODY)
    return styles.plain_text(kept, pages=table(spark, sf_dir, "pages"), separator="\n", by=["page_id"])


def size_filter_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a size of 2 at least, without scripts and styles."""
    kept = styles.keep_styles(glyphs(spark, sf_dir), min_size=2.0, drop_fonts=["script", "style"])
    return styles.plain_text(kept, separator=" ", by=["page_id"])


def numbered_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header and numbered entries from the filtered runs of each page."""
    kept = styles.keep_styles(glyphs(spark, sf_dir), keep_fonts=BODY)
    return styles.numbered_text(kept, ["page_id"], ["ord"], F.col("text"), lambda n, t: F.concat(F.lit("["), n.cast("string"), F.lit("]\n"), t), F.concat(F.lit("page "), F.col("page_id").cast("string")))


def style_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label per run: the anchor's x is the run's length, its y the order on the page."""
    runs = glyphs(spark, sf_dir).select("*", F.length("text").cast("double").alias("x1"), F.col("ord").cast("double").alias("top"))
    return styles.style_labels(runs, ["page_id", "ord", "font", "size"])


def bold_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """<b> is never closed in pages; its text up to the next tag is bold."""
    return table(spark, sf_dir, "pages").select("page_id", bold_marked_markup(F.col("html")).alias("text"))


def bold_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as an annotation whose runs are bold where the tag is b."""
    rows = glyphs(spark, sf_dir).withColumns({"path": F.col("page_id"), "page": F.lit(0), "idx": F.lit(0)})
    runs = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text", (F.col("font") == "b").alias("bold")))), lambda r: F.struct(r["text"].alias("text"), r["bold"].alias("bold")))
    return exports.export_bold(rows.groupBy("path", "page", "idx").agg(runs.alias("runs"), F.lit(None).cast("string").alias("contents"))).withColumnRenamed("path", "page_id")


def export_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a PDF, a turn an annotation."""
    return exports.export_plain(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "text")


def export_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The role is the author; there is no subject."""
    return exports.export_info(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], author="role", subject=None, text="text")


def export_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author and subject: the role, and for every other turn its number; what is null is left out."""
    rows = table(spark, sf_dir, "conversations").withColumn("subject", F.when(F.col("turn") % 2 == 1, F.concat(F.lit("turn "), F.col("turn").cast("string"))))
    return exports.export_info(rows, ["conv_id"], ["turn"], author="role", text="text")


def merge_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As merge_concat, in chunks: the length and digest of each."""
    docs = table(spark, sf_dir, "documents").withColumn("part", F.substring("source", -1, 1))
    out = exports.merge_chunks(docs, ["lang", "part"], "source", ["doc_id"], "text", chunk=20_000)
    return out.select("lang", "part", "chunk", "start", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("md5"))


def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text's name for PDFs named by page and, for every third page, a name that is no PDF's."""
    path = F.concat("url", F.when(F.col("page_id") % 3 == 0, ".html").when(F.col("page_id") % 3 == 1, ".pdf").otherwise(".PDF"))
    return table(spark, sf_dir, "pages").select("page_id", sibling_name(path).alias("out"))


def merge_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source is the file name; each language is a folder."""
    docs = table(spark, sf_dir, "documents").select("lang", "source", "doc_id")
    return exports.merge_order(docs, "source", ["lang"])


def merge_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language and source's last digit, the documents' texts by file name."""
    docs = table(spark, sf_dir, "documents").withColumn("part", F.substring("source", -1, 1))
    out = exports.merge_text(docs, ["lang", "part"], "source", ["doc_id"], "text")
    return out.select("lang", "part", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("md5"))


def merge_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As merge_concat, piece by piece: where each document stands in its language's and part's text."""
    docs = table(spark, sf_dir, "documents").select("lang", F.substring("source", -1, 1).alias("part"), "source", "doc_id", F.length("text").alias("length"))
    return exports.merge_pieces(docs, ["lang", "part"], "source", ["doc_id"], length=F.col("length")).select("lang", "part", "doc_id", "position", "start")


def natural_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of names whose digits are also full-width and lead with zeros."""
    name = F.concat("source", F.lit("第０"), F.translate(F.col("doc_id").cast("string"), "0123456789", "０１２３４５６７８９"), F.lit("話"))
    return table(spark, sf_dir, "documents").select("doc_id", natural_key(name).alias("key"))


def exported_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's text written to a file of its own and read again: length in bytes and digest of those that the listing does not rule out."""
    folder = f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}"
    out = exports.export_plain(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "text")
    texts.write_texts(out.withColumn("out", F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".txt"))), folder)
    read = texts.read_texts(spark, folder).where("length >= 400 and name like 'c%'")
    return read.select(F.regexp_extract("name", r"c(\d+)", 1).cast("long").alias("conv_id"), "length", F.md5("text").alias("md5"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (style_runs, dominant_style, dominant_filter, style_filter_plain, size_filter_plain, numbered_export, style_label, bold_wrap, bold_runs, export_plain, export_info, export_subjects, output_names, merge_order, merge_concat, merge_pieces, merge_chunks, natural_names, annotation_info, exported_texts)
}

#: Tested as the others, but not registered: they try the reading and writing of PDF files, of which the driver's tables have none.
FILE_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (locked_text, annotation_styles, merged_pages, scan_folder)}

RUNS = r"""WITH raw AS (
  SELECT page_id, regexp_extract_all(html, '(^|<[^>]*>)([^<]+)') AS rs FROM pages
), cut AS (
  SELECT page_id, unnest(range(len(rs))) AS ord, unnest(rs) AS run FROM raw
), named AS (
  SELECT page_id, CAST(ord AS INT) AS ord, regexp_extract(regexp_extract(run, '(^|<[^>]*>)([^<]+)', 1), '^<(/?[a-zA-Z][a-zA-Z0-9]*)', 1) AS font, regexp_extract(run, '(^|<[^>]*>)([^<]+)', 2) AS text FROM cut
), glyphs AS (
  SELECT page_id, ord, font, CAST(length(font) AS DOUBLE) AS size, text FROM named
)
"""
TOP = """, totals AS (
  SELECT page_id, font, size, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM glyphs GROUP BY page_id, font, size
), top AS (
  SELECT * FROM totals QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n_chars DESC, font, size) = 1
)
"""
KEY = """array_to_string(list_transform(regexp_extract_all(translate({0}, '０１２３４５６７８９', '0123456789'), '([0-9]+|[^0-9]+)'),
  lambda t: CASE WHEN regexp_full_match(t, '[0-9]+') THEN lpad(CAST(length(regexp_replace(t, '^0+', '')) AS VARCHAR), 4, '0') || regexp_replace(t, '^0+', '') ELSE t END), '')"""
NAME = "source || '第０' || translate(CAST(doc_id AS VARCHAR), '0123456789', '０１２３４５６７８９') || '話'"

SQL: dict[str, str] = {
    "style_runs": RUNS + "SELECT page_id, ord, font, size, text FROM glyphs",
    "dominant_style": RUNS + TOP + "SELECT page_id, font, size, n_chars FROM top",
    "dominant_filter": RUNS + TOP + "SELECT g.page_id, ord, g.font, g.size, text FROM glyphs g JOIN top t ON g.page_id = t.page_id WHERE g.size >= t.size",
    "style_filter_plain": RUNS + ", kept AS (SELECT page_id, string_agg(text, chr(10) ORDER BY ord) AS text FROM glyphs WHERE font IN ('p', 'b', 'h1', '/b', '/a') GROUP BY page_id) SELECT p.page_id, coalesce(text, '') AS text FROM (SELECT DISTINCT page_id FROM pages) p LEFT JOIN kept USING (page_id)",
    "size_filter_plain": RUNS + "SELECT page_id, string_agg(text, ' ' ORDER BY ord) AS text FROM glyphs WHERE size >= 2 AND font NOT IN ('script', 'style') GROUP BY page_id",
    "numbered_export": RUNS + ", kept AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS n FROM glyphs WHERE font IN ('p', 'b', 'h1', '/b', '/a')) SELECT page_id, 'page ' || page_id || chr(10) || string_agg('[' || n || ']' || chr(10) || text, chr(10) ORDER BY n) AS text FROM kept GROUP BY page_id",
    "style_label": RUNS + "SELECT page_id, ord, font, size, CAST(length(text) AS DOUBLE) AS x, CAST(ord AS DOUBLE) AS y, font || ' ' || CAST(size AS VARCHAR) AS label FROM glyphs",
    "bold_wrap": r"SELECT page_id, regexp_replace(html, '<b>([^<]+)', '【\1】', 'g') AS text FROM pages",
    "bold_runs": RUNS + "SELECT page_id, string_agg(CASE WHEN font = 'b' THEN '【' || text || '】' ELSE text END, '' ORDER BY ord) AS text FROM glyphs GROUP BY page_id",
    "export_plain": "SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
    "export_info": "WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) SELECT conv_id, string_agg(concat_ws(chr(9), CAST(k AS VARCHAR), role, coalesce(text, '')), chr(10) ORDER BY k) AS text FROM n GROUP BY conv_id",
    "export_subjects": "WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) SELECT conv_id, string_agg(concat_ws(chr(9), CAST(k AS VARCHAR), role, CASE WHEN turn % 2 = 1 THEN 'turn ' || turn END, coalesce(text, '')), chr(10) ORDER BY k) AS text FROM n GROUP BY conv_id",
    "merge_chunks": f"""WITH d AS (SELECT lang, right(source, 1) AS part, {KEY.format('source')} AS k, source, doc_id, coalesce(text, '') AS text FROM documents), p AS (
  SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY lang, part ORDER BY k, source, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d
), c AS (SELECT lang, part, start // 20000 AS chunk, min(greatest(start - 1, 0)) AS start, string_agg(CASE WHEN start > 0 THEN chr(10) ELSE '' END || text, '' ORDER BY start, k, source, doc_id) AS text FROM p GROUP BY lang, part, start // 20000)
SELECT lang, part, chunk, start, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS md5 FROM c""",
    "output_names": "SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN url || '.txt' END AS out FROM pages",
    "merge_order": f"SELECT lang, source, doc_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY {KEY.format('source')}, source, lang, doc_id) AS INT) AS position FROM documents",
    "merge_concat": f"WITH d AS (SELECT *, right(source, 1) AS part, {KEY.format('source')} AS k FROM documents), m AS (SELECT lang, part, string_agg(coalesce(text, ''), chr(10) ORDER BY k, source, doc_id) AS text FROM d GROUP BY lang, part) SELECT lang, part, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS md5 FROM m",
    "merge_pieces": f"WITH d AS (SELECT *, right(source, 1) AS part, {KEY.format('source')} AS k FROM documents) SELECT lang, part, doc_id, CAST(row_number() OVER w AS INT) AS position, CAST(coalesce(sum(length(coalesce(text, '')) + 1) OVER (PARTITION BY lang, part ORDER BY k, source, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d WINDOW w AS (PARTITION BY lang, part ORDER BY k, source, doc_id)",
    "locked_text": "WITH t AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS page, coalesce(text, '') AS text FROM conversations) SELECT conv_id, page, replace(text, chr(10), '') AS text, CAST(length(string_split(text, chr(10))[1]) AS BIGINT) AS n_head FROM t WHERE replace(text, chr(10), '') <> ''",
    "annotation_info": "WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) SELECT conv_id, string_agg(concat_ws(chr(9), CAST(k AS VARCHAR), coalesce(role, ''), 'turn ' || turn, coalesce(text, '')), chr(10) ORDER BY k) AS text FROM n GROUP BY conv_id",
    "annotation_styles": "WITH t AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS page, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations), s AS (SELECT conv_id, page, 'Head' AS subject, 'Head 12.0' AS contents FROM t WHERE ls[1] <> '' UNION ALL SELECT conv_id, page, 'Body', 'Body 10.0' FROM t WHERE len(list_filter(ls[2:], lambda x: x <> '')) > 0) SELECT * FROM s",
    "merged_pages": "WITH t AS (SELECT right(CAST(conv_id AS VARCHAR), 1) AS digit, CAST(row_number() OVER (PARTITION BY right(CAST(conv_id AS VARCHAR), 1) ORDER BY conv_id, turn) AS INT) AS page, replace(coalesce(text, ''), chr(10), '') AS text FROM conversations) SELECT * FROM t WHERE text <> ''",
    "exported_texts": "WITH t AS (SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id) SELECT conv_id, CAST(octet_length(encode(text)) AS BIGINT) AS length, md5(text) AS md5 FROM t WHERE octet_length(encode(text)) >= 400",
    "scan_folder": "SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations']) AS name",
    "natural_names": f"SELECT doc_id, {KEY.format('(' + NAME + ')')} AS key FROM documents",
}

FILE_SQL = {name: SQL.pop(name) for name in FILE_QUERIES}
QUERIES |= typeset.QUERIES
SQL |= typeset.SQL
