"""Queries of the operators on page geometry.  The driver's tables hold no geometry, so conversations are typeset by expressions.

A conversation is a file, a turn a page: its first word a headline across the page, the others in two columns of lines of six words, or,
on odd pages, in two tiers of vertical lines from right to left, jittered a little.  Every eleventh word has a reading in small type beside it.
The stream's order (ord) is a permutation, so only the geometry tells the reading order, and what each query must give
is known from the words' places in the turn.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import align, anchors, layout, marks, styles
from inkwell.operators.order import tasks_for
from inkwell.sources.stored import stored

PAGE = ("conv_id", "page")
BLANK = r"[\x20\x09-\x0D]+"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, page, k, text and the box of each word."""
    cut = turns(spark, sf_dir).select("conv_id", F.col("turn").alias("page"), F.filter(F.split(F.coalesce("text", F.lit("")), BLANK), lambda w: w != "").alias("words"))
    rows = cut.select(*PAGE, F.size("words").alias("n"), F.posexplode("words").alias("k", "text"))
    rows = rows.withColumn("half", F.when(F.col("n") >= 17, F.expr("cast(ceil((n - 1) / 2) as int)")).otherwise(F.greatest(F.col("n") - 1, F.lit(1))))
    rows = rows.selectExpr("*", "(k - 1) div half as part", "(k - 1) % half as i").selectExpr("*", "i div 6 as ln", "i % 6 as slot", "(k * 5) % 3 as jitter", "page % 2 = 1 as down")
    box = {
        "x0": "if(down, 690.0 - 18 * ln - jitter, 420.0 * part + 60 * slot)", "top": "if(down, 60.0 + 420 * part + 60 * slot, 60.0 + 18 * ln + jitter)",
        "x1": "if(down, 700.0 - 18 * ln - jitter, 420.0 * part + 60 * slot + 52)", "bottom": "if(down, 112.0 + 420 * part + 60 * slot, 70.0 + 18 * ln + jitter)",
    }
    head = {"x0": 0, "top": 0, "x1": 700, "bottom": 16}
    return rows.selectExpr("conv_id", "page", "k", "text", "down", *(f"cast(if(k = 0, {head[c]}, {e}) as double) as {c}" for c, e in box.items()))


def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words and their readings as glyphs, whose ord is no reading order."""
    placed = words(spark, sf_dir)
    stream = "cast((k * 7919 + 13) % 100003 as int)"
    text = placed.selectExpr("conv_id", "page", "down", f"{stream} as ord", "text", "if(k % 9 in (3, 4), 'Gothic', 'Mincho') as font", "if(k = 0, 16.0D, 10.0D) as size", "x0", "top", "x1", "bottom")
    kana = placed.where("k % 11 = 5").selectExpr(
        "conv_id", "page", "down", f"{stream} + 200000 as ord", "left(text, 2) as text", "'Kana' as font", "5.0D as size",
        "if(down, x1 + 1, x0 + 10) as x0", "if(down, top + 10, top - 5) as top", "if(down, x1 + 5, x0 + 40) as x1", "if(down, top + 40, top - 1) as bottom",
    )
    return text.unionByName(kana)


def table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """glyphs() as a table, for what reads them several times."""
    return stored(glyphs(spark, sf_dir), "glyphs")


def text_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = styles.keep_styles(glyphs(spark, sf_dir), drop_fonts=["Kana"])
    return layout.reading_order(kept, PAGE, F.col("down"))


def page_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages are vertical, where words follow each other as written."""
    return layout.writing_direction(words(spark, sf_dir), PAGE, "k")


def column_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text of pages with columns or vertical lines, from boxes alone."""
    pages = turns(spark, sf_dir).select("conv_id", F.col("turn").alias("page"))
    return layout.reading_text(text_in_order(spark, sf_dir), PAGE, pages, word=" ")


def run_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note for each run of a style, at the run's upper right corner."""
    return layout.style_runs(text_in_order(spark, sf_dir), PAGE, separator=" ").select(*PAGE, "run", "font", "size", "text", "n_glyphs", "x", "y", "label")


def size_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.size_threshold(glyphs(spark, sf_dir), ["conv_id"])


def text_by_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of each page where the file's own sizes say what is small."""
    kept = layout.keep_text(glyphs(spark, sf_dir), ["conv_id"])
    return kept.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n_glyphs"), F.sum(F.length("text")).alias("n_chars"), F.min("size").alias("least"))


def kana_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word that each reading belongs to."""
    placed = table(spark, sf_dir)
    boxes = placed.drop("text", "down", "size")
    found = layout.base_of_small(boxes.where("font = 'Kana'").drop("font"), boxes.where("font <> 'Kana'").drop("font"), "ord", PAGE)
    return found.select(*PAGE, "ord", "base", "distance")


def kana_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text with each reading in brackets behind its word."""
    placed = table(spark, sf_dir).withColumn("stream", F.col("ord"))
    kana, text, tasks = placed.where("font = 'Kana'"), placed.where("font <> 'Kana'"), tasks_for(placed)
    read = layout.with_readings(text, layout.base_of_small(kana.drop("down", "font", "size"), text, "stream", PAGE, tasks=tasks), "stream", PAGE, tasks=tasks)
    return layout.reading_text(layout.reading_order(read, PAGE, F.col("down"), tasks=tasks), PAGE, word=" ")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note at every seventh word of a page, a little off its upper right corner."""
    return words(spark, sf_dir).where("k % 7 = 2").selectExpr("conv_id", "page", "k as idx", "x1 + k % 3 - 1 as x", "top - 0.5 as y", "concat('note ', k) as contents")


def note_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each note with the font and size of the word whose corner is nearest."""
    corners = stored(glyphs(spark, sf_dir).where("font <> 'Kana'").selectExpr("conv_id", "page", "x1 as x", "top as y", "font", "size", "ord as word"), "corners")
    return anchors.note_styles(notes(spark, sf_dir), corners, PAGE, ["font", "size", "word"], reach=4.0)


def notes_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes of each conversation, led by the style of the run that they stand at."""
    runs = stored(layout.style_runs(text_in_order(spark, sf_dir), PAGE, distance=4.0), "runs")
    at_runs = runs.selectExpr("conv_id", "page", "run as idx", "x", "y", "concat('run ', run) as contents")
    return anchors.export_styled(at_runs, runs, ["conv_id"], ["page", "idx"], PAGE)


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose words are marked bold by tags that nest, touch, stay open, close twice or hold nothing."""
    cut = turns(spark, sf_dir).select("conv_id", "turn", F.split(F.coalesce("text", F.lit("")), BLANK).alias("w"))
    mark = "case k % 13 when 2 then concat('<b>', w) when 3 then concat(w, '<i><b>x</b></i>') when 5 then concat(w, '</b>') when 6 then concat('<b>', w, '</b>') when 8 then concat('</b>', w) when 9 then concat('<b></b>', w) when 11 then concat('<b>', w) else w end"
    return cut.selectExpr("conv_id", "turn", f"array_join(transform(w, (w, k) -> {mark}), '') as html")


def nested_bold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks.bold_text(marked(spark, sf_dir), ["conv_id", "turn"], "html")


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A numbered export of each conversation's words, six to an entry, read back after an editor has deleted, changed and added entries: how each came about."""
    six = words(spark, sf_dir).selectExpr("conv_id", "page * 1000 + k div 6 as e", "k", "text").groupBy("conv_id", "e").agg(F.array_sort(F.collect_list(F.struct("k", "text"))).alias("w"))
    six = stored(six, "entries")
    entries = six.selectExpr("conv_id", "e", "concat(e, ' ', array_join(transform(w, x -> x.text), ' ')) as text", "row_number() over (partition by conv_id order by e) as r")
    edited = entries.where("r % 12 <> 2").selectExpr("conv_id", "r * 2 as o", "if(r % 12 = 5, concat(text, ' new'), text) as text").unionAll(entries.where("r % 12 = 8").selectExpr("conv_id", "r * 2 + 1 as o", "concat('added ', r) as text"))
    texts = [stored(styles.numbered_text(rows, ["conv_id"], [order], F.col("text")), "entries") for rows, order in ((entries, "e"), (edited, "o"))]
    found = align.align(*(align.numbered_entries(t, ["conv_id"]) for t in texts), ["conv_id"])
    return found.select("conv_id", "place", F.coalesce("was", F.lit(0)).alias("was"), F.coalesce("now", F.lit(0)).alias("now"), "kind", "text", "edited")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (page_directions, column_text, run_notes, size_thresholds, text_by_threshold, kana_bases, kana_readings, note_fonts, notes_export, nested_bold, edits)}

WORDS = r"""WITH cut AS (
  SELECT conv_id, turn AS page, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM conversations
), each AS (
  SELECT conv_id, page, len(words) AS n, unnest(range(len(words))) AS k, unnest(words) AS text, CASE WHEN len(words) >= 17 THEN len(words) // 2 ELSE greatest(len(words) - 1, 1) END AS half FROM cut
), spots AS (
  SELECT *, (k - 1) // half AS part, (k - 1) % half AS i, page % 2 = 1 AS down, (k * 7919 + 13) % 100003 AS ord FROM each
), words AS (
  SELECT conv_id, page, k, text, part, i, CAST(ord AS INT) AS ord, CASE WHEN k % 9 IN (3, 4) THEN 'Gothic' ELSE 'Mincho' END AS font, CASE WHEN k = 0 THEN 16.0 ELSE 10.0 END::DOUBLE AS size,
    CASE WHEN k = 0 THEN 700 WHEN down THEN 700 - 18 * (i // 6) - (k * 5) % 3 ELSE 420 * part + 60 * (i % 6) + 52 END::DOUBLE AS x1,
    CASE WHEN k = 0 THEN 0 WHEN down THEN 60 + 420 * part + 60 * (i % 6) ELSE 60 + 18 * (i // 6) + (k * 5) % 3 END::DOUBLE AS top,
    CASE WHEN k = 0 THEN '' WHEN i = 0 THEN chr(10) || chr(10) WHEN i % 6 = 0 THEN chr(10) ELSE ' ' END AS sep
  FROM spots
), sizes AS (
  SELECT conv_id, page, text, size FROM words UNION ALL SELECT conv_id, page, left(text, 2), 5.0 FROM words WHERE k % 11 = 5
), histogram AS (
  SELECT conv_id, size, sum(length(text)) AS n FROM sizes GROUP BY conv_id, size
), cuts AS (
  SELECT a.conv_id, a.size, sum(b.n) FILTER (b.size < a.size) AS n0, sum(b.n * b.size * 100) FILTER (b.size < a.size) AS s0, sum(b.n) AS n, sum(b.n * b.size * 100) AS s
  FROM histogram a JOIN histogram b ON a.conv_id = b.conv_id GROUP BY a.conv_id, a.size
), thresholds AS (
  SELECT conv_id, max(struct_pack(v := CASE WHEN n0 > 0 AND n0 < n - n0 THEN (s0 * (n - n0) - (s - s0) * n0) ** 2 / (n0 * (n - n0)) END, less := -size, n0 := n0)) FILTER (n0 > 0 AND n0 < n - n0) AS best, max(n) AS n
  FROM cuts GROUP BY conv_id
)
"""

SQL: dict[str, str] = {
    "page_directions": WORDS + """, boxes AS (
  SELECT *, CASE WHEN k = 0 THEN 0 WHEN page % 2 = 1 THEN x1 - 10 ELSE x1 - 52 END AS x0, CASE WHEN k = 0 THEN 16 WHEN page % 2 = 1 THEN top + 52 ELSE top + 10 END AS bottom FROM words
), gaps AS (
  SELECT conv_id, page, greatest(x0 - lag(x1) OVER w, lag(x0) OVER w - x1) AS across, greatest(top - lag(bottom) OVER w, lag(top) OVER w - bottom) AS down FROM boxes WINDOW w AS (PARTITION BY conv_id, page ORDER BY k)
)
SELECT conv_id, page, count(*) FILTER (down > 0 AND across <= 0) AS n_down, count(*) FILTER (across > 0 AND down <= 0) AS n_across, count(*) FILTER (down > 0 AND across <= 0) > count(*) FILTER (across > 0 AND down <= 0) AS vertical FROM gaps GROUP BY conv_id, page""",
    "column_text": WORDS + ", said AS (SELECT conv_id, page, string_agg(sep || text, '' ORDER BY k) AS text FROM words GROUP BY conv_id, page) SELECT t.conv_id, turn AS page, coalesce(said.text, '') AS text FROM (SELECT DISTINCT conv_id, turn FROM conversations) t LEFT JOIN said ON said.conv_id = t.conv_id AND said.page = t.turn",
    "run_notes": WORDS + """, marked AS (
  SELECT *, CAST(k = 0 OR (font, size) <> lag((font, size)) OVER (PARTITION BY conv_id, page ORDER BY k) AS INT) AS new FROM words
), runs AS (
  SELECT *, CAST(sum(new) OVER (PARTITION BY conv_id, page ORDER BY k) AS INT) AS run FROM marked
)
SELECT conv_id, page, run, font, size, string_agg(text, ' ' ORDER BY k) AS text, count(*) AS n_glyphs, max(x1) AS x, min(top) AS y, font || ' ' || CAST(size AS VARCHAR) AS label FROM runs GROUP BY conv_id, page, run, font, size""",
    "size_thresholds": WORDS + "SELECT conv_id, -best.less AS threshold, CAST(coalesce(best.n0, 0) AS BIGINT) AS n_small, CAST(n - coalesce(best.n0, 0) AS BIGINT) AS n_large FROM thresholds",
    "text_by_threshold": WORDS + "SELECT conv_id, page, count(*) AS n_glyphs, CAST(sum(length(text)) AS BIGINT) AS n_chars, min(size) AS least FROM sizes JOIN thresholds USING (conv_id) WHERE best IS NULL OR size >= -best.less GROUP BY conv_id, page",
    "kana_bases": WORDS + "SELECT conv_id, page, CAST(ord + 200000 AS INT) AS ord, ord AS base, CAST(3 AS DOUBLE) AS distance FROM words WHERE k % 11 = 5",
    "kana_readings": WORDS + "SELECT conv_id, page, string_agg(sep || text || CASE WHEN k % 11 = 5 THEN '《' || left(text, 2) || '》' ELSE '' END, '' ORDER BY k) AS text FROM words GROUP BY conv_id, page",
    "note_fonts": WORDS + "SELECT conv_id, page, CAST(k AS INT) AS idx, x1 + k % 3 - 1 AS x, top - 0.5 AS y, 'note ' || k AS contents, font, size, ord AS word FROM words WHERE k % 7 = 2",
    "notes_export": WORDS + """, boxes AS (
  SELECT *, CASE WHEN k = 0 THEN 0 WHEN page % 2 = 1 THEN x1 - 10 ELSE x1 - 52 END AS x0, CASE WHEN k = 0 THEN 16 WHEN page % 2 = 1 THEN top + 52 ELSE top + 10 END AS bottom FROM words
), marked AS (
  SELECT *, CAST(k = 0 OR (font, size) <> lag((font, size)) OVER w OR greatest(x0 - lag(x1) OVER w, lag(x0) OVER w - x1, top - lag(bottom) OVER w, lag(top) OVER w - bottom) > 4 AS INT) AS new
  FROM boxes WINDOW w AS (PARTITION BY conv_id, page ORDER BY k)
), numbered AS (
  SELECT *, sum(new) OVER (PARTITION BY conv_id, page ORDER BY k) AS run FROM marked
), runs AS (
  SELECT conv_id, page, run, any_value(font) AS font, any_value(size) AS size FROM numbered GROUP BY conv_id, page, run
)
SELECT conv_id, string_agg(font || chr(9) || CAST(size AS VARCHAR) || chr(9) || 'run ' || run, chr(10) ORDER BY page, run) AS text FROM runs GROUP BY conv_id""",
    "nested_bold": r"""WITH cut AS (
  SELECT conv_id, turn, regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') AS ws FROM conversations
), each AS (
  SELECT conv_id, turn, unnest(range(len(ws))) AS k, unnest(ws) AS w FROM cut
), tokens AS (
  SELECT conv_id, turn, k, unnest(CASE k % 13 WHEN 2 THEN ['+', w] WHEN 3 THEN [w, '+', 'x', '-'] WHEN 5 THEN [w, '-'] WHEN 6 THEN ['+', w, '-'] WHEN 8 THEN ['-', w] WHEN 9 THEN ['+', '-', w] WHEN 11 THEN ['+', w] ELSE [w] END) AS t,
    unnest(CASE k % 13 WHEN 2 THEN [1, 0] WHEN 3 THEN [0, 1, 0, -1] WHEN 5 THEN [0, -1] WHEN 6 THEN [1, 0, -1] WHEN 8 THEN [-1, 0] WHEN 9 THEN [1, -1, 0] WHEN 11 THEN [1, 0] ELSE [0] END) AS step,
    unnest(range(4)[1:len(CASE k % 13 WHEN 2 THEN [1, 0] WHEN 3 THEN [0, 1, 0, -1] WHEN 5 THEN [0, -1] WHEN 6 THEN [1, 0, -1] WHEN 8 THEN [-1, 0] WHEN 9 THEN [1, -1, 0] WHEN 11 THEN [1, 0] ELSE [0] END)]) AS j
  FROM each
), sums AS (
  SELECT *, sum(step) OVER (PARTITION BY conv_id, turn ORDER BY k, j) AS d FROM tokens
), deep AS (
  SELECT *, d - least(min(d) OVER (PARTITION BY conv_id, turn ORDER BY k, j), 0) > 0 AS bold FROM sums
), texts AS (
  SELECT *, coalesce(lag(bold) OVER w, false) AS was, coalesce(lead(bold) OVER w, false) AS then_ FROM deep WHERE step = 0 AND t <> '' WINDOW w AS (PARTITION BY conv_id, turn ORDER BY k, j)
), said AS (
  SELECT conv_id, turn, string_agg(CASE WHEN bold AND NOT was THEN '【' ELSE '' END || t || CASE WHEN bold AND NOT then_ THEN '】' ELSE '' END, '' ORDER BY k, j) AS text FROM texts GROUP BY conv_id, turn
)
SELECT DISTINCT c.conv_id, c.turn, coalesce(said.text, '') AS text FROM conversations c LEFT JOIN said ON said.conv_id = c.conv_id AND said.turn = c.turn""",
    "edits": WORDS + """, entries AS (
  SELECT conv_id, page * 1000 + k // 6 AS e, (page * 1000 + k // 6) || ' ' || string_agg(text, ' ' ORDER BY k) AS text FROM words GROUP BY conv_id, page * 1000 + k // 6
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY e) AS r FROM entries
), steps AS (
  SELECT conv_id, r * 2 AS o, r, CASE WHEN r % 12 = 2 THEN 'deleted' WHEN r % 12 = 5 THEN 'changed' ELSE 'same' END AS kind, text, CASE WHEN r % 12 = 2 THEN NULL WHEN r % 12 = 5 THEN text || ' new' ELSE text END AS edited FROM ranked
  UNION ALL SELECT conv_id, r * 2 + 1, NULL, 'inserted', NULL, 'added ' || r FROM ranked WHERE r % 12 = 8
)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY o) AS INT) AS place, coalesce(r, 0) AS was, CASE WHEN kind <> 'deleted' THEN count(*) FILTER (kind <> 'deleted') OVER (PARTITION BY conv_id ORDER BY o) ELSE 0 END AS now, kind, text, edited FROM steps""",
}
