"""Line dedup: maximal repeated runs of lines, found in a suffix array over line numbers that distributed prefix doubling sorts.

What is left of the array after some doublings becomes small, as few runs are long; once it is one task's work, all further doublings are done there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.shared import ROWS_A_TASK, Scratch, free, numbered, quoted, sieved
from inkwell.llm.words import BASES, forget, slices, span_hashes, text_buffers, word_bounds

#: Fewest words of a run of lines that is deleted.  One: each repeated line goes, however short it is.
LEAST_WORDS = 1

LINES = "d long, t long, i int, h1 long, h2 long"


def line_rows(docs: DataFrame) -> DataFrame:
    """LINES: a row for each line with a word, i counting those of its document (d: id, t: a hash of the text); h1, h2: two hashes of the line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_buffers(part.column(2))
                breaks = np.flatnonzero(data == 10)
                starts = np.unique(np.concatenate([offsets[:-1][offsets[:-1] < offsets[1:]], breaks + 1]))
                starts = starts[starts < len(data)]
                ends = np.searchsorted(breaks, starts)
                row = np.searchsorted(offsets, starts, "right") - 1
                ends = np.minimum(np.append(breaks, len(data))[ends], offsets[row + 1])
                words, _, _ = word_bounds(data, offsets)
                filled = np.searchsorted(words, ends) > np.searchsorted(words, starts)
                starts, ends, row = starts[filled], ends[filled], row[filled]
                i = np.arange(len(row)) - np.searchsorted(row, row)
                h1, h2 = (span_hashes(data, starts, ends, base).view(np.int64) for base in BASES)
                ids, hashes = part.column(0).to_numpy(), part.column(1).to_numpy()
                arrays = [(ids[row], pa.int64()), (hashes[row], pa.int64()), (i, pa.int32()), (h1, pa.int64()), (h2, pa.int64())]
                yield pa.record_batch([pa.array(x, kind) for x, kind in arrays], names=["d", "t", "i", "h1", "h2"])

    return docs.select(*key_of(docs)[:2], F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, LINES)


def key_of(docs: DataFrame) -> list[Column]:
    """d, t and t2: the id, a null one below all others, and two hashes of the text."""
    text = F.coalesce(docs["text"], F.lit(""))
    return [F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(text).alias("t"), F.xxhash64(F.lit("second"), text).alias("t2")]


def first_texts(docs: DataFrame) -> DataFrame:
    """t, t2, d, size: each different text once, in its first document."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    return docs.select(*key_of(docs), size.alias("size")).groupBy("t", "t2").agg(F.min("d").alias("d"), F.max("size").alias("size"))


def in_a_row(texts: DataFrame) -> DataFrame:
    """d, t, begin: where each text begins if all stand one after another by d and t; between two there is a place that is no line's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            ends = at + np.cumsum(sizes)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(ends - sizes, pa.int64())], names=["d", "t", "begin"])
            at = int(ends[-1]) if len(ends) else at

    return texts.select("d", "t", "size").repartitionByRange("d", "t").sortWithinPartitions("d", "t").mapInArrow(run, "d long, t long, begin long")


def ranked(keyed: DataFrame, rows: int, scratch: Scratch) -> DataFrame:
    """p, rank, f, n from p, a, b, n: what stands at two places at least; ranks have the order of a and b, f is the first place of each.

    n, the number of lines that a rank tells apart, is a column, so that all levels are one plan for Spark, whose code is compiled once.
    """
    some = keyed.groupBy("a", "b").agg(F.min("p").alias("f"), F.max("p").alias("z"), F.max("n").alias("n")).where("f < z")
    ranks = scratch.store(some.orderBy("a", "b").select("a", "b", "f", "n", F.monotonically_increasing_id().alias("rank")), rows)
    return scratch.store(keyed.select("p", "a", "b").join(ranks, ["a", "b"]).select("p", "rank", "f", "n"), rows)


def suffix_ranks(places: DataFrame, rows: int, scratch: Scratch) -> list[tuple[DataFrame, int]]:
    """For each k as long as there are any: p, rank, f, n of the suffixes whose first n = 2**k lines stand elsewhere as well, and their number.

    The first of these tables with ROWS_A_TASK rows at most is the last one: see longest_in_task().
    Prefix doubling: the rank of 2n lines is that of a pair, the ranks of n lines here and n lines on.  Suffixes with one
    rank are an interval of the suffix array with a common prefix; a suffix with no such neighbour is settled and takes no further part.
    """
    zero, one = (F.lit(x).cast("long") for x in (0, 1))
    levels, now = [], ranked(places.select("p", F.col("rank").alias("a"), zero.alias("b"), one.alias("n")), rows, scratch)
    while rows := now.count():
        levels.append((now, rows))
        if rows <= ROWS_A_TASK:
            break
        ahead = now.select((F.col("p") - F.col("n")).alias("p"), F.col("rank").alias("b"))
        now = ranked(now.select("p", F.col("rank").alias("a"), (F.col("n") + F.col("n")).alias("n")).join(ahead, "p"), rows, scratch)
    return levels


def grouped(p: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row's group, the rows with its keys: its number in the order of the keys, its least p, and how many rows it has."""
    order = np.lexsort((p, *keys[::-1]))
    new = np.ones(len(p), bool)
    new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    begins, number = np.flatnonzero(new), np.empty(len(p), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, p[order[begins]][number], np.diff(np.append(begins, len(p)))[number]


def met_at(p: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the places sought are in p, which ascends, and where."""
    at = np.searchsorted(p, sought)
    rows = np.flatnonzero(p[np.minimum(at, len(p) - 1)] == sought) if len(p) else np.zeros(0, np.int64)
    return rows, at[rows]


def longest_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """p, m, f as in longest_earlier(), from one whole table of suffix_ranks(): its steps from there up and down again, in one task."""
    p, rank, f, n = (np.concatenate(x) for x in zip(*[[c.to_numpy() for c in b.columns] for b in batches], strict=True))
    order, n, levels = np.argsort(p), int(n[0]), []
    p, rank, f = p[order], rank[order], f[order]
    while len(p):
        levels.append((p, rank, f, n))
        rows, at = met_at(p, p + n)
        number, least, many = grouped(p[rows], rank[rows], rank[at])
        p, rank, f, n = p[rows][many > 1], number[many > 1], least[many > 1], 2 * n
    own, m, first = (np.zeros(0, np.int64) for _ in range(3))
    for p, rank, f, n in reversed(levels):
        heads, lengths = np.unique(np.stack([first, m]), axis=1)
        both, both_m, both_f = np.append(own, heads), np.append(m, lengths), np.append(first, heads)
        rows, at = met_at(p, both + both_m)
        _, least, _ = grouped(both[rows], both_f[rows], both_m[rows], rank[at])
        on = least < both[rows]
        both_m[rows[on]] += n
        both_f[rows[on]] = least[on]
        new = (p > f) & ~np.isin(p, own)
        m, first, own = np.append(both_m[: len(own)], np.full(new.sum(), n)), np.append(both_f[: len(own)], f[new]), np.append(own, p[new])
    yield pa.record_batch([pa.array(x, pa.int64()) for x in (own, m, first)], names=["p", "m", "f"])


def longest_earlier(levels: list[tuple[DataFrame, int]], scratch: Scratch) -> DataFrame | None:
    """p, m, f: the m first lines of the suffix at p, and no more, stand at f < p already; f is the first such place.

    From the longest prefixes down.  (f, m) names an interval of the suffix array: the suffixes with the m lines
    that begin at f, the first of them.  In each step the suffixes of an interval, and f for it, are told apart by the rank
    of their next n lines: those that are not the first of theirs move on to a longer common prefix.  The others stay,
    and need nothing of those that moved but f, so that each suffix is in one interval at a time.
    """
    state, above = None, 0
    for level, rows in reversed(levels):
        new = level.where("p > f").select("p", F.col("n").alias("m"), "f")
        both_rows, above = rows + above, rows  # what state has are suffixes of the level above
        if state is None:
            rest = level.select("p", "rank", "f", "n").coalesce(1).mapInArrow(longest_in_task, "p long, m long, f long") if rows <= ROWS_A_TASK else new
            state = scratch.store(rest, rows)
            continue
        heads = state.select(F.col("f").alias("p"), "m", "f").distinct()
        both = state.unionByName(heads).withColumn("q", F.col("p") + F.col("m"))
        met = both.join(level.select(F.col("p").alias("q"), "rank", "n"), "q", "left")
        heirs = met.where("rank is not null").groupBy("f", "m", "rank").agg(F.min("p").alias("a"), F.max("p").alias("z")).where("a < z")
        heirs = scratch.store(heirs.select("f", "m", "rank", "a"), both_rows)
        on = F.col("a") < F.col("p")
        moved = met.where("p > f").join(heirs, ["f", "m", "rank"], "left").select("p", F.when(on, F.col("m") + F.col("n")).otherwise(F.col("m")).alias("m"), F.when(on, F.col("a")).otherwise(F.col("f")).alias("f"))
        state = scratch.store(moved.unionByName(new.join(state.select("p"), "p", "left_anti")), both_rows)
    return state


def repeated_runs(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """d, t, i and m: m lines from the i-th on of the text t of document d that stand earlier as well; maximal, so none is within another.

    Of texts that are equal only the first counts, as the others are one run each.
    """
    texts = scratch.store(first_texts(docs))
    lines = scratch.store(line_rows(docs))
    numbers = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2").orderBy("h1", "h2")
    numbers = scratch.store(numbers.withColumn("rank", F.monotonically_increasing_id()))
    some = lines.join(numbers, ["h1", "h2"]).select("d", "t", "i", "rank").join(in_a_row(texts), ["d", "t"])
    # equal rows of docs are one document
    places = scratch.store(some.select((F.col("begin") + F.col("i")).alias("p"), "d", "t", "i", "rank").dropDuplicates(["p"]))
    rows = places.count()
    state = longest_earlier(suffix_ranks(places, rows, scratch), scratch)
    if state is None:
        return places.select("d", "t", "i", F.lit(0).cast("long").alias("m")).limit(0)
    # what stands at the place before, which is the same text's: between two texts there is a place that is no line's
    before = state.select((F.col("p") + 1).alias("p"), F.col("m").alias("longer"))
    maximal = state.select("p", "m").join(before, "p", "left").where("longer is null or longer <= m").select("p", "m")
    return places.select("p", "d", "t", "i").join(maximal, "p").select("d", "t", "i", "m")


def remove_repeated_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs with later copies of maximal repeated runs of lines deleted from text, and four more columns.

    docs: doc_id long, text string and any other columns, which stay.  Lines are what newlines part; only those with a word
    count, the others stay.  A run is as long as it can be: the lines from one line on that stand, in this order,
    earlier as well (in a smaller doc_id, or further up in the same document, all judged on the input).  It is deleted if it has at least least_words
    words; with one, every line goes that occurs earlier.  The text left is the other lines, joined by newlines.

    The new columns, each with underscores behind it where docs has the name already: n_lines, n_removed, n_runs (those deleted; one may
    overlap the next) and longest_run (lines of the longest of them), all long.

    A null text stays null, an empty one empty, both with no lines.  A null doc_id counts as smallest; texts that share a
    doc_id come in the order of a hash, and equal rows are one document and fare alike.  An empty table gives an empty result.
    A text of any length is read whole; one task holds one whole text and what is deleted from it.
    """
    scratch, last = Scratch(docs.sparkSession, "lines"), Scratch(docs.sparkSession, "cuts")
    cuts = repeated_runs(docs, scratch).groupBy("d", "t").agg(F.collect_list(F.struct(F.col("i").cast("long").alias("i"), "m")).alias("cuts"))  # of one text
    first = first_texts(docs).select("t", "t2", F.col("d").alias("first"))
    copies = docs.select(*key_of(docs)).join(scratch.store(first), ["t", "t2"]).where("d > first").select("d", "t").distinct()
    whole = F.expr("cast(null as array<struct<i:bigint,m:bigint>>)")
    marks = last.store(cuts.select("d", "t", "cuts", F.lit(False).alias("copy")).unionByName(copies.select("d", "t", whole.alias("cuts"), F.lit(True).alias("copy"))))
    scratch.drop()

    names = free(["n_lines", "n_removed", "n_runs", "longest_run"], docs.columns)
    d, t, own, copy = free(["d", "t", "cuts", "copy"], docs.columns)
    keys = key_of(docs)
    marks = marks.toDF(d, t, own, copy)
    met, others = sieved(docs.withColumns({d: keys[0], t: keys[1]}), marks, [d, t])  # so that texts without a mark are not dealt out
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in marks.schema.fields[2:]]
    joined = met.join(marks, [d, t], "left").select(*quoted(docs.columns), own, copy).unionAll(others.select(*quoted(docs.columns), *none))
    at, width, all_names = docs.columns.index("text"), len(docs.columns), [*docs.columns, *names]
    blank = bytes(range(9, 14)) + b" "

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part in slices(batch, f"c{at}"):
                texts, is_copy = part.column(at).cast(pa.binary()).to_pylist(), part.column(width + 1).to_pylist()
                counts: list[list[int]] = [[], [], [], []]
                for k, (text, runs) in enumerate(zip(texts, part.column(width), strict=True)):
                    all_lines = (text or b"").split(b"\n")
                    filled = [j for j, x in enumerate(all_lines) if x.strip(blank)]
                    gone, lengths = np.zeros(len(filled), bool), [0]
                    if is_copy[k] and filled:
                        starts, sizes = [0], [len(filled)]
                    elif runs.is_valid:
                        starts, sizes = (runs.values.field(c).to_pylist() for c in ("i", "m"))
                    else:
                        starts, sizes = [], []
                    words = np.cumsum([0, *(len(all_lines[j].split()) for j in filled)]) if least_words > 1 and starts else None
                    for i, m in zip(starts, sizes, strict=True):
                        if words is None or words[i + m] - words[i] >= least_words:
                            gone[i : i + m] = True
                            lengths.append(m)
                    if gone.any():
                        drop = {filled[j] for j in np.flatnonzero(gone)}
                        texts[k] = b"\n".join([x for j, x in enumerate(all_lines) if j not in drop])
                    for column, value in zip(counts, (len(filled), int(gone.sum()), len(lengths) - 1, max(lengths)), strict=True):
                        column.append(value)
                columns = list(part.columns[:width])
                columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.int64()) for c in counts)], names=all_names)

    return numbered(joined).mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in names)]))


LINES_SQL = r"""
WITH raw AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), numbered AS (
  SELECT doc_id, unnest(range(1, len(ls) + 1)) AS j, unnest(ls) AS line FROM raw
), filled AS (
  SELECT doc_id, j, line, row_number() OVER (PARTITION BY doc_id ORDER BY j) AS i FROM numbered WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), equal AS (
  SELECT a.doc_id AS d0, a.i AS i0, b.doc_id AS d, b.i AS i FROM filled a JOIN filled b ON a.line = b.line AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.i < b.i)
), islands AS (
  SELECT *, i - row_number() OVER (PARTITION BY d0, d, i - i0 ORDER BY i) AS island FROM equal
), ahead AS (
  SELECT d, i, count(*) OVER (PARTITION BY d0, d, i - i0, island ORDER BY i DESC) AS m FROM islands
), longest AS (
  SELECT d, i, max(m) AS m FROM ahead GROUP BY d, i
), maximal AS (
  SELECT d, m FROM (SELECT *, lag(i) OVER w AS i1, lag(m) OVER w AS m1 FROM longest WINDOW w AS (PARTITION BY d ORDER BY i)) WHERE i1 IS NULL OR i1 < i - 1 OR m1 <= m
), runs AS (
  SELECT d AS doc_id, count(*) AS n_runs, max(m) AS longest_run FROM maximal GROUP BY d
), gone AS (
  SELECT f.doc_id, f.j FROM longest l JOIN filled f ON f.doc_id = l.d AND f.i = l.i
), kept AS (
  SELECT n.doc_id, string_agg(line, chr(10) ORDER BY n.j) AS t FROM numbered n LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.j = n.j WHERE g.j IS NULL GROUP BY n.doc_id
), counts AS (
  SELECT doc_id, count(*) AS c FROM filled GROUP BY doc_id
), cuts AS (
  SELECT doc_id, count(*) AS c FROM gone GROUP BY doc_id
)
SELECT raw.doc_id, CAST(coalesce(counts.c, 0) AS BIGINT) AS n_lines, CAST(coalesce(cuts.c, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs,
  CAST(coalesce(longest_run, 0) AS BIGINT) AS longest_run, sha256(coalesce(t, '')) AS kept_sha256
FROM raw LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id) LEFT JOIN cuts USING (doc_id) LEFT JOIN runs USING (doc_id)
"""
