"""Merkle dataset manifest: leaves of rows, trees reduced by superblocks, a proof for each row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.shared import Scratch, quoted, tasks

#: Nodes of a run, and levels that one superblock collapses: FANOUT**LEVELS nodes meet in one task, 4,096 of about 100 bytes.
FANOUT, LEVELS = 8, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A level of a proof: the digests of the run's other nodes, those before the node and those after it, as hex one after another.
PROOF = "array<struct<before:string,after:string>>"


def sha(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def leaf(*fields: Column) -> Column:
    """The digest of a row: each field as ``-`` if it is null, else its bytes as text, a colon and the value."""

    def said(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return sha(F.concat(*map(said, fields)))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def folded(leaf_: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf_, lambda node, step: sha(F.concat(step["before"], node, step["after"])))


def siblings(proof: Column) -> Column:
    """All digests of a proof, from the leaf to the root, left to right in each run."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), "")


def collapsed(nodes: list[str], depth: int, fanout: int) -> list[list[str]]:
    """The levels from nodes up, depth + 1 of them."""
    from hashlib import sha256

    levels = [nodes]
    for _ in range(depth):
        below = levels[-1]
        levels.append([sha256("".join(below[i : i + fanout]).encode()).hexdigest() for i in range(0, len(below), fanout)])
    return levels


def depth(n: int, fanout: int, levels: int) -> int:
    """Levels that a superblock collapses in a tree whose layer has n nodes: fewer than levels where the tree ends."""
    k = 0
    while n > 1 and k < levels:
        n, k = -(-n // fanout), k + 1
    return k


def proofs(levels: list[list[str]], fanout: int) -> tuple[pa.Array, list[list[int]]]:
    """before and after of each node of all levels but the last, and for each leaf the places of its steps there."""
    before, after, first, at = [], [], [], 0
    for nodes in levels[:-1]:
        first.append(at)
        at += len(nodes)
        for i in range(0, len(nodes), fanout):
            run = nodes[i : i + fanout]
            whole = "".join(run)
            for k in range(len(run)):
                before.append(whole[: 64 * k])
                after.append(whole[64 * (k + 1) :])
    steps = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], ["before", "after"])
    return steps, [[a + i // fanout**k for k, a in enumerate(first)] for i in range(len(levels[0]))]


def ordered(rows: DataFrame, order: Sequence[str], scratch: Scratch) -> DataFrame:
    """rows with index, from 0, among the rows of one g in the order given (nulls first), and n, the number of g's rows.

    A range for each task, sorted there and written; what the ranges before it hold of each g is added to a row's place in its own.
    Rows that tie in all of order are told apart by where they come from, so that many equal rows are divided as well.
    """
    keys = ["g", *order, "tie"]
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    ranges = tied.repartitionByRange(tasks(rows.sparkSession), *keys).sortWithinPartitions(*keys).drop("tie")
    placed = scratch.store(ranges.withColumn("at", F.monotonically_increasing_id())).withColumn("range", F.shiftright("at", 33))
    counts = placed.groupBy("g", "range").agg(F.count(F.lit(1)).alias("own"), F.min("at").alias("first"))
    whole = Window.partitionBy("g")  # a row for each range that holds some of g
    before = F.sum("own").over(whole.orderBy("range")) - F.col("own")
    starts = scratch.store(counts.select(F.col("g").alias("g_"), F.col("range").alias("range_"), (before - F.col("first")).alias("shift"), F.sum("own").over(whole).alias("n")))
    both = placed.join(starts, F.col("g").eqNullSafe(F.col("g_")) & (F.col("range") == F.col("range_")))
    return both.select(*rows.columns, (F.col("at") + F.col("shift")).alias("index"), "n")


def climb(rows: DataFrame, scratch: Scratch, fanout: int, levels: int) -> list[DataFrame]:
    """The layers of the trees of all g, from rows (g, node, index, n and others) up to one node for each g."""
    width, kind = fanout**levels, rows.schema["g"].dataType.simpleString()

    def up(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("index")
        n = int(part["n"].iloc[0])
        top = collapsed(part["node"].tolist(), depth(n, fanout, levels), fanout)[-1]
        return pd.DataFrame({"g": part["g"].iloc[:1].tolist(), "node": top, "index": part["block"].iloc[:1].tolist(), "n": [-(-n // width)]})

    layers = [scratch.store(rows)]
    most = layers[0].agg(F.max("n")).first()[0] or 0
    while most > 1:
        blocks = layers[-1].select("g", "node", "index", "n", F.floor(F.col("index") / width).alias("block"))
        layers.append(scratch.store(blocks.groupBy("g", "block").applyInPandas(up, f"g {kind}, node string, index long, n long")))
        most = -(-most // width)
    return layers


def downward(names: list[str], fanout: int, levels: int) -> Callable:
    """Of a superblock's rows and of its root's row: the columns named, and what each row's proof is."""

    def down(rows: pa.Table, top: pa.Table) -> pa.Table:
        rows = rows.sort_by("index")
        found = collapsed(rows.column("node").to_pylist(), depth(rows.column("n")[0].as_py(), fanout, levels), fanout)
        steps, places = proofs(found, fanout)
        rest = top.column("proof").combine_chunks().flatten().cast(steps.type)
        more = range(len(steps), len(steps) + len(rest))
        offsets, flat = [0], []
        for own in places:
            flat += own
            flat += more
            offsets.append(len(flat))
        proof = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays([steps, rest]).take(pa.array(flat, pa.int32())))
        one = pa.array([0] * rows.num_rows, pa.int32())
        return pa.table({c: rows.column(c) for c in names} | {"subroot": top.column("subroot").take(one), "root": top.column("root").take(one), "proof": proof})

    return down


def descend(layers: list[DataFrame], above: DataFrame, scratch: Scratch, fanout: int, levels: int) -> DataFrame:
    """The first layer's rows with subroot, root and proof; above: g, block (0), subroot, root and proof of each tree's top."""
    width = fanout**levels
    for k in reversed(range(max(len(layers) - 1, 1))):
        names = [c for c in layers[k].columns if c != "n"]
        schema = ", ".join(f"{c} {layers[k].schema[c].dataType.simpleString()}" for c in names)

        blocks = layers[k].withColumn("block", F.floor(F.col("index") / width))
        above = blocks.groupBy("g", "block").cogroup(above.groupBy("g", "block")).applyInArrow(downward(names, fanout, levels), f"{schema}, subroot string, root string, proof {PROOF}")
        if k:
            above = scratch.store(above.select("g", F.col("index").alias("block"), "subroot", "root", "proof"))
    return above


def manifest(leaves: DataFrame, by: str = "lang", order: Sequence[str] = ("doc_id",), node: str = "leaf", fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """leaves with subroot, root and proof (PROOF), which folded() leads from the leaf to the root.

    leaves: by, the columns of order, node (a digest as hex) and any others, which stay; a column named subroot, root or proof is written
    over.  The rows of each by are a tree of their own, in the given order, nulls first, rows that tie by their digest; while a level has several
    nodes, each run of fanout of them (the last may be shorter, even one node) becomes their digest.  The subroots in the order of
    by (null first, by bytes) are a tree again.

    A row's index, cut into superblocks of fanout**levels, says in which task it meets its run: a superblock collapses to one node,
    and these are reduced in the same way, so each layer has that many times fewer rows.  Then proofs come down: a
    superblock's is put behind what its nodes have inside it.  No task sees more than a superblock or a range of the order, however common a by is.

    A null by is a tree like others; one row is its own subroot, one tree its own root with an empty proof.  Equal rows are
    leaves each.  An empty table gives an empty result.
    """
    scratch = Scratch(leaves.sparkSession, "merkle")
    given = [c for c in leaves.columns if c.lower() not in ("subroot", "root", "proof")]
    p = {c: f"p{i}" for i, c in enumerate(given)}
    rows = scratch.store(leaves.select(*quoted(given)).toDF(*p.values()).withColumns({"g": F.col(p[by]), "node": F.col(p[node])}))
    trees = climb(ordered(rows, [*(p[c] for c in order), "node"], scratch), scratch, fanout, levels)
    tops = trees[-1].select(F.lit(0).alias("g"), "node", F.col("g").alias("of"))
    roots = climb(ordered(tops, ["of"], scratch), scratch, fanout, levels)
    root = roots[-1].select("g", F.lit(0).cast("long").alias("block"), F.col("node").alias("subroot"), F.col("node").alias("root"), F.array().cast(PROOF).alias("proof"))
    said = descend(roots, root, scratch, fanout, levels)
    above = scratch.store(said.select(F.col("of").alias("g"), F.lit(0).cast("long").alias("block"), F.col("node").alias("subroot"), "root", "proof"))
    out = descend(trees, above, scratch, fanout, levels)
    return out.select(*p.values(), "subroot", "root", "proof").toDF(*given, "subroot", "root", "proof")


def field_sql(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"coalesce(octet_length(encode({text})) || ':' || {text}, '-')"


UP_SQL = "list_transform(range(0, len(nodes), 8), lambda i: sha256(array_to_string(nodes[i + 1:i + 8], '')))"
#: CRC-32 of a number's decimal digits, bit by bit.
CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""
FIELDS = ("doc_id", "source", "lang", "n_chars")


def manifest_sql() -> str:
    fields = ", ".join(map(field_sql, FIELDS))
    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    return SQL.format(fields=fields, text=field_sql("text"), lower=field_sql(lower), up=UP_SQL, third=f"{CRC_SQL.format('p.doc_id')} % 3 = 0")


SQL = """
WITH RECURSIVE said AS (
  SELECT doc_id, lang, concat({fields}, {text}) AS whole, concat({fields}, {lower}) AS changed FROM documents
), leaves AS (
  SELECT doc_id, lang, sha256(whole) AS leaf, sha256(changed) AS other FROM said
), level(lang, k, nodes) AS (
  SELECT lang, 0, list(leaf ORDER BY doc_id, leaf) FROM leaves GROUP BY lang
  UNION ALL
  SELECT lang, k + 1, {up} FROM level WHERE len(nodes) > 1
), tops AS (
  SELECT lang, max(k) AS depth, max_by(nodes, k)[1] AS subroot FROM level GROUP BY lang
), upper_level(k, nodes) AS (
  SELECT 0, list(subroot ORDER BY lang NULLS FIRST) FROM tops
  UNION ALL
  SELECT k + 1, {up} FROM upper_level WHERE len(nodes) > 1
), placed AS (
  SELECT doc_id, lang, leaf, other, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS i FROM leaves
), ranked AS (
  SELECT lang, subroot, depth, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM tops
), steps AS (
  SELECT p.doc_id, p.lang, k, (p.i // CAST(8 ** k AS BIGINT)) AS spot, nodes FROM placed p JOIN level l ON p.lang IS NOT DISTINCT FROM l.lang WHERE len(nodes) > 1
  UNION ALL
  SELECT p.doc_id, p.lang, depth + k, (r.i // CAST(8 ** k AS BIGINT)), nodes FROM placed p JOIN ranked r ON p.lang IS NOT DISTINCT FROM r.lang, upper_level WHERE len(nodes) > 1
), cut AS (
  SELECT doc_id, k, array_to_string(nodes[spot // 8 * 8 + 1:spot], '') AS before, array_to_string(nodes[spot + 2:spot // 8 * 8 + 8], '') AS after FROM steps
), proof AS (
  SELECT doc_id, list(struct_pack(before := before, after := after) ORDER BY k) AS steps FROM cut GROUP BY doc_id
), whole AS (
  SELECT max_by(nodes, k)[1] AS root FROM upper_level
), done AS (
  SELECT p.doc_id, leaf, subroot, root, coalesce(steps, []) AS steps, CASE WHEN {third} THEN other ELSE leaf END AS start
  FROM placed p JOIN tops t ON p.lang IS NOT DISTINCT FROM t.lang LEFT JOIN proof USING (doc_id), whole
), ended AS (
  SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda x: x.before || x.after), '')) AS proof_sha256,
    list_reduce(list_prepend(struct_pack(before := start, after := ''), steps), lambda a, x: struct_pack(before := sha256(x.before || a.before || x.after), after := '')).before AS folded_root
  FROM done
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM ended
"""
