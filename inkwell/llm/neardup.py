"""Embedding near-dedup: tiles of vectors in the order of their principal axes, compared axis by axis until a bound rules the rest out."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.components import components
from inkwell.llm.shared import saved, tasks

THRESHOLD = 0.98
#: Vectors of a tile, axes that are accumulated between two bounds, and most leading axes by which vectors are dealt to cells.
TILE, STEP, AXES = 2048, 8, 4
#: Room for rounding in bounds; the final comparison is exact.
ROUNDING = 1e-9
#: Groups of partial sums that the driver gets.
PARTS = 32

UNITS = "vec_id long, label string, dim int, unit binary"


def unit_vectors(vectors: DataFrame, label: str) -> DataFrame:
    """UNITS, one row for each row; unit is null where the row cannot link: a null, something not finite, or zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            usable = lists.is_valid().to_numpy(zero_copy_only=False) & batch.column(0).is_valid().to_numpy(zero_copy_only=False) & batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            dims = np.where(usable, pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), 0)
            units: list[bytes | None] = [None] * batch.num_rows
            for d in np.unique(dims[dims > 0]).tolist():
                own = np.flatnonzero(dims == d)
                x = lists.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)  # a null is NaN
                top = np.abs(x).max(axis=1)
                good = np.isfinite(top) & (top > 0)
                x = x[good] / top[good, None]
                x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
                for i, row in zip(own[good].tolist(), x, strict=True):
                    units[i] = row.tobytes()
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], names=["vec_id", "label", "dim", "unit"])

    return vectors.select(F.col("vec_id").cast("long"), F.col(label).cast("string").alias("label"), F.col("embedding").cast("array<double>")).mapInArrow(run, UNITS)


def axes(units: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each dimension the principal axes, as columns, the widest first, and the vectors' spread along each: from sums over all vectors, PARTS rows of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for d in np.unique(dims):
                x = np.frombuffer(b"".join(batch.column(1).filter(pa.array(dims == d)).to_pylist())).reshape(-1, d)
                x = np.hstack([np.ones((len(x), 1)), x])
                sums[d] = sums.get(d, 0) + x.T @ x
        at = np.random.default_rng().integers(PARTS)  # only where it is summed, not what
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([at] * len(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["dim", "part", "sums"])

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x) for x in rows.column("sums").to_pylist())
        return pa.table({"dim": rows.column("dim")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    partial = units.select("dim", "unit").mapInArrow(run, "dim int, part int, sums binary")
    out: dict = {}
    for row in partial.groupBy("dim", "part").applyInArrow(add, "dim int, sums binary").collect():
        out[row["dim"]] = out.get(row["dim"], 0) + np.frombuffer(row["sums"]).reshape(row["dim"] + 1, -1)
    for d, s in out.items():
        mean = s[0, 1:] / s[0, 0]
        variance, turned = np.linalg.eigh(s[1:, 1:] / s[0, 0] - np.outer(mean, mean))
        out[d] = turned[:, ::-1].copy(), np.sqrt(np.maximum(variance[::-1], 0))
    return out


def close_pairs(a: np.ndarray, b: np.ndarray, turned_a: np.ndarray, turned_b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of rows of a and b with a dot product of at least threshold.

    turned: the same rows on principal axes.  After each STEP axes, what the others can add is at most the product of
    their norms; a pair that cannot reach the threshold any more is left, and the tile when all are.
    """
    d = a.shape[1]
    tail_a, tail_b = (np.sqrt(np.maximum(np.cumsum((t**2)[:, ::-1], axis=1)[:, ::-1], 0)) for t in (turned_a, turned_b))
    sums, at = np.zeros((len(a), len(b))), 0
    while True:
        to = min(at + STEP, d)
        sums += turned_a[:, at:to] @ turned_b[:, at:to].T
        at = to
        rest = np.outer(tail_a[:, at], tail_b[:, at]) if at < d else 0.0
        i, j = np.nonzero(sums + rest >= threshold - ROUNDING)
        if at == d or len(i) * 4 < sums.size:
            break
    part = sums[i, j]
    while at < d and len(i):
        to = min(at + STEP, d)
        part = part + np.einsum("ij,ij->i", turned_a[i, at:to], turned_b[j, at:to])
        at = to
        alive = part + (tail_a[i, at] * tail_b[j, at] if at < d else 0.0) >= threshold - ROUNDING
        i, j, part = i[alive], j[alive], part[alive]
    exact = np.empty(len(i))
    for k in range(0, len(i), 65_536):
        exact[k : k + 65_536] = np.einsum("ij,ij->i", a[i[k : k + 65_536]], b[j[k : k + 65_536]])
    keep = exact >= threshold
    return i[keep], j[keep]


def spanned(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n items the smallest item that the links i-j reach."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per row of vectors.

    vectors: vec_id, embedding (array of numbers) and a label; other columns are ignored.  Two vectors link if
    their labels are equal and not null and their cosine, in double precision, is at least threshold (above 0).
    n_links: vectors linked directly; component_id: the smallest vec_id that links reach; kept: vec_id = component_id.
    Vectors that are null, empty, zero, of another dimension, or hold a null or what is not finite link with nothing.

    A null label or vec_id links nothing.  A row that repeats a vec_id is another vector of this id: its links count, and rows of one
    vec_id with different vectors may have different results.  A cosine of just the threshold links.  An empty table gives an empty result.

    Equal unit vectors are taken together and counted.  On unit vectors a cosine of c means a distance of
    sqrt(2 - 2c) at most, along each principal axis as well, so a vector meets only its cell of that width along
    the leading axes and the cells beside it.  As many axes count as spread the vectors over more than a cell, one at least and
    AXES at most: an axis along which all lie close tells none apart and only adds copies.  Crowded cells are cut into tiles, and each pair of tiles is a task
    of its own, which returns a count per vector and links that span what is connected there, never all pairs.
    """
    units = unit_vectors(vectors, label).withColumn("key", F.md5("unit"))
    reps = saved(units.where("unit is not null").groupBy("label", "dim", "key").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("n"), F.first("unit").alias("unit")).withColumn("rep", F.monotonically_increasing_id()))
    found = axes(reps)
    turn = {d: turned for d, (turned, _) in found.items()}
    width = np.sqrt(max(2 - 2 * threshold, 0)) + 1e-6
    used = {d: max(1, int((spread[:AXES] > width).sum())) for d, (_, spread) in found.items()}
    cells = [f"c{k}" for k in range(max(used.values(), default=1))]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            at = np.zeros((batch.num_rows, len(cells)), np.int64)
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                x = np.frombuffer(b"".join(batch.column("unit").take(pa.array(own)).to_pylist())).reshape(-1, d)
                y = np.floor(x @ turn[d][:, : used[d]] / width).astype(np.int64)
                at[own[:, None], np.arange(y.shape[1])] = y
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(at[:, k], pa.int64()) for k in range(len(cells)))], names=[*batch.schema.names, *cells])

    placed = reps.select("label", "dim", "rep", "n", "unit").mapInArrow(place, "label string, dim int, rep long, n long, unit binary, " + ", ".join(f"{c} long" for c in cells))
    placed = saved(placed)
    cell = ["label", "dim", *cells]
    tiles = placed.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    # a cell's own vectors, and as guests those of the cells before it: each pair of neighbouring cells meets once
    after = [steps for steps in product((-1, 0, 1), repeat=len(cells)) if steps >= (0,) * len(cells)]
    near = F.explode(F.array(*[F.struct(*(F.lit(x).alias(c) for c, x in zip(cells, steps, strict=True)), F.lit(any(steps)).alias("guest")) for steps in after]))
    dealt = placed.select("*", near.alias("by")).select("label", "dim", *((F.col(c) + F.col(f"by.{c}")).alias(c) for c in cells), "by.guest", "rep", "n", "unit")
    dealt = dealt.join(tiles, cell).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.when(F.col("guest"), F.struct(t.alias("i"), F.lit(-1).alias("j"))).otherwise(F.struct(F.least(t, F.col("own")).alias("i"), F.greatest(t, F.col("own")).alias("j"))))
    # guests of one home tile come in slices of their own, and with it each time
    dealt = dealt.withColumn("pair", F.explode(pair)).select(*cell, "pair.i", "pair.j", "guest", "own", "rep", "n", "unit")
    guests = dealt.where("guest")
    slices_ = guests.groupBy(*cell, "i").agg(F.ceil(F.count(F.lit(1)) / (4 * TILE)).cast("int").alias("slices"))
    guests = guests.join(slices_, [*cell, "i"]).withColumn("j", -1 - F.pmod(F.xxhash64("rep"), F.col("slices")).cast("int")).drop("slices")
    home = dealt.where("not guest")
    host = home.where("i = own and j = own").join(slices_, [*cell, "i"]).withColumn("j", F.explode(F.sequence(F.lit(-1), -F.col("slices"), F.lit(-1)))).drop("slices")
    order = home.columns
    blocks = home.unionByName(guests.select(order)).unionByName(host.select(order))

    def compare(rows: pa.Table) -> pa.Table:
        d, i, j = (rows.column(c)[0].as_py() for c in ("dim", "i", "j"))
        rep, n = rows.column("rep").to_numpy(), rows.column("n").to_numpy()
        units_ = np.frombuffer(b"".join(rows.column("unit").to_pylist())).reshape(-1, d)
        turned = units_ @ turn[d]
        guest, own = rows.column("guest").to_numpy(zero_copy_only=False), rows.column("own").to_numpy()
        left, right = (np.flatnonzero(~guest), np.flatnonzero(guest)) if j < 0 else (np.flatnonzero(own == i), np.flatnonzero(own == j))
        a, b = [], []
        for p in range(0, len(left), TILE):
            for q in range(0, len(right), TILE):
                l_, r_ = left[p : p + TILE], right[q : q + TILE]
                x, y = close_pairs(units_[l_], units_[r_], turned[l_], turned[r_], threshold)
                x, y = l_[x], r_[y]
                once = x < y if i == j else x != y
                a.append(x[once])
                b.append(y[once])
        a, b = (np.concatenate(v) if v else np.zeros(0, int) for v in (a, b))
        links = np.bincount(a, n[b], len(rep)) + np.bincount(b, n[a], len(rep))
        order_ = np.argsort(rep, kind="stable")
        back = np.argsort(order_, kind="stable")
        to = rep[order_][spanned(len(rep), back[a], back[b])][back]
        hit = np.flatnonzero(links)
        return pa.table({"rep": rep[hit], "links": links[hit].astype(np.int64), "to": to[hit]})

    met = saved(blocks.repartition(tasks(blocks.sparkSession), *cell, "i", "j").groupBy(*cell, "i", "j").applyInArrow(compare, "rep long, links long, to long"))
    parts = components(met, "rep", "to").select(F.col("id").alias("rep"), "component")
    linked = met.groupBy("rep").agg(F.sum("links").alias("links"))
    least = saved(reps.select("rep", "vec_id").join(parts, "rep").groupBy("component").agg(F.min("vec_id").alias("component_id")))
    joined = reps.select("rep", F.col("vec_id").alias("own"), "label", "dim", "key", "n").join(linked, "rep", "left").join(parts.join(least, "component").drop("component"), "rep", "left")
    classes = joined.select("label", "dim", "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "own").alias("component_id"))
    # rows that cannot link would meet in one task
    alone = units.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = units.where("key is not null").select("vec_id", "label", "dim", "key").join(classes, ["label", "dim", "key"]).select("vec_id", "n_links", "component_id")
    return out.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


NEAR_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), good AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), reach AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (
  SELECT a, min(b) AS c FROM reach GROUP BY a
), counts AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(least(c, vec_id), vec_id) AS component_id, vec_id = coalesce(least(c, vec_id), vec_id) AS kept
FROM v LEFT JOIN counts ON counts.a = vec_id LEFT JOIN least ON least.a = vec_id
"""
