"""Vector code compression: product codes of integer vectors, screened by a float32 matrix product and settled in int64."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.shared import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors that are screened at a time: a float32 for each entry of a codebook.
ROWS = 8_192
#: Unit roundoff of float32.
UNIT = 2.0**-24

INTEGERS = "vec_id long, label string, parts array<long>"


def widest(vectors: DataFrame) -> int:
    """Components of the longest vector."""
    return vectors.agg(F.coalesce(F.max(F.size(F.coalesce("embedding", F.array()))), F.lit(0))).first()[0]


def integers(vectors: DataFrame, dims: int, label: str, scale: int = SCALE) -> DataFrame:
    """vec_id, label and floor(scale * x) of the vectors that are whole and finite, with zeros up to dims components.

    What lies beyond the largest number for which squared distances fit in 63 bits counts as that number.
    """
    most = int(np.sqrt(2.0**61 / max(dims, 1)) / 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null is NaN
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            wrong = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            good = lists.is_valid().to_numpy(zero_copy_only=False) & (wrong[offsets[1:]] == wrong[offsets[:-1]])
            out = np.zeros((batch.num_rows, dims), np.int64)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            fine = good[row]
            with np.errstate(over="ignore"):
                values = np.clip(np.floor(flat[fine] * scale), -most, most).astype(np.int64)
            out[row[fine], (np.arange(len(flat)) - offsets[:-1][row])[fine]] = values
            own = pa.array(np.flatnonzero(good))
            packed = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * dims, pa.int32()), pa.array(out[good].ravel(), pa.int64()))
            yield pa.record_batch([batch.column(0).take(own), batch.column(1).take(own), packed], names=["vec_id", "label", "parts"])

    return vectors.select(F.col("vec_id").cast("long"), F.col(label).cast("string").alias("label"), F.col("embedding").cast("array<double>")).mapInArrow(run, INTEGERS)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the nearest row of book and the squared distance to it, both of int64; ties go to the lower index.

    |x - c|**2 - |x|**2 = |c|**2 - 2 x.c is taken from a float32 product.  Its error is below `slack`: a sum of L products
    errs by at most g(L) |x| |c| with g(L) = L u / (1 - L u), in whatever order it is summed, rounding x and c to float32 adds u
    of each, and so does each step after it.  So the nearest entry is among those within twice the slack of the least, and
    these alone are measured again in integers.
    """
    length = x.shape[1]
    c32, x32 = book.astype(np.float32), x.astype(np.float32)
    norms = np.einsum("ij,ij->i", book, book)
    score = norms.astype(np.float32)[None, :] - 2 * (x32 @ c32.T)
    size = np.sqrt(np.einsum("ij,ij->i", x.astype(np.float64), x.astype(np.float64)))
    far = np.sqrt(float(norms.max()))
    gamma = (length + 4) * UNIT / (1 - (length + 4) * UNIT)
    slack = 1.01 * (2 * gamma * size * far + 4 * UNIT * (far * far + 2 * size * far)) + 1e-30
    least = score.min(axis=1).astype(np.float64)
    i, j = np.nonzero(score <= np.nextafter((least + 2 * slack).astype(np.float32), np.float32(np.inf))[:, None])
    gap = x[i] - book[j]
    exact = np.einsum("ij,ij->i", gap, gap)
    starts = np.searchsorted(i, np.arange(len(x)))
    best = np.minimum.reduceat(exact, starts) if len(x) else exact
    hit = np.flatnonzero(exact == best[i])
    first = hit[np.searchsorted(i[hit], np.arange(len(x)))]
    return j[first], best


def assigned(parts: pa.Array, books: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """For ROWS vectors at a time: where they are, their parts, the entries and the squared distances, each by vector and part."""
    n, _, length = books.shape
    x = parts.flatten().to_numpy(zero_copy_only=False).reshape(len(parts), n, length)
    for at in range(0, len(x), ROWS):
        own = x[at : at + ROWS]
        found = [nearest(np.ascontiguousarray(own[:, p]), books[p]) for p in range(n)]
        yield slice(at, at + len(own)), own, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: each entry the floored mean of the parts nearest to it; an unused one stays.

    A task returns the sums of its vectors by part, entry and component; Spark adds them up, so the driver gets one
    codebook's worth of numbers, however many tasks there are.
    """
    n, entries, length = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((n, entries), np.int64)
        for batch in batches:
            for _, x, near, _ in assigned(batch.column(0), books):
                for p in range(n):
                    order = np.argsort(near[:, p], kind="stable")
                    used, first = np.unique(near[order, p], return_index=True)
                    sums[p, used] += np.add.reduceat(x[order, p], first)
                    counts[p, used] += np.diff(np.append(first, len(order)))
        where = np.flatnonzero(counts.ravel())
        held = np.hstack([counts.reshape(-1, 1), sums.reshape(-1, length)])[where]
        yield pa.record_batch([pa.array(np.repeat(where, length + 1)), pa.array(np.tile(np.arange(length + 1), len(where))), pa.array(held.ravel())], names=["entry", "k", "value"])

    total = rows.select("parts").mapInArrow(run, "entry long, k long, value long").groupBy("entry", "k").agg(F.sum("value").alias("value")).toArrow()
    held = np.zeros((n * entries, length + 1), np.int64)
    held[total.column("entry").to_numpy(), total.column("k").to_numpy()] = total.column("value").to_numpy()
    out = books.reshape(-1, length).copy()
    used = held[:, 0] > 0
    out[used] = held[used, 1:] // held[used, :1]
    return out.reshape(books.shape)


def trained(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks by part, entry and component, from rows of INTEGERS; they begin with the parts of the smallest vec_ids (nulls last, ties by components)."""
    first = rows.select("vec_id", "parts").orderBy(F.asc_nulls_last("vec_id"), "parts").limit(entries).collect()
    length = len(first[0]["parts"]) // parts if first else 0
    books = np.array([r["parts"] for r in first], np.int64).reshape(len(first), parts, length).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(first) else 0):
        books = moved(rows, books)
    return books


def digest(books: np.ndarray) -> str:
    return sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encoded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (an index for each part, in hex digits) and error of rows of INTEGERS."""
    digits = max(2, len(f"{max(books.shape[1] - 1, 0):x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([f"{i:0{digits}x}" for i in range(books.shape[1])], object)
        for batch in batches:
            for at, _, near, far in assigned(batch.column(2), books):
                part = batch.slice(at.start, at.stop - at.start)
                code = names[near].sum(axis=1)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(code, pa.string()), pa.array(far.sum(axis=1), pa.int64())], names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, "vec_id long, label string, code string, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """vec_id, label (as text), code, error and label_error of each vector, and the codebooks by part, entry and component.

    vectors: vec_id, embedding (array of numbers) and a label; other columns are ignored.  Components become floor(1024 * x), and vectors
    are cut into consecutive parts of equal length, each with a codebook of its own.  A round assigns every part to its
    nearest entry and moves each entry to the floored mean of its parts; then parts are assigned once more.  error: squared
    distances summed over the parts; label_error: errors summed over the vectors of the label.

    Vectors that are null or hold a null or what is not finite are left out.  A vector shorter than the longest one, or than a multiple
    of parts, counts as continued with zeros.  A component beyond about 2**27 (for 256 dimensions) counts as that, so
    that no sum overflows.  Null labels count together; rows of one vec_id, null or equal ones too, are vectors each.  With fewer vectors
    than entries the codebooks are as short as that.  An empty table gives an empty result and empty codebooks.
    """
    scratch = Scratch(vectors.sparkSession, "codes")
    dims = -(-widest(vectors) // parts) * parts or parts
    rows = scratch.store(integers(vectors, dims, label))
    books = trained(rows, parts, entries, rounds)
    if not books.size:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), books
    out = scratch.store(encoded(rows, books))
    # one row for each label, whose size Spark knows from the files: it broadcasts them if they are small, else it splits the large partitions
    errors = scratch.store(out.groupBy("label").agg(F.sum("error").alias("label_error"))).select(F.col("label").alias("own"), "label_error")
    return out.join(errors, F.col("label").eqNullSafe(F.col("own"))).drop("own"), books


def restored(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """codes with embedding, the vector that each code stands for: the middle of its integer cell."""
    digits = max(2, len(f"{max(books.shape[1] - 1, 0):x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [[int(c[k * digits : (k + 1) * digits], 16) for k in range(len(books))] for c in batch.column(1).to_pylist()]
            x = (books[np.arange(len(books)), np.array(at, np.int64).reshape(-1, len(books))].reshape(len(at), -1) + 0.5) / scale
            yield pa.record_batch([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["vec_id", "embedding"])

    return codes.select("vec_id", "code").mapInArrow(run, "vec_id long, embedding array<double>")


def codes_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB SQL of compress(); integers are exact in doubles."""
    out = [f"""WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS MATERIALIZED (
  SELECT vec_id, label, p, e[p * (len(e) // {parts}) + 1:(p + 1) * (len(e) // {parts})] AS x FROM kept, range({parts}) t(p)
), book0 AS MATERIALIZED (
  SELECT p, i, x AS c FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS i FROM cut) WHERE i < {entries}
)"""]
    for k in range(rounds + 1):
        out.append(f""", near{k} AS MATERIALIZED (
  SELECT vec_id, any_value(label) AS label, u.p, any_value(x) AS x, min(struct_pack(d := list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c), i := i)) AS best
  FROM cut u JOIN book{k} b ON u.p = b.p GROUP BY vec_id, u.p
)""")
        if k < rounds:
            out.append(f""", flat{k} AS (
  SELECT p, best.i AS i, unnest(range(1, len(x) + 1)) AS j, unnest(x) AS v FROM near{k}
), mean{k} AS (
  SELECT p, i, list(m ORDER BY j) AS c FROM (SELECT p, i, j, floor(sum(v) / count(*)) AS m FROM flat{k} GROUP BY p, i, j) GROUP BY p, i
), book{k + 1} AS MATERIALIZED (
  SELECT p, i, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m USING (p, i)
)""")
    out.append(f""", said AS (
  SELECT sha256(string_agg(array_to_string(list_transform(c, lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, i)) AS codebooks_sha256 FROM book{rounds}
), coded AS (
  SELECT vec_id, any_value(label) AS label, string_agg(lower(lpad(to_hex(best.i), 2, '0')), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, said""")
    return "".join(out)
