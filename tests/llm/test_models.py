"""Language-model scores, vector codes and the Merkle manifest against brute force, and their defined cases."""

import math
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwell.llm import codes, merkle, pitmanyor

SF = "/root/testdata/sf0.001"


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)})), None]


# op11


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(documents):
    return pitmanyor.train(documents.where(~pitmanyor.held_out(F.col("doc_id"))))


def test_base_scores_and_counts(documents, model):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    count = Counter(t for i, text in texts.items() if not out[i] for t in tokens(text))
    total = sum(count.values())
    assert (model.n_tokens, model.n_words) == (total, len(count))
    scored = pitmanyor.score(documents, model).collect()
    assert len(scored) == len(texts)
    for r in scored:
        own = tokens(texts[r["doc_id"]])
        assert r["n_tokens"] == len(own) and r["n_known"] == sum(t in count for t in own)
        assert math.isclose(r["base_score"], sum(math.log10((count[t] + 1) / (total + len(count) + 1)) for t in own), rel_tol=1e-9)
        assert r["score"] < 0


def test_the_model_is_better_than_its_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = pitmanyor.held_out(F.col("doc_id"))
    scored = pitmanyor.score(docs, pitmanyor.train(docs.where(~out)))
    found = {r["group"]: r["perplexity"] for r in pitmanyor.perplexity(scored, pitmanyor.held_out(F.col("doc_id"))).collect()}
    base = {r["group"]: r["perplexity"] for r in pitmanyor.perplexity(scored, pitmanyor.held_out(F.col("doc_id")), "base_score").collect()}
    assert found[True] < 0.75 * base[True] and found[False] < 0.4 * base[False]


def test_chances_of_all_words_are_one(model):
    """In restaurants of frequent words, of classes and of a class that no text has: all known words and what is unknown."""
    rows = model.state.collect()
    assert len(model.sums) == pitmanyor.KEEP and len(model.frequent)
    contexts = [pitmanyor.BEGIN, ord("a"), ord("e"), 1, *(pitmanyor.CLASSES + k for k in range(0, len(model.frequent), 9))]
    held = {"parents": model.parents, "sums": model.sums}
    for context in contexts:
        total = 0.0
        for row in rows:
            words = np.frombuffer(row["words"], np.uint64)
            for some in (words, np.array([12345], np.uint64)):
                ask = pa.table({"block": [0], "bucket": [row["bucket"]], "words": [some.tobytes()], "sizes": [np.ones(len(some), np.uint16).tobytes()], "contexts": [np.full(len(some), context, np.uint16).tobytes()]})
                got = pitmanyor.answers(ask, pa.Table.from_pylist([row.asDict()]), held)
                chance = (10.0 ** np.frombuffer(got.column("chances")[0].as_py(), np.float32).astype(float)).sum()
                total += chance if some is words else chance / len(rows)
        assert abs(total - 1) < 1e-4, (context, total)


def partitions(n):
    if n == 0:
        yield []
        return
    for p in partitions(n - 1):
        for k in range(len(p)):
            yield [*p[:k], p[k] + 1, *p[k + 1 :]]
        yield [*p, 1]


@pytest.mark.parametrize(("c", "base", "parent", "d"), [(2, 1.0, 0.3, 0.5), (4, 3.0, 0.2, 0.7), (5, 0.5, 0.9, 0.2)])
def test_seating_has_the_models_distribution(c, base, parent, d):
    """How many tables the Gibbs moves leave, against the sum over all seatings."""
    want = defaultdict(float)
    for p in partitions(c):
        weight = math.prod((base + d * k) * parent for k in range(len(p)))
        want[len(p)] += weight * math.prod(math.prod(j - d for j in range(1, size)) for size in p)
    n, rng = 40_000, np.random.default_rng(4)
    t, seats = np.zeros(n, np.int64), np.zeros(0, np.int64)
    for _ in range(12):
        t, seats = pitmanyor.seat(np.full(n, c), t, seats, np.full(n, base), np.full(n, parent), d, 8, rng)
    assert seats.sum() == n * c and len(seats) == t.sum() and seats.min() > 0
    got = np.bincount(t, minlength=c + 1)[1:] / n
    assert np.allclose(got, [want[k] / sum(want.values()) for k in range(1, c + 1)], atol=0.012)


def test_those_who_came_or_went_take_or_leave_a_seat():
    rng = np.random.default_rng(1)
    t, seats = pitmanyor.seat(np.array([9, 5000, 3, 2]), np.zeros(4, np.int64), np.zeros(0, np.int64), np.array([5.0, 800.0, 1.0, 0.1]), np.array([0.5, 0.9, 0.1, 1e-9]), 0.8, 8, rng)
    for c in ([30, 4000, 2, 2], [4, 4100, 7, 90]):
        t, seats = pitmanyor.seat(np.array(c), t, seats, np.array([5.0, 800.0, 1.0, 0.1]), np.array([0.5, 0.9, 0.1, 1e-9]), 0.8, 8, rng)
        assert np.add.reduceat(seats, np.cumsum(t) - t).tolist() == c and (t <= c).all() and seats.min() > 0


def test_defined_texts_and_rows(spark, model):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", None), (3, "The the THE", "y"), (None, "the", "z"), (4, "w " * 60_000, "x"), (4, "w " * 60_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string").withColumn("score", F.lit(1))
    got = pitmanyor.score(docs, model).collect()
    assert sorted((r["n_tokens"] for r in got)) == [1, 1, 1, 2, 4, 60_001, 60_001] and len({r["score"] for r in got if r["doc_id"] == 4}) == 1
    own = pitmanyor.train(docs)
    assert own.n_tokens == 120_011 and all(math.isfinite(r["score"]) for r in pitmanyor.score(docs, own).collect())
    assert pitmanyor.score(docs.limit(0), model).count() == 0
    none = pitmanyor.train(docs.limit(0))
    assert none.n_tokens == 0 and {r["score"] for r in pitmanyor.score(docs, none).collect()} == {0.0}
    assert pitmanyor.held_out(F.lit(None)) is not None and docs.where("doc_id is null").where(pitmanyor.held_out(F.col("doc_id"))).count() == 0


def test_slices_blocks_and_buckets_change_no_count(documents, monkeypatch):
    monkeypatch.setattr(pitmanyor, "SLICE_BYTES", 20_000)
    monkeypatch.setattr(pitmanyor, "BLOCK_BYTES", 30_000)
    monkeypatch.setattr(pitmanyor, "BUCKET_BYTES", 100_000)
    many = pitmanyor.train(documents.repartition(5))
    one = pitmanyor.score(documents, many).groupBy().agg(F.sum("n_known").alias("k"), F.sum("n_tokens").alias("n")).first()
    assert many.buckets > 2 and one["k"] == one["n"] == many.n_tokens


def test_counts_and_tables_take_a_byte_each(model):
    for x in ([], [0, 1, 254], [255, 256, 3, 1 << 40, 255]):
        assert pitmanyor.wide(pitmanyor.narrow(np.array(x, np.int64))).tolist() == x
    for row in model.state.collect():
        entries = len(row["contexts"]) // 2 + len(row["classes"]) // 2 + len(row["words"]) // 8
        assert len(row["tables"]) < 1.1 * entries * (1 + len(model.sums) - 1) + 8 and len(row["counts"]) < 1.1 * len(row["contexts"]) / 2 + 8
        assert len(row["seated"]) < 2 * len(row["tables"])


def test_every_token_is_a_customer_whatever_is_frequent(documents, monkeypatch):
    """Words before that are not frequent have their class's restaurant: no token is left out, however few have their own."""
    for share in (1, 64, 1024):
        monkeypatch.setattr(pitmanyor, "SHARE", share)
        own = pitmanyor.train(documents, burn=0, keep=1)
        parts = [pitmanyor.Dishes.read(b.slice(k, 1), own.parents) for b in own.state.toArrow().to_batches() for k in range(b.num_rows)]
        assert sum(d.customers.sum() + d.direct.sum() for d in parts) == own.n_tokens and len(own.frequent) < share


# op12


def brute_codes(rows, parts, entries, rounds):
    """Whole integers, all distances."""
    kept = sorted((i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    x = np.array([[math.floor(1024 * c) for c in v] for _, v, _ in kept], dtype=object).reshape(len(kept), parts, -1)
    books = [[list(x[k, p]) for k in range(min(entries, len(kept)))] for p in range(parts)]

    def near(v, book):
        d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in book]
        return min(range(len(d)), key=lambda k: (d[k], k)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for v in x[:, p]:
                own[near(v, books[p])[0]].append(v)
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if k in own else b for k, b in enumerate(books[p])]
    out = []
    for (i, _, label), v in zip(kept, x, strict=True):
        found = [near(v[p], books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for k, _ in found), int(sum(d for _, d in found))))
    sums = defaultdict(int)
    for _, label, _, e in out:
        sums[label] += e
    return sorted(((i, None if label is None else str(label), c, e, sums[label]) for i, label, c, e in out), key=str), books


def test_codes_are_those_of_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.3, 8)], None if i % 7 == 0 else int(i % 3)) for i in rng.permutation(160)]
    rows += [(1000 + k, rows[k][1], rows[k][2]) for k in range(20)] + [(2000, None, 1), (2001, [None] * 8, 1), (2002, [math.inf] * 8, 1), (2003, [math.nan] * 8, 1), (2004, [0.0] * 8, None), (2005, [3e4] * 8, 5), (2006, [-3e4] * 8, 5)]
    given = spark.createDataFrame([(*r, "e") for r in rows], "vec_id long, embedding array<double>, label int, error string").repartition(4)
    got, books = codes.compress(given, parts=4, entries=20, rounds=3)
    want, expected = brute_codes(rows, 4, 20, 3)
    assert sorted(((r["vec_id"], r["label"], r["code"], r["error"], r["label_error"]) for r in got.collect()), key=str) == want
    assert books.tolist() == expected
    back = codes.restored(got, books).where("vec_id < 100").collect()
    near = {i: v for i, v, _ in rows}
    assert all(len(r["embedding"]) == 8 for r in back) and np.mean([np.abs(np.array(r["embedding"]) - near[r["vec_id"]]).mean() for r in back]) < 0.3


def test_screening_never_loses_the_nearest():
    """Ties, near ties and numbers far beyond what float32 holds."""
    rng = np.random.default_rng(3)
    for scale, shift in product((3, 1000, 10**6, 10**8), (0, 10**7)):
        book = rng.integers(-scale, scale + 1, (64, 4)) + shift
        book[40] = book[3]
        x = np.concatenate([rng.integers(-scale, scale + 1, (300, 4)) + shift, book[rng.integers(64, size=50)] + rng.integers(-1, 2, (50, 4)), (book[:20] + book[20:40]) // 2])
        near, far = codes.nearest(x, book)
        d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        assert (near == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()


def test_few_odd_and_no_vectors(spark):
    kind = "vec_id long, embedding array<float>, label string"
    some = spark.createDataFrame([(2, [1.0, 2.0, 3.0], "a"), (None, [1.0], None), (1, [], "a"), (2, [1.0, 2.0, 3.0], "a"), (5, [3e38, -3e38], "b")], kind)
    got, books = codes.compress(some, parts=2)
    assert books.shape == (2, 5, 2) and got.count() == 5 and {r["error"] for r in got.where("vec_id <= 2").collect()} == {0}
    for none in (some.limit(0), spark.createDataFrame([(1, None, "a")], kind)):
        got, books = codes.compress(none)
        assert got.count() == 0 and got.columns == ["vec_id", "label", "code", "error", "label_error"] and codes.digest(books) == sha256(b"").hexdigest()


# op13


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def brute_trees(rows, fanout):
    """by, order, leaf: for each row subroot, root and the whole proof, from the definition."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[0]].append(row)
    key = lambda v: (v is not None, v if v is not None else 0)

    def climb(nodes):
        """The root, and each node's levels: run and place."""
        proof, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, i in enumerate(at):
                run = nodes[i // fanout * fanout : i // fanout * fanout + fanout]
                proof[k].append(("".join(run[: i % fanout]), "".join(run[i % fanout + 1 :])))
            nodes, at = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)], [i // fanout for i in at]
        return nodes[0], proof

    done, tops = {}, []
    for by in sorted(groups, key=lambda b: (b is not None, (b or "").encode())):
        own = sorted(groups[by], key=lambda r: (key(r[1]), r[2]))
        root, proof = climb([r[2] for r in own])
        done[by] = (own, root, proof)
        tops.append((by, root))
    root, above = climb([t for _, t in tops])
    return sorted(((r, sub, root, p + up) for (by, sub), up in zip(tops, above, strict=True) for r, p in zip(done[by][0], done[by][2], strict=True)), key=str)


@pytest.mark.parametrize(("fanout", "levels"), [(8, 4), (3, 2), (2, 1)])
def test_manifest_is_that_of_brute_force(spark, fanout, levels):
    rng = np.random.default_rng(6)
    langs = ["en"] * 60 + [None, "é", "zz", "", "a", "b", "c", "d", "e", "f"]
    rows = [(langs[rng.integers(len(langs))], None if rng.random() < 0.05 else int(rng.integers(-50, 150)), h(str(rng.integers(90)))) for _ in range(230)] + [("lone", 1, h("x"))] + [("same", 4, h("y"))] * 11
    given = spark.createDataFrame([(*r, "keep", 1.5) for r in rows], "lang string, doc_id long, leaf string, root string, `a.b` double").repartition(4)
    out = merkle.manifest(given, fanout=fanout, levels=levels)
    assert out.columns == ["lang", "doc_id", "leaf", "a.b", "subroot", "root", "proof"]
    got = [((r["lang"], r["doc_id"], r["leaf"]), r["subroot"], r["root"], [(s["before"], s["after"]) for s in r["proof"]]) for r in out.collect()]
    assert sorted(got, key=str) == brute_trees(rows, fanout)
    folded = out.select((merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok"), (merkle.folded(F.lit(h("other")), F.col("proof")) == F.col("root")).alias("bad")).distinct().collect()
    assert [tuple(r) for r in folded] == [(True, False)]


def test_one_row_one_tree_and_none(spark):
    one = spark.createDataFrame([(None, None, h("x"))], "lang string, doc_id long, leaf string")
    row = merkle.manifest(one).first()
    assert row["subroot"] == row["root"] == row["leaf"] == h("x") and row["proof"] == []
    assert merkle.manifest(one.limit(0)).count() == 0


def test_trees_by_numbers(spark):
    rows = [(k % 3 or None, k, h(str(k))) for k in range(40)]
    out = merkle.manifest(spark.createDataFrame(rows, "lang long, doc_id long, leaf string"), fanout=2, levels=1)
    assert out.count() == 40 and out.where(merkle.folded(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    assert out.select("subroot").distinct().count() == 3 and out.select("root").distinct().count() == 1


def test_leaves_say_what_is_null(spark):
    given = spark.createDataFrame([(-5, None, "é1", "", 7)], "a long, b string, c string, d string, e int")
    got = given.select(merkle.leaf(*map(F.col, "abcde")).alias("x"), merkle.lower_ascii(F.lit("AbÉZ9")).alias("y")).first()
    assert got["x"] == h("2:-5", "-", "3:é1", "0:", "1:7") and got["y"] == "abÉz9"
