"""N-gram Jaccard join: documents with similar sets of word shingles, by T-occurrence search with DivideSkip."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.blocks import answered, bucket_of, how_common, ranked, scattered, send
from inkwell.llm.components import components
from inkwell.llm.neardup import spanned
from inkwell.llm.shared import Scratch, few, free, quoted, saved, sieved, stored, tasks
from inkwell.llm.words import LOWER, ROLL, forget, mix, slices, span_hashes, text_buffers, window_hashes, word_bounds

SHINGLE, PERCENT = 5, 80
#: Documents of an index, and of a tile of a family: each document of n goes to n / TILE pairs of tiles.
INDEX, TILE = 256, 1024
#: Shingles of an index or a tile, so that long documents come in smaller ones.
MOST_SHINGLES = 4 << 20
#: Rounds in which each inverted list is searched for one of its documents only.
STARS = 2
#: DivideSkip: how much a probe of a long list costs against merging it.
MU = 0.01

SIFTED = "doc_id long, t long, n long, text string"
SETS = "doc_id long, t long, n long, s1 long, s2 long, shingles binary, prefix binary, indexed int"


def least_overlap(n: int | np.ndarray, percent: int):
    """How many of its n shingles a document shares at least with any that it links to."""
    return -(-percent * n // 100)


def overlap_of_equals(n: int, percent: int) -> int:
    """How many it shares at least with any that has as many shingles or more."""
    return -(-2 * percent * n // (100 + percent))


def shingle_pairs(rows: pa.Table, k: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, bucket and row of each distinct shingle of each row."""
    parts, base = [], 0
    for batch in rows.combine_chunks().to_batches():
        for piece in slices(batch, "text"):
            data, offsets = text_buffers(piece.column("text"))
            starts, ends, before = word_bounds(data, offsets)
            words, counts = span_hashes(LOWER[data], starts, ends), np.diff(before)
            h, windows = window_hashes(words, counts, k, ROLL[0])
            second, _ = window_hashes(words, counts, k, ROLL[1])
            row = np.repeat(np.arange(len(counts)), windows)
            for short in range(1, k):  # the whole text as one
                few = np.flatnonzero(counts == short)
                if len(few):
                    own = words[np.isin(np.repeat(np.arange(len(counts)), counts), few)]
                    for roll, at in ((ROLL[0], 0), (ROLL[1], 1)):
                        w, _ = window_hashes(own, counts[few], short, roll)
                        w = mix(w ^ np.uint64(short))
                        if at:
                            second = np.concatenate([second, w])
                        else:
                            h = np.concatenate([h, w])
                    row = np.concatenate([row, few])
            with np.errstate(over="ignore"):
                _, once = np.unique(mix(h + mix(row.astype(np.uint64) + np.uint64(1))), return_index=True)
            parts.append((h[once], bucket_of(second[once], buckets), row[once] + base))
            base += piece.num_rows
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(0, int)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def eighths(percent: int) -> int:
    """How many eighths of all shingles tell that a document has too few that occur elsewhere: over twice the part that it may have alone."""
    return min(8, -(-25 * (100 - percent) * 8 // 1000))


def sifted(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """SIFTED, one row per row of docs: n distinct shingles; the text is null for a document that can't link.

    Some eighths of the shingles, taken by their hash, are counted over all rows by 32 bits of it.  A document with more of them to itself
    than the n - least_overlap that it may have of all links with nothing.  Shingles that these bits take for one only leave a document
    more for shingle_sets(), which counts all shingles of what is left by their whole hashes.
    """
    part = eighths(percent)

    def some(rows: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        h, b, row = shingle_pairs(rows, k, buckets)
        n = np.bincount(row, minlength=rows.num_rows)
        taken = (h & np.uint64(7)) < part
        return h[taken] >> np.uint64(32), b[taken], row[taken], n

    def sender(rows: pa.Table, block: int, buckets: int) -> pa.Table:
        h, b, _, _ = some(rows, buckets)
        order, cuts = ranked(h, b)
        at = order[cuts]
        return send(block, h[at], b[at], np.diff(np.append(cuts, len(h))))

    def finish(rows: pa.Table, codes: np.ndarray, buckets: int) -> pa.Table:
        h, b, row, n = some(rows, buckets)
        order, cuts = ranked(h, b)
        level = np.zeros(len(h), np.uint8)
        level[order] = np.repeat(codes, np.diff(np.append(cuts, len(h))))
        alone = np.bincount(row[level == 1], minlength=rows.num_rows)
        left = pa.array((n > 0) & (alone <= n - least_overlap(n, percent)))
        text = pc.if_else(left, rows.column("text").combine_chunks(), pa.scalar(None, rows.column("text").type))
        return pa.table({"doc_id": rows.column("doc_id").cast(pa.int64()), "t": rows.column("t").cast(pa.int64()), "n": pa.array(n, pa.int64()), "text": text})

    rows, size = scattered(docs)
    return answered(rows, size * part // 8, sender, how_common, finish, SIFTED)


def shingle_sets(docs: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """SETS, one row per row of docs: n distinct shingles; for a document that can link, its set and prefix.

    A document links only if least_overlap() of its shingles occur elsewhere; all other documents are done, most of them by sifted(),
    so that only what may have copies sends all of its shingles.
    t: a hash of the text.  shingles: the set as sorted 64-bit hashes; s1, s2: a hash of it.  prefix: those of its shingles that occur
    elsewhere and are among its n - least_overlap + 1 rarest, in one order for all documents; the first indexed of them are among its
    n - overlap_of_equals + 1 rarest.  The first shingle that two linked documents share is in both prefixes, and among the indexed of
    the one with fewer shingles, as all others that they share follow it.
    """

    def sender(rows: pa.Table, block: int, buckets: int) -> pa.Table:
        h, b, _ = shingle_pairs(rows, k, buckets)
        order, cuts = ranked(h, b)
        at = order[cuts]
        return send(block, h[at], b[at], np.diff(np.append(cuts, len(h))))

    def finish(rows: pa.Table, codes: np.ndarray, buckets: int) -> pa.Table:
        h, b, row = shingle_pairs(rows, k, buckets)
        order, cuts = ranked(h, b)
        level = np.zeros(len(h), np.uint8)
        level[order] = np.repeat(codes, np.diff(np.append(cuts, len(h))))
        n = np.bincount(row, minlength=rows.num_rows)
        shared = np.bincount(row[level > 1], minlength=rows.num_rows)
        linkable = (n > 0) & (shared >= least_overlap(n, percent))
        keep = linkable[row]
        h, level, row = h[keep], level[keep], row[keep]
        sort = np.lexsort((h, level, row))
        h, level, row = h[sort], level[sort], row[sort]
        ends = np.searchsorted(row, np.arange(rows.num_rows), "right")
        out: dict[str, list] = {"s1": [], "s2": [], "shingles": [], "prefix": [], "indexed": []}
        for i in range(rows.num_rows):
            if not linkable[i]:
                for column in out.values():
                    column.append(None)
                continue
            own = slice(ends[i] - n[i], ends[i])
            first = h[own][: n[i] - least_overlap(int(n[i]), percent) + 1]
            whole = np.sort(h[own]).tobytes()
            name = hashlib.blake2b(whole, digest_size=16).digest()
            out["s1"].append(int.from_bytes(name[:8], "little", signed=True))
            out["s2"].append(int.from_bytes(name[8:], "little", signed=True))
            out["shingles"].append(whole)
            elsewhere = level[own][: len(first)] > 1
            out["prefix"].append(first[elsewhere].tobytes())
            out["indexed"].append(int(elsewhere[: n[i] - overlap_of_equals(int(n[i]), percent) + 1].sum()))
        kinds = {"s1": pa.int64(), "s2": pa.int64(), "shingles": pa.binary(), "prefix": pa.binary(), "indexed": pa.int32()}
        return pa.table({"doc_id": rows.column("doc_id").cast(pa.int64()), "t": rows.column("t").cast(pa.int64()), "n": pa.array(n, pa.int64()), **{c: pa.array(v, kinds[c]) for c, v in out.items()}})

    all_rows = scratch.store(sifted(docs, k, percent))
    rows, size = scattered(all_rows.where("text is not null"))
    sets = answered(rows, size, sender, how_common, finish, SETS)
    done = all_rows.where("text is null")
    return sets.unionAll(done.select("doc_id", "t", "n", *[F.lit(None).cast(f.dataType).alias(f.name) for f in sets.schema.fields[3:]]))


class Index:
    """Inverted lists of some sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")  # so that lists are ascending
        self.owners = owner[order]
        self.tokens, self.begins = np.unique(tokens[order], return_index=True)
        self.ends = np.append(self.begins[1:], len(tokens))

    def search(self, query: np.ndarray, percent: int) -> np.ndarray:
        """Which sets reach percent similarity with the query.

        They occur in T = least_overlap lists at least.  The L longest lists are set aside; the others are
        merged through a heap; what occurs there T - L times is probed in the long ones by binary search.
        """
        at = np.searchsorted(self.tokens, query)
        at = at[(at < len(self.tokens)) & (self.tokens[np.minimum(at, len(self.tokens) - 1)] == query)]
        need = int(least_overlap(len(query), percent))
        if len(at) < need:
            return np.zeros(0, np.int64)
        lengths = self.ends[at] - self.begins[at]
        at = at[np.argsort(-lengths, kind="stable")]
        longest = max(int(lengths.max()), 2)
        aside = min(need - 1, int(need / (MU * np.log2(longest) + 1)))
        short = [self.owners[self.begins[i] : self.ends[i]].tolist() for i in at[aside:]]
        found = [(owner, sum(1 for _ in same)) for owner, same in groupby(heapq.merge(*short))]
        alive = np.array([o for o, c in found if c >= need - aside], np.int64)
        count = np.array([c for _, c in found if c >= need - aside], np.int64)
        for k, i in enumerate(at[:aside]):
            if not len(alive):
                break
            own = self.owners[self.begins[i] : self.ends[i]]
            place = np.searchsorted(own, alive)
            count += own[np.minimum(place, len(own) - 1)] == alive
            if k % 16 == 15:
                still = count + (aside - k - 1) >= need
                alive, count = alive[still], count[still]
        return alive[100 * count >= percent * (len(query) + self.sizes[alive] - count)]


def portions(most: int) -> Column:
    """Into how many indexes or tiles the documents of a group go."""
    return F.ceil(F.greatest(F.count(F.lit(1)) / most, F.sum("n") / MOST_SHINGLES)).cast("int")


def starred(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b of linked documents among pairs (g, v; n: shingles of v): g is searched for among its v, INDEX of them at a time."""
    parts = pairs.groupBy("g").agg(portions(INDEX).alias("parts"))
    held = pairs.join(parts, "g").select("g", F.pmod(F.xxhash64("v"), "parts").cast("int").alias("part"), "v", F.lit(False).alias("asks"))
    asked = parts.select("g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("g").alias("v"), F.lit(True).alias("asks"))
    rows = held.unionAll(asked).join(sets.select("v", "shingles"), "v")

    def search(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy(zero_copy_only=False)
        return links_of(group, np.flatnonzero(asks), np.flatnonzero(~asks), percent)

    return saved(rows.groupBy("g", "part").applyInArrow(search, "a long, b long"))


def tiled(families: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b of links that span what is connected in families (g, v, c; n: shingles of v), between different components c.

    A family is cut into tiles of TILE documents; each pair of tiles is a task, in which the documents
    of one are searched for in an index of the other's.
    """
    tiles = families.groupBy("g").agg(portions(TILE).alias("tiles"))
    own = families.join(tiles, "g").withColumn("own", F.pmod(F.xxhash64("v"), "tiles").cast("int")).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = own.select("g", F.least("own", "t").alias("i"), F.greatest("own", "t").alias("j"), "own", "v", "c").join(sets.select("v", "shingles"), "v")

    def search(group: pa.Table) -> pa.Table:
        tile, i, j = group.column("own").to_numpy(), group.column("i")[0].as_py(), group.column("j")[0].as_py()
        return links_of(group, np.flatnonzero(tile == i), np.flatnonzero(tile == j), percent)

    # so that pairs of tiles, whose sets are small for the time that they take, are not put together in few tasks
    return saved(rows.repartition(tasks(rows.sparkSession), "g", "i", "j").groupBy("g", "i", "j").applyInArrow(search, "a long, b long"))


def links_of(group: pa.Table, ask: np.ndarray, hold: np.ndarray, percent: int) -> pa.Table:
    """Each row of ask searched for in an index of the rows hold; a, b: links with the smallest id that they reach."""
    forget()
    v = group.column("v").to_numpy()
    own = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(ask) and len(hold):
        index = Index([own[i] for i in hold])
        for i in ask:
            hit = hold[index.search(own[i], percent)]
            a.append(np.full(len(hit), i))
            b.append(hit)
    order = np.argsort(v, kind="stable")
    back = np.argsort(order, kind="stable")
    to = v[order][spanned(len(v), back[np.concatenate(a)], back[np.concatenate(b)])][back]
    moved = np.flatnonzero(to != v)
    return pa.table({"a": pa.array(v[moved], pa.int64()), "b": pa.array(to[moved], pa.int64())})


def classes(docs: DataFrame, shingle: int, percent: int, by_id: bool) -> tuple[DataFrame, DataFrame]:
    """SETS and u, a number of each row; and s1, s2, doc_id and t for each set with an id: its class's document of smallest id, then t.

    by_id: the sets of one doc_id are one class as well.

    Equal sets are one.  Two sets that link share a shingle of their prefixes that one of them has indexed, so the inverted lists of
    prefix shingles hold every link.  First each list is searched for one of its documents: the one with most shingles that others
    have, which is close to all copies made from it, and once more for any other; this joins nearly all of
    a group of copies at a cost in proportion to it.  What is left are lists of several components in which some document is indexed;
    documents that such lists connect are a family, and each is searched for in all of its family, tile by tile.  Documents that share
    no more than a frame of common text are in no such list, as common shingles come late in the order and so are indexed by none.
    """
    scratch = Scratch(docs.sparkSession, "sifted")
    sets = stored(shingle_sets(docs, shingle, percent, scratch).withColumn("u", F.monotonically_increasing_id()), "shingles")
    scratch.drop()
    filled = sets.where("s1 is not null and doc_id is not null")
    names = saved(filled.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "t", "u")).alias("least")).select("s1", "s2", "least.doc_id", "least.t", F.col("least.u").alias("v")))
    own = filled.select(F.col("u").alias("v"), "n", "shingles", "prefix", "indexed").join(names.select("v"), "v", "left_semi")

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            if prefixes:
                sizes = [len(p) for p in prefixes]
                v, w, indexed, n = (np.repeat(x, sizes) for x in (batch.column(0).to_numpy(), sizes, batch.column(2).to_numpy(), batch.column(3).to_numpy()))
                place = np.concatenate([np.arange(x) for x in sizes])
                yield pa.record_batch([pa.array(np.concatenate(prefixes), pa.int64()), pa.array(v, pa.int64()), pa.array(w, pa.int32()), pa.array(place < indexed), pa.array(n, pa.int64())], names=["token", "v", "w", "indexed", "n"])

    postings = own.select("v", "prefix", "indexed", "n").mapInArrow(lists, "token long, v long, w int, indexed boolean, n long")
    common = postings.groupBy("token").agg(F.min("v").alias("a"), F.max("v").alias("z"), F.max("indexed").alias("i")).where("a <> z and i").select("token")
    postings = saved(postings.join(common, "token").select("token", "v", "w", "n"))
    rows = postings.count()
    links = parts = None
    if by_id:
        many = filled.join(names.select("s1", "s2", "v"), ["s1", "s2"]).groupBy("doc_id").agg(F.min("v").alias("a"), F.max("v").alias("z")).where("a < z").select("doc_id", "a")
        links = saved(filled.join(many, "doc_id").join(names.select("s1", "s2", "v"), ["s1", "s2"]).select("a", F.col("v").alias("b")).distinct())
    for turn in range(STARS + 1):
        known = postings
        if parts is None:
            known = known.withColumn("c", F.col("v"))
        else:
            known = known.join(parts, known["v"] == parts["id"], "left").select("token", "v", "w", "n", F.coalesce("component", "v").alias("c"))
        known = saved(few(known, rows))
        weight = F.struct(F.col("w") if turn == 0 else F.lit(0), F.xxhash64("v", F.lit(turn)), "v", "c")
        mixed = known.groupBy("token").agg(F.min("c").alias("a"), F.max("c").alias("z"), F.max(weight).alias("star")).where("a <> z")
        met = known.join(mixed.select("token", F.col("star.v").alias("g"), F.col("star.c").alias("gc")), "token")
        if turn < STARS:
            found = starred(saved(few(few(met, rows).where("c <> gc").select("g", "v", "n").distinct(), rows)), own, percent)
        else:
            met = saved(few(few(met, rows).select("g", "v", "c", "n").distinct(), rows))
            family = components(met, "g", "v").withColumnRenamed("component", "g")
            members = saved(few(few(met.select("v", "c", "n").distinct(), rows).join(family, F.col("v") == F.col("id")).select("g", "v", "c", "n"), rows))
            found = tiled(members, own, percent)
        links = found if links is None else links.unionAll(found)
        parts = components(links)
    joined = names.join(parts, names["v"] == parts["id"], "left").select("s1", "s2", "doc_id", "t", F.coalesce("component", "v").alias("class"))
    least = saved(joined.groupBy("class").agg(F.min(F.struct("doc_id", "t")).alias("least")))  # so that a hot class can be split in the join
    return sets, saved(joined.select("s1", "s2", "class").join(least, "class").select("s1", "s2", "least.doc_id", "least.t"))


def similar_documents(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id, one row per row of docs.

    docs: doc_id long, text string; other columns are ignored.  A document's set: its distinct runs of shingle words,
    A-Z lower-cased; with fewer words, the whole sequence as one.  Two documents link when
    100 * intersection >= percent * union; component_id is the smallest doc_id that links reach.
    A null, empty or blank text has an empty set and links with nothing.  Rows of one doc_id are one document with
    each of their sets; a null doc_id links with nothing and has a null component.  Texts of any length count whole; one task holds
    one whole set.  An empty table gives an empty result.  How links are found: see classes().
    """
    sets, named = classes(docs, shingle, percent, by_id=True)
    # rows without a set to join, most of all, would meet in one task
    alone = sets.where("s1 is null or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component"))
    out = sets.where("s1 is not null and doc_id is not null").select("doc_id", "n", "s1", "s2").join(named.select("s1", "s2", F.col("doc_id").alias("component")), ["s1", "s2"]).select("doc_id", "n", "component")
    # a document without a set to join may have another row with one
    if not alone.where("doc_id is not null").join(out.where("doc_id <> component").select("doc_id"), "doc_id", "left_semi").isEmpty():
        least = out.groupBy("doc_id").agg(F.min("component").alias("least"))
        alone = alone.join(least, "doc_id", "left").select("doc_id", "n", F.coalesce("least", "component").alias("component"))
    return out.unionAll(alone).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def without_copies(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each group of similar texts: that of smallest doc_id, and of those of one id the one whose text's hash is least.

    Texts are similar as in similar_documents(), and group by what links reach, each row by its own text whatever other rows its
    doc_id has; so a text goes only if the row that stays reaches it.  Of equal ids with equal texts one row stays, any of them.
    Rows without an id or a word stay, as they link with nothing; all columns stay as they are, whatever their names.
    """
    sets, named = classes(docs, shingle, percent, by_id=False)
    rows = sets.where("s1 is not null and doc_id is not null")
    stay = named.select("s1", "s2", F.col("doc_id").alias("d"), F.col("t").alias("h"))
    gone = rows.join(stay, ["s1", "s2"]).where("doc_id <> d or t <> h").select("doc_id", "t").distinct().withColumn("gone", F.lit(True))
    again = rows.groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "t").join(gone, ["doc_id", "t"], "left_anti").withColumn("gone", F.lit(False))
    d, t, verdict = free(["d", "t", "gone"], docs.columns)
    marks = saved(gone.unionAll(again)).toDF(d, t, verdict)
    keyed = docs.withColumns({d: F.col("doc_id").cast("long"), t: F.xxhash64(F.coalesce("text", F.lit("")))})
    met, others = sieved(keyed, marks, [d, t])  # so that texts which stay are not dealt out
    marked = met.join(marks, [d, t], "left")
    once = marked.where(F.col(verdict).isNull()).select(*quoted(docs.columns)).unionAll(others.select(*quoted(docs.columns)))
    if marks.where(~F.col(verdict)).isEmpty():
        return once
    return once.unionByName(marked.where(~F.col(verdict)).dropDuplicates([d, t]).select(*quoted(docs.columns)))


JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))) END AS x FROM w
), t AS (
  SELECT doc_id, len(x) AS n, unnest(x) AS g FROM s
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS an, b.n AS bn, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
), links AS (
  SELECT a, b FROM pairs WHERE 100 * c >= 90 * (an + bn - c)
), reach AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (
  SELECT a, min(b) AS c FROM reach GROUP BY a
)
SELECT doc_id, CAST(len(x) AS BIGINT) AS n_shingles, coalesce(least(c, doc_id), doc_id) AS component_id FROM s LEFT JOIN least ON least.a = doc_id
"""
