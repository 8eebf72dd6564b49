"""Secret scans: fixed patterns, and strings that pass a battery of randomness tests. DataFrame functions only."""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.shared import free, quoted, saved, stored

#: The base patterns, in the order in which kinds are listed; group 2 of an assignment is its value.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
VALUE_BEFORE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")

#: A candidate for the tests: a whole run of what encodings use with its final padding, of this length at least; other = part runs.
LEAST_RUN = 24
RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_=-]{%d})[A-Za-z0-9+/_-]++(?:=++(?![A-Za-z0-9+/_-]))?+" % LEAST_RUN
#: A run that mixes both of these fits no encoding; it is cut at the ones and, apart from that, at the others.  Each is sought once, so a long run costs its length.
MIXED = (r"[+/]", r"[_-]")
PARTS = (r"[A-Za-z0-9+/]+=*", r"[A-Za-z0-9_-]+=*")
#: Encodings from the narrowest: name, what every character must match, alphabet, and of ordinary text in it the share of letters that are spread as in English, or None for numbers.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("decimal", "[0-9]", DIGITS, None),
    ("hex", "[0-9a-f]", DIGITS + "abcdef", None),
    ("HEX", "[0-9A-F]", DIGITS + "ABCDEF", None),
    ("base32", "[A-Z2-7]", UPPER + "234567", 1.0),
    ("lower", "[a-z0-9]", LOWER + DIGITS, 1.0),
    ("base62", "[A-Za-z0-9]", UPPER + LOWER + DIGITS, 0.95),
    ("base64", "[A-Za-z0-9+/]", UPPER + LOWER + DIGITS + "+/", 0.95),
    ("base64url", "[A-Za-z0-9_-]", UPPER + LOWER + DIGITS + "-_", 0.95),
)
#: How often each letter of a to z occurs in English, in ten thousands of all letters; and, as a model of numbers in text, each digit from 0 to 9 in hundreds.
ENGLISH = (817, 149, 278, 425, 1270, 223, 202, 609, 697, 15, 77, 403, 241, 675, 751, 193, 10, 599, 633, 906, 276, 98, 236, 15, 197, 7)
NUMBERS = (22, 18, 12, 8, 7, 7, 7, 7, 6, 6)
#: A string counts as random if no test of the battery rejects it at LEVEL (Bonferroni), and as no ordinary text at false-discovery rate RATE.
LEVEL, RATE = 0.001, 0.01
#: P-values are counted in bins of a quarter of a power of ten, up to this many.
BINS = 48
#: The chances of ordinary text are exact for strings of so many characters at most; and the fewest that a string has without its padding.
EXACT, LEAST_BODY = 96, 16


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


#: Entries of an array that grows entry by entry, each time as a copy; and code points of text that are cut at places.
BLOCK, CHUNK = 256, 1024


def running(values: Column, join) -> Column:
    """What join (a sum, a maximum) makes of 0 and all int values before each; by blocks, so that the cost goes with their number."""
    none = F.expr("cast(array() as array<int>)")

    def grown(xs: Column) -> Column:
        zero = F.struct(F.lit(0).alias("t"), none.alias("out"))
        return F.aggregate(xs, zero, lambda a, x: F.struct(join(a["t"], x).alias("t"), F.concat(a["out"], F.array(a["t"])).alias("out")), lambda a: a["out"])

    def of_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), join))
        return let(grown(totals), lambda before: F.flatten(F.transform(blocks, lambda b, k: F.transform(grown(b), lambda x: join(x, before[k])))))

    def of_values(v: Column) -> Column:
        last = F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / BLOCK).cast("int")
        return let(F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(v, k * BLOCK + 1, F.lit(BLOCK))), of_blocks)

    return let(values, of_values)


def how_many(ascending: Column, fits) -> Column:
    """How many of the first entries fit, where none fits after one that does not: by halving."""
    steps = F.lit([1 << k for k in reversed(range(31))])
    return F.aggregate(steps, F.lit(0), lambda at, by: F.when(F.coalesce(fits(F.get(ascending, at + by - 1)), F.lit(False)), at + by).otherwise(at))


def found(text: Column, pattern: str) -> Column:
    """start, end (code points) and text of all leftmost non-overlapping matches; none is empty."""
    both = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("size"), hit.alias("hit")))

    def placed(x: Column) -> Column:
        before = running(F.transform(x, lambda h: h["gap"] + F.coalesce(h["size"], F.lit(0))), lambda a, b: a + b)
        hits = F.zip_with(x, before, lambda h, at: F.struct((at + h["gap"]).alias("start"), (at + h["gap"] + h["size"]).alias("end"), h["hit"].alias("hit")))
        return F.filter(hits, lambda h: h["hit"].isNotNull())

    none = F.expr("cast(array() as array<struct<start:int,end:int,hit:string>>)")
    return F.when(text.rlike(pattern), let(both, placed)).otherwise(none)


def spans(hits: Column, kind: str) -> Column:
    return F.transform(hits, lambda h: F.struct(h["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), h["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """By start and kind: array<struct<start, kind, end>>."""
    assign = F.filter(found(text, ASSIGN), lambda h: F.length(F.regexp_replace(h["hit"], VALUE_BEFORE, "")) >= LEAST_VALUE)
    # the longest runs are the matches, so that a least length in the pattern drops just the failing ones
    access = found(text, r"AKIA[A-Z0-9]{%d,}" % (LEAST_ACCESS - 4))
    lower_hex = found(text, r"[0-9a-f]{%d,}" % LEAST_HEX)
    return F.array_sort(F.concat(spans(assign, "assign"), spans(access, "access"), spans(lower_hex, "hex")))


#: The terms of erfc's rational Chebyshev fit (relative error 1.2e-7 everywhere), from the constant on.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def chance_below(z: Column) -> Column:
    """The normal distribution function, right to six digits in the far tail below as well."""

    def of(v: Column) -> Column:
        def tail(t: Column) -> Column:
            terms = F.lit(ERFC[-1])
            for c in reversed(ERFC[:-1]):
                terms = F.lit(c) + t * terms
            return t * F.exp(terms - v * v / 2) / 2

        return let(let(1 / (1 + F.abs(v) / F.lit(8.0**0.5)), tail), lambda p: F.when(v < 0, p).otherwise(1 - p))

    return let(z, of)


def text_chances(share: float | None, size: int) -> list[float]:
    """The letters' chances in ordinary text: share as in English, the rest even over the alphabet; None: digits of numbers."""
    given, share = (NUMBERS, 1.0) if share is None else (ENGLISH, share)
    rest = size - len(given) if share < 1 else 0
    return [share * x / sum(given) for x in given] + [(1 - share) / max(rest, 1)] * rest


def power_sums(share: float | None, size: int) -> tuple[float, float, float]:
    """Sums of the second, third and fourth powers of the chances."""
    return tuple(sum(x**j for x in text_chances(share, size)) for j in (2, 3, 4))


def exact_bins(chances: list[float]) -> list[int]:
    """For each length from 0 to EXACT and each bin from 1 to BINS, one after another: the most pairs of equal letters that strings of
    letters with these chances have with probability 10**(-bin / 4) at most, or less; -1 if none are that rare.

    Letter by letter: ways[m, c] sums, over all counts of the letters so far with m in all and c pairs, the products of chance**count / count!.
    """
    most = int(EXACT * (EXACT - 1) / 2 * sum(x * x for x in chances)) + 1  # from the mean on nothing is rare
    ways = np.zeros((EXACT + 1, most + 1))
    ways[0, 0] = 1
    for x in chances:
        more, factor = np.zeros_like(ways), 1.0
        for k in range(EXACT + 1):
            own = k * (k - 1) // 2
            if own > most:
                break
            more[k:, own:] += ways[: EXACT + 1 - k, : most + 1 - own] * factor
            factor *= x / (k + 1)
        ways = more
    below = np.cumsum(ways * np.cumprod([1.0, *range(1, EXACT + 1)])[:, None], axis=1)
    return [int(np.searchsorted(row, 10.0 ** (-b / 4), "right")) - 1 for row in below for b in range(1, BINS + 1)]


@cache
def rare_pairs() -> tuple[list[int], list[int]]:
    """The tables of exact_bins() of all kinds of text, one after another, and each encoding's place there."""
    kinds: dict[tuple, int] = {}
    table: list[int] = []
    for e in ENCODINGS:
        kind = (e[3], None if e[3] in (None, 1.0) else len(e[2]))
        if kind not in kinds:
            kinds[kind] = len(table)
            table += exact_bins(text_chances(e[3], len(e[2])))
    return table, [kinds[e[3], None if e[3] in (None, 1.0) else len(e[2])] for e in ENCODINGS]


def deviation(pairs: Column, n: Column, s2: Column, s3: Column, s4: Column) -> Column:
    """How many standard deviations the number of pairs of equal letters lies above its mean, as a normal variable.

    s2, s3, s4: sums of powers of the letters' chances, which give the number's first three moments for any length; the
    third enters as in a gamma distribution (Wilson and Hilferty), so that the tail above is right for short strings, too.
    """

    def moments(x: Column) -> Column:
        n, s2, s3, s4 = (x[c] for c in ("n", "s2", "s3", "s4"))
        two, s22 = n * (n - 1) / 2, s2 * s2
        three, four = n * (n - 1) * (n - 2), n * (n - 1) * (n - 2) * (n - 3)
        variance = two * (s2 - s22) + three * (s3 - s22)
        third = (
            two * (s2 - 3 * s22 + 2 * s2 * s22)
            + three * (3 * (1 - 2 * s2) * (s3 - s22) + s3 - 3 * s2 * s3 + 2 * s2 * s22)
            + four * (4 * s4 - 9 * s2 * s3 + 5 * s2 * s22)
        )
        return let(F.struct(((x["pairs"] - two * s2) / F.sqrt(variance)).alias("z"), (third / F.pow(variance, F.lit(1.5))).alias("skew")), corrected)

    def corrected(y: Column) -> Column:
        return 6 / y["skew"] * (F.cbrt(F.greatest(1 + y["skew"] * y["z"] / 2, F.lit(1e-9))) - 1) + y["skew"] / 6

    return let(F.struct(pairs.alias("pairs"), n.alias("n"), s2.alias("s2"), s3.alias("s3"), s4.alias("s4")), moments)


def candidates(text: Column) -> Column:
    """What found gives for runs of LEAST_RUN characters at least; of a mixed run the parts of this length, which may overlap."""

    def parts(h: Column) -> Column:
        shifted = [F.transform(found(h["hit"], p), lambda x: F.struct((h["start"] + x["start"]).alias("start"), (h["start"] + x["end"]).alias("end"), x["hit"].alias("hit"))) for p in PARTS]
        return F.when(h["hit"].rlike(MIXED[0]) & h["hit"].rlike(MIXED[1]), F.concat(*shifted)).otherwise(F.array(h))

    return F.filter(F.flatten(F.transform(found(text, RUN), parts)), lambda h: F.length(h["hit"]) >= LEAST_RUN)


def tested(hit: Column) -> Column:
    """struct<encoding, n, p_random, bin> of a candidate, null if no encoding has all its characters or it is hardly more than padding.

    p_random: the least p-value of chi-squared uniformity, runs about the middle and serial correlation,
    times three; bin: of the chance that ordinary text of this length has so few pairs of equal letters, on which chi-squared depends
    linearly.  It is exact up to EXACT characters; beyond, it is the normal distribution's, which is larger than the exact one there.
    """
    body = F.rtrim(hit, F.lit("="))
    code = F.lit(None).cast("int")
    table, places = rare_pairs()
    rare = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")  # folded to one literal
    for i in reversed(range(len(ENCODINGS))):
        code = F.when(body.rlike(f"^{ENCODINGS[i][1]}+$"), F.lit(i)).otherwise(code)
    zero = F.lit(0.0)
    plus = lambda a, y: a + y

    def with_code(c: Column) -> Column:
        letters = F.element_at(F.lit([e[2] for e in ENCODINGS]), c + 1)
        halves = F.element_at(F.lit(["0" * (len(e[2]) // 2) + "1" * (len(e[2]) // 2) for e in ENCODINGS]), c + 1)
        sums = [F.element_at(F.lit([power_sums(e[3], len(e[2]))[j] for e in ENCODINGS]), c + 1) for j in range(2)]
        counts = F.transform(F.split(letters, ""), lambda ch: (F.length(body) - F.length(F.replace(body, ch, F.lit("")))).cast("double"))
        return let(
            F.struct(letters.alias("a"), F.length(letters).cast("double").alias("k"), F.length(body).cast("double").alias("n"), c.alias("c"), counts.alias("counts"), F.call_function("translate", body, letters, halves).alias("high"), *(s.alias(f"s{j + 2}") for j, s in enumerate(sums))),
            measured,
        )

    def measured(x: Column) -> Column:
        n, middle = x["n"], (x["k"] - 1) / 2
        pairs = F.aggregate(F.transform(x["counts"], lambda y: y * (y - 1) / 2), zero, plus)
        high = F.length(F.replace(x["high"], F.lit("0"), F.lit(""))).cast("double")
        changes = [(n - F.length(F.replace(x["high"], F.lit(two), F.lit("")))) / 2 for two in ("01", "10")]
        # serial products piece by piece, each with the first letter of the next, so that a long string is never an array of letters
        value = lambda ch: F.instr(x["a"], ch) - 1 - middle
        neighbours = lambda v: F.aggregate(F.zip_with(v, F.slice(v, 2, CHUNK + 1), lambda a, b: F.coalesce(a * b, zero)), zero, plus)
        pieces = lambda ps: F.aggregate(F.transform(ps, lambda p, j: let(F.transform(F.split(F.concat(p, F.coalesce(F.substring(F.get(ps, j + 1), 1, 1), F.lit(""))), ""), value), neighbours)), zero, plus)
        product = let(F.regexp_extract_all(body, F.lit(".{1,%d}" % CHUNK), F.lit(0)), pieces)
        own = F.aggregate(F.transform(x["counts"], lambda y, i: y * (i - middle) * (i - middle)), zero, plus)
        own_bins = F.slice(rare, F.element_at(F.lit(places), x["c"] + 1) + F.least(n, F.lit(float(EXACT))).cast("int") * BINS + 1, F.lit(BINS))
        return let(F.struct(x["c"].alias("c"), n.alias("n"), x["k"].alias("k"), x["s2"].alias("s2"), x["s3"].alias("s3"), pairs.alias("pairs"), (2 * high * (n - high) / n).alias("even"), (changes[0] + changes[1]).alias("changes"), product.alias("product"), own.alias("own"), own_bins.alias("bins")), judged)

    def judged(x: Column) -> Column:
        n, k, even = x["n"], x["k"], x["even"]
        spread = even * (even - 1) / F.greatest(n - 1, F.lit(1.0))
        z_runs = F.when(spread > 0, F.abs(x["changes"] - even) / F.sqrt(spread)).otherwise(9.0)
        z_serial = F.when(x["own"] > 0, F.abs(x["product"] / x["own"]) * F.sqrt(n)).otherwise(9.0)
        z_even = deviation(x["pairs"] - 0.5, n, 1 / k, 1 / (k * k), 1 / (k * k * k))
        two, s22 = n * (n - 1) / 2, x["s2"] * x["s2"]
        z_text = (x["pairs"] + 0.5 - two * x["s2"]) / F.sqrt(two * (x["s2"] - s22) + 2 * two * (n - 2) * (x["s3"] - s22))
        usual = F.least(F.lit(BINS), F.floor(-4 * F.log10(F.greatest(chance_below(z_text), F.lit(1e-300)))).cast("int"))
        text_bin = F.when(n <= EXACT, how_many(x["bins"], lambda most: most >= x["pairs"])).otherwise(usual)
        p_random = 3 * F.least(chance_below(-z_even), 2 * chance_below(-z_runs), 2 * chance_below(-z_serial))
        return F.struct(x["c"].alias("encoding"), n.cast("int").alias("n"), F.least(F.lit(1.0), p_random).alias("p_random"), text_bin.alias("bin"))

    return let(code, lambda c: F.when(c.isNotNull() & (F.length(body) >= LEAST_BODY), with_code(c)))


def mask_secrets(docs: DataFrame) -> DataFrame:
    """docs with each secret in text masked, spans as scan() gives them; all rows and columns stay.

    The spans go with the rows through one pass, so no join is needed.  A null text stays null, an empty one empty; a text of any
    length is masked in chunks, at a cost in proportion to it; other columns may have any names.  Repeated rows fare alike; an empty
    table gives an empty result.
    """
    rows, _, spans_ = scanned(docs, wide=True)
    return rows.withColumn("text", masked(F.col("text"), F.col(spans_))).select(*quoted(docs.columns))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans of each whole text; both array<struct<start, kind, end>> by start and kind.

    docs: doc_id, text; other columns are ignored.  base: matches of the fixed patterns, kind an index of
    KINDS, start and end in code points, end exclusive.  spans: those, and as kind random each run of encoding characters,
    outside base spans, that no test of the battery rejects and that a false-discovery control over the table
    accepts as no ordinary text.  A run has LEAST_RUN characters at least, shorter ones are not tested; = ends it
    but for padding, and one that mixes - or _ with + or / is tested in parts, cut at either.  The control is length-aware: candidates compete only with those of their
    encoding and power of two of length, by Benjamini and Hochberg's rule over bins of p-values, so that
    what is gathered is a count per stratum and bin.

    A null or empty text has no spans; rows stay one for one, repeated ones and those without an id too, though each counts in the
    control.  A text of any length is read whole, at a cost in proportion to it.  An empty table gives an empty result.
    """
    rows, base, spans_ = scanned(docs.select("doc_id", "text"), wide=False)
    return rows.select("doc_id", F.col(base).alias("base"), F.col(spans_).alias("spans"))


def meets(r: Column, kind: Column) -> Column:
    """Whether r overlaps any of one kind's spans, which are ascending and apart: if so, then the last that begins before r's end."""
    return F.when(F.size(kind) > 0, let(how_many(kind, lambda s: s["start"] < r["end"]), lambda at: F.coalesce(F.get(kind, at - 1)["end"] > r["start"], F.lit(False)))).otherwise(False)


def scanned(docs: DataFrame, wide: bool) -> tuple[DataFrame, str, str]:
    """docs with two more columns, and their names: base and spans; not wide: without text."""
    base, runs, spans_ = free(["base", "runs", "spans"], docs.columns)
    text = F.coalesce("text", F.lit(""))
    tests = F.transform(candidates(text), lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), tested(h["hit"]).alias("t")))
    rows = docs.select("*", base_spans(text).alias(base), tests.alias(runs))
    rows = stored(rows, "spans") if wide else saved(rows.drop("text"))

    def of_kind(k: int) -> Column:
        return F.filter(base, lambda b: b["kind"] == k)

    kinds = F.array(*map(of_kind, range(3)))
    apart = let(kinds, lambda ks: F.filter(runs, lambda r: r["t"].isNotNull() & ~(meets(r, ks[0]) | meets(r, ks[1]) | meets(r, ks[2]))))
    outside = F.when(F.size(runs) > 0, apart).otherwise(F.col(runs))
    open_rows = rows.where(F.size(runs) > 0).select(F.explode(outside).alias("r"))

    def stratum(r: Column) -> Column:
        return r["t"]["encoding"] * 64 + F.floor(F.log2(r["t"]["n"])).cast("int")

    counts = open_rows.groupBy(stratum(F.col("r")).alias("stratum"), F.col("r.t.bin").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = counts.groupBy("stratum").agg(F.sum("n").alias("m"), F.collect_list(F.struct("bin", "n")).alias("bins"))  # BINS + 1 entries at most
    share = lambda b: F.aggregate(F.filter("bins", lambda y: y["bin"] >= b), F.lit(0).cast("long"), lambda a, y: a + y["n"])
    fits = F.filter(F.transform("bins", lambda b: b["bin"]), lambda b: F.col("m") * F.pow(F.lit(10.0), -b / 4.0) <= RATE * share(b))
    least = bins.select("stratum", F.array_min(fits).alias("least")).where("least is not null")
    # one row for each encoding and power of two of length, 64 * len(ENCODINGS) at most: a literal of the last plan
    limits = [F.struct(F.lit(r["stratum"]), F.lit(r["least"])) for r in least.collect()]
    table = F.map_from_entries(F.array(*limits)) if limits else F.expr("cast(map() as map<int,int>)")
    passed = lambda r: (r["t"]["p_random"] >= LEVEL) & (r["t"]["bin"] >= F.try_element_at(table, stratum(r)))
    random = F.transform(F.filter(outside, lambda r: F.coalesce(passed(r), F.lit(False))), lambda r: F.struct(r["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), r["end"].alias("end")))
    return rows.withColumn(spans_, F.array_sort(F.concat(base, random))), base, spans_


def listed(spans_: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.lit(list(KINDS))
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans_: Column, mask: str = "[secret]") -> Column:
    """text with each span, or run of overlapping spans, replaced by mask; in chunks, so that no place is sought from the text's start."""

    def merged(xs: Column) -> Column:
        """start and end of each run: one begins where a span begins at or behind all ends before it."""
        ends = F.transform(xs, lambda s: s["end"])
        with_reach = F.zip_with(xs, running(ends, lambda a, b: F.greatest(a, b)), lambda s, at: F.struct(s["start"].alias("start"), at.alias("reach")))
        first = F.filter(with_reach, lambda s: s["start"] >= s["reach"])
        return let(first, lambda f: F.zip_with(f, F.slice(f, 2, 1 << 30), lambda a, b: F.struct(a["start"].alias("start"), F.coalesce(b["reach"], F.array_max(ends)).alias("end"))))

    def cut(runs: Column) -> Column:
        def one(chunk: Column, k: Column) -> Column:
            begin = k * CHUNK
            before = how_many(runs, lambda r: r["end"] <= begin)
            own = let(before, lambda at: F.slice(runs, at + 1, how_many(runs, lambda r: r["start"] < begin + CHUNK) - at))

            def step(a: Column, r: Column) -> Column:
                lead = F.concat(F.substring(chunk, a["at"] - begin + 1, F.greatest(r["start"] - a["at"], F.lit(0))), F.when(r["start"] >= begin, F.lit(mask)).otherwise(""))
                return F.struct(r["end"].alias("at"), F.concat(a["out"], lead).alias("out"))

            return F.aggregate(own, F.struct(begin.alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(chunk, a["at"] - begin + 1, F.lit(CHUNK))))

        return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % CHUNK), F.lit(0)), one), "")

    return F.when(F.size(spans_) > 0, let(spans_, lambda xs: let(merged(xs), cut))).otherwise(text)


def scan_sql() -> str:
    """DuckDB SQL for base spans and spans of documents, from the same fixed values; the normal distribution by series and continued fraction."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    kinds = [(0, ASSIGN, f"length(regexp_replace(hit, {quoted(VALUE_BEFORE)}, '')) >= {LEAST_VALUE}"), (1, ACCESS, f"length(hit) >= {LEAST_ACCESS}"), (2, HEX, f"length(hit) >= {LEAST_HEX}")]

    def hits(source: str, pattern: str, kind: int) -> str:
        """Matches of a pattern in t of the source's rows (doc_id, t, s: where t stands); next: whether another match follows at once."""
        return f"""SELECT doc_id, {kind} AS kind, hits[i] AS hit, CAST(s + list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS BIGINT) AS s, i < len(hits) AND gaps[i + 1] = '' AS next
        FROM (SELECT doc_id, s, gaps, hits, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, s, string_split_regex(t, {quoted(pattern)}) AS gaps, regexp_extract_all(t, {quoted(pattern)}) AS hits FROM {source}))"""

    rare, places = rare_pairs()
    keep = " OR ".join(f"(kind = {k} AND {ok})" for k, _, ok in kinds)
    code = "CASE " + " ".join(f"WHEN regexp_full_match(body, {quoted(e[1] + '+')}) THEN {i}" for i, e in enumerate(ENCODINGS)) + " END"
    table = ", ".join(f"({i}, {quoted(e[2])}, CAST({len(e[2])} AS DOUBLE), {', '.join(f'CAST({x!r} AS DOUBLE)' for x in power_sums(e[3], len(e[2])))}, {places[i]})" for i, e in enumerate(ENCODINGS))
    down = lambda n: f"list_transform(range(0, {n}), lambda i: CAST({n} - i AS DOUBLE))"

    def below(z: str) -> str:
        series = f"0.5 + exp(-{z} * {z} / 2) / sqrt(2 * pi()) * {z} * list_reduce(list_prepend(CAST(1 AS DOUBLE), {down(60)}), lambda acc, j: 1 + {z} * {z} / (2 * j + 1) * acc)"
        fraction = f"exp(-{z} * {z} / 2) / sqrt(2 * pi()) / list_reduce(list_prepend(abs({z}), {down(400)}), lambda acc, j: abs({z}) + j / acc)"
        return f"(CASE WHEN abs({z}) < 2 THEN {series} WHEN {z} < 0 THEN {fraction} ELSE 1 - {fraction} END)"

    def moments(s2: str, s3: str, s4: str) -> str:
        """struct of the mean, the standard deviation and the skewness of the number of pairs."""
        three, four = "(n * (n - 1) * (n - 2))", "(n * (n - 1) * (n - 2) * (n - 3))"
        variance = f"(n * (n - 1) / 2 * ({s2} - {s2} ** 2) + {three} * ({s3} - {s2} ** 2))"
        third = f"(n * (n - 1) / 2 * ({s2} - 3 * {s2} ** 2 + 2 * {s2} ** 3) + 3 * {three} * (1 - 2 * {s2}) * ({s3} - {s2} ** 2) + {three} * ({s3} - 3 * {s2} * {s3} + 2 * {s2} ** 3) + {four} * ({s4} - 3 * {s2} * {s3} + 2 * {s2} ** 3) + 3 * {four} * ({s4} - 2 * {s2} * {s3} + {s2} ** 3))"
        return f"{{'mean': n * (n - 1) / 2 * {s2}, 'sd': sqrt({variance}), 'skew': {third} / {variance} ** 1.5}}"

    gamma = lambda m: f"6 / {m}.skew * (cbrt(greatest(1 + {m}.skew * (pairs - 0.5 - {m}.mean) / {m}.sd / 2, 1e-9)) - 1) + {m}.skew / 6"
    names = ", ".join(quoted(k) for k in KINDS)
    return f"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(0 AS BIGINT) AS s FROM documents
), hits AS (
  {" UNION ALL ".join(hits("docs", p, k) for k, p, _ in kinds)}
), base AS (
  SELECT doc_id, kind, hit, s, s + length(hit) AS e FROM hits WHERE {keep}
), runs AS (
  SELECT doc_id, s, CASE WHEN next THEN rtrim(hit, '=') ELSE hit END AS t FROM ({hits("docs", "[A-Za-z0-9+/_-]+=*", 3)})
), mixed AS (
  SELECT * FROM runs WHERE length(t) >= {LEAST_RUN} AND regexp_matches(t, {quoted(MIXED[0])}) AND regexp_matches(t, {quoted(MIXED[1])})
), parts AS (
  SELECT doc_id, s, t AS hit FROM runs WHERE NOT (regexp_matches(t, {quoted(MIXED[0])}) AND regexp_matches(t, {quoted(MIXED[1])}))
  UNION ALL {" UNION ALL ".join(f"SELECT doc_id, s, hit FROM ({hits('mixed', p, 3)})" for p in PARTS)}
), found AS (
  SELECT doc_id, hit, s, s + length(hit) AS e FROM parts WHERE length(hit) >= {LEAST_RUN}
), candidates AS (
  SELECT *, rtrim(hit, '=') AS body FROM found f WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = f.doc_id AND b.s < f.e AND f.s < b.e)
), coded AS (
  SELECT *, {code} AS c FROM candidates
), valued AS (
  SELECT doc_id, s, e, body, c, a, s2, s3, s4, place, k, CAST(length(body) AS DOUBLE) AS n, list_transform(string_split(body, ''), lambda ch: CAST(strpos(a, ch) - 1 AS DOUBLE)) AS v
  FROM coded JOIN (VALUES {table}) AS enc(code, a, k, s2, s3, s4, place) ON c = code WHERE length(body) >= {LEAST_BODY}
), rare AS (
  SELECT CAST(string_split('{",".join(map(str, rare))}', ',') AS INT[]) AS most
), measured AS (
  SELECT *, list_sum(list_transform(string_split(a, ''), lambda ch: pow(length(body) - length(replace(body, ch, '')), 2) - (length(body) - length(replace(body, ch, ''))))) / 2 AS pairs,
    CAST(len(list_filter(v, lambda y: y > (k - 1) / 2)) AS DOUBLE) AS high,
    1 + len(list_filter(range(1, len(v)), lambda i: (v[i] > (k - 1) / 2) <> (v[i + 1] > (k - 1) / 2))) AS runs,
    list_sum(list_transform(range(1, len(v)), lambda i: (v[i] - (k - 1) / 2) * (v[i + 1] - (k - 1) / 2))) AS product,
    list_sum(list_transform(v, lambda y: (y - (k - 1) / 2) * (y - (k - 1) / 2))) AS own
  FROM valued
), scored AS (
  SELECT *, 2 * high * (n - high) / n AS even, {moments("(1 / k)", "(1 / k ** 2)", "(1 / k ** 3)")} AS evenly, {moments("s2", "s3", "s4")} AS usual FROM measured
), deviating AS (
  SELECT doc_id, s, e, c * 64 + CAST(floor(log2(n)) AS INT) AS stratum, -({gamma("evenly")}) AS z1,
    -CASE WHEN even * (even - 1) > 0 THEN abs(runs - even - 1) / sqrt(even * (even - 1) / greatest(n - 1, 1.0)) ELSE 9.0 END AS z2,
    -CASE WHEN own > 0 THEN abs(product / own) * sqrt(n) ELSE 9.0 END AS z3, (pairs + 0.5 - usual.mean) / usual.sd AS z4,
    CASE WHEN n <= {EXACT} THEN len(list_filter(most[place + CAST(n AS INT) * {BINS} + 1:place + CAST(n AS INT) * {BINS} + {BINS}], lambda x: x >= pairs)) END AS exact
  FROM scored, rare
), binned AS (
  SELECT *, least(1.0, 3 * least({below("z1")}, 2 * {below("z2")}, 2 * {below("z3")})) AS p_random,
    coalesce(exact, CAST(least({BINS}, floor(-4 * log10(greatest({below("z4")}, 1e-300)))) AS INT)) AS bin
  FROM deviating
), counts AS (
  SELECT stratum, bin, count(*) AS n FROM binned GROUP BY stratum, bin
), shares AS (
  SELECT stratum, bin, sum(n) OVER (PARTITION BY stratum) AS m, sum(n) OVER (PARTITION BY stratum ORDER BY bin DESC) AS share FROM counts
), limits AS (
  SELECT stratum, min(bin) AS least_bin FROM shares WHERE m * pow(10.0, -bin / 4.0) <= {RATE} * share GROUP BY stratum
), spans AS (
  SELECT doc_id, kind, s, e FROM base
  UNION ALL SELECT doc_id, 3, s, e FROM binned JOIN limits USING (stratum) WHERE p_random >= {LEVEL} AND bin >= least_bin
), listed AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
    string_agg([{names}][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind, e) FILTER (kind < 3) AS b,
    string_agg([{names}][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind, e) AS w
  FROM spans GROUP BY doc_id
)
SELECT docs.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(w, '') AS spans
FROM docs LEFT JOIN listed USING (doc_id)
"""
