"""Quality rules: counts for each text, failure rates of hosts shrunk by a beta prior, verdicts for documents. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.secrets import let
from inkwell.llm.shared import saved

LEAST_WORDS = 50
#: A text fails if more than this share of its words, in hundredths, lies in windows of WINDOW words found twice or more.
MOST_REPEATED, WINDOW = 50, 3
#: A host is rejected if its shrunk failure rate is above this.
MOST_FAILURES = 0.5

BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of WINDOW words whose words occur twice or more in the text."""

    def of_hashes(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), of_sorted))

    def of_sorted(s: Column) -> Column:
        last = F.size(s) - 1
        twin = lambda x, i: ((i > 0) & (s[F.greatest(i - 1, F.lit(0))]["h"] == x["h"])) | ((i < last) & (s[F.least(i + 1, last)]["h"] == x["h"]))
        return let(F.array_sort(F.transform(F.filter(s, twin), lambda x: x["i"])), covered)

    def covered(starts: Column) -> Column:
        zero = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(starts, zero, lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(WINDOW), i - a["at"])).alias("n")), lambda a: a["n"])

    def of_words(w: Column) -> Column:
        hashes = F.zip_with(F.zip_with(w, F.slice(w, 2, 1 << 30), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.slice(w, 3, 1 << 30), lambda x, c: F.when(c.isNotNull(), F.xxhash64(x["a"], x["b"], c)))
        return F.when(F.size(w) < WINDOW, F.lit(0).cast("long")).otherwise(let(F.slice(hashes, F.lit(1), F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))), of_hashes))

    return let(words, of_words)


def document_counts(docs: DataFrame, host: str) -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of each whole text."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    read = docs.select("doc_id", F.col(host).alias("host"), text.alias("text"))
    words = F.filter(F.split("text", BLANK, -1), lambda x: x != "")
    rows = read.select(
        "doc_id",
        "host",
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"))).alias("w"),
        F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = rows.select("doc_id", "host", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("w.r").alias("n_repeat_words"))
    return rows.withColumn("base_failed", failed)


def host_rates(counted: DataFrame) -> DataFrame:
    """host, n, failed, rate (shrunk): one row per host that is not null.

    The beta prior is fitted by moments to the hosts' rates: with mean m of all documents and the
    variance v between hosts beyond what chance gives, its strength is m * (1 - m) / v - 1 (at least 1);
    where hosts differ no more than by chance, or there is one host alone, it is the number of documents, so that all take the mean.
    """
    hosts = counted.where("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    hosts = saved(hosts)
    row = hosts.agg(F.sum("n").alias("n"), F.sum("failed").alias("f"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("ff")).first()
    n, f, k = row["n"] or 0, row["f"] or 0, row["k"]
    mean = f / n if n else 0.0
    strength = float(max(n, 1))
    if k > 1 and 0 < mean < 1:
        within = n - row["nn"] / n
        between = (row["ff"] - n * mean * mean - (k - 1) * mean * (1 - mean)) / max(within - (k - 1), 1e-9)
        if between > 0:
            strength = max(mean * (1 - mean) / between - 1, 1.0)
    return hosts.withColumn("rate", (F.col("failed") + strength * mean) / (F.col("n") + strength))


def judge(docs: DataFrame, host: str = "source", most_failures: float = MOST_FAILURES) -> DataFrame:
    """The columns of document_counts(), then host_rate and kept (not base_failed, and the host not rejected).

    docs: doc_id, text and the host's column; other columns are ignored.  A null text is empty and fails; a null
    host has no rate and rejects nothing; rows stay one for one, repeated ones too, each counting for its host.  A rate equal to
    most_failures does not reject.  A text of any length counts whole; an empty table gives an empty result.  Rates are sums by host, taken before
    the shuffle; documents meet them in a join on the host, whose hot keys adaptive execution may split.
    """
    counted = saved(document_counts(docs, host))
    rates = host_rates(counted).select(F.col("host").alias("_host"), F.col("rate").alias("host_rate"))
    out = counted.join(rates, counted["host"] == F.col("_host"), "left").drop("_host")
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("host_rate", F.lit(0.0)) <= most_failures))


HOST_SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM w)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id
), counts AS (
  SELECT w.doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN repeats USING (doc_id)
), base AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
), hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM base WHERE source IS NOT NULL GROUP BY source
), total AS (
  SELECT CAST(sum(n) AS DOUBLE) AS n, sum(f) / CAST(sum(n) AS DOUBLE) AS m, count(*) AS k, sum(CAST(n AS DOUBLE) * n) AS nn, sum(f * f / CAST(n AS DOUBLE)) AS ff FROM hosts
), moments AS (
  SELECT *, (ff - n * m * m - (k - 1) * m * (1 - m)) / greatest(n - nn / n - (k - 1), 1e-9) AS v FROM total
), prior AS (
  SELECT m, CASE WHEN k > 1 AND m > 0 AND m < 1 AND v > 0 THEN greatest(m * (1 - m) / v - 1, 1.0) ELSE greatest(n, 1) END AS s FROM moments
), rates AS (
  SELECT source, (f + s * m) / (n + s) AS rate FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(rate, 0) <= 0.5 AS kept
FROM base LEFT JOIN rates USING (source)
"""
