"""Document rules and host verdicts, with DataFrame functions only.

Every document gets word, symbol and repetition counts and a base verdict. Failures of the base
rules are counted by host; each host's failure rate is shrunk towards the corpus by a beta prior
fitted to all hosts (method of moments), and the host verdict is joined back to its documents.

Defined results: a null or blank text has no words, so it fails the base rules; a null host has no
host verdict (its documents pass that part); equal rows each get their own result row; an empty
table gives an empty result; columns other than the id, text and host are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.storage import materialize

#: White space between words: \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
#: A host whose shrunk failure rate is above this loses all its documents.
MAX_HOST_RATE = 0.5
#: Weight of a prior in documents where hosts do not differ beyond chance.
POOLED_WEIGHT = 1e6


def document_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    spoken = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.select(
        F.col(id_col),
        F.col(host_col).alias("host"),
        F.split(F.btrim(text, F.lit(SPACES)), r"[\x20\x09-\x0D]+").alias("parts"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        spoken.alias("lines"),
    )
    words = first.select(
        id_col,
        "host",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("parts")[0] == "", F.array().cast("array<string>")).otherwise(F.col("parts")).alias("words"),
    )
    # one 64-bit hash for each three-word window; the words themselves are needed no longer
    hashed = words.select(
        id_col,
        "host",
        "n_symbols",
        "n_dup_lines",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.expr("CASE WHEN size(words) > 2 THEN transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) END").alias("h"),
    )
    # texts without any repeated window skip the sort
    paired = hashed.withColumn("p", F.expr("CASE WHEN size(array_distinct(h)) < size(h) THEN array_sort(transform(h, (x, i) -> struct(x AS x, i AS i))) END")).drop("h")
    at = paired.withColumn(
        "at",
        F.expr("CASE WHEN p IS NOT NULL THEN array_sort(transform(filter(p, (y, k) -> (k > 0 AND p[k - 1].x = y.x) OR (k < size(p) - 1 AND p[k + 1].x = y.x)), y -> y.i)) END"),
    ).drop("p")
    covered = F.expr("coalesce(aggregate(transform(at, (s, k) -> CASE WHEN k = 0 THEN 3 ELSE least(3, s - at[k - 1]) END), 0L, (a, x) -> a + x), 0L)")
    return at.withColumn("n_repeat_words", covered).drop("at").withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    )


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """(alpha, beta) fitted by moments to a frame of host_docs and host_failed. One row comes to the driver.

    The variance of the hosts' rates beyond what binomial chance explains sets the weight; without
    any such variance all hosts share the corpus rate.
    """
    n, f = F.col("host_docs"), F.col("host_failed")
    total = hosts.agg(F.sum(n).alias("n"), F.sum(f).alias("f"), F.count("*").alias("k"), F.sum(f * f / n).alias("q")).first()
    if not total.n:
        return 0.5, 0.5
    mean = total.f / total.n
    if mean in (0.0, 1.0):
        return mean * POOLED_WEIGHT, (1 - mean) * POOLED_WEIGHT
    between = total.q / total.n - mean * mean - mean * (1 - mean) * total.k / total.n
    weight = min(POOLED_WEIGHT, mean * (1 - mean) / between - 1) if between > 0 else POOLED_WEIGHT
    weight = max(weight, 1e-6)
    return mean * weight, (1 - mean) * weight


def host_verdicts(metrics: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """host, host_docs, host_failed, host_rate (shrunk), host_failed_verdict; failures are pre-aggregated by Spark."""
    hosts = materialize(
        metrics.where(F.col("host").isNotNull())
        .groupBy("host")
        .agg(F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed")),
        "hosts",
    )
    alpha, beta = beta_prior(hosts)
    rate = (F.col("host_failed") + F.lit(alpha)) / (F.col("host_docs") + F.lit(alpha + beta))
    return hosts.withColumn("host_rate", rate).withColumn("host_rejected", F.col("host_rate") > max_host_rate)


def apply_quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Metrics, base verdict and kept for each document."""
    metrics = materialize(document_metrics(docs, id_col, text_col, host_col), "metrics")
    joined = metrics.join(host_verdicts(metrics, max_host_rate), "host", "left")
    return joined.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False))).alias("kept"),
        F.coalesce("host_docs", F.lit(0)).cast("long").alias("host_docs"),
        F.coalesce("host_failed", F.lit(0)).cast("long").alias("host_failed"),
    )


#: The same result in DuckDB; the prior is the same formula.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
      list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT *, CASE WHEN len(ws) > 2 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) ELSE [] END AS gs FROM w),
n AS (SELECT *, row_number() OVER () AS rid FROM g),
e AS (SELECT rid, unnest(gs) AS gram, unnest(range(1, len(gs) + 1)) AS pos FROM n),
c AS (SELECT rid, gram FROM e GROUP BY ALL HAVING count(*) > 1),
p AS (SELECT DISTINCT e.rid, e.pos + o.o AS at FROM e JOIN c USING (rid, gram), (VALUES (0), (1), (2)) o(o)),
r AS (SELECT rid, count(*) AS k FROM p GROUP BY rid),
m AS (SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
      CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(k, 0) AS BIGINT) AS n_repeat_words
      FROM n LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS host_docs, CAST(sum(CAST(base_failed AS INT)) AS BIGINT) AS host_failed FROM b WHERE source IS NOT NULL GROUP BY source),
s AS (SELECT sum(host_docs) AS n, sum(host_failed) / sum(host_docs) AS mean, count(*) AS k, sum(host_failed * host_failed / host_docs) AS q FROM h),
v AS (SELECT *, q / n - mean * mean - mean * (1 - mean) * k / n AS between_ FROM s),
a AS (SELECT mean, CASE WHEN mean = 0 OR mean = 1 OR between_ <= 0 THEN 1e6 ELSE greatest(1e-6, least(1e6, mean * (1 - mean) / between_ - 1)) END AS weight FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce((host_failed + mean * weight) / (host_docs + weight) > 0.5, false) AS kept,
       CAST(coalesce(host_docs, 0) AS BIGINT) AS host_docs, CAST(coalesce(host_failed, 0) AS BIGINT) AS host_failed
FROM b LEFT JOIN h USING (source) LEFT JOIN a ON true
"""
