"""Quality rules by host: rule failures are aggregated by domain, the rates
shrunk with an empirical beta prior, and the host's verdict joined back to its
documents. Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillgrain.llm.common import settled

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
HOST_LIMIT = 0.75


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row, however often the
    lambdas inside ``body`` refer to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words that lie in a ``width``-word window found twice or more in the text.

    Windows are compared by the 64-bit hash of their words. Only texts with a
    repeated hash sort their windows; sorting is by (hash, place), so
    neighbours tell which places repeat, and the gaps between those places tell
    how many words they cover.
    """
    places = F.sequence(F.lit(0), F.size(words) - width)
    hashes = F.transform(places, lambda i: F.xxhash64(F.slice(words, i + 1, width)))

    def places_of(h: Column) -> Column:
        return F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def doubled(s: Column) -> Column:
        near = lambda i: F.get(s, i)["h"]
        return F.filter(s, lambda x, i: (near(i - 1) == x["h"]) | (near(i + 1) == x["h"]))

    def spread(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def count(h: Column) -> Column:
        at = let(places_of(h), lambda s: F.array_sort(F.transform(doubled(s), lambda x: x["i"])))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(let(at, spread))

    return F.when(F.size(words) <= width, F.lit(0).cast("bigint")).otherwise(let(hashes, count))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)
    of every whole text; null text has no words and no lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    found = docs.select(
        F.col("doc_id").cast("bigint"), F.col("source").alias("host"), words.alias("words"), lines.alias("lines"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"))
    found = found.select(
        "doc_id", "host", F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"))
    return found.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def host_rates(judged: DataFrame) -> DataFrame:
    """(host, n_docs, n_failed, rate): failure rate by host, shrunk to the beta
    prior whose mean and variance are those of the hosts' rates, less what
    counting alone would scatter. A null host is a host of its own."""
    hosts = judged.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("bigint")).alias("n_failed"))
    hosts = settled(hosts, "hosts")
    rate = F.col("n_failed") / F.col("n_docs")
    total = hosts.agg(F.count("*").alias("k"), F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"),
                      F.avg(rate).alias("mean_rate"), F.var_pop(rate).alias("var_rate"), F.avg(1 / F.col("n_docs")).alias("scatter")).first()
    alpha, beta = beta_prior(total["k"], total["n"], total["f"], total["var_rate"], total["scatter"])
    return hosts.withColumn("rate", (F.col("n_failed") + F.lit(alpha)) / (F.col("n_docs") + F.lit(alpha + beta)))


def beta_prior(k: int, n: int | None, failed: int | None, variance: float | None, scatter: float | None) -> tuple[float, float]:
    """Parameters of the prior from sums over all hosts. Without hosts, or with
    rates that do not differ more than chance, the prior is as strong as the
    mean host's documents; it is never weaker than one document."""
    if not n:
        return 0.5, 0.5
    mean = (failed + 0.5) / (n + 1)
    spread = mean * (1 - mean)
    between = variance - spread * scatter
    strength = n / k if between <= 0 else spread / between - 1
    strength = min(max(strength, 1.0), n / k + 1.0)
    return mean * strength, (1 - mean) * strength


def judge(docs: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, source; further columns are ignored) with
    their features, ``base_failed``, ``host_rate`` and ``kept``.

    A document is kept when its own rules hold and its host's shrunk failure
    rate is at most ``host_limit``: a host goes as a whole only when three of
    four of its documents fail. One row per input row, repeated rows and null
    ids included.
    """
    judged = settled(features(docs), "quality")
    rates = settled(host_rates(judged).select(F.col("host").alias("of"), F.col("rate").alias("host_rate")), "host-rates")
    joined = judged.join(rates, F.col("host").eqNullSafe(F.col("of"))).drop("of")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= host_limit))
