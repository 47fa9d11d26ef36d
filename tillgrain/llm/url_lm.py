"""URL filter: host and path rules, and for URLs without a rule the ratio of two
character language models.

Accepted and rejected URLs (those a rule judges) each give a variable-order
Markov model: the next character is predicted from the longest context that has
been seen, smoothed step by step with shorter ones (Witten-Bell). A URL is
blocked when its log-likelihood under the rejected model, less that under the
accepted one and per character, passes a threshold calibrated on held-out URLs.

Counts cover all judged URLs and are made in Spark. They are looked up in a table
of CELLS hashed cells, so what is broadcast is bounded whatever the input: two
models of three float32 arrays, 24 MB.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tillgrain.llm.common import mixed, raw_texts, settled, signed, slices

# fixed values: rules as (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
ORDER = 5
CELLS = 1 << 20
SYMBOLS = 256
#: Held-out scores are counted in bins of this width to choose the threshold.
BIN = 0.02
#: Share of held-out accepted URLs that the threshold may block.
MISBLOCKED = 0.02
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased, and path; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    split = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(url, split, 1), UPPER, LOWER), F.regexp_extract(url, split, 2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, of, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(of + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def grams(texts: list[bytes], order: int = ORDER) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each context length the hashes of contexts and of contexts with the next
    character, at every place of all texts (an end mark included), and each text's places."""
    size = np.array([len(t) + 1 for t in texts])
    flat = np.frombuffer(b"".join(b"\x02" * order + t + b"\x03" for t in texts), np.uint8).astype(np.uint64) + np.uint64(1)
    starts = np.cumsum(size + order) - size
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)
    contexts, whole, h = [], [], np.zeros(len(place), np.uint64)
    for k in range(order + 1):
        if k:
            h = h + flat[place - k] * np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64))
        salt = np.uint64(k + 1)
        contexts.append(mixed(h * np.uint64(2) + salt))
        whole.append(mixed(mixed(h * np.uint64(2) + salt) + flat[place]))
    return contexts, whole, size


def counted(urls: DataFrame) -> DataFrame:
    """(rejected, gram, context, n) over all of ``urls`` (text, rejected)."""
    schema = pa.schema([("rejected", pa.bool_()), ("gram", pa.int64()), ("context", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 20):
            rejected = batch.column("rejected").to_numpy(zero_copy_only=False).astype(bool)
            texts = raw_texts(batch)
            for flag in (False, True):
                own = [t for t, r in zip(texts, rejected.tolist()) if r == flag]
                if own:
                    contexts, whole, _ = grams(own)
                    gram, first, n = np.unique(np.concatenate(whole), return_index=True, return_counts=True)
                    context = np.concatenate(contexts)[first]
                    yield pa.record_batch([pa.array(np.full(len(gram), flag)), pa.array(signed(gram)), pa.array(signed(context)), pa.array(n)], schema=schema)

    return urls.select("text", "rejected").mapInArrow(run, "rejected boolean, gram bigint, context bigint, n bigint").groupBy(
        "rejected", "gram", "context").agg(F.sum("n").alias("n"))


def model(counts: DataFrame) -> list[np.ndarray] | None:
    """[accepted grams, contexts, continuations, the same for rejected] in hashed
    cells; None if a class has no URL. At most 6 * CELLS sums reach the driver."""
    cell = lambda c: F.pmod(F.col(c), F.lit(CELLS))
    whole = counts.groupBy("rejected", cell("gram").alias("cell")).agg(F.sum("n").alias("a"), F.lit(0).cast("bigint").alias("b")).withColumn("kind", F.lit(0))
    context = counts.groupBy("rejected", cell("context").alias("cell")).agg(F.sum("n").alias("a"), F.count("*").alias("b")).withColumn("kind", F.lit(1))
    rows = whole.unionByName(context).toArrow()
    rejected, kind, at, a, b = (rows.column(c).to_numpy() for c in ("rejected", "kind", "cell", "a", "b"))
    out = []
    for flag in (False, True):
        g, c = (rejected == flag) & (kind == 0), (rejected == flag) & (kind == 1)
        if not c.any():
            return None
        n, total, kinds = (np.zeros(CELLS, np.float32) for _ in range(3))
        n[at[g]], total[at[c]], kinds[at[c]] = a[g], a[c], b[c]
        out += [n, total, kinds]
    return out


def ratios(texts: list[bytes], arrays: list[np.ndarray]) -> np.ndarray:
    """log P(rejected) - log P(accepted) per character of every text."""
    contexts, whole, size = grams(texts)
    mask = np.uint64(CELLS - 1)
    logs = []
    for n, total, kinds in (arrays[:3], arrays[3:]):
        p = np.full(int(size.sum()), 1 / SYMBOLS)
        for c, g in zip(contexts, whole):
            at = (c & mask).astype(np.int64)
            seen, distinct = total[at].astype(float), kinds[at].astype(float)
            hits = np.minimum(n[(g & mask).astype(np.int64)], seen)
            p = np.where(seen > 0, (hits + distinct * p) / np.maximum(seen + distinct, 1), p)
        logs.append(np.add.reduceat(np.log(p), np.cumsum(size) - size))
    return (logs[1] - logs[0]) / size


def scored(urls: DataFrame, arrays: list[np.ndarray] | None) -> DataFrame:
    """``urls`` with ``score``; 0 without a model. The other columns pass through."""
    if arrays is None:
        return urls.withColumn("score", F.lit(0.0))
    shared = urls.sparkSession.sparkContext.broadcast(arrays)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 20):
            yield batch.append_column("score", pa.array(ratios(raw_texts(batch), shared.value)))

    return urls.mapInArrow(run, T.StructType([*urls.schema.fields, T.StructField("score", T.DoubleType())]))


def best_threshold(bins: list[tuple[int, int, int]], most: float = MISBLOCKED) -> float:
    """The least threshold, 0 or more, at which at most ``most`` of the held-out
    accepted URLs are blocked, from (bin, accepted, rejected)."""
    bins = sorted(bins)
    accepted, rejected = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not accepted or not rejected:
        return 0.0
    above, lowest, refused = 0, bins[-1][0] + 1, None
    for at, na, _ in reversed(bins):
        above += na
        if above > most * accepted:
            refused = at
            break
        lowest = at
    # in the middle of the gap below the lowest bin that may be blocked
    threshold = (lowest + (lowest if refused is None else refused + 1)) / 2 * BIN
    return max(0.0, threshold)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Rows of ``pages`` (page_id, url; further columns are ignored) as page_id,
    host, path, rule, score, verdict.

    A rule's verdict stands; other URLs are blocked when their score passes the
    threshold. Null urls and urls without ``://`` have empty parts and score as an
    empty text. Without judged URLs of both kinds all others are allowed. Repeated
    rows and null ids are judged like any row.
    """
    host, path = parts(F.col("url"))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"))
    found = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", found["rule"].alias("rule"), found["verdict"].alias("by_rule"), F.concat("host", "path").alias("text"))
    rows = settled(rows, "urls")
    known = rows.where("rule IS NOT NULL").select("text", (F.col("by_rule") == "block").alias("rejected"), (F.pmod(F.xxhash64("host", "path"), F.lit(5)) == 0).alias("held"))
    trial = model(settled(counted(known.where("NOT held")), "url-trial"))
    tested = scored(known.where("held"), trial).groupBy(F.floor(F.col("score") / BIN).alias("bin")).agg(
        F.count_if(~F.col("rejected")).alias("accepted"), F.count_if("rejected").alias("blocked"))
    threshold = best_threshold([tuple(r) for r in tested.collect()]) if trial else 0.0
    final = model(settled(counted(known), "url-counts"))
    judged = scored(rows, final)
    verdict = F.coalesce("by_rule", F.when(F.col("score") >= F.lit(threshold), "block").otherwise("allow")) if final else F.coalesce("by_rule", F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", "score", verdict.alias("verdict"))
