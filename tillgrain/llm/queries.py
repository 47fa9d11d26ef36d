"""Registered queries of this subpackage: every operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillgrain.llm import (bpe, exact_blocks, host_quality, ngram_join, packing, periodic_runs, pii_surrogates, secret_links,
                           substring_windows, suffix_runs, token_alignment, toxicity_chain, url_lm)
from tillgrain.llm.common import settled, table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_ngrams(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))
    # written here, since the size of the batches that pass to Python is set for a step
    return settled(found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), "bpe-digests", batch_bytes=bpe.BATCH_BYTES)


def op3_suffix_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_runs.dedup_suffixes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_exact_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_blocks.dedup_exact(table(spark, sf_dir, "documents"))


def op6_url_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lm.judge(table(spark, sf_dir, "pages").select("page_id", "url"))


def op7_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_chain.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def demonstration_key(spark: SparkSession) -> bytes:
    """The session's key; the made-up documents of the registered queries do
    without a secret one."""
    return spark.conf.get(pii_surrogates.KEY_SETTING, "demonstration").encode()


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_surrogates.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), demonstration_key(spark))
    return found.select("doc_id", "text", "n_entities", "entity_types")


def op10_substring_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_windows.dedup_windows(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"))


def op12_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_links.scan_secrets(table(spark, sf_dir, "documents"))
    written = F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(written, ",").alias("spans"))


def repeating(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of ``docs`` where one text in ten repeats a stretch of its own
    words from some word on, as the check of op13 plants it. Null ids and texts stay."""
    h, words = F.crc32(F.col("doc_id").cast("string")), F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g = F.floor(h / 10)

    def planted(w):
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, a + (i - a) % p))), " ")

    made = bpe.let(words, lambda w: F.when(F.size(w) > 0, planted(w)))
    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(made, "text")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(repeating(table(spark, sf_dir, "documents")))
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    rows = found.withColumn("first", first).withColumn("length", -F.col("first.l"))
    written = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return rows.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "first.start", "length", "first.period",
        F.expr("1000 * length div first.period").alias("exponent_milli"),
        F.sha2(F.array_join(written, ""), 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_byte_bpe, op3_suffix_runs, op4_host_quality, op5_exact_blocks, op6_url_lm,
                                     op7_toxicity_chain, op8_packing, op9_pii_surrogates, op10_substring_windows, op11_token_alignment,
                                     op12_secret_links, op13_periodic_runs)}
