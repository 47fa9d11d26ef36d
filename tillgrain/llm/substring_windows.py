"""Substring dedup: Rabin-Karp hashes of every fixed-length token window,
counted in Spark; repeated windows merge into maximal removal intervals.

A word goes when a window over it also starts in a document with a smaller
doc_id. Windows are compared by a 64-bit hash of the word sequence: among n
windows about n^2 / 2^65 pairs collide by chance, under one in a thousand runs
at 10^8 windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tillgrain.llm.common import hashed, raw_texts, rolling, settled, signed, slices, split_words

WIDTH = 13


def window_hashes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(h, doc_id, known): distinct windows of each document. Within a batch only
    the smallest document of a window is open; the others are ``known`` to
    repeat. Null text or under ``width`` words: none."""
    schema = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("known", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            batch = batch.take(pc.sort_indices(batch.column("doc_id")))
            per_doc = [signed(rolling(hashed(split_words(t)), width)) for t in raw_texts(batch)]
            ids = np.repeat(batch.column("doc_id").to_numpy().astype(np.int64), [len(x) for x in per_doc])
            if len(ids):
                h = np.concatenate(per_doc)
                order = np.argsort(h, kind="stable")
                h, ids = h[order], ids[order]
                same = np.concatenate([[False], h[1:] == h[:-1]])
                once = ~same | np.concatenate([[True], ids[1:] != ids[:-1]])
                starts = np.flatnonzero(~same)
                known = ids > np.repeat(ids[starts], np.diff(np.append(starts, len(h))))
                yield pa.record_batch([pa.array(h[once]), pa.array(ids[once]), pa.array(known[once])], schema=schema)

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(run, "h bigint, doc_id bigint, known boolean")


def repeated_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, hashes): per document the windows that a smaller doc_id also has.

    Open windows are dealt out by hash, known repeats by hash and document, so a
    window that a third of all documents share sends one row a batch to its task.
    A pass over each sorted partition keeps only the first document of the
    current hash.
    """
    key = F.when(F.col("known"), F.xxhash64("h", "doc_id")).otherwise(F.col("h"))
    dealt = window_hashes(docs, width).repartition(key).sortWithinPartitions("known", "h", "doc_id")
    schema = pa.schema([("h", pa.int64()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, None
        for batch in batches:
            h, doc = (batch.column(c).to_numpy() for c in ("h", "doc_id"))
            known = batch.column("known").to_numpy(zero_copy_only=False)
            n = int(np.count_nonzero(~known))  # open rows come first
            later = known.copy()
            if n:
                new = np.concatenate([[h[0] != held], h[1:n] != h[:n - 1]])
                starts = np.where(new, doc[:n], 0)
                if not new[0]:
                    starts[0] = first
                    new[0] = True
                firsts = starts[new][np.cumsum(new) - 1]
                held, first = h[n - 1], firsts[-1]
                later[:n] = doc[:n] > firsts
            if later.any():
                yield pa.record_batch([pa.array(h[later]), pa.array(doc[later])], schema=schema)

    later = dealt.mapInArrow(run, "h bigint, doc_id bigint")
    return later.groupBy("doc_id").agg(F.collect_set("h").alias("hashes"))


def covered(mask: np.ndarray, width: int, n: int) -> tuple[np.ndarray, int]:
    """Which of ``n`` words lie in a flagged window, and the number of maximal runs of them."""
    edge = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(mask)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    inside = np.cumsum(edge[:n]) > 0
    return inside, int(np.count_nonzero(np.diff(inside.astype(np.int8), prepend=0) == 1))


def dedup_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows of ``docs`` (doc_id, text; further columns are ignored) as doc_id,
    n_words, n_removed, n_spans, kept_text, kept_sha256.

    Null and empty texts have no words and an empty remainder. Rows with a null
    doc_id are kept whole and count for nobody. Rows that share a doc_id are one
    document: they do not remove each other's words.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    flagged = settled(repeated_windows(docs, width), "windows")
    schema = "doc_id bigint, n_words bigint, n_removed bigint, n_spans bigint, kept_text string, kept_sha256 string"
    arrow = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                       ("kept_text", pa.binary()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text, hashes in zip(raw_texts(batch), batch.column("hashes")):
                words = split_words(text)
                spans = removed = 0
                if hashes.is_valid:
                    mask = np.isin(signed(rolling(hashed(words), width)), hashes.values.to_numpy())
                    inside, spans = covered(mask, width, len(words))
                    removed = int(inside.sum())
                    kept = b" ".join(w for w, gone in zip(words, inside.tolist()) if not gone)
                else:
                    kept = b" ".join(words)
                out.append((len(words), removed, spans, kept, hashlib.sha256(kept).hexdigest()))
            cols = [pa.array(c, t) for c, t in zip(zip(*out), [f.type for f in arrow][1:])]
            done = pa.record_batch([batch.column("doc_id"), *cols], schema=arrow)
            yield done.set_column(4, "kept_text", done.column(4).cast(pa.string()))

    return docs.join(flagged, "doc_id", "left").mapInArrow(run, schema)
