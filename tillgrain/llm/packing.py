"""Order-preserving packing by dynamic programming.

Token streams of documents are cut into windows of at most 2048 tokens, in
order. A cut may fall on a document end, a sentence end, or, inside stretches
without either, on every HARD_STEP-th token. The cuts minimise padding plus a
penalty for each document or sentence that a cut truncates. The best
predecessor of a cut within the last 2048 tokens is the front of a monotone
queue, so the work is linear; windows whose length is a power of two need no
padding and are tried besides.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tillgrain.llm.common import slices

LENGTH = 2048
END_ID = 1
#: Penalties in tokens of padding: a cut inside a document at a sentence end, a
#: cut inside a sentence, and each sequence (so that none is made needlessly).
SENTENCE, HARD, SEQUENCE = 8, 64, 4
HARD_STEP = 32
#: Tokens packed at a time; the last window of a piece moves to the next.
PIECE = 1 << 20


@lru_cache(maxsize=4)
def encoder(path: str) -> tiktoken.Encoding:
    """Encoder with the vocabulary of a tokenizers byte-level BPE file. Its ids
    are ranks, so the faster rank-merging library gives the same ids; the file's
    special tokens stay whole in a text, as they do there."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(odd)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encoded(enc: tiktoken.Encoding, text: str | None) -> np.ndarray:
    """Ids of a text followed by END_ID; null is empty."""
    ids = enc.encode_to_numpy(text or "", allowed_special="all", disallowed_special=())
    return np.append(ids.astype(np.uint32), np.uint32(END_ID))


@lru_cache(maxsize=4)
def sentence_ends(path: str) -> np.ndarray:
    """By id: whether a sentence or line can end after the token."""
    enc = encoder(path)
    out = np.zeros(enc.n_vocab, bool)
    for token in range(enc.n_vocab):
        try:
            body = enc.decode_single_token_bytes(token)
        except KeyError:
            continue
        out[token] = body.rstrip(b" ")[-1:] in (b".", b"!", b"?", b"\n") or b"\n" in body
    return out


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, ascending from 0 to the total, and their penalties."""
    sentences = np.flatnonzero(ends[ids]) + 1
    soft = np.union1d(np.concatenate([[0], sentences]), doc_ends)
    gaps = np.diff(soft)
    wide = np.flatnonzero(gaps > 2 * HARD_STEP)
    k = (gaps[wide] - 1) // HARD_STEP
    inner = np.repeat(soft[wide], k) + HARD_STEP * (np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + 1)
    points = np.concatenate([soft, inner])
    cost = np.concatenate([np.where(np.isin(soft, doc_ends), 0, SENTENCE), np.full(len(inner), HARD)])
    order = np.argsort(points, kind="stable")
    return points[order], cost[order]


def best_windows(points: np.ndarray, cost: np.ndarray, length: int = LENGTH) -> list[int]:
    """Ends of the windows with the least padding plus penalties."""
    n = len(points)
    powers: dict[int, list[int]] = {}
    size = 1
    while size <= length:
        at = np.searchsorted(points, points - size)
        for j in np.flatnonzero((points >= size) & (points[np.minimum(at, n - 1)] == points - size)).tolist():
            powers.setdefault(j, []).append(int(at[j]))
        size *= 2
    place, price = points.tolist(), (cost + SEQUENCE).tolist()
    total, before = [0] * n, [0] * n
    keys: deque[tuple[int, int]] = deque()  # (total[i] + place[i], i), increasing
    for j in range(1, n):
        key = total[j - 1] + place[j - 1]
        while keys and keys[-1][0] >= key:
            keys.pop()
        keys.append((key, j - 1))
        here = place[j]
        while here - place[keys[0][1]] > length:
            keys.popleft()
        key, i = keys[0]
        least = key + length - here
        for p in powers.get(j, ()):
            if total[p] < least:
                least, i = total[p], p
        total[j], before[j] = least + price[j], i
    out, j = [], n - 1
    while j > 0:
        out.append(place[j])
        j = before[j]
    return out[::-1]


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """Rows of ``docs`` (doc_id, text; further columns are ignored) as pieces:
    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if
    asked for, ids.

    Every row becomes a document of its ids and END_ID: null and empty texts are
    END_ID alone, repeated rows and null ids are packed as any other. Each input
    partition packs its documents in the order it holds them; sequence_id is the
    partition's number and a count. A task holds PIECE tokens and one batch.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
              ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    ddl = ", ".join(f"{n} bigint" for n, _ in fields)
    if with_ids:
        fields, ddl = [*fields, ("ids", pa.list_(pa.int32()))], f"{ddl}, ids array<int>"
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, ends = encoder(path), sentence_ends(path)
        task = TaskContext.get()
        made = (task.partitionId() if task else 0) << 33
        held: list[tuple] = []  # (doc_id, remaining ids, start, doc_tokens)

        def flush(last: bool) -> pa.RecordBatch | None:
            nonlocal held, made
            ids = np.concatenate([h[1] for h in held])
            doc_ends = np.cumsum([len(h[1]) for h in held])
            windows = np.array([0, *best_windows(*cut_points(ids, doc_ends, ends), length)])
            stop = len(windows) - 1 if last else len(windows) - 2
            if stop <= 0:
                return None
            done = windows[stop]
            bounds = np.union1d(windows[:stop + 1], doc_ends[doc_ends < done])
            a, b = bounds[:-1], bounds[1:]
            doc = np.searchsorted(doc_ends, a, side="right")
            window = np.searchsorted(windows, a, side="right") - 1
            doc_starts = np.concatenate([[0], doc_ends[:-1]])
            base = np.array([h[2] for h in held])
            crc = [zlib.crc32(ids[x:y]) for x, y in zip(a.tolist(), b.tolist())]
            cols = [pa.array([held[d][0] for d in doc.tolist()], pa.int64()), pa.array(a - doc_starts[doc] + base[doc]), pa.array(b - a),
                    pa.array(crc, pa.int64()), pa.array([held[d][3] for d in doc.tolist()], pa.int64()), pa.array(made + window), pa.array(a - windows[window])]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids[:done].astype(np.int32))))
            made += stop
            left = [(h[0], h[1][max(0, done - s):], h[2] + max(0, done - s), h[3]) for h, s, e in zip(held, doc_starts.tolist(), doc_ends.tolist()) if e > done]
            held = left
            return pa.record_batch(cols, schema=schema)

        waiting = 0
        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encoded(enc, text)
                for at in range(0, len(ids), PIECE):
                    held.append((doc_id, ids[at:at + PIECE], at, len(ids)))
                    waiting += len(held[-1][1])
                    if waiting >= PIECE:
                        # parts of one document that meet are one stretch: its inner end is no document end
                        held = joined(held)
                        if (out := flush(False)) is not None:
                            yield out
                        waiting = sum(len(h[1]) for h in held)
        if held:
            held = joined(held)
            yield flush(True)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, ddl)


def joined(held: list[tuple]) -> list[tuple]:
    """Parts that continue the part before them, put together."""
    out: list[tuple] = []
    for part in held:
        if out and part[2] and out[-1][0] == part[0] and out[-1][3] == part[3] and out[-1][2] + len(out[-1][1]) == part[2]:
            prev = out.pop()
            part = (prev[0], np.concatenate([prev[1], part[1]]), prev[2], prev[3])
        out.append(part)
    return out
