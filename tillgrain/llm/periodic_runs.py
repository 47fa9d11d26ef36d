"""Periodic runs by an online sparse diagonal DP.

A cell of the DP is a word and one of its earlier occurrences; its lag is the
distance between them. A match lengthens the lag's active diagonal by one, a
diagonal that ends long enough is a run and is emitted in the same pass.

Counting every earlier occurrence of every word would take n^2 / 2 steps for a
text of one repeated word. So the lags are dealt out by octave: a lag q with
k/2 < q <= k (k a power of two) is advanced only where k consecutive words occur
again, and only by the nearest earlier occurrence of them. In a run of period q
with four periods or more these k words (q <= k < 2q) have their nearest earlier
occurrence exactly q words back, since q is the smallest period; outside of it
the diagonal breaks. Hence one diagonal at most is active at a word in each
octave, none is missed, multiples of a period never start one, and the work is
n log n. The occurrences are sparse: 2k words can only occur again where both
halves do, so each octave looks at the places that the one before it left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tillgrain.llm.common import raw_texts, slices, split_words

MIN_LENGTH = 6
PERIODS = 4
#: Text bytes whose words are looked at together; a longer text is looked at alone.
STRETCH = 2 << 20


def occurrences(rank: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of places ``at`` (ascending) with their keys: the lag to the nearest earlier
    place of the same key (0: none), a number for each key, and whether it occurs twice."""
    order = np.argsort(rank, kind="stable")
    key, place = rank[order], at[order]
    again = np.concatenate([[False], key[1:] == key[:-1]])
    lag = np.where(again, np.diff(place, prepend=0), 0)
    number = np.cumsum(~again) - 1
    twice = again | np.append(again[1:], False)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return lag[back], number[back], twice[back]


def diagonals(at: np.ndarray, lag: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the maximal stretches of places on one lag."""
    if len(at):
        ends = np.append(np.flatnonzero((np.diff(at) != 1) | (np.diff(lag) != 0)), len(at) - 1)
        first = np.concatenate([[0], ends[:-1] + 1])
        period = lag[first]
        length = at[ends] - at[first] + k + period
        long = length >= np.maximum(MIN_LENGTH, PERIODS * period)
        yield from zip((at[first] - period)[long].tolist(), length[long].tolist(), period[long].tolist())


def runs_of(words: np.ndarray, owner: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run; ``words`` are numbers of words, and
    ``owner``, ascending, the number of the text that each belongs to. Sorted."""
    n, k, found = len(words), 1, []
    if not n:
        return found
    longest = int(np.bincount(owner).max())
    at, rank = np.arange(n), owner.astype(np.int64) * (int(words.max()) + 1) + words
    while len(at) and PERIODS * (k // 2 + 1) <= longest:
        lag, number, twice = occurrences(rank, at)
        here = (lag > k // 2) & (lag <= k)
        found += diagonals(at[here], lag[here], k)
        named = np.full(n + k, -1, np.int64)
        named[at[twice]] = number[twice]
        at = at[twice]
        at = at[named[at + k] >= 0]
        at = at[owner[at] == owner[at + k]]
        rank = named[at] * (int(number.max()) + 1) + named[at + k]
        k *= 2
    return sorted(found)


def find_runs(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (doc_id, text; further columns are ignored) as doc_id,
    n_words, runs (array of start, length, period; by start, then period) and
    collapsed_text: the words without each run's repetitions, joined by a space.

    A run is a stretch of at least MIN_LENGTH words and PERIODS times its smallest
    period that no neighbouring word extends. Null, empty and blank texts have no
    words and no runs. Every row is looked at alone, so repeated rows and null ids
    are treated alike.
    """
    kinds = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(kinds)), ("collapsed_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=STRETCH):
            texts = [split_words(t) for t in raw_texts(batch)]
            flat = [w for words in texts for w in words]
            sizes = np.array([len(words) for words in texts])
            numbers = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            found = runs_of(numbers, np.repeat(np.arange(len(texts)), sizes))
            edge = np.zeros(len(flat) + 1, np.int64)
            for start, length, period in found:
                edge[start + period] += 1
                edge[start + length] -= 1
            repeated = np.cumsum(edge[:-1]) > 0
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            doc = np.searchsorted(offsets, [r[0] for r in found], side="right") - 1
            runs: list[list] = [[] for _ in texts]
            for (start, length, period), d in zip(found, doc.tolist()):
                runs[d].append({"start": start - int(offsets[d]), "length": length, "period": period})
            kept = []
            for words, a, b in zip(texts, offsets[:-1].tolist(), offsets[1:].tolist()):
                gone = repeated[a:b]
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if gone.any() else b" ".join(words))
            yield pa.record_batch([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(runs, schema.field("runs").type),
                                   pa.array(kept, pa.binary()).cast(pa.string())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed_text string")
