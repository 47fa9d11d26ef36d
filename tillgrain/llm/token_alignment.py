"""Cross-tokenizer alignment by interval coalescing.

The tokens of two tokenizers A and B over the same bytes are sorted together by
start (lexsort); the running maximum of their ends (maximum.accumulate) breaks
them into groups where a start reaches it; within the groups overlapping tokens
expand to links. Links are counted over the whole corpus, each batch of texts
sending the distinct pairs of ids it holds, and the counts go back to the
batches by the pair.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tillgrain.llm.bpe import gathered
from tillgrain.llm.common import settled, slices
from tillgrain.llm.packing import encoder

#: Text bytes aligned together; their distinct id pairs are what a batch sends.
BATCH_BYTES = 1 << 19
_CHUNK = re.compile(" +[^ ]*")
_JOINTS = (b",", b"|", b";", b"")


class Sides:
    """Both tokenizers with the bytes of their entries."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a = encoder(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [self.a.decode_single_token_bytes(i) for i in range(self.a.n_vocab)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        # pieces that hold a space after another character would join chunks
        self.whole = any(re.search("[^▁]▁", p) for p in pieces)
        decimal = [b"%d" % i for i in range(max(len(self.bytes_a), len(pieces)))]
        self.written = [d + joint for joint in _JOINTS for d in decimal]
        self.stride = len(decimal)

    def ids_a(self, text: str) -> np.ndarray:
        return self.a.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype(np.int64)

    def all_ids_b(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that start with the space that B would add. No entry spans
        the end of a word and the space after it, so distinct words are encoded once."""
        if self.whole:
            return [np.array(ids, np.int64) for ids in self.b.encode([t[1:] for t in texts], num_threads=1)]
        split = [_CHUNK.findall(t) for t in texts]
        counts = np.cumsum([0, *map(len, split)])
        coded = pa.array(list(chain.from_iterable(split)), pa.string()).dictionary_encode()
        words, places = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        ids = self.b.encode([w[1:] for w in words], num_threads=1)
        if " " in words:  # a text's last space: an empty string would get none
            ids[words.index(" ")] = [self.b.piece_to_id("▁")]
        offsets = np.cumsum([0, *map(len, ids)])
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(offsets[-1]))
        return [gathered(offsets, flat, places[a:b])[0] for a, b in zip(counts[:-1].tolist(), counts[1:].tolist())]


@lru_cache(maxsize=2)
def sides(path_a: str, path_b: str) -> Sides:
    return Sides(path_a, path_b)


def coalesced(start: np.ndarray, end: np.ndarray, side: np.ndarray) -> np.ndarray:
    """The group of every interval: a group ends where a start reaches the greatest end so far."""
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(np.concatenate([[False], start[order][1:] >= reach[:-1]]))
    return group


def overlapping(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of all overlapping tokens; both sides tile the same bytes."""
    low, high = np.searchsorted(end_b, start_a, side="right"), np.searchsorted(start_b, end_a, side="left")
    size = high - low
    a = np.repeat(np.arange(len(start_a)), size)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)


def _tiles(ids: list[np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = np.concatenate(ids)
    end = np.cumsum(sizes[flat])
    return flat, end - sizes[flat], end


def aligned(both: Sides, texts: list[str | None], overlaps: bool) -> tuple[list[tuple], np.ndarray, list[bytes]]:
    """Per text (n_a, n_b, n_groups, n_links); the id pairs of all links, texts
    in order; and each text's groups as written."""
    spaced = [" " + t if t else "" for t in texts]
    ids_a = [both.ids_a(t) for t in spaced]
    ids_b = both.all_ids_b(spaced)
    same = [bool(t) and (raw := t.encode()) == b"".join([both.bytes_a[i] for i in a.tolist()]) == b"".join([both.bytes_b[i] for i in b.tolist()]) and raw != b""
            for t, a, b in zip(spaced, ids_a, ids_b)]
    held = [k for k, ok in enumerate(same) if ok]
    counts, written = [(0, 0, 0, 0)] * len(texts), [b""] * len(texts)
    if not held:
        return counts, np.empty(0, np.int64), written
    (a, start_a, end_a), (b, start_b, end_b) = (_tiles([ids[k] for k in held], sizes) for ids, sizes in ((ids_a, both.sizes_a), (ids_b, both.sizes_b)))
    n_a, n_b = (np.array([len(ids[k]) for k in held]) for ids in (ids_a, ids_b))
    side = np.repeat(np.array([0, 1], np.int8), [len(a), len(b)])
    group = coalesced(np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b]), side)
    last = group[np.cumsum(n_a) - 1]  # a text's end closes a group
    n_groups = np.diff(last, prepend=-1)
    at_a, at_b = overlapping(start_a, end_a, start_b, end_b)
    if not overlaps:
        together = end_a[at_a] == end_b[at_b]
        at_a, at_b = at_a[together], at_b[together]
    pairs = (a[at_a] << 32) | b[at_b]
    n_links = np.diff(np.searchsorted(at_a, np.cumsum(n_a)), prepend=0)
    order = np.lexsort((side, group))
    g, s = group[order], side[order]
    joint = np.where(np.append(np.diff(g), 1) > 0, 2, np.append(np.diff(s) != 0, False))
    stops = np.cumsum(n_a + n_b)
    joint[stops - 1] = 3
    tokens = np.concatenate([a, b])[order] + joint * both.stride
    for k, x, y, row in zip(held, [0, *stops[:-1].tolist()], stops.tolist(), zip(n_a.tolist(), n_b.tolist(), n_groups.tolist(), n_links.tolist())):
        counts[k], written[k] = row, b"".join([both.written[t] for t in tokens[x:y].tolist()])
    return counts, pairs, written


def place_type(n: int) -> type:
    return np.uint8 if n <= 1 << 8 else np.uint16 if n <= 1 << 16 else np.uint32


def batches_of(docs: DataFrame, path_a: str, path_b: str, overlaps: bool, with_groups: bool) -> DataFrame:
    """A row for each batch of texts: per text its counts and the digest of its
    groups; the distinct id pairs of the batch, how often it links them, and the
    place of every link's pair among them (as few bytes as hold them)."""
    fields = [("batch", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("digests", pa.list_(pa.string())),
              ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("places", pa.binary())]
    ddl = "batch bigint, doc_ids array<bigint>, sizes array<bigint>, digests array<string>, pairs array<bigint>, counts array<bigint>, places binary"
    if with_groups:
        fields, ddl = [*fields, ("groups", pa.list_(pa.string()))], f"{ddl}, groups array<string>"
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, task = sides(path_a, path_b), TaskContext.get()
        number = (task.partitionId() if task else 0) << 33
        for batch in slices(batches, most=BATCH_BYTES):
            counts, links, written = aligned(both, batch.column("text").to_pylist(), overlaps)
            pairs, places, times = np.unique(links, return_inverse=True, return_counts=True)
            row = [number, batch.column("doc_id").to_pylist(), [n for c in counts for n in c],
                   [hashlib.sha256(w).hexdigest() if w else "" for w in written], pairs, times, places.astype(place_type(len(pairs))).tobytes()]
            if with_groups:
                row.append([w.decode() for w in written])
            yield pa.record_batch([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)
            number += 1

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, ddl)


def pair_counts(batches: DataFrame) -> DataFrame:
    """(pair, total, best): links of every id pair over the whole corpus, and
    whether no other A id is linked more often to its B id."""
    sent = batches.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
    totals = settled(sent.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("total")), "link-totals")
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    most = totals.groupBy(b.alias("b")).agg(F.max("total").alias("most"))  # a row for each B id
    return totals.withColumn("b", b).join(most, "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, overlaps: bool = False, with_groups: bool = False) -> DataFrame:
    """Rows of ``docs`` (doc_id, text; further columns are ignored) as doc_id, n_a,
    n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if asked for,
    groups, as ``a1,a2|b1;a3|b2,b3``.

    Links are the token pairs whose ranges end together, or with ``overlaps`` all
    that overlap. Null and empty texts, and texts whose tokens of either side do
    not give back the text after a space, have no tokens: zeros and ''. Every row
    counts, repeated rows and null ids too; equal counts are all best.
    """
    path_a = path_a or public_tokenizers.path("byte_bpe_50k.json")
    path_b = path_b or public_tokenizers.path("piece_bpe_32k.model")
    batches = settled(batches_of(docs, path_a, path_b, overlaps, with_groups), "aligned")
    sent = batches.select("batch", F.posexplode("pairs").alias("place", "pair"))
    back = sent.join(pair_counts(batches), "pair").groupBy("batch").agg(F.collect_list(F.struct("place", "total", "best")).alias("looked"))
    fields = [(n, pa.int64()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [("groups_sha256", pa.string())]
    ddl = ", ".join(f"{n} {'string' if n == 'groups_sha256' else 'bigint'}" for n, _ in fields)
    if with_groups:
        fields, ddl = [*fields, ("groups", pa.string())], f"{ddl}, groups string"
    schema = pa.schema(fields)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows:
            for k in range(row.num_rows):
                sizes = row.column("sizes")[k].values.to_numpy().reshape(-1, 4)
                places = np.frombuffer(row.column("places")[k].as_py(), place_type(row.column("n_pairs")[k].as_py()))
                links = np.concatenate([[0], np.cumsum(sizes[:, 3])])
                total, best = np.zeros(len(places) + 1, np.int64), np.zeros(len(places) + 1, np.int64)
                looked = row.column("looked")[k]
                if looked.is_valid:
                    at, n, top = (looked.values.field(i) for i in range(3))
                    counts, tops = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                    counts[at.to_numpy()], tops[at.to_numpy()] = n.to_numpy(), top.to_numpy(zero_copy_only=False)
                    np.cumsum(counts[places], out=total[1:]), np.cumsum(tops[places], out=best[1:])
                cols = [row.column("doc_ids")[k].values, *(pa.array(sizes[:, i]) for i in range(4)),
                        pa.array(np.diff(best[links])), pa.array(np.diff(total[links])), row.column("digests")[k].values]
                if with_groups:
                    cols.append(row.column("groups")[k].values)
                yield pa.record_batch([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)

    kept = ["doc_ids", "sizes", "digests", "places", *(["groups"] if with_groups else [])]
    size = F.size("pairs").alias("n_pairs")
    joined = batches.select("batch", *kept, size).join(settled(back, "looked-up"), "batch", "left")
    return settled(joined.select(*kept, "n_pairs", "looked").mapInArrow(run, ddl), "alignment")
