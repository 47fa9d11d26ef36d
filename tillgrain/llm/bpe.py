"""Byte-level BPE: words are split off by the tokenizer's pattern, and Spark
higher-order functions fold ranked merges over the bytes of distinct words with
a literal rank map; decoding concatenates the pieces of ids.

A merge looks up two neighbouring pieces by number, not by text: the literal map
has every pair of pieces whose join is a piece, in a flat array, so that a
lookup reads one place. A word that is a piece is that piece; merging gives
it, save for the few pieces (if any) that merging does not reach and that are
looked up whole.

A batch of documents becomes one row with the words that its task has not met
before, so a word is merged about once a task and nothing is shuffled; the ids
of earlier words are kept where documents are put together again. Words travel as
numbers of their bytes and, for lookups, as characters of the same number (Latin-1).
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tillgrain.llm.common import settled, slices

MAPS = 1 << 15
NONE = 1 << 30
#: Most bits of a piece's number: two of them and a place of 2^26 bytes in a word share 62.
MOST_BITS = 18
#: Characters of the documents that share one row of new words.
BATCH_BYTES = 1 << 20
#: Words a task remembers; with more it starts anew.
KNOWN = 1 << 20
#: Bytes of a file that one task reads: the more, the fewer words are merged in several tasks.
SCAN_BYTES = 64 << 20


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _slot(piece: Column) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(MAPS)).cast("int")


@lru_cache(maxsize=4)
def unreached(path: str) -> dict[bytes, int]:
    """The pieces that merging their own bytes does not give: words to look up whole."""
    ranks = read_ranks(path)

    def reached(piece: bytes) -> bool:
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((ranks.get(a + b, NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == NONE:
                return False
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return True

    return {piece: rank for piece, rank in ranks.items() if not reached(piece)}


def _literal(values, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), kind)


def whole_map(spark, found: dict[bytes, int]) -> Column:
    """The ranks as a literal array of maps; the slot of a piece is Spark's hash of it."""
    pieces = [(token.decode("latin-1"), rank) for token, rank in found.items()]
    placed = spark.createDataFrame(pieces, "piece string, rank int").select("piece", "rank", _slot(F.col("piece")).alias("slot")).toArrow()
    maps: list[dict] = [{} for _ in range(MAPS)]
    for piece, rank, slot in zip(*(c.to_pylist() for c in placed.columns)):
        maps[slot][piece] = rank
    return _literal(maps, "array<map<string,int>>")


def numbers(path: str) -> list[bytes]:
    """All pieces by their number in a fold: bytes have their own value, and longer
    pieces follow by rank, so that a lower number is a lower rank among them."""
    ranks = read_ranks(path)
    return [bytes([x]) for x in range(256)] + sorted((t for t in ranks if len(t) > 1), key=ranks.__getitem__)


@lru_cache(maxsize=4)
def pair_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, left, joined): numbers a and b side by side are joined[base[a] + b] if
    left[base[a] + b] is a, and no piece otherwise. The rows of all a lie over one
    another, each moved to where its entries meet free places. One number more than
    there are has a base and no entries."""
    place = {t: n for n, t in enumerate(numbers(path))}
    pairs = sorted((place[t[:k]], place[t[k:]], n) for t, n in place.items() for k in range(1, len(t)) if t[:k] in place and t[k:] in place)
    rows = np.array(pairs, np.int64).reshape(-1, 3)
    rows = [row for row in np.split(rows, np.flatnonzero(np.diff(rows[:, 0])) + 1) if len(row)]
    width, room, chance = len(place) + 1, 8 * len(pairs) + 1, np.random.default_rng(0)
    base, left, joined = np.zeros(width, np.int64), np.full(room + width, -1), np.zeros(room + width, np.int64)
    for row in sorted(rows, key=len, reverse=True):
        right = row[:, 1]
        for _ in range(64):
            tries = chance.integers(0, room, 32)
            fits = tries[(left[tries[:, None] + right] < 0).all(axis=1)]
            if len(fits):
                at = fits[0]
                break
        else:  # behind all others
            at = len(left)
            left, joined = np.append(left, np.full(width, -1)), np.append(joined, np.zeros(width, np.int64))
        base[row[0, 0]], left[at + right], joined[at + right] = at, row[0, 0], row[:, 2]
    return base, left, joined


def number_bits(edge: int) -> int:
    """Bits for the numbers of ``edge`` pieces, the edge and a free place."""
    return (edge + 1).bit_length()


def merged_ids(raw: Column, ranks: Column, base: Column, joined: Column, edge: int) -> Column:
    """Ids of one word of these bytes: the adjacent pair of least rank, the leftmost of
    equals, is merged until no pair has a rank. The state has a number for each piece:
    that of the pair it begins, then its start, then its own, so the least is the pair
    to merge. A merge ranks anew only the pairs beside it; ``edge`` stands before the
    first piece and joins with nothing."""
    bits = number_bits(edge)
    up, own, none = 62 - bits, (1 << bits) - 1, 1 << 62
    start = lambda x: x.bitwiseAND(F.lit((1 << up) - 1 - own))
    number = lambda x: x.bitwiseAND(F.lit(own)).cast("int")

    def pair(a: Column, b: Column) -> Column:
        """The state of a before b without its start; b is null behind the last piece."""
        found = F.get(joined, F.get(base, a) + b)
        return F.when(found.bitwiseAND(F.lit(own)) == a, found).otherwise(F.lit(none) + a)

    def step(state: Column) -> Column:
        def merge(least: Column, at: Column) -> Column:
            made, before = F.shiftright(least, up).cast("int"), F.get(state, at - 2)
            beside = F.array(pair(number(before), made) + start(before), pair(made, number(F.get(state, at + 1))) + start(least))
            return F.concat(F.slice(state, 1, at - 2), beside, F.slice(state, at + 2, F.size(state)))

        return let(F.array_min(state), lambda least: F.when(least >= none, state).otherwise(
            let(F.array_position(state, least).cast("int"), lambda at: merge(least, at))))

    first = lambda raw: F.transform(raw, lambda x, i: pair(x, F.get(raw, i + 1)) + F.shiftleft(i.cast("bigint"), bits))
    return let(raw, lambda raw: F.aggregate(
        raw, F.concat(F.array(F.lit(none + edge)), first(raw)), lambda state, _: step(state),
        lambda state: F.transform(F.slice(state, 2, F.size(state)), lambda x: F.get(ranks, number(x)))))


def word_ids(spark, path: str) -> Column:
    """Ids of each of ``words``, whose bytes are ``raw``. Literals are bound once:
    every use of one would be a copy of it in the plan and in each task."""
    ranks, pieces, whole = read_ranks(path), numbers(path), unreached(path)
    edge = len(pieces)
    bits = number_bits(edge)
    if bits > MOST_BITS:
        raise ValueError(f"{edge} pieces leave too few bits for places in a word")
    base, left, joined = pair_table(path)
    tables = [_literal([ranks[t] for t in pieces], "array<int>"), _literal(base.tolist(), "array<int>"),
              # a free place has a number that no piece has
              _literal(np.where(left < 0, edge + 1, (joined << (62 - bits)) + left).tolist(), "array<bigint>")]

    def bound(body, *names: Column) -> Column:
        return let(tables[len(names)], lambda t: bound(body, *names, t)) if len(names) < len(tables) else body(*names)

    folded = lambda i, names: merged_ids(F.get("raw", i), *names, edge)
    if not whole:
        return bound(lambda *names: F.transform("words", lambda word, i: folded(i, names)))
    rank = lambda maps, piece: F.try_element_at(F.get(maps, _slot(piece)), piece)
    return let(whole_map(spark, whole), lambda maps: bound(lambda *names: F.transform("words", lambda word, i: F.coalesce(
        F.when(rank(maps, word).isNotNull(), F.array(rank(maps, word))), folded(i, names)))))


@lru_cache(maxsize=1)
def plain_pattern() -> re.Pattern:
    """The tokenizer's pattern for texts without characters beyond U+FFFF: with its
    classes written out it needs no property lookups, which take most of the time."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    members = {e: "".join(f"{re.escape(m[0][0])}-{re.escape(m[0][-1])}" for m in regex.finditer(e + "+", every)) for e in (r"\p{L}", r"\p{N}", r"\s")}

    def written(found: re.Match) -> str:
        if found[0] == r"\S":
            return f"[^{members[r'\s']}]"
        inside = re.sub(r"\\p\{[LN]\}|\\s", lambda m: members[m[0]], found[0])
        return inside if found[0].startswith("[") else f"[{inside}]"

    return re.compile(re.sub(r"\[[^\]]*\]|\\p\{[LN]\}|\\[sS]", written, public_tokenizers.PATTERN))


def split_text(text: str, pattern: regex.Pattern = regex.compile(public_tokenizers.PATTERN)) -> list[str]:
    """All matches of the tokenizer's pattern."""
    beyond = len(text.encode("utf-16-le")) > 2 * len(text)
    return (pattern if beyond else plain_pattern()).findall(text)


class Places(dict):
    """Word -> its place; a new word takes the next one."""

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        return place


class Known:
    """Words a task has met, by 128-bit hashes in order of their first half: 20 bytes
    a word instead of some 200 as text in a dictionary."""

    def __init__(self):
        self.first, self.second, self.place = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int32)

    def __len__(self) -> int:
        return len(self.place)

    def add(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The place of each of these distinct words, and which of them are new."""
        halves = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w.encode()) for w in words]), "<u8").reshape(-1, 2)
        order = np.argsort(halves[:, 0])
        first, second = halves[order, 0], halves[order, 1]
        at = np.searchsorted(self.first, first)
        if len(self):
            near = np.minimum(at, len(self) - 1)
            new = (self.first[near] != first) | (self.second[near] != second)
            places = np.where(new, 0, self.place[near]).astype(np.int32)
        else:
            new, places = np.ones(len(words), bool), np.zeros(len(words), np.int32)
        # new words in the order of the batch
        fresh = np.sort(order[new])
        places[new] = len(self) + np.searchsorted(fresh, order[new])
        self.first = np.insert(self.first, at[new], first[new])
        self.second = np.insert(self.second, at[new], second[new])
        self.place = np.insert(self.place, at[new], places[new])
        placed = np.empty(len(words), np.int32)
        placed[order] = places
        return placed, fresh


def split_batches(docs: DataFrame) -> DataFrame:
    """A row for each batch of documents: ids, words a document, each word's place
    among the task's words (int32), how many of these earlier rows of the task have
    brought (0: the task starts anew), the new words as Latin-1 text and their bytes."""
    schema = pa.schema([("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("places", pa.binary()), ("known", pa.int32()), ("words", pa.list_(pa.string())), ("raw", pa.list_(pa.list_(pa.int32())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> pa.RecordBatch:
            before, own = len(known), list(seen)
            placed, fresh = known.add(own)
            new = [own[k].encode() for k in fresh.tolist()]
            words = pa.array([w.decode("latin-1") for w in new], pa.string())
            ends = np.concatenate([[0], np.cumsum([len(w) for w in new])]).astype(np.int32)
            raw = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(new), np.uint8).astype(np.int32)))
            whole = pa.array([0, len(words)], pa.int32())
            one = lambda values, kind: pa.array([values], pa.list_(kind))
            return pa.record_batch([one(ids, pa.int64()), one(counts, pa.int32()), pa.array([placed[np.concatenate(places)].tobytes()]), pa.array([before], pa.int32()),
                                    pa.ListArray.from_arrays(whole, words), pa.ListArray.from_arrays(whole, raw)], schema=schema)

        known, seen, ids, counts, places, held = Known(), Places(), [], [], [], 0
        for batch in slices(batches, most=BATCH_BYTES):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = split_text(text or "")
                places.append(np.fromiter(map(seen.__getitem__, words), np.int32, len(words)))
                ids.append(doc_id), counts.append(len(words))
                held += len(text or "")
                if held >= BATCH_BYTES:
                    yield row()
                    seen, ids, counts, places, held = Places(), [], [], [], 0
                    if len(known) >= KNOWN:
                        known = Known()
        if ids:
            yield row()

    return docs.mapInArrow(run, "doc_ids array<bigint>, counts array<int>, places binary, known int, words array<string>, raw array<array<int>>")


def gathered(offsets: np.ndarray, values: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists at ``places`` one after the other, and the length of each."""
    start = offsets[places]
    size = offsets[places + 1] - start
    ends = np.cumsum(size)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(start, size)
    return values[at], size


def appended(held: np.ndarray, n: int, more: np.ndarray) -> np.ndarray:
    """``held`` with ``more`` after its first n values; its room doubles when it is full."""
    if n + len(more) > len(held):
        held = np.concatenate([held[:n], np.empty(max(n, len(more)), held.dtype)])
    held[n:n + len(more)] = more
    return held


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids binary): little-endian unsigned 32-bit ids of every whole text.

    Null and empty texts have no ids. One row per input row; repeated rows and
    null ids pass through. Further columns are ignored. The ids are written once,
    so that decoding runs beside neither splitting nor merging.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = split_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    found = rows.select("doc_ids", "counts", "places", "known", word_ids(docs.sparkSession, path).alias("tokens"))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, offsets, n = np.empty(0, "<u4"), np.zeros(1, np.int64), 0
        for batch in batches:
            for k in range(batch.num_rows):
                ids, counts, tokens = (batch.column(c)[k].values for c in ("doc_ids", "counts", "tokens"))
                places, known = np.frombuffer(batch.column("places")[k].as_buffer(), np.int32), batch.column("known")[k].as_py()
                if known == 0:
                    n = 0
                if known != n:
                    raise RuntimeError("rows of a task came in another order than they were made")
                # the child of a sliced list begins at its first offset
                ends = tokens.offsets.to_numpy()
                values = appended(values, int(offsets[n]), tokens.values.to_numpy()[ends[0]:ends[-1]])
                offsets = appended(offsets, n + 1, offsets[n] + ends[1:] - ends[0])
                n += len(tokens)
                words = np.concatenate([[0], np.cumsum(counts.to_numpy())])
                for at in range(0, len(ids), 1000):
                    done = [gathered(offsets, values, places[a:b])[0].tobytes() for a, b in zip(words[at:at + 1000].tolist(), words[at + 1:at + 1001].tolist())]
                    yield pa.record_batch([ids[at:at + 1000].cast(pa.int64()), pa.array(done, pa.binary())], schema=schema)

    return settled(found.mapInArrow(run, "doc_id bigint, ids binary"), "bpe-ids", batch_bytes=1 << 20, scan_bytes=SCAN_BYTES)


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, text binary, decoded_sha256): the pieces
    of the ids, one after the other. A null or empty list decodes to nothing."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                        ("text", pa.binary()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(path)
        pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        for batch in slices(batches, "ids", BATCH_BYTES):
            out = []
            for ids in batch.column("ids").to_pylist():
                ids = ids or b""
                text = gathered(offsets, flat, np.frombuffer(ids, "<u4"))[0].tobytes()
                out.append((ids, len(ids) // 4, hashlib.sha256(ids).hexdigest(), text, hashlib.sha256(text).hexdigest()))
            if out:
                yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(zip(*out), list(schema)[1:]))], schema=schema)

    return rows.select("doc_id", "ids").mapInArrow(
        run, "doc_id bigint, ids binary, n_tokens bigint, ids_sha256 string, text binary, decoded_sha256 string")
