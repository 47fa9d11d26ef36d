"""Substring dedup by a run-length suffix index.

Every byte goes that lies in a ``LENGTH``-byte string which also starts somewhere
else in the corpus.

1. A sample of all 32-byte grams, chosen by their hash, is counted. A repeated
   string holds repeated grams only, so stretches without a unique sampled gram
   are all that can repeat.
2. Stretches are cut into contexts: runs of string starts with the same least
   gram. Equal strings have the same least gram, so all their occurrences meet
   under one key; each start lies in exactly one context.
3. Contexts that occur more than once repeat as a whole. The different contexts
   of a key are indexed: from their suffixes the run-compressed Burrows-Wheeler
   transform is kept, with the text places sampled at both ends of each run.
   Matches that cannot be extended to the left lie at run ends, so the samples
   give the matching statistics of every place in one pass along the text;
   stretches of LENGTH or more are marked.
4. A key whose contexts exceed one index is split over several; what an index
   cannot tell, strings that occur once in it, is counted over all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from tillgrain.llm.common import ODD, mixed, raw_texts, settled, signed, slices

LENGTH = 400
GRAM = 32
#: One gram in this many is sampled.
EVERY = 32
INDEX_BYTES = 1 << 20
#: Start given in a packet to a string that is known to repeat.
KNOWN = -1
_SEGMENT = 2 << 20
_TABLE = mixed(np.arange(1, 257, dtype=np.uint64))
_INVERSE = np.uint64(pow(int(ODD), -1, 1 << 64))
_TOP = np.uint64(1 << 63)


def rolled(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive bytes, made in segments of bounded size."""
    n = len(data) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(n, np.uint64)
    for a in range(0, n, _SEGMENT):
        part = data[a:min(a + _SEGMENT, n) + width - 1]
        up = np.cumprod(np.full(len(part), ODD))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[part] * up)])
        k = len(part) - width + 1
        down = np.cumprod(np.full(k, _INVERSE))
        out[a:a + k] = mixed((sums[width:] - sums[:k]) * down)
    return out


def ordered_grams(data: np.ndarray) -> np.ndarray:
    """Hashes of all grams with the top bit set on those that are not sampled, so
    that sampled ones come first in order."""
    h = rolled(data, GRAM)
    return np.where(h % np.uint64(EVERY) == 0, h & ~_TOP, h | _TOP)


def sampled_rows(docs: DataFrame) -> DataFrame:
    """(h, doc_id, known, many): sampled grams of all documents. Within a batch a
    gram that occurs twice is known to repeat; one row of it, ``many``, tells the
    other batches. Documents with a place that no sampled gram covers get a known
    row of their own, so that later steps see them."""
    schema = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("known", pa.bool_()), ("many", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=4 << 20):
            found, docs_of, bare = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), raw_texts(batch)):
                if len(text) < LENGTH:
                    continue
                grams = ordered_grams(np.frombuffer(text, np.uint8))
                at = np.flatnonzero(grams < _TOP)
                found.append(grams[at])
                docs_of.append(np.full(len(at), doc_id, np.int64))
                if np.diff(np.concatenate([[-1], at, [len(grams)]])).max() > LENGTH - GRAM + 1:
                    bare.append(doc_id)
            if not found:
                continue
            h, doc = np.concatenate(found), np.concatenate(docs_of)
            order = np.argsort(h, kind="stable")
            h, doc = signed(h[order]), doc[order]
            new = np.concatenate([[True], h[1:] != h[:-1]])[:len(h)]
            size = np.diff(np.append(np.flatnonzero(new), len(h)))
            many = np.repeat(size > 1, size)
            once = many & (new | np.concatenate([[True], doc[1:] != doc[:-1]])[:len(h)])
            zero = np.zeros(len(bare), np.int64)
            rows = [np.concatenate([h[new], h[once], zero]), np.concatenate([doc[new], doc[once], np.array(bare, np.int64)]),
                    np.concatenate([np.zeros(new.sum(), bool), np.ones(once.sum() + len(bare), bool)]),
                    np.concatenate([many[new], np.ones(once.sum() + len(bare), bool)])]
            yield pa.record_batch([pa.array(c) for c in rows], schema=schema)

    return docs.mapInArrow(run, "h bigint, doc_id bigint, known boolean, many boolean")


def repeated_of(rows: DataFrame, carried: str, schema: pa.Schema) -> DataFrame:
    """Of rows (h, known, many, ...) those that are known, or whose h has another
    row. Rows are dealt out and sorted by h; one row is held back at a time."""
    key = F.when(F.col("known"), F.xxhash64("h", *schema.names[1:])).otherwise(F.col("h"))
    dealt = rows.repartition(key).sortWithinPartitions("known", "h")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (row, whether it is already known to repeat)
        for batch in batches:
            if not batch.num_rows:
                continue
            known, many = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("known", "many"))
            h = batch.column("h").to_numpy()
            same = np.zeros(len(h) + 1, bool)
            same[1:-1] = (h[1:] == h[:-1]) & ~known[1:] & ~known[:-1]
            rows = batch.select(names)
            if held is not None:
                same[0] = bool(h[0] == held[0].column("h")[0].as_py() and not known[0])
                if same[0] or held[1]:
                    yield held[0]
            yes = known | many | same[:-1] | same[1:]
            last = len(h) - 1
            if known[last]:
                held = None
                picked = rows.filter(pa.array(yes))
            else:
                held = (rows.slice(last, 1), bool(yes[last]))
                picked = rows.slice(0, last).filter(pa.array(yes[:last]))
            if picked.num_rows:
                yield picked
        if held is not None and held[1]:
            yield held[0]

    return dealt.mapInArrow(run, carried)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values."""
    n = len(values) - width + 1
    full = -(-len(values) // width) * width
    blocks = np.concatenate([values, np.full(full - len(values), np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def contexts_of(text: bytes, repeated: np.ndarray) -> Iterator[tuple[int, int, int, bool]]:
    """(key, first start, last start, twice) of the contexts of a text whose sampled
    grams in ``repeated`` (sorted) are not unique. ``twice``: the key's gram occurs
    again in the context, which only then can hold equal strings itself."""
    if len(text) < LENGTH:
        return
    grams = ordered_grams(np.frombuffer(text, np.uint8))
    at = np.flatnonzero(grams < _TOP)
    own = signed(grams[at])
    place = np.minimum(np.searchsorted(repeated, own), max(len(repeated) - 1, 0))
    unique = at[repeated[place] != own] if len(repeated) else at
    n, reach = len(text) - LENGTH + 1, LENGTH - GRAM
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.clip(unique - reach, 0, n), 1)
    np.add.at(edge, np.clip(unique + 1, 0, n), -1)
    open_ = np.cumsum(edge[:n]) == 0
    turns = np.flatnonzero(np.diff(np.concatenate([[0], open_.astype(np.int8), [0]])))
    for a, b in zip(turns[::2].tolist(), turns[1::2].tolist()):  # starts a .. b - 1
        least = signed(sliding_least(grams[a:b + reach], reach + 1))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(least)) + 1, [b - a]])
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            inside = grams[a + x:a + y + reach] == grams[a:b + reach].dtype.type(least[x].view(np.uint64))
            yield int(least[x]), a + x, a + y - 1, int(np.count_nonzero(inside)) > 1


CONTEXT = "key bigint, c bigint, n int, twice boolean, doc_id bigint, th bigint, lo bigint, body binary"


def context_rows(docs: DataFrame) -> DataFrame:
    """A row for each context of ``docs`` (doc_id, th, text, grams); its bytes only
    with the first of equal ones in a batch."""
    schema = pa.schema([("key", pa.int64()), ("c", pa.int64()), ("n", pa.int32()), ("twice", pa.bool_()), ("doc_id", pa.int64()), ("th", pa.int64()), ("lo", pa.int64()), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=4 << 20):
            out, seen = [], set()
            for doc_id, th, text, grams in zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), raw_texts(batch), batch.column("grams")):
                for key, a, b, twice in contexts_of(text, np.sort(grams.values.to_numpy())):
                    body = text[a:b + LENGTH]
                    c = xxhash.xxh3_64_intdigest(body) - (1 << 63)
                    out.append((key, c, len(body), twice, doc_id, th, a, None if (key, c) in seen else body))
                    seen.add((key, c))
            if out:
                yield pa.record_batch([pa.array(v, f.type) for v, f in zip(zip(*out), schema)], schema=schema)

    return docs.mapInArrow(run, CONTEXT)


def suffix_order(symbols: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Suffix array by prefix doubling of the suffixes still alike, and the ranks
    by the first ``level`` symbols (None if all differ before). Separators are
    symbols of their own, so every suffix ends at one."""
    n = len(symbols)
    pad = np.concatenate([symbols, np.zeros(3, np.int64)])
    bits = int(symbols.max()).bit_length()
    first = (pad[:n] << (2 * bits)) | (pad[1:n + 1] << bits) | pad[2:n + 2]
    sa = np.argsort(first, kind="stable")
    new = np.concatenate([[True], first[sa][1:] != first[sa][:-1]])
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h, at_level = 3, None
    while True:
        if h == level:
            at_level = rank.copy()
        alike = ~(new & np.append(new[1:], True))
        act = np.flatnonzero(alike)
        if not len(act):
            return sa, at_level
        p = sa[act]
        ahead = np.where(p + h < n, rank[np.minimum(p + h, n - 1)] + 1, 0)
        key = rank[p] * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        p, key = p[order], key[order]
        sa[act] = p
        starts = np.concatenate([[True], key[1:] != key[:-1]])
        new[act] = starts
        rank[p] = np.maximum.accumulate(np.where(starts, act, 0))
        h *= 2


@dataclass
class RunIndex:
    """Run-compressed Burrows-Wheeler transform of a text: the runs' symbols and
    lengths, and the text places of the first and last suffix of each run."""

    heads: np.ndarray
    lengths: np.ndarray
    firsts: np.ndarray
    lasts: np.ndarray

    @classmethod
    def of(cls, symbols: np.ndarray, sa: np.ndarray) -> RunIndex:
        bwt = symbols[sa - 1]
        starts = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        ends = np.append(starts[1:], len(sa))
        return cls(bwt[starts], ends - starts, sa[starts], sa[ends - 1])

    def matching_statistics(self, symbols: np.ndarray, ranks: np.ndarray, level: int, least: int) -> np.ndarray:
        """For every place the length of its longest match elsewhere, as far as it is
        ``least`` or more (0 otherwise), from the samples at run ends alone."""
        n = len(symbols)
        p, q = self.lasts[:-1], self.firsts[1:]  # neighbours with different symbols before them
        rest = least - level
        inside = np.maximum(p, q) + least <= n
        p, q = p[inside], q[inside]
        alike = (ranks[p] == ranks[q]) & (ranks[p + rest] == ranks[q + rest])
        p, q = p[alike], q[alike]
        length = np.full(len(p), least)
        going = np.arange(len(p))
        while len(going):
            a, b = p[going] + length[going], q[going] + length[going]
            going = going[(np.maximum(a, b) < n) & (symbols[np.minimum(a, n - 1)] == symbols[np.minimum(b, n - 1)])]
            length[going] += 1
        ends = np.zeros(n, np.int64)
        np.maximum.at(ends, p, p + length)
        np.maximum.at(ends, q, q + length)
        ahead = np.maximum.accumulate(ends) - np.arange(n)
        return np.where(ahead >= least, ahead, 0)


LEVEL = 3 << 7  # 384 symbols


def marked_windows(bodies: list[bytes]) -> np.ndarray:
    """For the bodies one after the other, each with one separator behind it:
    whether the LENGTH-byte string at a place also starts elsewhere in them."""
    k = len(bodies)
    size = np.array([len(b) for b in bodies])
    symbols = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8).astype(np.int64) + k
    ends = np.cumsum(size + 1) - 1
    symbols[ends] = np.arange(k)
    sa, ranks = suffix_order(symbols, LEVEL)
    if ranks is None:
        return np.zeros(len(symbols), bool)
    return RunIndex.of(symbols, sa).matching_statistics(symbols, ranks, LEVEL, LENGTH) >= LENGTH


def runs_of(starts: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans covered by strings at the flagged starts."""
    at = np.flatnonzero(starts)
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) > LENGTH)
    return list(zip(at[np.append(0, cuts + 1)].tolist(), (at[np.append(cuts, len(at) - 1)] + LENGTH).tolist()))


def indexed(different: DataFrame) -> DataFrame:
    """(key, c, a, b, packet, body): spans of contexts found in their index, and for
    keys split over several indexes packets of what one of them cannot tell. A
    packet has the strings whose hash falls to it: those that occur once in the
    index, with their context and start, and one of each that repeats in it."""
    schema = pa.schema([("key", pa.int64()), ("c", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("packet", pa.int32()), ("body", pa.binary())])

    def done(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        bodies = [r[2] for r in rows]
        marked, out, parts = marked_windows(bodies), [], rows[0][4]
        starts = np.cumsum([0] + [len(b) + 1 for b in bodies])
        once, often = [], []
        for (key, c, body, uses, _), at in zip(rows, starts.tolist()):
            n = len(body) - LENGTH + 1
            own = marked[at:at + n]
            if uses == 1:
                out += [(key, c, a, b, None, None) for a, b in runs_of(own)]
            if parts > 1:
                h = signed(rolled(np.frombuffer(body, np.uint8), LENGTH))
                known = own | (uses > 1)
                left = np.flatnonzero(~known)
                once.append(np.stack([h[left], np.full(len(left), c), left]))
                often.append(h[known])
        if parts > 1:
            often = np.unique(np.concatenate(often))
            found = np.concatenate([*once, np.stack([often, np.zeros(len(often), np.int64), np.full(len(often), KNOWN)])], axis=1)
            to = (found[0].view(np.uint64) >> np.uint64(33)) % np.uint64(parts)
            for packet in np.unique(to).tolist():
                out.append((rows[0][0], None, None, None, packet, np.ascontiguousarray(found[:, to == packet]).tobytes()))
        for i in range(0, len(out), 20_000):
            yield pa.record_batch([pa.array(v, f.type) for v, f in zip(zip(*out[i:i + 20_000]), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in slices(batches, "body", 1 << 20):
            columns = (batch.column(c).to_pylist() for c in ("bucket", "part", "key", "c", "body", "uses", "parts"))
            for bucket, part, *row in zip(*columns):
                if (bucket, part) != group:
                    if rows:
                        yield from done(rows)
                    group, rows = (bucket, part), []
                rows.append(tuple(row))
        if rows:
            yield from done(rows)

    dealt = different.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "key", "c")
    return dealt.mapInArrow(run, "key bigint, c bigint, a bigint, b bigint, packet int, body binary")


def crossing_spans(packets: DataFrame) -> DataFrame:
    """(key, c, a, b): strings that repeat only over the indexes of a split key."""
    schema = pa.schema([(n, pa.int64()) for n in ("key", "c", "a", "b")])

    def done(key: int, bodies: list[bytes]) -> Iterator[pa.RecordBatch]:
        h, c, at = np.concatenate([np.frombuffer(b, np.int64).reshape(3, -1) for b in bodies], axis=1)
        _, place, count = np.unique(h, return_inverse=True, return_counts=True)
        picked = (count[place] > 1) & (at != KNOWN)
        if picked.any():
            c, at = c[picked], at[picked]
            order = np.lexsort((at, c))
            c, at = c[order], at[order]
            first = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (at[1:] != at[:-1] + 1)]))
            last = np.append(first[1:], len(c)) - 1
            yield pa.record_batch([pa.array(np.full(len(first), key)), pa.array(c[first]), pa.array(at[first]), pa.array(at[last] + LENGTH)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, bodies = None, []
        for batch in batches:
            for key, packet, body in zip(*(batch.column(c).to_pylist() for c in ("key", "packet", "body"))):
                if (key, packet) != group:
                    if bodies:
                        yield from done(group[0], bodies)
                    group, bodies = (key, packet), []
                bodies.append(body)
        if bodies:
            yield from done(group[0], bodies)

    return packets.repartition("key", "packet").sortWithinPartitions("key", "packet").mapInArrow(run, "key bigint, c bigint, a bigint, b bigint")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, th, spans): bytes to remove from each row of ``docs`` (doc_id, th, text)."""
    grams = repeated_of(sampled_rows(docs.select("doc_id", "text")), "h bigint, doc_id bigint", pa.schema([("h", pa.int64()), ("doc_id", pa.int64())]))
    grams = settled(grams.groupBy("doc_id").agg(F.collect_set("h").alias("grams")), "grams")
    # by merge at every size, like the last join
    seen = settled(context_rows(docs.join(grams.hint("merge"), "doc_id").select("doc_id", "th", "text", "grams")), "contexts")
    forms = seen.groupBy("key", "c", "n", "twice").agg(F.count("*").alias("uses"), F.first("body", ignorenulls=True).alias("body"))
    forms = settled(forms, "context-forms")
    keys = forms.groupBy("key").agg(F.count("*").alias("forms"), F.sum("n").alias("bytes"), F.bool_or("twice").alias("twice")).where("forms > 1 OR twice").drop("twice")
    keys = settled(keys, "context-keys")
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    buckets, parts = max(1, -(-total // INDEX_BYTES)), F.ceil(F.col("bytes") / INDEX_BYTES)
    different = forms.join(keys.withColumn("parts", parts), "key").select(
        "key", "c", "body", "uses", "parts",
        # a key of more than one index has indexes of its own
        F.when(F.col("parts") > 1, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(buckets))).alias("bucket"),
        F.when(F.col("parts") > 1, F.pmod(F.xxhash64("c"), F.col("parts")) + 1).otherwise(F.lit(0)).alias("part"))
    marks = settled(indexed(different), "marks")
    crossing = crossing_spans(marks.where("packet IS NOT NULL").select("key", "packet", "body"))
    whole = forms.where("uses > 1").select("key", "c", F.lit(0).cast("bigint").alias("a"), F.col("n").cast("bigint").alias("b"))
    spans = marks.where("packet IS NULL").select("key", "c", "a", "b").unionByName(crossing).unionByName(whole)
    spans = settled(spans.groupBy("key", "c").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "spans")
    placed = seen.select("key", "c", "doc_id", "th", "lo").join(spans, ["key", "c"])
    moved = F.transform("spans", lambda s: F.struct((s["a"] + F.col("lo")).alias("a"), (s["b"] + F.col("lo")).alias("b")))
    return placed.groupBy("doc_id", "th").agg(F.flatten(F.collect_list(moved)).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal spans of overlapping or touching ones."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(s) for s in out]


def dedup_suffixes(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (doc_id, text; further columns are ignored) as doc_id,
    n_bytes, n_removed, n_spans, kept binary, kept_sha256.

    Null and empty texts have no bytes and an empty remainder. Every row counts
    as a text of its own, so repeated rows of LENGTH bytes or more lose all of
    them. Rows with a null doc_id are kept whole and count for nobody.
    """
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    spans = settled(repeated_spans(keyed.where("doc_id IS NOT NULL")), "document-spans")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text, found in zip(raw_texts(batch), batch.column("spans")):
                gone = merged(list(zip(*(found.values.field(c).to_pylist() for c in ("a", "b"))))) if found.is_valid else []
                parts, last = [], 0
                for a, b in gone:
                    parts.append(text[last:a])
                    last = b
                kept = b"".join(parts) + text[last:]
                out.append((len(text), len(text) - len(kept), len(gone), kept, hashlib.sha256(kept).hexdigest()))
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(v, f.type) for v, f in zip(zip(*out), list(schema)[1:]))], schema=schema)

    return keyed.join(spans.hint("merge"), ["doc_id", "th"], "left").select("doc_id", "text", "spans").mapInArrow(
        run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string")
