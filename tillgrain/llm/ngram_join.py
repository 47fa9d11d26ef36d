"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct five-word shingles; two link when the
Jaccard similarity is 0.75 or more. Shingles have one global order: those that
few documents hold first. Of a set with n shingles any partner shares at least
t = ceil(0.75 n). A prefix of n - t + l shingles then holds at least l of the
shared ones, and more when both sets are of like size: if c shingles are
shared within both prefixes and x is the set whose prefix ends first, all other
shared shingles lie in the rest of x, so |x & y| <= c + max(n_x - p_x, n_y - p_y).
With the overlap that 0.75 asks for, ceil(3 (n_x + n_y) / 7), this gives the
number of matches a pair needs before it is verified. Each document chooses l
by the estimated cost of its candidates: a longer prefix reads more postings
but leaves fewer pairs.

Everything is exact: candidates are a superset of the links, and links are
verified on the whole shingle sets. Pairs are not expanded inside groups:
rare shingles give pairs, shingles in more than LIGHT documents only say that
their documents belong to one cluster. The least l any document may choose is
also the least number of shingles two linked documents share in their prefixes,
so a pair without a rare shingle has that many frequent ones in common. Documents
with as many are suspects. The order of the first prefixes knows the most
frequent shingles only, so passages that a few dozen unlike documents share stand
in them, and would chain most of a large table into one cluster. So suspects are
joined again among themselves, with all their shingles in exact order: a
prefix then holds a frequent shingle only where all but a quarter of the set is
frequent. Of h frequent shingles in it only the first h - l + 1 can be the first
common one; no others make clusters. Clusters are verified inside tasks in blocks of bounded size, which skip pairs that are already
connected; across blocks only documents of different parts meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tillgrain.llm.common import hashed, mixed, raw_texts, rolling, settled, signed, slices, split_words
from tillgrain.llm.components import components

WIDTH = 5
LENGTHS = (16, 24, 32)
#: Shingles in more documents than this make clusters instead of pairs.
LIGHT = 24
#: Documents of a cluster in one block; a task verifies two blocks.
BLOCK = 1024
#: Frequent shingles are found by counts in pieces of COUNT_PIECE shingles; the
#: list that orders them last has at most FREQUENT entries (16 bytes each). It
#: only changes the order, never which pairs are found.
COUNT_PIECE, COUNT_LEAST, FREQUENT = 1 << 20, 3, 1 << 17


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of a text in lower
    case; a shorter text is one shingle, one without words has none."""
    words = hashed(split_words(text.lower()))
    if len(words) < width:
        return signed(mixed(rolling(words, len(words)) + np.uint64(len(words)))) if len(words) else np.empty(0, np.int64)
    return np.unique(signed(rolling(words, width)))


def signature(tokens: np.ndarray) -> tuple[int, int]:
    """128-bit signature of a set."""
    x = tokens.view(np.uint64)
    pair = np.array([mixed(x).sum(dtype=np.uint64), mixed(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)])
    return tuple(signed(pair).tolist())


def profile(docs: DataFrame) -> DataFrame:
    """First pass, rows of two kinds: (0, doc_id, n, s1, s2) for each document and
    (1, shingle, documents, null, null) for shingles frequent in a piece of a task."""
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64())])

    def frequent(pieces: list[np.ndarray]) -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(pieces), return_counts=True)
        often = counts >= COUNT_LEAST
        k = int(often.sum())
        none = pa.nulls(k, pa.int64())
        return pa.record_batch([pa.array(np.ones(k, np.int32)), pa.array(tokens[often]), pa.array(counts[often]), none, none], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, held, seen = [], 0, set()
        for batch in slices(batches):
            n, s1, s2 = [], [], []
            for text in raw_texts(batch):
                tokens = shingles(text)
                sig = signature(tokens)
                n.append(len(tokens)), s1.append(sig[0]), s2.append(sig[1])
                if len(tokens) and sig not in seen:
                    seen.add(sig)
                    pieces.append(tokens)
                    held += len(tokens)
                if held >= COUNT_PIECE:
                    yield frequent(pieces)
                    pieces, held, seen = [], 0, set()
            yield pa.record_batch([pa.array(np.zeros(len(n), np.int32)), batch.column("doc_id"), pa.array(n), pa.array(s1), pa.array(s2)], schema=schema)
        if pieces:
            yield frequent(pieces)

    return docs.mapInArrow(run, "kind int, key bigint, n bigint, s1 bigint, s2 bigint")


def prefix_rows(docs: DataFrame, frequent: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(token, doc_id, place, n): the longest prefix a document may choose. Of
    documents with equal sets in a task only the first is written."""
    schema = pa.schema([("token", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int32()), ("n", pa.int32())])

    def order(tokens: np.ndarray) -> np.ndarray:
        if not len(frequent):
            return tokens
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        often = np.where(frequent[at] == tokens, counts[at], 0)
        return tokens[np.lexsort((tokens, often))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in slices(batches):
            tokens, ids, sizes = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), raw_texts(batch)):
                found = shingles(text)
                sig = signature(found)
                if not len(found) or sig in seen:
                    continue
                seen.add(sig)
                n = len(found)
                tokens.append(order(found)[:n - (3 * n + 3) // 4 + max(LENGTHS)])
                ids.append(doc_id), sizes.append(n)
            if ids:
                k = [len(t) for t in tokens]
                place = np.concatenate([np.arange(x, dtype=np.int32) for x in k])
                yield pa.record_batch([pa.array(np.concatenate(tokens)), pa.array(np.repeat(np.array(ids, np.int64), k)), pa.array(place),
                                       pa.array(np.repeat(np.array(sizes, np.int32), k))], schema=schema)

    return docs.mapInArrow(run, "token bigint, doc_id bigint, place int, n int")


def _least(n: Column) -> Column:
    return F.floor((3 * n + 3) / 4)


def chosen_prefixes(shared: DataFrame) -> DataFrame:
    """(doc_id, n, p): each document's prefix length at the least estimated cost.
    With l extra matches it reads the postings of its prefix and leaves about
    postings / matches needed candidates, each as dear to verify as its set."""
    n = F.col("n")
    base = n - _least(n)
    reads = shared.groupBy("doc_id", "n").agg(*[F.sum(F.when(F.col("place") < base + k, F.col("df") - 1).otherwise(0)).alias(f"r{k}") for k in LENGTHS])
    need = lambda k: F.ceil(6 * n / 7) - _least(n) + k
    costs = [F.struct((F.col(f"r{k}") * (1 + n / need(k))).alias("cost"), F.lit(k).alias("k")) for k in LENGTHS]
    return reads.select("doc_id", "n", F.least(n, base + F.least(*costs)["k"]).cast("int").alias("p"))


def _needed(n: Column) -> Column:
    """Frequent shingles that a pair without a rare one in common shares at least:
    min(LENGTHS), or 0.75 of a set where that is less."""
    return F.least(F.lit(min(LENGTHS)), _least(n))


def prefixes(shared: DataFrame) -> DataFrame:
    """The rows of ``shared`` inside the prefix that each document chooses."""
    return shared.join(chosen_prefixes(shared).hint("merge"), ["doc_id", "n"]).where("place < p")


def frequent_rows(rows: DataFrame) -> DataFrame:
    """The rows of frequent shingles in the shortest prefixes, where two documents
    that link without a rare shingle have enough of them in common."""
    return rows.where(F.col("df") > LIGHT).where(F.col("place") < F.col("n") - _least(F.col("n")) + min(LENGTHS))


def suspects(rows: DataFrame) -> DataFrame:
    """Documents that may link without a rare shingle in common: their prefixes hold
    as many frequent ones as such a pair shares."""
    heavy = frequent_rows(rows).groupBy("doc_id", "n").agg(F.count("*").alias("h"))
    return heavy.where(F.col("h") >= _needed(F.col("n"))).select("doc_id").distinct()


def ordered_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``prefix_rows`` for few documents, in the exact order of the shingles
    by their number among these; ``df`` is that number, 1 left out. A shingle that
    many share comes after all rarer ones, so it is in a prefix only where a quarter
    of the set is not rarer."""
    schema = pa.schema([("token", pa.int64()), ("doc_id", pa.int64()), ("s", pa.int64()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(text) for text in raw_texts(batch)]
            k = [len(x) for x in sets]
            if sum(k):
                each = lambda values: pa.array(np.repeat(np.array(values, np.int64), k))
                yield pa.record_batch([pa.array(np.concatenate(sets)), each(batch.column("doc_id").to_pylist()), each([signature(x)[0] for x in sets]),
                                       each(k).cast(pa.int32())], schema=schema)

    tokens = docs.mapInArrow(run, "token bigint, doc_id bigint, s bigint, n int")
    found = tokens.withColumn("df", F.count("*").over(Window.partitionBy("token")).cast("int")).where("df > 1")
    own = Window.partitionBy("doc_id", "s")
    # the shingles that no other document has come first
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "token")) - 1
    return found.withColumn("place", place.cast("int")).where(F.col("place") < F.col("n") - _least(F.col("n")) + max(LENGTHS)).select("token", "doc_id", "place", "n", "df")


def cluster_shingles(heavy: DataFrame) -> DataFrame:
    """The rows of frequent shingles that can be the first common one of a pair that
    has no rare one in common."""
    rows = Window.partitionBy("doc_id", "n")
    ranked = heavy.withColumn("h", F.count("*").over(rows)).withColumn("rank", F.row_number().over(rows.orderBy("df", "token")))
    return ranked.where(F.col("rank") <= F.col("h") - _needed(F.col("n")) + 1)


def pair_edges(rows: DataFrame, apart: DataFrame | None = None) -> DataFrame:
    """(a, b): pairs with a rare shingle in common and enough matches in their
    prefixes. Two documents of ``apart`` must have enough of rare ones alone: they
    are looked at again."""
    rest = rows.where(F.col("df") > LIGHT).groupBy("doc_id").agg(F.count("*").alias("heavy"))
    light = rows.where(F.col("df") <= LIGHT).select("token", "doc_id", "n", "p")
    a, b = light.alias("a"), light.alias("b")
    pairs = a.join(b, F.expr("a.token = b.token AND a.doc_id < b.doc_id AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)"))
    counted = pairs.groupBy(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb")).agg(
        F.count("*").alias("c"), F.first(F.expr("greatest(a.n - a.p, b.n - b.p)")).alias("beyond"))
    missing = F.ceil(3 * (F.col("na") + F.col("nb")) / 7) - F.col("beyond") - F.col("c")
    rest = rest.withColumn("later", F.lit(False)) if apart is None else rest.join(apart.withColumn("later", F.lit(True)).hint("merge"), "doc_id", "left")
    more = rest.select(F.col("doc_id").alias("a"), F.col("heavy").alias("ha"), F.col("later").alias("la"))
    also = rest.select(F.col("doc_id").alias("b"), F.col("heavy").alias("hb"), F.col("later").alias("lb"))
    both = F.expr("coalesce(la, false) AND coalesce(lb, false)")
    close = counted.withColumn("missing", missing).join(more.hint("merge"), "a", "left").join(also.hint("merge"), "b", "left")
    return close.where(F.col("missing") <= F.when(both, 0).otherwise(F.expr("least(coalesce(ha, 0), coalesce(hb, 0))"))).select("a", "b")


def cluster_edges(rows: DataFrame) -> DataFrame:
    """(a, b): for shingles in many documents the link of each document to the first of them."""
    first = cluster_shingles(frequent_rows(rows))
    hubs = first.groupBy("token").agg(F.min("doc_id").alias("b"))
    return first.join(hubs, "token").select(F.col("doc_id").alias("a"), "b")


def candidate_edges(shared: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(a, b): a superset of the links, or what connects it. Pairs with a rare shingle
    in common come from the prefixes; documents that may link without one are
    ordered again among themselves by exact numbers (from ``docs``) before frequent
    shingles make clusters of them."""
    rows = settled(prefixes(shared), "prefixes")
    if docs is None:
        return pair_edges(rows).unionByName(cluster_edges(rows))
    again = settled(suspects(rows), "suspects")
    tokens = settled(ordered_rows(docs.join(again.hint("merge"), "doc_id").select("doc_id", "text")), "ordered-tokens")
    second = settled(prefixes(tokens), "second-prefixes")
    return pair_edges(rows, again).unionByName(pair_edges(second)).unionByName(cluster_edges(second))


def links_of(ids: np.ndarray, sets: list[np.ndarray], parts: np.ndarray, side: np.ndarray | None) -> list[tuple[int, int]]:
    """Links that connect all similar sets of a task: a spanning forest of them.
    Sets of one part are connected already. ``side``: with two blocks only pairs
    across are compared."""
    sizes = np.array([len(s) for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    marked = np.zeros(int(flat.max()) + 1, np.int32)
    label, found = np.unique(parts, return_inverse=True)[1], []
    for x in range(len(sets)):
        own = flat[starts[x]:starts[x] + sizes[x]]
        want = (label != label[x]) & (4 * np.minimum(sizes, sizes[x]) >= 3 * np.maximum(sizes, sizes[x]))
        if side is None:
            want[:x] = False
        else:
            want &= side != side[x]
            if side[x]:
                continue
        at = np.flatnonzero(want)
        if not len(at):
            continue
        marked[own] = 1
        if len(at) * 2 > len(sets):
            common = np.add.reduceat(marked[flat], starts)[at]
        else:
            k = sizes[at]
            ends = np.cumsum(k)
            place = np.arange(ends[-1]) - np.repeat(ends - k, k) + np.repeat(starts[at], k)
            common = np.add.reduceat(marked[flat[place]], ends - k)
        marked[own] = 0
        for y in at[100 * common >= 75 * (sizes[at] + sizes[x] - common)].tolist():
            if label[y] != label[x]:
                found.append((int(ids[x]), int(ids[y])))
                label[label == label[y]] = label[x]
    return found


def block_links(docs: DataFrame, placed: DataFrame, name: str) -> DataFrame:
    """(a, b): links between documents of different parts, verified on whole sets.
    ``placed`` (doc_id, label, part, i, j, side) names the meetings (label, i, j) a
    document takes part in; where i <> j only documents of unlike side are compared."""
    # a table of its own, so that a large cluster's rows can be split where they meet the texts
    placed = settled(placed, f"{name}-placed")
    # by merge at every size: a plan that broadcasts while tables are small would
    # not show what the join costs when they are not
    rows = docs.join(placed.hint("merge"), "doc_id").select("label", "i", "j", "side", "part", "doc_id", "text")
    dealt = rows.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "doc_id")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def found(key: tuple, ids: list, parts: list, sides: list, sets: list) -> list[tuple[int, int]]:
        if len(ids) < 2:
            return []
        return links_of(np.array(ids), sets, np.array(parts), None if key[1] == key[2] else np.array(sides))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, ([], [], [], []), []
        for batch in slices(batches):
            columns = [batch.column(c).to_pylist() for c in ("label", "i", "j", "doc_id", "part", "side")]
            for label, i, j, doc_id, part, side, text in zip(*columns, raw_texts(batch)):
                if (label, i, j) != key:
                    out += found(key, *held) if key else []
                    key, held = (label, i, j), ([], [], [], [])
                own = shingles(text)
                if len(own):
                    for values, value in zip(held, (doc_id, part, side, own)):
                        values.append(value)
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
                out = []
        out += found(key, *held) if key else []
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    return settled(dealt.mapInArrow(run, "a bigint, b bigint"), name)


def _block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("doc_id"), blocks).cast("int")


def across(placed: DataFrame) -> DataFrame:
    """Meetings of every two documents of a cluster (doc_id, label, part) that are in
    different parts. Those outside the cluster's largest part meet one another and
    all others; the largest part's own blocks do not meet. So a cluster of one part
    is not read, and one of a large part and r others is read 1 + r / BLOCK times."""
    sizes = placed.groupBy("label", "part").agg(F.count("*").alias("k"))
    most = sizes.groupBy("label").agg(F.max(F.struct("k", F.col("part").alias("main"))).alias("most"), F.sum("k").alias("n"))
    blocks = lambda k: F.ceil(k / BLOCK).cast("int")
    split = most.where("n > most.k").select(
        "label", F.col("most.main").alias("main"), blocks(F.col("n") - F.col("most.k")).alias("others"), blocks(F.col("most.k")).alias("mains"))
    at = placed.join(split, "label").withColumn("own", F.when(F.col("part") == F.col("main"), F.col("others") + _block(F.col("mains"))).otherwise(_block(F.col("others"))))
    last = F.when(F.col("part") == F.col("main"), F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1
    met = at.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return met.select("doc_id", "label", "part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("side"))


def verified_links(docs: DataFrame, clusters: DataFrame) -> DataFrame:
    """(a, b): links found inside clusters (node, label), verified on whole sets.

    Documents of a cluster are dealt to blocks, and a task holds one or two, so its
    memory is bounded whatever the cluster's size. First blocks are verified one by
    one. Where a cluster has several, the first documents of the parts found meet,
    which connects like blocks, and then all documents of different parts do.
    """
    sizes = clusters.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    named = clusters.select(F.col("node").alias("doc_id"), "label").join(sizes, "label")
    once = named.withColumn("i", _block(F.col("blocks")))
    links = block_links(docs, once.select("doc_id", "label", F.col("doc_id").alias("part"), "i", F.col("i").alias("j"), F.lit(False).alias("side")), "links")
    wide = settled(named.where("blocks > 1").select("doc_id", "label"), "wide")
    if wide.isEmpty():
        return links

    def parted(links: DataFrame) -> DataFrame:
        found = components(links, "parts").toDF("doc_id", "part")
        return settled(wide.join(found.hint("merge"), "doc_id", "left").select("doc_id", "label", F.coalesce("part", "doc_id").alias("part")), "parted")

    parts = parted(links)
    several = parts.where("doc_id <> part").select("label", "part").distinct()
    links = links.unionByName(block_links(docs, across(several.select(F.col("part").alias("doc_id"), "label", "part")), "first-links"))
    return links.unionByName(block_links(docs, across(parted(links)), "far-links"))


def join_ngrams(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (doc_id, text; further columns are ignored) as doc_id,
    n_shingles, component_id: the smallest doc_id reachable by links.

    Null, empty and blank texts have no shingles and link with nothing. Rows
    that share a doc_id are one document with several texts: what links to one
    of them links to the id. Rows with a null doc_id link with nothing and have
    a null component.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    first = settled(profile(docs), "profile")
    rows = first.where("kind = 0").select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), "s1", "s2")
    often = first.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow()
    by_key = np.argsort(often.column("key").to_numpy())
    named = docs.where("doc_id IS NOT NULL")
    dealt = prefix_rows(named, often.column("key").to_numpy()[by_key], often.column("n").to_numpy()[by_key])
    dealt = dealt.withColumn("df", F.count("*").over(Window.partitionBy("token")).cast("int")).where("df > 1")
    shared = settled(dealt, "shared-tokens")
    clusters = settled(components(settled(candidate_edges(shared, named), "candidates"), "clusters"), "cluster-labels")
    links = verified_links(named, clusters)
    # equal sets are one class; links connect classes
    same = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    heads = settled(same.groupBy("s1", "s2").agg(F.min("doc_id").alias("head")), "heads")
    member = settled(same.join(heads.hint("merge"), ["s1", "s2"]).select("doc_id", "head").distinct(), "members")
    labels = components(links.unionByName(member.where("doc_id <> head").toDF("a", "b")), "link-components")
    labels = settled(labels, "labels").toDF("doc_id", "label")
    return rows.join(labels.hint("merge"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))
