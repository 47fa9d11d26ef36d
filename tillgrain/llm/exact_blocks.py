"""Exact dedup by deterministic block naming: fixed-size blocks are sorted into
integer names, adjacent pairs of names are named again, and so on until every
document has one name, which is its identity.

Only DataFrame functions. Equal content gets equal names because names are given
to distinct contents, compared byte by byte; a hash only deals rows out and
looks names up, and blocks whose hash belongs to several contents are looked up
by content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillgrain.llm.common import settled

BLOCK_BYTES = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Text with A-Z lower-cased and nothing else changed; null is empty. For
    pure ASCII ``lower`` does the same and is quicker."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _named(distinct: DataFrame, key: list[str]) -> DataFrame:
    """Distinct keys with an integer name: rank in the sorted partition, unique across partitions."""
    return distinct.sortWithinPartitions(*key).withColumn("name", F.monotonically_increasing_id())


def block_names(texts: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, at, name) of every fixed-size block of ``texts`` (row, body binary).

    Contents travel once, merged before the shuffle, so a text that a third of
    the rows share costs one row a task; names go back on the 8-byte hash.
    """
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("body") / block_bytes)).cast("int")
    blocks = texts.select("row", "body", F.explode(F.sequence(F.lit(0), count - 1)).alias("at")).select(
        "row", "at", F.substring("body", F.col("at") * block_bytes + 1, F.lit(block_bytes)).alias("content"))
    blocks = blocks.withColumn("h", F.xxhash64("content"))
    distinct = blocks.groupBy("h", "content").agg(F.count("*").alias("uses"))
    names = settled(_named(distinct, ["content"]).select("h", "name", "uses"), "block-names")
    lookup = names.groupBy("h").agg(F.min("name").alias("name"), F.count("*").alias("contents"))
    placed = settled(blocks.select("row", "at", "h").join(lookup, "h"), "blocks").select("row", "at", "h", "name", "contents")
    shared = placed.where("contents > 1").select("h").distinct()
    if shared.isEmpty():
        return placed.select("row", "at", "name")
    # different contents under one hash: name them again and look up by content
    clash = blocks.join(shared, "h")
    again = settled(_named(clash.groupBy("h", "content").agg(F.count("*").alias("uses")), ["content"])
                    .withColumn("name", -1 - F.col("name")), "block-clashes")
    return placed.where("contents = 1").select("row", "at", "name").unionByName(
        clash.join(again, ["h", "content"]).select("row", "at", "name"))


def identities(texts: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, copies, level, name): equal pairs (level, name) exactly for equal
    bodies; ``copies`` counts repeated rows.

    At each level a row with one name is finished; the others have names of
    adjacent blocks paired and named anew, so rounds grow with the logarithm of
    the longest text.
    """
    current = block_names(texts, block_bytes).groupBy("row", "at").agg(F.min("name").alias("name"), F.count("*").alias("copies"))
    current, level, finished = settled(current, "named-0"), 0, []
    while True:
        longer = current.where("at > 0").select("row").distinct()
        finished.append(current.join(longer, "row", "left_anti").select("row", "copies", F.lit(level).alias("level"), "name"))
        pairs = current.join(longer, "row", "left_semi").groupBy("row", F.floor(F.col("at") / 2).cast("int").alias("at")).agg(
            F.min(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("a"),
            F.min(F.when(F.col("at") % 2 == 1, F.col("name"))).alias("b"), F.min("copies").alias("copies"))
        pairs = settled(pairs, f"pairs-{level}")
        if pairs.isEmpty():
            break
        level += 1
        names = settled(_named(pairs.groupBy("a", "b").agg(F.count("*").alias("uses")), ["a", "b"]), f"pair-names-{level}")
        current = settled(pairs.alias("p").join(names.alias("n"), F.expr("p.a = n.a AND p.b <=> n.b")).select(
            "p.row", "p.at", "n.name", "p.copies"), f"named-{level}")
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    return out


def keyed_rows(docs: DataFrame) -> DataFrame:
    """(row, body): the normalised text as bytes under the row's key (id, digest)."""
    text = normalised(F.col("text"))
    return docs.select(F.struct(F.col("doc_id").cast("bigint").alias("id"), F.unhex(F.sha2(F.encode(text, "utf-8"), 256)).alias("sha")).alias("row"),
                       F.encode(text, "utf-8").alias("body"))


def dedup_exact(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of ``docs`` (doc_id, text; further columns are ignored) as doc_id,
    keep_id, group_size, kept, text_sha256.

    Texts are equal after lower-casing A-Z; null counts as empty. The largest
    doc_id of a group stays. Of rows that repeat both doc_id and text one is
    kept. A null doc_id stays only in a group without any other id.
    """
    rows = settled(identities(keyed_rows(docs), block_bytes), "identities")
    groups = settled(rows.groupBy("level", "name").agg(F.max("row.id").alias("keep_id"), F.sum("copies").alias("group_size")), "groups")
    each = rows.join(groups, ["level", "name"]).select("row", "keep_id", "group_size", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return each.select(F.col("row.id").alias("doc_id"), "keep_id", "group_size",
                       (F.col("row.id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
                       F.lower(F.hex("row.sha")).alias("text_sha256"))
