"""Secret scans by linking the parts of multipart credentials.

Strong forms are reported wherever they stand: assignments to a secret's name,
access identifiers and long hexadecimal strings. Weak candidates (an account
name, a token that only looks random, an address) are everywhere in clean text;
one is reported only when complementary parts stand in the same scope within
REACH characters. A scope is a paragraph: the text between blank lines.

* a weak secret needs an identifier or an endpoint,
* a weak identifier needs a secret,
* an endpoint needs both a secret and an identifier;

strong spans serve as parts too (access: identifier; assign and hex: secret).
The parts are joined by interval in Spark: each part is dealt to the bins of
REACH characters that it can reach, so a bin holds a bounded number of parts
however long the text is, and a candidate meets one row, its bin.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tillgrain.llm.common import settled, slices

REACH = 400
KINDS = ("assign", "access", "hex", "id", "secret", "endpoint")

# fixed patterns of the strong forms
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Weak identifiers: a value given to an account's name, an e-mail address, or a token of capitals and digits.
NAMED_ID = re.compile(r"(?<![A-Za-z0-9])(?:access[_-]?(?:key[_-]?)?id|client[_-]?id|account(?:[_-]?id)?|user(?:name)?|login|tenant(?:[_-]?id)?)"
                      r"[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@-]{4,}", re.IGNORECASE | re.ASCII)
BARE_ID = re.compile(r"(?<![A-Za-z0-9])(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])[A-Z0-9]{16,}(?![A-Za-z0-9])")
EMAIL = re.compile(r"(?<![\w.+%-])[\w.+%-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])", re.ASCII)
#: Weak secrets: 16 characters or more of a key's alphabet that look random.
BARE_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
LEAST_BITS = 3.0
ENDPOINT = re.compile(r"(?<![A-Za-z0-9])[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s\"'<>]+|(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?::\d{1,5})?(?![\w.]\d)"
                      r"|(?<![\w.-])(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}:\d{2,5}(?!\d)")
BLANK_LINE = re.compile(r"\n[\x20\t\r]*\n")


def strong(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strong spans, in order; kinds are places in KINDS.

    A run of characters of one class is matched whole or not at all, so the
    least length may stand in the pattern of ``access`` and ``hex``; an
    assignment that is too short still uses up its characters.
    """
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def looks_random(token: str) -> bool:
    """Digits and letters, and LEAST_BITS of entropy a character."""
    if not any(c.isdigit() for c in token) or not any(c.isalpha() for c in token):
        return False
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values()) >= LEAST_BITS


def weak(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the weak candidates beside the strong spans, in order.

    Of overlapping candidates the endpoint stays, then the identifier; one that
    overlaps a strong span is part of that.
    """
    found: list[tuple[int, int, int]] = []
    taken = [(a, b) for a, _, b in spans]
    for kind, pattern in ((5, ENDPOINT), (3, NAMED_ID), (3, EMAIL), (3, BARE_ID), (4, BARE_SECRET)):
        new = [(m.start(), m.end()) for m in pattern.finditer(text) if kind != 4 or looks_random(m[0])]
        if new and taken:
            taken.sort()
            starts, reach = np.array([a for a, _ in taken]), np.maximum.accumulate([b for _, b in taken])
            before = np.searchsorted(starts, [b for _, b in new])  # taken spans that start before the candidate ends
            new = [(a, b) for (a, b), i in zip(new, before.tolist()) if not i or reach[i - 1] <= a]
        found += [(a, kind, b) for a, b in new]
        taken += new
    return sorted(found)


def scan(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_assign, n_access, n_hex, base_sha256, base, parts): the strong
    spans of every row and, where it has weak candidates, all its parts. Candidates
    of a text that has no secret at all, or secrets alone, cannot be linked and are left out."""
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
    part = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("scope", pa.int64())])
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
                        ("base_sha256", pa.string()), ("base", pa.list_(span)), ("parts", pa.list_(part))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        row = (task.partitionId() if task else 0) << 33
        for batch in slices(batches):
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text = text or ""
                base = strong(text)
                maybe = weak(text, base)
                kinds = Counter(k for _, k, _ in base)
                parts = []
                both = {role(k) for _, k, _ in base + maybe}
                if maybe and "secret" in both and len(both) > 1:
                    blanks = np.array([m.end() for m in BLANK_LINE.finditer(text)], np.int64)
                    every = sorted(base + maybe)
                    scopes = np.searchsorted(blanks, [a for a, _, _ in every], side="right").tolist()
                    parts = [{"start": a, "kind": k, "end": b, "scope": s} for (a, k, b), s in zip(every, scopes)]
                digest = hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
                out.append((row, doc_id, kinds[0], kinds[1], kinds[2], digest, [{"start": a, "kind": k, "end": b} for a, k, b in base], parts))
                row += 1
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "row bigint, doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, "
                                "base array<struct<start:bigint,kind:int,end:bigint>>, parts array<struct<start:bigint,kind:int,end:bigint,scope:bigint>>")


def role(kind: int) -> str:
    return ("secret", "id", "secret", "id", "secret", "endpoint")[kind]


def linked(found: DataFrame, reach: int = REACH) -> DataFrame:
    """(row, links): the weak candidates with complementary parts in reach."""
    parts = found.select("row", F.explode("parts").alias("p")).select("row", "p.*")
    parts = parts.withColumn("bin", F.floor(F.col("start") / reach))
    roles = F.element_at(F.array(*(F.lit(role(k)) for k in range(len(KINDS)))), F.col("kind") + 1)
    dealt = parts.select("row", "scope", F.explode(F.sequence(F.col("bin") - 1, F.col("bin") + 1)).alias("bin"),
                         F.struct(roles.alias("role"), F.col("start").alias("at")).alias("part"))
    bins = dealt.groupBy("row", "scope", "bin").agg(F.collect_list("part").alias("around"))

    def near(name: str) -> Column:
        return F.exists("around", lambda p: (p["role"] == name) & (F.abs(p["at"] - F.col("start")) <= reach))

    goes = (F.when(F.col("kind") == 3, near("secret")).when(F.col("kind") == 4, near("id") | near("endpoint"))
            .when(F.col("kind") == 5, near("secret") & near("id")))
    links = parts.where("kind >= 3").join(bins, ["row", "scope", "bin"]).where(goes)
    return links.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("links"))


def scan_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Rows of ``docs`` (doc_id, text; further columns are ignored) as doc_id,
    n_assign, n_access, n_hex, base_sha256 and found: the strong spans and the
    linked weak ones (start, kind, end; code points, end exclusive), by start, then kind.

    Null and empty texts have no spans. Every row is scanned alone, so repeated
    rows and null ids are treated alike. Spans of different kinds may overlap if
    strong; those of equal start are ordered by kind as in KINDS.
    """
    rows = settled(scan(docs), "secret-parts")
    links = settled(linked(rows.where(F.size("parts") > 0).select("row", "parts"), reach), "secret-links")
    spans = F.array_sort(F.concat("base", F.coalesce("links", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))))
    return rows.join(links, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), kind_name(s["kind"]).alias("kind"), s["end"].alias("end"))).alias("found"))


def kind_name(kind: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), kind + 1)
