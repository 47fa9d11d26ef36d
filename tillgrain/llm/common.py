"""Shared helpers of the training-data operators: tables, batches and word hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from tillgrain.session import through_table

#: While a step is written: shuffle files go back when it is done, and batches
#: that pass to Python are small however long the texts are.
STEP = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}
SLICE_BYTES = 8 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame, name: str, batch_bytes: int | None = None, scan_bytes: int | None = None) -> DataFrame:
    """``df`` as a durable table in the shared folder; the shuffle files that
    made it are given back at once, so a job's disk use is that of its largest
    step and not the sum of all steps. ``batch_bytes``: size of the batches that
    pass to Python in this step; ``scan_bytes``: of a table's part that a task reads."""
    conf = df.sparkSession.conf
    step = STEP if batch_bytes is None else {**STEP, "spark.sql.execution.arrow.maxBytesPerBatch": str(batch_bytes)}
    if scan_bytes is not None:
        step = {**step, "spark.sql.files.maxPartitionBytes": str(scan_bytes)}
    before = {k: conf.get(k, None) for k in step}
    for k, v in step.items():
        conf.set(k, v)
    try:
        return through_table(df, name)
    finally:
        for k, v in before.items():
            conf.set(k, v) if v is not None else conf.unset(k)


def unused(name: str, columns: Iterable[str]) -> str:
    """``name``, with underscores added until no column is called that."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of the batches with about ``most`` bytes of text each; one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        part = (np.cumsum(sizes) - sizes) // most
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            yield batch.slice(a, b - a)


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of every text; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def split_words(text: bytes) -> list[bytes]:
    """Maximal runs of bytes other than space and 0x09-0x0D, which is what
    ``bytes.split()`` cuts at."""
    return text.split()


def hashed(words: list[bytes]) -> np.ndarray:
    """64-bit hash of every word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalises 64-bit values so that every bit depends on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash (mod 2^64) of every ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = values[:n].copy()
    for k in range(1, width):
        out = out * ODD + values[k:k + n]
    return mixed(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
