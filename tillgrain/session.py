"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tillgrain")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # small local inputs: keep all cores busy instead of merging partitions
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Only where ``spark.checkpoint.dir`` is unset (local tests) a temporary
    folder is taken and set, so that ``checkpoint()`` works as well.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    fresh = tempfile.mkdtemp(prefix="tillgrain-")
    atexit.register(shutil.rmtree, fresh, ignore_errors=True)
    sc.setCheckpointDir(fresh)
    return sc.getCheckpointDir() or fresh


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of this run below the shared one."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Paths made inside the runs that are open, innermost last.
_RUNS: list[list[str]] = []


def run_path(spark: SparkSession, name: str) -> str:
    """Fresh path below the shared folder for one run's table."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    if _RUNS:
        _RUNS[-1].append(path)
    return path


@contextmanager
def run_tables(spark: SparkSession) -> Iterator[list[str]]:
    """A run: the intermediate tables written inside are dropped at its end, so
    results must have been written or collected by then. Without a run they stay,
    because a lazy result may still read them."""
    made: list[str] = []
    _RUNS.append(made)
    try:
        yield made
    finally:
        _RUNS.remove(made)
        for path in made:
            drop_path(spark, path)


#: What the open query calls have stored, innermost last.
_CALLS: list[dict] = []


@contextmanager
def shared_tables() -> Iterator[None]:
    """A query call: a table that several of its operators need is made once."""
    _CALLS.append({})
    try:
        yield
    finally:
        _CALLS.pop()


def once(key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """The table made for ``key`` in this query call; outside of one, a new table.
    Frames in a key stand for themselves, not for equal ones."""
    if not _CALLS:
        return make()
    made, plain = _CALLS[-1], tuple(id(k) if isinstance(k, DataFrame) else k for k in key)
    if plain not in made:
        made[plain] = (make(), key)  # the key's frames live on, so that no other gets their id
    return made[plain][0]


def made(key: tuple) -> DataFrame | None:
    """The table that this query call has made for ``key``, if it has."""
    return _CALLS[-1][key][0] if _CALLS and key in _CALLS[-1] else None


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


#: gives the shuffle files of a query back when it has ended
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def through_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back.

    Cuts lineage with a durable table: losing an executor costs a re-read, not
    a recomputation, and every later branch reads the same rows. The shuffle files
    that made it are given back at once, so a query's disk use is that of its
    largest step and its tables, not the sum of all steps.
    """
    return stored(df, run_path(df.sparkSession, name))


def stored(df: DataFrame, path: str) -> DataFrame:
    """``through_table`` at a path of the caller's, who may drop it when nothing reads it again."""
    with settings(df.sparkSession, {SHUFFLE_CLEANUP: "true"}):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
