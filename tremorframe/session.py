"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the operators are designed around. A hot sequence may
# hold a large share of all events: AQE splits its join partition, also where
# the split costs the next aggregation one more exchange.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # folders of many small files are listed in tasks; by default up to 10,000 of them, of a few milliseconds
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "256",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", app: str = "tremorframe", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    parallel = os.cpu_count() if cpus == "*" else int(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        # call sites for error messages cost several driver calls per expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(max(parallel, 4)))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is the cluster's ``spark.checkpoint.dir``. Only a local session without
    that setting gets a temporary folder; a cluster without it is an error,
    since executors on other machines could not see a local one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="tremorframe-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch root."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    made = getattr(_APART, "made", None)
    if made is None and _OPEN_JOBS:
        made = _OPEN_JOBS[-1]
    if made is not None:
        made.append(path)
    return path


_OPEN_JOBS: list[list[str]] = []
_APART = threading.local()  # tables of one thread, so that none of another is removed with them


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def job_scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the scratch tables made inside when the job ends, also after an error.

    What the job returns must not read them any more, see ``settled``.
    """
    made: list[str] = []
    _OPEN_JOBS.append(made)
    try:
        yield
    finally:
        _OPEN_JOBS.remove(made)
        for path in made:
            _remove(spark, path)


def settled(report: DataFrame) -> DataFrame:
    """A report of a few rows, computed now."""
    return report.sparkSession.createDataFrame(report.collect(), report.schema)


# Shuffle files otherwise stay until the driver's garbage collector finds that nothing names them.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FREEING: list[str] = []
_FREEING_LOCK = threading.Lock()


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Remove the shuffle files of a write as soon as it ends; also of writes in other threads.

    Not for a result that is run again: it would have to shuffle again.
    """
    with _FREEING_LOCK:
        _FREEING.append(FREE_SHUFFLES)
        spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        with _FREEING_LOCK:
            _FREEING.pop()
            if not _FREEING:
                spark.conf.unset(FREE_SHUFFLES)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the scratch folder and read it back.

    For results used by several later jobs: the work is done once, the lineage
    is cut, and a lost executor costs only a re-read of the files. What the write
    shuffled is not needed any more then, and is removed.
    """
    return _written(df, scratch_path(df.sparkSession, name))


def _written(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    with freed_shuffles(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing_table(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """A staged table that only the writes inside read; it is removed when they have ended."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    try:
        yield _written(df, path)
    finally:
        _remove(spark, path)


def stage_apart(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``make()`` staged, and the tables this thread staged on the way to it removed."""
    path = scratch_path(spark, name)
    outer, _APART.made = getattr(_APART, "made", None), []
    try:
        return _written(make(), path)
    finally:
        made, _APART.made = _APART.made, outer
        for each in made:
            _remove(spark, each)
