"""Incremental ingest of sequence files as two streams.

The first takes the files not read yet, each by its own header, and lands their
events. The second passes on the events that no batch has had before: what has
been seen is kept as state in RocksDB, so a batch looks up its own events and
never reads the table, however large that has grown.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tremorframe.sources.lines import literal_path
from tremorframe.sources.sequences import read_with_report, well_formed

# Two rows with these equal are one event; the hash alone would not be enough.
KEY = ["eq_id", "event_id", "t_us", "lat", "lon", "depth", "mag", "mag_type"]
FILES = "path string, modificationTime timestamp, length long, content binary"
LANDED = (
    "eq_id string, event_id long, t_us long, lat double, lon double, depth double, mag double, mag_type string, "
    "stored boolean, landed timestamp"
)
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # a batch then writes its changes, not all of the state
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def _finish(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    query = (
        rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def _land(events: DataFrame, path: str, stored: bool = False) -> None:
    rows = events.select(*KEY, F.lit(stored).alias("stored"), F.current_timestamp().alias("landed"))
    rows.write.mode("overwrite").parquet(path)


def stream_ingest(
    spark: SparkSession,
    path: str,
    sink: str,
    checkpoint: str,
    layout: str = "iso",
    max_files: int = 10_000,
    forget_after: str | None = None,
) -> DataFrame:
    """Load the files of folder ``path`` not loaded yet into the Parquet table ``sink``.

    The checkpoint remembers which files were read, so a second run only takes
    new ones, ``max_files`` per batch. Events that a file repeats, or that another
    batch has had, are left out, so the table does not depend on ``max_files``.
    Every batch of either stream overwrites a folder of its own: one repeated after a
    failure leaves no duplicates. Files that cannot be read, or have no header,
    are passed over and tried again by each later run.

    The state holds the events seen, on the executors' disks and in the
    checkpoint; with ``forget_after`` (such as ``90 days``) only those that arrived
    within that time, and one that is repeated later counts as new. A new
    checkpoint beside an old table begins by taking the table's events into the
    state, once. Returns the table.
    """
    landing, bad = f"{checkpoint}/landing", f"{checkpoint}/bad"
    run = _table(spark, f"{checkpoint}/run")
    fresh = run is None
    name = uuid.uuid4().hex if fresh else run.first()["run"]

    def pass_on(batch: DataFrame, batch_id: int) -> None:
        new = batch.filter(~F.col("stored")).select(*KEY)
        new.write.mode("overwrite").parquet(f"{sink}/part={name}-{batch_id}")

    def settle() -> None:
        """Pass on what has landed; landed files are removed once that is done."""
        rows = spark.readStream.schema(LANDED).option("cleanSource", "delete").parquet(f"{landing}/*")
        if forget_after:
            rows = rows.withWatermark("landed", forget_after).dropDuplicatesWithinWatermark(KEY)
        else:
            rows = rows.dropDuplicates(KEY)
        with _settings(spark, STATE):
            _finish(rows, pass_on, f"{checkpoint}/seen")

    def take(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        paths = [literal_path(r[0]) for r in batch.collect()]  # at most max_files
        if paths:
            events, report = read_with_report(session, paths, layout)
            _land(well_formed(events), f"{landing}/batch-{batch_id}")
            report.filter("status in ('failed', 'parse_error')").write.mode("overwrite").parquet(f"{bad}/batch={batch_id}")

    if fresh:
        stored = _table(spark, sink)
        if stored is not None:
            _land(stored, f"{landing}/stored", stored=True)
            settle()
        spark.createDataFrame([(name,)], "run string").coalesce(1).write.mode("overwrite").parquet(f"{checkpoint}/run")
    again = _table(spark, bad)
    if again is not None and (paths := [literal_path(r[0]) for r in again.select("source_file").distinct().collect()]):
        # equal events that land once more are known by then
        _land(well_formed(read_with_report(spark, paths, layout)[0]), f"{landing}/again-{uuid.uuid4().hex}")
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", max_files).load(path)
    _finish(files.select("path"), take, f"{checkpoint}/files")
    settle()
    return spark.read.parquet(sink).drop("part")
