"""Table sinks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, functions as F


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    single_file: bool = False,
    mode: str = "overwrite",
    counted: Observation | None = None,
) -> str:
    """Write ``df`` as Parquet or CSV with header.

    ``counted`` receives the number of rows written as ``n``, without a second
    computation.

    Partitioned writes rebalance on the partition columns first: few files per
    folder, and AQE splits a folder that is too large for one task.
    ``single_file`` is for small exports only.
    """
    if fmt not in ("parquet", "csv"):
        raise ValueError("fmt is parquet or csv")
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    if single_file:
        df = df.coalesce(1)
    if counted is not None:
        df = df.observe(counted, F.count(F.lit(1)).alias("n"))
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    getattr(writer, fmt)(path)
    return path


def write_files(rows: DataFrame, path: str) -> str:
    """Write the lines ``value`` to text files named ``file``, below their line ``head``; a pattern for their folders.

    For many small files: a folder of Spark's for each costs far more than its
    lines do. Every task has a folder instead, in which it writes one file after
    another, so a file with more rows than a task takes has a part in several
    folders, each below ``head`` unless that is null. A repeated task writes the same
    names again. Rows without a name have no file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
        folder = f"{base}/part-{TaskContext.get().partitionId():05d}"
        name, count = None, 0
        with ExitStack() as opened:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if name is None:
                    store.create_dir(folder)
                names, values = batch["file"].to_numpy(zero_copy_only=False), batch["value"].to_pylist()
                heads = batch["head"]
                ends = [*(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
                for start, end in zip([0, *ends], ends):
                    if names[start] != name:
                        opened.close()
                        name, count = names[start], count + 1
                        out = opened.enter_context(store.open_output_stream(f"{folder}/{name}", compression=None))
                        if heads[start].is_valid:
                            out.write(f"{heads[start]}\n".encode())
                    out.write("".join(f"{line}\n" for line in values[start:end]).encode())
        yield pa.RecordBatch.from_pydict({"files": [count]}, pa.schema([("files", pa.int64())]))

    named = rows.select("file", "head", F.coalesce("value", F.lit("")).alias("value")).filter("file is not null")
    sorted_rows = named.hint("rebalance", "file").sortWithinPartitions("file")
    sorted_rows.mapInArrow(write, "files long").write.format("noop").mode("overwrite").save()
    return f"{path}/part-*"


def put_file(spark, path: str, content: bytes) -> str:
    """One small file, in any store that Spark can write to."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(content)
    out.close()
    return path


def write_event_table(df: DataFrame, path: str) -> str:
    """Write events as Parquet in ranges of (sequence, time).

    Readers skip files by the statistics of both columns, and a task meets few
    sequences, so aggregations combine almost all their rows before a shuffle.
    The ranges include the time: a hot sequence covers many files, where a
    bucket by sequence would hold it whole.
    """
    ranged = df.repartitionByRange("eq_id", "t_us").sortWithinPartitions("eq_id", "t_us")
    ranged.write.mode("overwrite").parquet(path)
    return path


def read_back_count(spark, path: str, expected: int | None = None) -> int:
    """Rows of a written Parquet table; an error if they are not as expected."""
    found = spark.read.parquet(path).agg(F.count("*").alias("n")).first()["n"]
    if expected is not None and found != expected:
        raise AssertionError(f"{path}: wrote {expected} rows, read {found}")
    return found
