"""Submission lines and files."""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, Row, Window, functions as F

from tremorframe.functions.clock import eq_stamp

# Which file and line a window is written to. Any other window has
# a file of its own.
FILE_OF_WINDOW = {"T1": ("T1-T2", 1), "T2": ("T1-T2", 2), "T3": ("T3", 1)}


def submission_lines(pred: DataFrame, cat: DataFrame) -> DataFrame:
    """``eq_id, file_name, line_no, line``.

    A line is ``id lon lat main_mag max_mag type yyyyMMddHH`` with the 14-digit
    id of the mainshock second. Files are named by that id and the windows in
    them; mainshocks after the first of a second carry their number as well, so
    that each has files of its own.
    """
    where = F.create_map(
        *[F.lit(x) for w, (f, n) in FILE_OF_WINDOW.items() for x in (w, f"{f}|{n}")]
    )
    place = F.split(F.coalesce(where[F.col("window")], F.concat("window", F.lit("|1"))), r"\|")
    stamp = F.col("_stamp")
    nth = F.row_number().over(Window.partitionBy("_stamp").orderBy("eq_id"))
    mains = (
        cat.select("eq_id", "t0_us", "mainshock_mag", "mainshock_lat", "mainshock_lon")
        .withColumn("_stamp", eq_stamp(F.col("t0_us")))
        .withColumn("_nth", nth)
    )
    joined = pred.select("eq_id", "window", "pred_mag", "mag_type", "pred_time").join(mains, "eq_id")
    number = F.when(F.col("_nth") > 1, F.concat(F.lit("-"), F.col("_nth"))).otherwise("")
    return joined.select(
        "eq_id",
        F.concat(stamp, number, F.lit("-"), place[0], F.lit(".csv")).alias("file_name"),
        place[1].cast("int").alias("line_no"),
        F.concat_ws(
            " ",
            stamp,
            F.format_string("%.4f", "mainshock_lon"),
            F.format_string("%.4f", "mainshock_lat"),
            F.format_string("%.1f", "mainshock_mag"),
            F.format_string("%.1f", "pred_mag"),
            "mag_type",
            "pred_time",
        ).alias("line"),
    )


def write_submission(lines: DataFrame, path: str) -> str:
    """One file per ``file_name``, its lines in order.

    All lines of a file, few, meet in one task, which writes it in one piece; a
    repeated task writes the same again.
    """

    def write(rows: Iterator[Row]) -> None:
        store, base = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
        store.create_dir(base)
        for row in rows:
            with store.open_output_stream(f"{base}/{row['file_name']}", compression=None) as out:
                out.write("".join(f"{x['line']}\n" for x in row["lines"]).encode())

    ordered = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    lines.groupBy("file_name").agg(ordered.alias("lines")).foreachPartition(write)
    return path


def coverage(pred: DataFrame, lines: DataFrame, source: str = "S1_data") -> DataFrame:
    """One row: number of files and the share of rows from ``source``."""
    share = pred.agg(
        F.count("*").alias("n_rows"),
        (F.avg(F.when(F.col("source") == source, 1.0).otherwise(0.0)) * 100.0).alias("data_share_pct"),
    )
    files = lines.agg(F.countDistinct("file_name").alias("n_files"))
    return share.withColumn("n_files", files.scalar())
