"""Event sequences, one CSV file per mainshock, read as one table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tremorframe.functions.clock import parse_date_time_micros, parse_iso_micros
from tremorframe.functions.scalar import digits14
from tremorframe.sources.lines import EMPTY, NO_HEADER, OK, UNREADABLE_FILE, number, read_csv, read_files, survey, unreadable
from tremorframe.sources.schemas import CORRUPT, DATE_TIME_EVENTS, ISO_EVENTS, NEEDED, OPTIONAL

# File name endings in front of which the 14-digit id stands.
SUFFIX = {"iso": r"_seq\.csv", "date_time": r"_eq\.csv"}
UNREADABLE = "_unreadable"
FILE_STATUS = pa.schema([("source_file", pa.string()), ("status", pa.string())])


def _schema(layout: str) -> T.StructType:
    if layout not in SUFFIX:
        raise ValueError(f"layout must be one of {sorted(SUFFIX)}")
    return ISO_EVENTS if layout == "iso" else DATE_TIME_EVENTS


def to_events(raw: DataFrame, layout: str) -> DataFrame:
    """Records of sequence files, as ``read_csv`` gives them, as events.

    ``event_id`` is a hash of sequence id and row content, so it does not depend
    on how the files were split, on the order of their columns, on a retry or on
    the folder of the file. ``_corrupt_record`` is set for records with a wrong
    number of fields; a number that cannot be read is null, the row stays, and
    ``_unreadable`` says so.
    """
    schema = _schema(layout)
    if layout == "iso":
        t_us = parse_iso_micros(F.trim("time"))
        lat, lon, depth, mag, mag_type = "latitude", "longitude", "depth", "mag", "magType"
    else:
        t_us = parse_date_time_micros(F.col("Date"), F.col("Time"))
        lat, lon, depth, mag, mag_type = "Lat", "Lon", "Depth", "Mag", "MagType"
    bad: Column = F.lit(False)
    for c in (lat, lon, depth, mag):
        bad = bad | unreadable(c)
    eq_id = digits14(F.col("source_file"), SUFFIX[layout])
    return raw.select(
        eq_id.alias("eq_id"),
        F.xxhash64(eq_id, *schema.names).alias("event_id"),
        t_us.alias("t_us"),
        number(lat).alias("lat"),
        number(lon).alias("lon"),
        number(depth).alias("depth"),
        number(mag).alias("mag"),
        F.col(mag_type).alias("mag_type"),
        F.col(CORRUPT),
        bad.alias(UNREADABLE),
    )


def well_formed(ev: DataFrame, strict: bool = True) -> DataFrame:
    """Events without damaged lines; ``strict``: and with a time and a magnitude."""
    ev = ev.filter(F.col(CORRUPT).isNull()).drop(CORRUPT, UNREADABLE)
    return ev.na.drop(subset=["t_us", "mag"]) if strict else ev


def read_sequences(
    spark: SparkSession, glob: str, layout: str = "iso", strict: bool = True, keep_malformed: bool = False
) -> DataFrame:
    """Events of all files matching ``glob``; the files may order their columns differently.

    Damaged lines are dropped unless ``keep_malformed``, which returns every
    line, so that drops can be counted. ``strict`` also drops rows without a
    time or magnitude. A file that cannot be read, or has data and no header, is
    an error; ``read_with_report`` goes on without it.
    """
    _schema(layout)
    ev = to_events(read_csv(spark, glob, NEEDED[layout], OPTIONAL[layout]), layout)
    return ev if keep_malformed else well_formed(ev, strict)


def read_with_report(spark: SparkSession, path: str | list[str], layout: str = "iso") -> tuple[DataFrame, DataFrame]:
    """All records of the files that can be read, and ``eq_id, source_file, status`` of every file.

    A file is ``ok``, ``empty`` (no line but blank ones), ``failed`` (it cannot be
    read to its end) or ``parse_error`` (it has data and no header). Blank files
    are normal: a search without results writes them.
    """
    _schema(layout)
    lines = spark.read.text(path)
    files = survey(lines, NEEDED[layout])
    status = {OK: "ok", EMPTY: "empty", UNREADABLE_FILE: "failed", NO_HEADER: "parse_error"}
    table = pa.table({"source_file": [f.path for f in files], "status": [status[f.status] for f in files]}, FILE_STATUS)
    rows = spark.createDataFrame(table)
    report = rows.select(digits14(F.col("source_file"), SUFFIX[layout]).alias("eq_id"), "source_file", "status")
    return to_events(read_files(spark, path, lines, files, NEEDED[layout], OPTIONAL[layout]), layout), report


def bad_files(report: DataFrame) -> DataFrame:
    """``eq_id, file_status``: the worst of the files of each sequence that could not be used."""
    bad = report.filter(F.col("status").isin("failed", "parse_error") & F.col("eq_id").isNotNull())
    return bad.groupBy("eq_id").agg(F.min("status").alias("file_status"))


def load_counts(ev: DataFrame) -> DataFrame:
    """Rows and distinct sequences, in one pass."""
    return ev.agg(
        F.count("*").alias("n_rows"), F.countDistinct("eq_id").alias("n_sequences")
    )


def malformed_counts(ev: DataFrame) -> DataFrame:
    """``eq_id, n_malformed, n_unreadable`` of a ``keep_malformed`` read.

    Damaged lines, and rows that stay with a number that could not be read.
    """
    bad: Column = F.col(CORRUPT).isNotNull()
    return ev.groupBy("eq_id").agg(
        F.count_if(bad).alias("n_malformed"), F.count_if(F.col(UNREADABLE) & ~bad).alias("n_unreadable")
    )
