"""Mainshock catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tremorframe.functions.clock import (
    SECOND_US,
    column_micros,
    eq_stamp,
    ntz_micros,
    parse_iso_micros,
    utc_timestamp,
)
from tremorframe.sources.lines import number, read_csv
from tremorframe.sources.schemas import CORRUPT, ISO_EVENTS, NEEDED, OPTIONAL


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Raw global catalog; files may order their columns differently, surplus ones are ignored.

    Damaged lines are dropped; a number that cannot be read is null.
    """
    raw = read_csv(spark, path, NEEDED["iso"], OPTIONAL["iso"]).filter(F.col(CORRUPT).isNull())
    numbers = {f.name for f in ISO_EVENTS.fields if f.dataType.simpleString() == "double"}
    return raw.select(*[number(c).alias(c) if c in numbers else F.col(c) for c in ISO_EVENTS.names])


def clean_catalog(raw: DataFrame, ordered: bool = True) -> DataFrame:
    """Time parsed, ``year`` and ``month`` added, newest first.

    ``t_us`` carries the time in UTC; ``ordered=False`` saves the global sort
    when the result is not for reading.
    """
    t_us = parse_iso_micros(F.col("time")) if dict(raw.dtypes)["time"] == "string" else column_micros(raw, "time")
    clean = raw.withColumn("t_us", t_us).select(
        "t_us", "latitude", "longitude", "depth", "mag", "magType", "place",
        F.year(utc_timestamp(F.col("t_us"))).alias("year"),
        F.month(utc_timestamp(F.col("t_us"))).alias("month"),
    )
    return clean.orderBy(F.col("t_us").desc()) if ordered else clean


def mainshocks_from_catalog(clean: DataFrame) -> DataFrame:
    """Clean catalog as mainshocks: id and origin time at whole seconds."""
    return clean.select(
        eq_stamp(F.col("t_us")).alias("eq_id"),
        (F.floor(F.col("t_us") / float(SECOND_US)) * SECOND_US).alias("t0_us"),
        F.col("mag").cast("double").alias("mainshock_mag"),
        F.col("depth").cast("double").alias("mainshock_depth"),
        F.col("latitude").cast("double").alias("mainshock_lat"),
        F.col("longitude").cast("double").alias("mainshock_lon"),
        "year",
    )


def unique_mainshocks(cat: DataFrame) -> DataFrame:
    """The largest mainshock of each id.

    Ids are cut to the second, so two mainshocks can share one; operators expect
    one catalog row per id.
    """
    others = [c for c in cat.columns if c not in ("eq_id", "mainshock_mag")]
    top = cat.groupBy("eq_id").agg(F.max(F.struct("mainshock_mag", *others)).alias("m"))
    return top.select("eq_id", "m.*").select(*cat.columns)


def read_mainshocks(spark: SparkSession, path: str) -> DataFrame:
    """Mainshock list with the origin time split in six columns, in any order.

    The second may have a fraction. A damaged line, and a mainshock without a
    readable time, are errors: every later result hangs on it.
    """
    raw = read_csv(spark, path, NEEDED["mainshocks"], OPTIONAL["mainshocks"])
    whole = [number(c, "int") for c in ("Year", "Month", "Day", "Hour", "Minute")]
    t0 = F.try_make_timestamp_ntz(*whole, number("Second", "decimal(8,6)"))
    wrong = F.raise_error(F.concat(F.lit("mainshock without a time, or a damaged line, in "), F.col("source_file")))
    t0_us = F.coalesce(F.when(F.col(CORRUPT).isNull(), ntz_micros(t0)), wrong.cast("bigint"))
    return raw.withColumn("t0_us", t0_us).select(
        eq_stamp(F.col("t0_us")).alias("eq_id"),
        "t0_us",
        number("Mag").alias("mainshock_mag"),
        number("Depth").alias("mainshock_depth"),
        number("Lat").alias("mainshock_lat"),
        number("Lon").alias("mainshock_lon"),
        F.col("Source").alias("source"),
        number("Year", "int").alias("year"),
    )


def top_mainshocks(cat: DataFrame, n: int = 50) -> DataFrame:
    """The n largest mainshocks, newest first among equals."""
    return cat.orderBy(F.col("mainshock_mag").desc(), F.col("t0_us").desc(), "eq_id").limit(n)
