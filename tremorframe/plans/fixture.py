"""Earthquake sequences derived from the ``events`` test table.

Each user is a sequence, each event an earthquake. All columns are functions of
the event row, so the same definitions can be stated in SQL for comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tremorframe.functions.clock import column_micros, utc_timestamp

MAINSHOCK_BOOST = 4.0


def quakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in engine columns."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    eid, uid = F.col("event_id"), F.col("user_id")
    tenths = lambda c: c / F.lit(10.0)
    return raw.select(
        uid.alias("eq_id"),
        "event_id",
        column_micros(raw, "ts").alias("t_us"),
        (tenths((uid * 37) % 1200) - 60 + tenths((eid * 17) % 61 - 30)).alias("lat"),
        (tenths((uid * 73) % 3600) - 180 + tenths((eid * 29) % 61 - 30)).alias("lon"),
        F.when(eid % 50 != 0, tenths((eid * 13) % 700)).alias("depth"),
        tenths(F.floor(F.col("value") / 11.5) + 30).alias("mag"),
        F.col("event_type").alias("mag_type"),
    )


def mainshocks(ev: DataFrame) -> DataFrame:
    """The first event of each sequence, raised in magnitude, as its mainshock."""
    first = ev.filter(F.col("eq_id").isNotNull()).groupBy("eq_id").agg(
        F.min(F.struct("t_us", "event_id", "mag", "lat", "lon", "depth")).alias("m")
    )
    return first.select(
        "eq_id",
        F.col("m.t_us").alias("t0_us"),
        (F.col("m.mag") + MAINSHOCK_BOOST).alias("mainshock_mag"),
        F.col("m.depth").alias("mainshock_depth"),
        F.col("m.lat").alias("mainshock_lat"),
        F.col("m.lon").alias("mainshock_lon"),
        F.year(utc_timestamp(F.col("m.t_us"))).alias("year"),
    )
