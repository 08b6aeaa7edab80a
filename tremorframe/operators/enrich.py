"""Attach mainshock attributes to events.

Events:   ``eq_id, event_id, t_us, lat, lon, depth, mag, mag_type``
Catalog:  ``eq_id, t0_us, mainshock_mag, mainshock_depth, mainshock_lat, mainshock_lon``
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tremorframe.functions.clock import hours_between
from tremorframe.functions.geo import haversine_km

RULES = ("after_t0", "first_row", "all")


def enrich(ev: DataFrame, cat: DataFrame, rule: str = "after_t0", precision: str = "micro") -> DataFrame:
    """Events joined to their mainshock, with ``hours`` and ``dist_km``.

    ``after_t0`` keeps events strictly after the mainshock, ``first_row`` drops
    the earliest event of each sequence and keeps the rest, ``all`` keeps every
    event. The join carries no hint: Catalyst broadcasts the catalog while it
    is below the size threshold and otherwise sort-merges, splitting hot
    sequences.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    joined = ev.join(cat, "eq_id").withColumn(
        "hours", hours_between(F.col("t_us"), F.col("t0_us"), precision)
    )
    if rule == "after_t0":
        joined = joined.filter(F.col("hours") > 0)
    elif rule == "first_row":
        # the least time by hash, and ids only among the events of that time:
        # a minimum over both at once would sort all events
        least = ev.groupBy("eq_id").agg(F.min("t_us").alias("_t"))
        heads = (
            ev.join(least, "eq_id").filter(F.col("t_us") == F.col("_t"))
            .groupBy("eq_id", "_t").agg(F.min("event_id").alias("_id"))
        )
        is_head = F.coalesce((F.col("t_us") == F.col("_t")) & (F.col("event_id") == F.col("_id")), F.lit(False))
        joined = joined.join(heads, "eq_id", "left").filter(~is_head).drop("_t", "_id")
    return joined.withColumn(
        "dist_km",
        haversine_km(F.col("mainshock_lat"), F.col("mainshock_lon"), F.col("lat"), F.col("lon")),
    )


def valid_events(ev: DataFrame) -> DataFrame:
    """Drop events without a time or a magnitude."""
    return ev.na.drop(subset=["t_us", "mag"])


def seq_stats(ev: DataFrame, cat: DataFrame) -> DataFrame:
    """Records per sequence, mainshock row included, with catalog attributes."""
    counts = ev.groupBy("eq_id").agg(F.count("*").alias("record_count"))
    return cat.join(counts, "eq_id", "left").withColumn(
        "record_count", F.coalesce("record_count", F.lit(0).cast("bigint"))
    )
