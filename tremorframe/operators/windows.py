"""Forecast windows and the largest event in each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tremorframe.functions.clock import HOUR_US
from tremorframe.functions.scalar import mag_type_or_default

Window3 = tuple[str, float, float]

# Fixed values: (name, start, end] in hours after the mainshock.
WINDOWS: tuple[Window3, ...] = (("T1", 0, 24), ("T2", 24, 72), ("T3", 72, 168))


def window_label(t_us: Column, t0_us: Column, windows: Sequence[Window3] = WINDOWS) -> Column:
    """Name of the half-open window ``(start, end]`` an event is in, else null.

    Windows must not overlap, so one CASE replaces a join on a range.
    """
    ordered = sorted(windows, key=lambda w: w[1])
    if any(a[2] > b[1] for a, b in zip(ordered, ordered[1:])):
        raise ValueError("windows overlap")
    since = t_us - t0_us
    label = F.lit(None).cast("string")
    for name, start, end in ordered:
        label = F.when(
            (since > int(start * HOUR_US)) & (since <= int(end * HOUR_US)), name
        ).otherwise(label)
    return label


def each_window(df: DataFrame, windows: Sequence[Window3] = WINDOWS) -> DataFrame:
    """One row per input row and window, with ``window, t1_h, t2_h``."""
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("window"),
                F.lit(float(start)).alias("t1_h"),
                F.lit(float(end)).alias("t2_h"),
            )
            for name, start, end in windows
        ]
    )
    return df.select("*", F.inline(rows))


def window_max(enriched: DataFrame, windows: Sequence[Window3] = WINDOWS) -> DataFrame:
    """Largest event per sequence and window, earliest first on ties, and the count.

    Two aggregations instead of a ranking: the first collapses events to one
    row per magnitude and type inside each map task, so however many events a
    sequence has, only a few hundred rows per window reach the second.
    Equal magnitude at the same microsecond is settled by type name.
    """
    by_mag = (
        enriched.filter(F.col("mag").isNotNull())
        .withColumn("window", window_label(F.col("t_us"), F.col("t0_us"), windows))
        .filter(F.col("window").isNotNull())
        .withColumn("mag_type", mag_type_or_default(F.col("mag_type")))
        .groupBy("eq_id", "window", "mag", "mag_type")
        .agg(F.count("*").alias("n"), F.min("t_us").alias("t_us"))
    )
    return largest(by_mag)


def largest(by_mag: DataFrame) -> DataFrame:
    """Largest event and number of events per sequence and window, from counts per magnitude and type."""
    return (
        by_mag.groupBy("eq_id", "window")
        .agg(
            F.min(F.struct((-F.col("mag")).alias("neg_mag"), "t_us", "mag_type")).alias("top"),
            F.sum("n").alias("n_events"),
        )
        .select(
            "eq_id",
            "window",
            (-F.col("top.neg_mag")).alias("max_mag"),
            F.col("top.t_us").alias("t_us"),
            F.col("top.mag_type").alias("mag_type"),
            "n_events",
        )
    )
