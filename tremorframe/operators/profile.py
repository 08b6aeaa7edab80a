"""What a forecast needs of the events of each sequence, in one mergeable table.

A profile has a row per sequence, window, half-day bin, magnitude and type, with
the number of aftershocks and the earliest time. Productivity, decay and window
maxima are all read from it, so events are read once for all three. Map tasks
collapse events before the shuffle, a hot sequence is spread over its cells,
and profiles of several loads merge into the profile of all.

Columns: ``eq_id, window, bin, in_days, known, mag, mag_type, n, t_us``. ``window``
is null outside of the windows, ``bin`` counts half days from the mainshock on,
the last one taking all that is later; ``in_days`` says whether an event lies
within ``days``, ``known`` whether it was known at the time of issue.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tremorframe.functions.clock import DAY_US, HOUR_US, days_between
from tremorframe.functions.scalar import mag_type_or_default
from tremorframe.operators.windows import WINDOWS, Window3, largest, window_label

BIN_DAYS = 0.5
DAYS = 30.0
CELL = ("eq_id", "window", "bin", "in_days", "known", "mag", "mag_type")


def event_profile(
    enriched: DataFrame,
    windows: Sequence[Window3] = WINDOWS,
    issue_time_h: float | None = None,
    days: float = DAYS,
) -> DataFrame:
    """The profile of all events after their mainshock; earlier ones are left out."""
    since = F.col("t_us") - F.col("t0_us")
    half_days = F.floor(days_between(F.col("t_us"), F.col("t0_us")) / BIN_DAYS)
    known = F.lit(True) if issue_time_h is None else since <= int(issue_time_h * HOUR_US)
    cells = enriched.filter(since > 0).select(
        "eq_id",
        window_label(F.col("t_us"), F.col("t0_us"), windows).alias("window"),
        F.least(half_days, F.lit(int(round(days / BIN_DAYS)) - 1)).cast("int").alias("bin"),
        (since <= int(days * DAY_US)).alias("in_days"),
        known.alias("known"),
        "mag",
        mag_type_or_default(F.col("mag_type")).alias("mag_type"),
        "t_us",
    )
    return cells.groupBy(*CELL).agg(F.count("*").alias("n"), F.min("t_us").alias("t_us"))


def merge_profiles(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The profile of the events of all; they must hold different events, and the same windows and days."""
    rows = first
    for other in others:
        rows = rows.unionByName(other)
    return rows.groupBy(*CELL).agg(F.sum("n").alias("n"), F.min("t_us").alias("t_us"))


def profile_counts(profile: DataFrame, min_mag: float = 4.0) -> DataFrame:
    """``eq_id, n_obs``: events of at least ``min_mag`` within the profile's days, sequences without one left out."""
    counted = profile.filter(F.col("in_days") & (F.col("mag") >= min_mag))
    return counted.groupBy("eq_id").agg(F.sum("n").alias("n_obs"))


def profile_bins(profile: DataFrame, min_mag: float = 4.0, overflow: str = "clip") -> DataFrame:
    """``eq_id, bin, n`` per half day; events after the last day go to the last bin or are dropped."""
    if overflow not in ("clip", "drop"):
        raise ValueError("overflow is clip or drop")
    counted = profile.filter(F.col("mag") >= min_mag)
    if overflow == "drop":
        counted = counted.filter("in_days")
    return counted.groupBy("eq_id", "bin").agg(F.sum("n").alias("n"))


def profile_max(profile: DataFrame) -> DataFrame:
    """Largest known event per sequence and window, as ``windows.window_max`` finds it among the events."""
    return largest(profile.filter(F.col("known") & F.col("mag").isNotNull() & F.col("window").isNotNull()))
