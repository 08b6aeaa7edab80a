"""Largest aftershock per window: observed, modelled, or by rule of thumb."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tremorframe.functions.clock import HOUR_US, hour_stamp
from tremorframe.functions.scalar import DEFAULT_MAG_TYPE
from tremorframe.functions.seismo import (
    EtasParams,
    RjParams,
    bath,
    error_credit,
    rj_expected_count,
    rj_max_mag,
)
from tremorframe.operators.etas import etas_max_mag
from tremorframe.operators.profile import profile_max
from tremorframe.operators.windows import WINDOWS, Window3, each_window, window_max

SOURCE_DATA, SOURCE_MODEL, SOURCE_BATH = "S1_data", "S2_RJ+ETAS", "S3_Bath"


def rj_table(
    cat: DataFrame,
    a: Column,
    rj: RjParams = RjParams(),
    min_mag: float = 4.0,
    windows: tuple[Window3, ...] = WINDOWS,
) -> DataFrame:
    """Expected count and median largest magnitude per mainshock and window."""
    main, t1, t2 = F.col("mainshock_mag"), F.col("t1_h"), F.col("t2_h")
    return each_window(cat.select("eq_id", "mainshock_mag"), windows).select(
        "eq_id",
        "window",
        rj_expected_count(main, min_mag, t1, t2, a, rj).alias("rj_count"),
        rj_max_mag(main, t1, t2, a, rj).alias("rj_mag"),
    )


def predict(
    cat: DataFrame,
    joined: DataFrame,
    a: DataFrame | float | None,
    first_hour: DataFrame,
    windows: tuple[Window3, ...] = WINDOWS,
    rj: RjParams = RjParams(),
    etas: EtasParams = EtasParams(),
    issue_time_h: float | None = None,
    etas_units: str = "hours",
    profile: DataFrame | None = None,
) -> DataFrame:
    """One row per mainshock and window with ``pred_mag``, ``pred_t_us`` and ``source``.

    ``joined`` is ``enrich(..., rule='all')``. Observed windows come from the
    data; with ``issue_time_h`` only from events up to that hour. Empty windows
    blend the Reasenberg-Jones and epidemic estimates, for which ``a`` is the
    one-row calibration; without it they fall back to Bath's law. Only empty
    windows pay for the epidemic sums. With ``profile``, the event profile of the
    same windows and time of issue as a table, the events are read for those alone.
    """
    known = joined
    if issue_time_h is not None:
        known = joined.filter(F.col("t_us") - F.col("t0_us") <= int(issue_time_h * HOUR_US))
    seen = window_max(known, windows) if profile is None else profile_max(profile)
    seen = seen.withColumnRenamed("t_us", "seen_t_us")
    slots = each_window(
        cat.select("eq_id", "t0_us", "mainshock_mag", "mainshock_lat", "mainshock_lon"), windows
    )
    filled = slots.join(seen, ["eq_id", "window"], "left")
    # reading both columns keeps the two uses of ``filled`` equal, and so the
    # events are ranked once
    observed = F.col("max_mag").isNotNull() & (F.coalesce("n_events", F.lit(0)) > 0)
    epidemic = etas_max_mag(known, filled.filter(~observed), windows, etas, etas_units)

    main, t1, t2 = F.col("mainshock_mag"), F.col("t1_h"), F.col("t2_h")
    a_value = a.scalar() if isinstance(a, DataFrame) else F.lit(a).cast("double")
    s2_mag = F.round(0.6 * rj_max_mag(main, t1, t2, a_value, rj) + 0.4 * F.col("etas_mag"), 1)
    s2_mag = F.when(F.col("first_hour").isNotNull(), s2_mag)
    s2_time = F.col("t0_us") + F.round(F.col("first_hour") * float(HOUR_US)).cast("bigint")
    s3_time = F.col("t0_us") + ((t1 + t2) / 2.0 * float(HOUR_US)).cast("bigint")
    modelled = s2_mag.isNotNull()

    def choose(s1: Column, s2: Column, s3: Column) -> Column:
        return F.when(observed, s1).when(modelled, s2).otherwise(s3)

    return (
        filled.join(epidemic, ["eq_id", "window"], "left")
        .join(F.broadcast(first_hour), "window", "left")  # one row per window
        .select(
            "eq_id",
            "mainshock_mag",
            "window",
            choose(F.round("max_mag", 1), s2_mag, F.round(bath(main), 1)).alias("pred_mag"),
            choose(F.col("seen_t_us"), s2_time, s3_time).alias("pred_t_us"),
            F.coalesce("mag_type", F.lit(DEFAULT_MAG_TYPE)).alias("mag_type"),
            F.coalesce("n_events", F.lit(0).cast("bigint")).alias("n_events"),
            choose(F.lit(SOURCE_DATA), F.lit(SOURCE_MODEL), F.lit(SOURCE_BATH)).alias("source"),
        )
        .withColumn("pred_time", hour_stamp(F.col("pred_t_us")))
    )


def strategy_mix(pred: DataFrame) -> DataFrame:
    """Distinct sources used per mainshock, joined with ``+``."""
    return pred.groupBy("eq_id").agg(
        F.array_join(F.array_sort(F.collect_set("source")), "+").alias("strategy")
    )


def prediction_report(pred: DataFrame, cat: DataFrame) -> DataFrame:
    """Predictions beside the mainshock magnitude and Bath's law."""
    main = cat.select("eq_id", F.col("mainshock_mag").alias("main_mag"))
    return (
        pred.drop("mainshock_mag")
        .join(main, "eq_id")
        .select(
            "eq_id", "window", "main_mag", "pred_mag", "n_events", bath(F.col("main_mag")).alias("bath_mag")
        )
    )


def score(pred: DataFrame, truth: DataFrame, w_mag: float = 1.0, w_time: float = 1.0) -> DataFrame:
    """Points of 100 over all windows of ``truth`` (``eq_id, window, max_mag, t_us``).

    Magnitude errors below 0.3 and time errors below one hour earn full credit,
    falling linearly to none at 2.0 and 24 hours. The weights are split so that
    a perfect forecast has 100.
    """
    both = truth.select("eq_id", "window", "max_mag", "t_us").join(
        pred.select("eq_id", "window", "pred_mag", "pred_t_us"), ["eq_id", "window"], "left"
    )
    mag_credit = error_credit(F.col("pred_mag") - F.col("max_mag"), 0.3, 2.0)
    hours_off = (F.col("pred_t_us") - F.col("t_us")) / F.lit(float(HOUR_US))
    time_credit = error_credit(hours_off, 1.0, 24.0)
    earned = (F.lit(w_mag) * mag_credit + F.lit(w_time) * time_credit) / F.lit(w_mag + w_time)
    return both.agg(
        F.count("*").alias("n_windows"),
        (F.avg(F.coalesce(earned, F.lit(0.0))) * F.lit(100.0)).alias("score"),
    )
