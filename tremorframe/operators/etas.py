"""Epidemic-type rates: every earlier event adds to the rate of a sequence.

The natural form is a self join of grid hours with all earlier events. Both
operators turn it round: an event knows on its own which hours it contributes
to, so there is no join and no pair ever reaches a shuffle, only sums per
sequence and hour or per sequence and window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tremorframe.functions.clock import HOUR_US
from tremorframe.functions.seismo import EtasParams, etas_decay, etas_decay_sum, etas_max_from_total, etas_weight
from tremorframe.operators.windows import WINDOWS, Window3, each_window


def _history(joined: DataFrame, windows: tuple[Window3, ...], *extra: str) -> DataFrame:
    """Events with a magnitude before the start of each window.

    There is no lower bound: foreshocks count for every window, the mainshock
    itself for the windows that start after it.
    """
    since = F.col("t_us") - F.col("t0_us")
    rows = joined.filter(F.col("mag").isNotNull()).select(
        "eq_id", "mag", since.alias("since_us"), (since / F.lit(float(HOUR_US))).alias("hours"), *extra
    )
    return each_window(rows, windows).filter(
        F.col("since_us") < (F.col("t1_h") * float(HOUR_US)).cast("bigint")
    )


def _window_hours() -> Column:
    """One row per full hour of the window."""
    last = (F.ceil(F.col("t2_h")) - 1).cast("int")
    return F.explode(F.sequence(F.col("t1_h").cast("int"), last)).alias("hour")


def _trigger(etas: EtasParams) -> Column:
    lag_days = (F.col("hour") - F.col("hours")) / 24.0
    return F.col("weight") * etas_decay(lag_days, etas)


def etas_rate(
    joined: DataFrame,
    cat: DataFrame,
    windows: tuple[Window3, ...] = WINDOWS,
    etas: EtasParams = EtasParams(),
) -> DataFrame:
    """``eq_id, window, hour, rate`` at every full hour of every window.

    ``joined`` is ``enrich(..., rule='all')``. The history of a window ends at
    its start. Hours are exploded and summed inside the same task.
    """
    hours = _window_hours()
    added = (
        _history(joined, windows)
        .select("eq_id", "window", etas_weight(F.col("mag"), etas).alias("weight"), "hours", hours)
        .groupBy("eq_id", "window", "hour")
        .agg(F.sum(_trigger(etas)).alias("added"))
    )
    grid = each_window(cat.select("eq_id"), windows).select("eq_id", "window", hours)
    return grid.join(added, ["eq_id", "window", "hour"], "left").select(
        "eq_id",
        "window",
        "hour",
        (F.lit(etas.mu) + F.coalesce("added", F.lit(0.0))).alias("rate"),
    )


def etas_max_mag(
    joined: DataFrame,
    targets: DataFrame,
    windows: tuple[Window3, ...] = WINDOWS,
    etas: EtasParams = EtasParams(),
    etas_units: str = "hours",
) -> DataFrame:
    """``eq_id, window, etas_mag`` for the wanted ``(eq_id, window)`` rows.

    ``hours`` sums the hourly values of the daily rate as they are; ``days``
    scales the sum to events. What an event adds over all hours of a window is one
    expression, so an event costs the same in a window of any length.
    """
    if etas_units not in ("hours", "days"):
        raise ValueError("etas_units is hours or days")
    step = 1.0 if etas_units == "hours" else 1.0 / 24.0
    # at most one entry per window; joined by sequence, as the events already are
    wanted = targets.groupBy("eq_id").agg(F.collect_set("window").alias("wanted"))
    history = _history(joined.join(wanted, "eq_id"), windows, "wanted").filter(
        F.array_contains("wanted", F.col("window"))
    )
    start = F.floor("t1_h")
    lag_days = (start - F.col("hours")) / 24.0
    own = etas_weight(F.col("mag"), etas) * etas_decay_sum(lag_days, F.ceil("t2_h") - start, etas)
    added = history.groupBy("eq_id", "window").agg(F.sum(own).alias("added"))
    n_hours = F.create_map(
        *[F.lit(v) for name, t1, t2 in windows for v in (name, float(-(-(t2 - t1) // 1)))]
    )
    total = (
        n_hours[F.col("window")] * F.lit(etas.mu) + F.coalesce("added", F.lit(0.0))
    ) * F.lit(step)
    slots = wanted.select("eq_id", F.explode("wanted").alias("window"))
    return slots.join(added, ["eq_id", "window"], "left").select(
        "eq_id", "window", etas_max_from_total(total, etas).alias("etas_mag")
    )
