"""Parameters of the classic laws estimated from observed sequences.

Every function returns a DataFrame; one-row results are read by later plans as
scalar subqueries, never collected.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tremorframe.functions.clock import DAY_US, days_between
from tremorframe.functions.seismo import (
    OMORI_C_BOUNDS,
    OMORI_FALLBACK,
    OMORI_K_BOUNDS,
    OMORI_P_BOUNDS,
    RjParams,
    omori_rate,
)
from tremorframe.operators.profile import BIN_DAYS, DAYS, profile_bins, profile_counts
from tremorframe.operators.quantiles import global_medians
from tremorframe.operators.windows import WINDOWS, Window3, each_window
from tremorframe.session import stage_table


def bath_constant(features: DataFrame) -> DataFrame:
    """Median of largest aftershock minus mainshock magnitude."""
    deltas = features.select((F.col("mag_max") - F.col("mainshock_mag")).alias("bath_delta"))
    return global_medians(deltas, ["bath_delta"])


def rj_a_per_sequence(
    enriched: DataFrame, rj: RjParams = RjParams(), days: float = 30, min_mag: float = 4.0
) -> DataFrame:
    """``eq_id, n_obs, a_hat`` for sequences with at least one event that counts."""
    counted = enriched.filter(
        (F.col("t_us") > F.col("t0_us"))
        & (F.col("t_us") - F.col("t0_us") <= int(days * DAY_US))
        & (F.col("mag") >= min_mag)
    )
    n_obs = counted.groupBy("eq_id").agg(
        F.count("*").alias("n_obs"), F.max("mainshock_mag").alias("mainshock_mag")
    )
    return _a_hats(n_obs, rj, days, min_mag)


def rj_a_per_sequence_of(
    profile: DataFrame, cat: DataFrame, rj: RjParams = RjParams(), min_mag: float = 4.0
) -> DataFrame:
    """The same from an event profile, within its days."""
    n_obs = profile_counts(profile, min_mag).join(cat.select("eq_id", "mainshock_mag"), "eq_id")
    return _a_hats(n_obs, rj, DAYS, min_mag)


def _a_hats(n_obs: DataFrame, rj: RjParams, days: float, min_mag: float) -> DataFrame:
    q = 1.0 - rj.p
    if abs(q) < 1e-6:
        integral = math.log((days + rj.c_days) / rj.c_days)
    else:
        integral = ((days + rj.c_days) ** q - rj.c_days**q) / q
    return n_obs.select(
        "eq_id",
        "n_obs",
        (
            F.log10("n_obs")
            - F.lit(rj.b) * (F.col("mainshock_mag") - F.lit(min_mag))
            - F.lit(math.log10(max(integral, 1e-10)))
        ).alias("a_hat"),
    )


def rj_a(
    enriched: DataFrame, rj: RjParams = RjParams(), days: float = 30, min_mag: float = 4.0
) -> DataFrame:
    """One row ``a``: the median over sequences, or the given default without data."""
    return median_a(rj_a_per_sequence(enriched, rj, days, min_mag), rj)


def median_a(hats: DataFrame, rj: RjParams = RjParams()) -> DataFrame:
    """One row ``a`` from the values of the sequences."""
    return global_medians(hats, ["a_hat"]).select(F.round(F.coalesce("a_hat", F.lit(rj.a)), 3).alias("a"))


def omori_bins(
    enriched: DataFrame, min_mag: float = 4.0, max_days: float = 30.0, overflow: str = "clip", fill: bool = False
) -> DataFrame:
    """``eq_id, bin, n`` counts per half day; later events go to the last bin or are dropped.

    Bins without an event are left out, or with ``fill`` counted as zero: every
    sequence with aftershocks of any magnitude then has all its bins.
    """
    if overflow not in ("clip", "drop"):
        raise ValueError("overflow is clip or drop")
    n_bins = int(round(max_days / BIN_DAYS))
    days = days_between(F.col("t_us"), F.col("t0_us"))
    after = enriched.filter((F.col("t_us") > F.col("t0_us")) & (F.col("mag") >= min_mag))
    if overflow == "drop":
        after = after.filter(days <= max_days)
    bins = (
        after.withColumn("bin", F.least(F.floor(days / BIN_DAYS), F.lit(n_bins - 1)).cast("int"))
        .groupBy("eq_id", "bin")
        .agg(F.count("*").alias("n"))
    )
    if not fill:
        return bins
    every = enriched.filter(F.col("t_us") > F.col("t0_us")).select("eq_id").distinct()
    every = every.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    return every.join(bins, ["eq_id", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def omori_grid(n_c: int = 60, n_p: int = 45) -> tuple[np.ndarray, np.ndarray]:
    """Candidate c (log spaced) and p (evenly spaced) between their bounds."""
    lo, hi = OMORI_C_BOUNDS
    c = lo * (hi / lo) ** (np.arange(n_c) / (n_c - 1))
    p = OMORI_P_BOUNDS[0] + (OMORI_P_BOUNDS[1] - OMORI_P_BOUNDS[0]) * (np.arange(n_p) / (n_p - 1))
    return c, p


def converged(y: np.ndarray, mid: np.ndarray, start: np.ndarray, rounds: int = 200) -> np.ndarray:
    """``k, c, p, sse`` at a local least squares point, all sequences at once.

    Damped Gauss-Newton in log k, log c and p. A step that would raise the error
    is not taken, so no error is above the one of ``start``; a parameter at its bound
    that wants to leave it is held. Ends when no sequence moves any more.
    """
    bounds = np.array([np.log(OMORI_K_BOUNDS), np.log(OMORI_C_BOUNDS), OMORI_P_BOUNDS])
    low, high = bounds[:, 0], bounds[:, 1]
    at = np.clip(np.stack([np.log(start[0]), np.log(start[1]), start[2]], axis=1), low, high)

    def model(x: np.ndarray) -> np.ndarray:
        return BIN_DAYS * np.exp(x[:, :1]) / (mid + np.exp(x[:, 1:2])) ** x[:, 2:]

    expected = model(at)
    sse, damping, moving = ((y - expected) ** 2).sum(axis=1), np.full(len(y), 1e-3), np.ones(len(y), bool)
    for _ in range(rounds):
        i = np.flatnonzero(moving)
        if not len(i):
            break
        x, f = at[i], expected[i]
        c = np.exp(x[:, 1:2])
        slope = np.stack([f, -x[:, 2:] * c / (mid + c) * f, -np.log(mid + c) * f], axis=2)
        toward = np.einsum("nbi,nb->ni", slope, y[i] - f)
        held = ((x <= low) & (toward < 0)) | ((x >= high) & (toward > 0))
        slope = np.where(held[:, None, :], 0.0, slope)
        normal = np.einsum("nbi,nbj->nij", slope, slope)
        scale = np.maximum(np.einsum("nii->ni", normal), 1e-300)
        normal += (np.where(held, 1.0, damping[i, None] * scale))[:, :, None] * np.eye(3)
        step = np.linalg.solve(normal, np.where(held, 0.0, toward)[:, :, None])[:, :, 0]
        new = np.clip(x + step, low, high)
        tried = model(new)
        error = ((y[i] - tried) ** 2).sum(axis=1)
        better = error <= sse[i]
        small = np.abs(new - x).max(axis=1) < 1e-12
        moving[i] = ~((better & small) | (~better & (damping[i] > 1e12)))
        j = i[better]
        at[j], expected[j], sse[j] = new[better], tried[better], error[better]
        damping[i] = np.where(better, np.maximum(damping[i] / 5, 1e-12), damping[i] * 4)
    found = np.stack([np.exp(at[:, 0]), np.exp(at[:, 1]), at[:, 2], sse])
    return np.where(sse <= start[3], found, start)


def omori_fit(
    bins: DataFrame,
    cat: DataFrame,
    max_days: float = 30.0,
    min_events: int = 10,
    grid: tuple[np.ndarray, np.ndarray] | None = None,
    converge: bool = False,
) -> DataFrame:
    """``eq_id, k, c, p, sse`` least squares fit of the Omori law to the bin counts.

    For given c and p the best K has a closed form, so each sequence is a search
    over the (c, p) grid, one matrix product per Arrow batch, and a second one
    in quarter steps around the best point. With ``converge`` the search goes on from
    there, see ``converged``. Sequences below ``min_events`` events get the
    fallback parameters.
    """
    n_bins = int(round(max_days / BIN_DAYS))
    mid = (np.arange(n_bins) + 0.5) * BIN_DAYS
    c_axis, p_axis = grid or omori_grid()
    c_all, p_all = (a.ravel() for a in np.meshgrid(c_axis, p_axis, indexing="ij"))
    c_ratio, p_step = c_axis[1] / c_axis[0], p_axis[1] - p_axis[0]
    quarter = np.arange(-4, 5) / 4.0
    c_near, p_near = (a.ravel() for a in np.meshgrid(c_ratio**quarter, p_step * quarter, indexing="ij"))

    def decay(c: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected counts per bin for K of one: ``... x bins x candidates``."""
        return BIN_DAYS / (mid[:, None] + c[..., None, :]) ** p[..., None, :]

    coarse = decay(c_all, p_all)

    def smallest(y: np.ndarray, c: np.ndarray, p: np.ndarray, shape: np.ndarray) -> tuple:
        cross, norm = (y[:, None, :] @ shape)[:, 0, :], (shape**2).sum(axis=-2)
        k = np.clip(cross / norm, *OMORI_K_BOUNDS)
        sse = (y**2).sum(axis=1, keepdims=True) - 2 * k * cross + k**2 * norm
        at = np.arange(len(y)), sse.argmin(axis=1)
        return k[at], np.broadcast_to(c, sse.shape)[at], np.broadcast_to(p, sse.shape)[at], sse[at]

    @F.pandas_udf("k double, c double, p double, sse double")
    def fit(counts: pd.Series) -> pd.DataFrame:
        parts = [np.empty((4, 0))]
        for at in range(0, len(counts), 500):
            y = np.stack(counts.iloc[at : at + 500].to_list())
            _, c, p, _ = smallest(y, c_all, p_all, coarse)
            c = np.clip(c[:, None] * c_near, *OMORI_C_BOUNDS)
            p = np.clip(p[:, None] + p_near, *OMORI_P_BOUNDS)
            best = np.stack(smallest(y, c, p, decay(c, p)))
            parts.append(converged(y, mid, best) if converge else best)
        return pd.DataFrame(np.concatenate(parts, axis=1).T, columns=["k", "c", "p", "sse"])

    # at most one entry per bin and sequence
    by_bin = F.map_from_entries(F.collect_list(F.struct("bin", "n")))
    vectors = bins.groupBy("eq_id").agg(F.sum("n").alias("total"), by_bin.alias("m"))
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(n_bins - 1)),
        lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0)).cast("double"),
    )
    fitted = (
        vectors.filter(F.col("total") >= min_events)
        .select("eq_id", fit(dense).alias("f"))
        .select("eq_id", "f.*")
    )
    k0, c0, p0 = OMORI_FALLBACK
    return cat.select("eq_id").join(fitted, "eq_id", "left").select(
        "eq_id",
        F.coalesce("k", F.lit(k0)).alias("k"),
        F.coalesce("c", F.lit(c0)).alias("c"),
        F.coalesce("p", F.lit(p0)).alias("p"),
        "sse",
    )


def omori_medians(fits: DataFrame) -> DataFrame:
    """One row ``k, c, p``: the median of each parameter over sequences."""
    return global_medians(fits, ["k", "c", "p"])


def calibrated(
    profile: DataFrame,
    cat: DataFrame,
    min_mag: float = 4.0,
    omori_min_mag: float = 4.0,
    windows: tuple[Window3, ...] = WINDOWS,
    converge: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """``a`` and ``window, first_hour``, as tables, from an event profile that has been written out."""
    a = median_a(rj_a_per_sequence_of(profile, cat, min_mag=min_mag))
    fits = omori_fit(profile_bins(profile, omori_min_mag), cat, converge=converge)
    first_hour = omori_first_hour(omori_medians(fits), windows)
    return stage_table(a, "rj_a"), stage_table(first_hour, "first_hour")


def omori_first_hour(
    params: DataFrame, windows: tuple[Window3, ...] = WINDOWS, step_h: float = 0.1, target: float = 0.5
) -> DataFrame:
    """``window, first_hour``: when the expected number of events reaches ``target``.

    One row per window: the parameters are medians over all sequences, so the
    answer does not differ between mainshocks. Without a crossing the window
    start is used, and never more than the window middle.
    """
    steps = F.sequence(
        F.lit(0), (F.ceil((F.col("t2_h") - F.col("t1_h")) / step_h) - 1).cast("int")
    )
    grid = each_window(params, windows).select(
        "window", "t1_h", "t2_h", "k", "c", "p", F.explode(steps).alias("step")
    )
    hour = F.col("t1_h") + F.col("step") * F.lit(step_h)
    rate = omori_rate(hour / 24.0, F.col("k"), F.col("c"), F.col("p"))
    running = Window.partitionBy("window").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return (
        grid.withColumn("hour", hour)
        .withColumn("expected", F.sum(rate * F.lit(step_h) / 24.0).over(running))
        .groupBy("window", "t1_h", "t2_h")
        .agg(F.min(F.when(F.col("expected") >= target, F.col("hour"))).alias("crossing"))
        .select(
            "window",
            F.least(
                F.coalesce("crossing", "t1_h"), (F.col("t1_h") + F.col("t2_h")) / 2.0
            ).alias("first_hour"),
        )
    )
