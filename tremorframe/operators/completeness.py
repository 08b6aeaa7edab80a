"""Completeness magnitude and Gutenberg-Richter b from magnitude counts.

Both need only how often each magnitude occurs: the table ``eq_id, mag, n`` of
``magnitude_counts``, never the events and never lists of magnitudes. The smallest
and largest magnitude of a sequence fix its bins, which are then counted with a
combination in the map tasks: a sequence comes together as one row per tenth
of a magnitude, also where each of a million magnitudes has digits of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tremorframe.operators.quantiles import value_counts

STEP = 0.1
DELTA_M = 0.1
MIN_B = 5


def magnitude_counts(enriched: DataFrame) -> DataFrame:
    return value_counts(enriched, ["eq_id"], "mag")


def magnitude_range(counts: DataFrame) -> DataFrame:
    """``eq_id, mag_min, mag_max, mag_n``."""
    return counts.groupBy("eq_id").agg(
        F.min("mag").alias("mag_min"), F.max("mag").alias("mag_max"), F.sum("n").alias("mag_n")
    )


def _bins(counts: DataFrame, span: DataFrame, mc_mode: str) -> DataFrame:
    """A row per sequence and bin with its number and sum of magnitudes.

    ``_n_own`` and ``_n_next`` count those from the bin's own and from the next bin's rounded edge
    on, which differ from the bin's by the rounding of its edges. The few magnitudes outside of
    the bins keep a row each.
    """
    rows = counts.filter(F.col("mag").isNotNull()).join(span, "eq_id")
    rows = _edge_bins(rows) if mc_mode == "edge" else _tenth_bins(rows)
    mag, n = F.col("mag"), F.col("n")
    parts = [F.sum(n).alias("_n"), F.sum(n * mag).alias("_s")]
    for name, edge in (("own", F.round("_edge", 1)), ("next", F.round("_edge_after", 1))):
        counted = F.when(mag >= edge, n).otherwise(0)
        parts += [F.sum(counted).alias(f"_n_{name}"), F.sum(counted * mag).alias(f"_s_{name}")]
    outside = F.when(F.col("_bin").isNull(), mag).alias("_outside")
    return rows.groupBy("eq_id", "mag_min", "mag_n", "_bin", "_edge", outside).agg(*parts)


def gutenberg_richter(
    counts: DataFrame,
    span: DataFrame | None = None,
    mc_mode: str = "edge",
    min_n: int = 10,
    small: str = "min",
    above: str = "mc",
) -> DataFrame:
    """``eq_id, mc, b_value``: mc by maximum curvature, the fullest magnitude bin, and b.

    ``edge`` bins on the float edges ``lo + i*d`` that published results were
    computed with, last bin closed; ``grid`` bins on whole tenths. Sequences
    below ``min_n`` events get their smallest magnitude, or null with
    ``small='null'``. A sequence whose edges do not even form one bin has no mc.
    Rows without a magnitude take no part. b is the maximum likelihood estimate over the magnitudes
    of at least mc, or with ``above='min'`` over all. ``span`` is
    ``magnitude_range``, where that is at hand; a sequence without magnitudes then has no row.
    """
    if mc_mode not in ("edge", "grid") or small not in ("min", "null") or above not in ("mc", "min"):
        raise ValueError("mc_mode is edge or grid, small is min or null, above is mc or min")
    measured = magnitude_range(counts) if span is None else span.select("eq_id", "mag_min", "mag_max", "mag_n")
    bins = _bins(counts, measured, mc_mode)
    fullest = F.max(F.when(F.col("_bin").isNotNull(), F.struct("_n", (-F.col("_bin")).alias("_down"), "_edge"))).over(
        Window.partitionBy("eq_id")
    )
    bins = bins.withColumn("_top", fullest)
    top = -F.col("_top._down")
    mc = F.round(F.col("_top._edge"), 1)

    def from_top(what: str) -> Column:
        """Over the magnitudes of at least the rounded edge of the fullest bin."""
        return F.sum(
            F.when(F.col("_bin") > top, F.col(f"_{what}"))
            .when(F.col("_bin") == top, F.col(f"_{what}_own"))
            .when(F.col("_bin") == top - 1, F.col(f"_{what}_next"))
            .when(F.col("_outside") >= mc, F.col(f"_{what}"))
            .otherwise(0)
        )

    rows = bins.groupBy("eq_id", "mag_min", "mag_n").agg(
        F.max(mc).alias("_mc"), from_top("n").alias("_n_mc"), from_top("s").alias("_s_mc"),
        F.sum("_n").alias("_n_all"), F.sum("_s").alias("_s_all"),
    )
    if span is None:
        rows = measured.select("eq_id").join(rows, "eq_id", "left")
    lowest, few = F.col("mag_min"), F.col("mag_n") < min_n
    mc = F.when(few, lowest if small == "min" else F.lit(None).cast("double")).otherwise(F.col("_mc"))
    everything = F.lit(True) if above == "min" else few
    start = lowest if above == "min" else mc
    n = F.when(everything, F.col("_n_all")).otherwise(F.col("_n_mc"))
    total = F.when(everything, F.col("_s_all")).otherwise(F.col("_s_mc"))
    return rows.select("eq_id", mc.alias("mc"), _b(n, total, start).alias("b_value"))


def _b(n: Column, total: Column, start: Column) -> Column:
    excess = total / F.nullif(n, F.lit(0)) - start + F.lit(DELTA_M / 2)
    return F.when((n >= MIN_B) & start.isNotNull(), F.lit(1.0) / (F.lit(math.log(10.0)) * excess))


def _tenth_bins(rows: DataFrame) -> DataFrame:
    tenth = F.round(F.col("mag") * 10).cast("bigint")
    return rows.withColumns({"_bin": tenth, "_edge": tenth / F.lit(10.0), "_edge_after": (tenth + 1) / F.lit(10.0)})


def _edge_bins(rows: DataFrame) -> DataFrame:
    """Bin on edges that accumulate rounding as ``lo + i*d``; null past the last edge."""
    mag, lo, d, last = F.col("mag"), F.col("_lo"), F.col("_d"), F.col("_last")
    rows = rows.withColumn("_lo", F.floor(F.col("mag_min") * 10) / F.lit(10.0))
    rows = rows.withColumn("_d", (lo + F.lit(STEP)) - lo)
    stop = F.ceil(F.col("mag_max") * 10) / F.lit(10.0) + F.lit(STEP)
    rows = rows.withColumn("_last", F.ceil((stop - lo) / F.lit(STEP)) - 1)

    def edge(i: Column) -> Column:
        return lo + i * d

    guess = F.floor((mag - lo) / d)
    found = (
        F.when(mag == edge(last), last - 1)
        .when(mag < edge(guess), guess - 1)
        .when(mag >= edge(guess + 1), guess + 1)
        .otherwise(guess)
    )
    rows = rows.withColumn("_bin", found)
    rows = rows.withColumn("_bin", F.when((F.col("_bin") >= 0) & (F.col("_bin") < last), F.col("_bin")))
    return rows.withColumns({"_edge": edge(F.col("_bin")), "_edge_after": edge(F.col("_bin") + 1)})


def completeness_mag(
    counts: DataFrame, mc_mode: str = "edge", min_n: int = 10, small: str = "min"
) -> DataFrame:
    """``eq_id, mc``."""
    return gutenberg_richter(counts, None, mc_mode, min_n, small).select("eq_id", "mc")


def b_above_min(counts: DataFrame) -> DataFrame:
    """``eq_id, mc, b_value`` with the smallest magnitude as ``mc``."""
    n = F.sum(F.when(F.col("mag").isNotNull(), F.col("n")))
    sums = counts.groupBy("eq_id").agg(F.min("mag").alias("mc"), n.alias("n"), F.sum(F.col("n") * F.col("mag")).alias("s"))
    return sums.select("eq_id", "mc", _b(F.col("n"), F.col("s"), F.col("mc")).alias("b_value"))
