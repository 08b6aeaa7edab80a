"""One feature row per mainshock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tremorframe.operators import completeness as gr
from tremorframe.operators.quantiles import group_quantiles
from tremorframe.session import stage_table

# Names and order of the feature table.
FEATURE_COLUMNS = [
    "eq_id", "mainshock_mag", "mainshock_depth", "mainshock_lat", "mainshock_lon",
    "aftershock_count",
    "mag_mean", "mag_std", "mag_max", "mag_min", "mag_median", "mag_range", "mag_diff_main_max",
    "depth_mean", "depth_std", "depth_max",
    "dist_mean", "dist_std", "dist_max", "dist_median", "spatial_spread",
    "time_span_hours", "time_mean_hours", "count_24h", "count_72h", "ratio_24h",
    "mc", "b_value", "n_mag_ge_4", "n_mag_ge_5", "n_mag_ge_6",
]

_COUNTS = (
    "aftershock_count", "count_24h", "count_72h", "count_168h",
    "n_mag_ge_4", "n_mag_ge_5", "n_mag_ge_6",
)
# Wide first, so that most events of a task share a bin; a thousandth of it next.
_BIN_WIDTH = {"mag": 0.1, "dist_km": 20.0}


def _within(hours: int) -> Column:
    return F.count_if((F.col("hours") > 0) & (F.col("hours") <= hours))


def _moments(seen: DataFrame) -> DataFrame:
    """What map tasks can combine to one row per sequence."""
    later = F.when(F.col("hours") > 0, F.col("hours"))
    columns = [F.count("*").alias("aftershock_count"), F.count("mag").alias("mag_n"), F.min("mag").alias("mag_min")]
    for source, name in (("mag", "mag"), ("depth", "depth"), ("dist_km", "dist")):
        columns += [
            F.avg(source).alias(f"{name}_mean"),
            F.stddev_pop(source).alias(f"{name}_std"),
            F.max(source).alias(f"{name}_max"),
        ]
    columns += [
        F.max(later).alias("time_span_hours"),
        F.avg(later).alias("time_mean_hours"),
        *[_within(h).alias(f"count_{h}h") for h in (24, 72, 168)],
        *[F.count_if(F.col("mag") >= m).alias(f"n_mag_ge_{m}") for m in (4, 5, 6)],
    ]
    return seen.groupBy("eq_id").agg(*columns)


def _quantiles(seen: DataFrame) -> DataFrame:
    """``eq_id, mag_median, dist_median, spatial_spread``, both columns in the same passes."""
    names = list(_BIN_WIDTH)
    cells = F.array(*[F.struct(F.lit(i).alias("of"), F.col(c).alias("v")) for i, c in enumerate(names)])
    width = F.lit(0.0)
    for i, c in enumerate(names):
        width = F.when(F.col("of") == i, F.lit(_BIN_WIDTH[c])).otherwise(width)
    found = group_quantiles(
        seen.select("eq_id", F.inline(cells)), ["eq_id", "of"], "v", {"q50": 0.5, "q90": 0.9},
        lambda v: F.floor(v / width), lambda v: F.floor(v / width * 1000),
    )

    def of(column: str, quantile: str) -> Column:
        return F.max(F.when(F.col("of") == names.index(column), F.col(quantile)))

    return found.groupBy("eq_id").agg(
        of("mag", "q50").alias("mag_median"),
        of("dist_km", "q50").alias("dist_median"),
        of("dist_km", "q90").alias("spatial_spread"),
    )


def _exact_stats(seen: DataFrame, mc_mode: str) -> DataFrame:
    """Statistics per sequence; the quantiles, which take three steps, are written out."""
    moments = _moments(seen)
    mc_b = gr.gutenberg_richter(gr.magnitude_counts(seen), moments, mc_mode)
    quantiles = stage_table(_quantiles(seen), "quantiles")
    return moments.join(mc_b, "eq_id", "left").join(quantiles, "eq_id", "left")


def _sketched_stats(seen: DataFrame, mc_mode: str) -> DataFrame:
    later = F.when(F.col("hours") > 0, F.col("hours"))
    columns = [F.count("*").alias("aftershock_count")]
    for source, name in (("mag", "mag"), ("depth", "depth"), ("dist_km", "dist")):
        columns += [
            F.avg(source).alias(f"{name}_mean"),
            F.stddev_samp(source).alias(f"{name}_std"),
            F.max(source).alias(f"{name}_max"),
        ]
    columns += [
        F.min("mag").alias("mag_min"),
        F.percentile_approx("mag", 0.5).alias("mag_median"),
        F.percentile_approx("dist_km", [0.5, 0.9]).alias("dist_q"),
        F.max(later).alias("time_span_hours"),
        F.avg(later).alias("time_mean_hours"),
        *[_within(h).alias(f"count_{h}h") for h in (24, 72, 168)],
        *[F.count_if(F.col("mag") >= m).alias(f"n_mag_ge_{m}") for m in (4, 5, 6)],
    ]
    b = gr.gutenberg_richter(gr.magnitude_counts(seen), None, mc_mode, small="null", above="min")
    return (
        seen.groupBy("eq_id").agg(*columns)
        .withColumns({"dist_median": F.col("dist_q")[0], "spatial_spread": F.col("dist_q")[1]})
        .join(b, "eq_id", "left")
    )


def seq_features(
    enriched: DataFrame,
    cat: DataFrame,
    flavor: str = "exact",
    as_of_hours: float | None = None,
    mc_mode: str = "edge",
) -> DataFrame:
    """The 31 feature columns per mainshock.

    ``exact``: population deviation, exact quantiles, b above mc, mainshocks
    without aftershocks kept with zero counts. ``spark``: sample deviation,
    sketched quantiles, b above the smallest magnitude, mc only from ten events,
    only mainshocks with aftershocks, and ``count_168h`` in addition.
    ``as_of_hours`` uses only what was known that long after the mainshock. The
    events are read five times, so ``enriched`` is best a table.
    """
    if flavor not in ("exact", "spark"):
        raise ValueError("flavor is exact or spark")
    seen = enriched if as_of_hours is None else enriched.filter(F.col("hours") <= as_of_hours)
    stats = (_exact_stats if flavor == "exact" else _sketched_stats)(seen, mc_mode)

    keep = ["eq_id", "mainshock_mag", "mainshock_depth", "mainshock_lat", "mainshock_lon"]
    keep += [c for c in cat.columns if c == "year"]
    rows = cat.select(*keep).join(stats, "eq_id", "left" if flavor == "exact" else "inner")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in _COUNTS})
    rows = rows.withColumns(
        {
            "mag_range": F.col("mag_max") - F.col("mag_min"),
            "mag_diff_main_max": F.col("mainshock_mag") - F.col("mag_max"),
            "ratio_24h": F.try_divide(
                F.col("count_24h").cast("double"), F.col("aftershock_count")
            ),
        }
    )
    names = list(FEATURE_COLUMNS)
    if flavor == "spark":
        names.insert(names.index("ratio_24h"), "count_168h")
        names += [c for c in rows.columns if c == "year"]
    return rows.select(*names)
