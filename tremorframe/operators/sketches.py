"""Features of a store that grows by loads, without reading the events of earlier loads.

Every load leaves one row per sequence: counts, moments, ranges, counts per
tenth of a magnitude, and KLL sketches of magnitude and distance. All of
them merge, so the features of everything loaded so far come from these rows. A sketch
holds a few thousand values however many it has seen; the rank of a quantile
is off by at most about ``2.3 / k`` of all values, and it is exact below ``k`` of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tremorframe.operators.completeness import DELTA_M, MIN_B
from tremorframe.operators.features import FEATURE_COLUMNS

K = 1024
MOMENTS = {"mag": "mag", "depth": "depth", "dist_km": "dist"}
SUMS = ("aftershock_count", "hours_n", "hours_sum", "count_24h", "count_72h", "count_168h", "n_mag_ge_4", "n_mag_ge_5", "n_mag_ge_6")


def load_summary_rows(seen: DataFrame, k: int = K) -> DataFrame:
    """One row per sequence for ``eq_id, mag, depth, hours, dist_km`` of one load."""
    later = F.when(F.col("hours") > 0, F.col("hours"))
    columns = [F.count("*").alias("aftershock_count"), F.count(later).alias("hours_n")]
    columns += [F.sum(later).alias("hours_sum"), F.max(later).alias("hours_max"), F.min("mag").alias("mag_min")]
    for source, name in MOMENTS.items():
        columns += [
            F.count(source).alias(f"{name}_n"), F.avg(source).alias(f"{name}_mean"),
            F.var_pop(source).alias(f"{name}_var"), F.max(source).alias(f"{name}_max"),
        ]
    columns += [F.count_if(later <= h).alias(f"count_{h}h") for h in (24, 72, 168)]
    columns += [F.count_if(F.col("mag") >= m).alias(f"n_mag_ge_{m}") for m in (4, 5, 6)]
    columns += [F.kll_sketch_agg_double("mag", k).alias("mag_kll"), F.kll_sketch_agg_double("dist_km", k).alias("dist_kll")]
    tenth = F.round(F.col("mag") * 10).cast("int")
    per_tenth = seen.filter(F.col("mag").isNotNull()).groupBy("eq_id", tenth.alias("tenth")).agg(F.count("*").alias("n"))
    tenths = per_tenth.groupBy("eq_id").agg(F.collect_list(F.struct("tenth", "n")).alias("tenths"))
    return seen.groupBy("eq_id").agg(*columns).join(tenths, "eq_id", "left")


def merged_features(stored: DataFrame, cat: DataFrame, min_n: int = 10) -> DataFrame:
    """The feature columns of ``seq_features(flavor='spark', mc_mode='grid')`` from the rows of any number of loads.

    Loads must hold different events. Quantiles come from the sketches, mc is the
    fullest tenth, the lowest among equals, and b is taken above the smallest magnitude.
    """
    columns = [F.sum(c).alias(c) for c in SUMS]
    columns += [F.max("hours_max").alias("time_span_hours"), F.min("mag_min").alias("mag_min")]
    for name in MOMENTS.values():
        n, mean, var = (F.col(f"{name}_{c}") for c in ("n", "mean", "var"))
        columns += [
            F.sum(n).alias(f"{name}_n"), F.sum(n * mean).alias(f"{name}_s"),
            F.sum(n * (var + mean * mean)).alias(f"{name}_ss"), F.max(f"{name}_max").alias(f"{name}_max"),
        ]
    columns += [F.kll_merge_agg_double(c).alias(c) for c in ("mag_kll", "dist_kll")]
    merged = stored.groupBy("eq_id").agg(*columns)
    # two numbers per tenth meet, however many loads there were
    counted = stored.select("eq_id", F.explode("tenths").alias("t")).groupBy("eq_id", "t.tenth").agg(F.sum("t.n").alias("n"))
    fullest = counted.groupBy("eq_id").agg(F.max(F.struct("n", (-F.col("tenth")).alias("down"))).alias("top"))

    def mean(name: str) -> Column:
        return F.col(f"{name}_s") / F.nullif(F.col(f"{name}_n"), F.lit(0))

    def std(name: str) -> Column:
        n = F.col(f"{name}_n")
        inside = F.greatest(F.col(f"{name}_ss") - n * mean(name) * mean(name), F.lit(0.0))
        return F.sqrt(inside / F.nullif(n - 1, F.lit(0)))

    def quantile(sketch: str, rank: float, n: str) -> Column:
        return F.when(F.col(n) > 0, F.kll_sketch_get_quantile_double(F.when(F.col(n) > 0, F.col(sketch)), F.lit(rank)))

    excess = mean("mag") - F.col("mag_min") + F.lit(DELTA_M / 2)
    stats = merged.join(fullest, "eq_id", "left").select(
        "eq_id", *SUMS, "time_span_hours", "mag_min", *[f"{n}_max" for n in MOMENTS.values()],
        *[mean(n).alias(f"{n}_mean") for n in MOMENTS.values()],
        *[std(n).alias(f"{n}_std") for n in MOMENTS.values()],
        (F.col("hours_sum") / F.nullif(F.col("hours_n"), F.lit(0))).alias("time_mean_hours"),
        quantile("mag_kll", 0.5, "mag_n").alias("mag_median"),
        quantile("dist_kll", 0.5, "dist_n").alias("dist_median"),
        quantile("dist_kll", 0.9, "dist_n").alias("spatial_spread"),
        F.when(F.col("mag_n") >= min_n, -F.col("top.down") / F.lit(10.0)).alias("mc"),
        F.when(F.col("mag_n") >= MIN_B, F.lit(1.0) / (F.lit(math.log(10.0)) * excess)).alias("b_value"),
    )
    keep = ["eq_id", "mainshock_mag", "mainshock_depth", "mainshock_lat", "mainshock_lon"]
    year = [c for c in cat.columns if c == "year"]
    rows = cat.select(*keep, *year).join(stats, "eq_id").withColumns(
        {
            "mag_range": F.col("mag_max") - F.col("mag_min"),
            "mag_diff_main_max": F.col("mainshock_mag") - F.col("mag_max"),
            "ratio_24h": F.try_divide(F.col("count_24h").cast("double"), F.col("aftershock_count")),
        }
    )
    names = list(FEATURE_COLUMNS)
    names.insert(names.index("ratio_24h"), "count_168h")
    return rows.select(*names, *year)
