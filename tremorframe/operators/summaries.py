"""Reports over feature rows and catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tremorframe.functions.scalar import mag_class


def global_summary(features: DataFrame) -> DataFrame:
    return features.agg(
        F.count("*").alias("total"),
        F.round(F.avg("mainshock_mag"), 2).alias("avg_main_mag"),
        F.round(F.max("mainshock_mag"), 1).alias("max_main_mag"),
        F.round(F.avg("aftershock_count"), 0).alias("avg_aft_count"),
        F.max("aftershock_count").alias("max_aft_count"),
        F.round(F.avg("b_value"), 3).alias("avg_b_value"),
    )


def mag_class_summary(features: DataFrame) -> DataFrame:
    return (
        features.groupBy(mag_class(F.col("mainshock_mag")).alias("mag_bin"))
        .agg(
            F.count("*").alias("n"),
            F.round(F.avg("aftershock_count"), 0).alias("avg_aft"),
            F.max("aftershock_count").alias("max_aft"),
            F.round(F.avg("b_value"), 3).alias("avg_b"),
            F.round(F.avg("ratio_24h"), 3).alias("avg_24h_ratio"),
        )
        .orderBy(F.col("mag_bin").desc())
    )


def top_sequences(features: DataFrame, n: int = 10) -> DataFrame:
    """The n sequences with most aftershocks and their rank, ties sharing one.

    The top is taken first. All sequences with more aftershocks than a kept one
    are kept too, so ranking the n survivors gives the global rank. The year is
    listed where the features have it.
    """
    year = [c for c in features.columns if c == "year"]
    top = (
        features.select("eq_id", *year, "mainshock_mag", "aftershock_count", "mag_max", "b_value")
        .orderBy(F.col("aftershock_count").desc(), "eq_id")
        .limit(n)
    )
    over = Window.partitionBy(F.lit(0)).orderBy(F.col("aftershock_count").desc())
    return top.select(
        "eq_id",
        *year,
        F.round("mainshock_mag", 1).alias("mag"),
        "aftershock_count",
        F.round("mag_max", 1).alias("max_aft_mag"),
        F.round("b_value", 3).alias("b_value"),
        F.rank().over(over).alias("rank_by_count"),
    ).orderBy("rank_by_count", "eq_id")


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over complete pairs; null where one side is constant.

    Spark's ``corr`` divides by zero there, an error in ANSI mode.
    """
    x, y = F.when(y.isNotNull(), x.cast("double")), F.when(x.isNotNull(), y.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def feature_corr(features: DataFrame) -> DataFrame:
    count, main = F.col("aftershock_count"), F.col("mainshock_mag")
    return features.agg(
        F.round(correlation(main, count), 4).alias("corr_mag_count"),
        F.round(correlation(main, F.col("mag_max")), 4).alias("corr_mag_maxaft"),
        F.round(correlation(F.col("mainshock_depth"), count), 4).alias("corr_depth_count"),
        F.round(correlation(F.col("b_value"), count), 4).alias("corr_bval_count"),
    )


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """``bin, lo, hi, n, mean`` over equal bins from minimum to maximum.

    The last bin is closed, bins without values are listed, and ``mean`` is that
    of the whole column. Equal values form one unit-wide range around them.
    """
    values = df.select(F.col(col).alias("v")).filter(F.col("v").isNotNull())
    span = values.agg(F.min("v").alias("mn"), F.max("v").alias("mx"), F.avg("v").alias("mean"))
    flat = F.when(F.col("mn") == F.col("mx"), 0.5).otherwise(0.0)
    low, high = F.col("mn") - flat, F.col("mx") + flat
    # one subquery serves every use below
    span = span.select(
        F.struct(low.alias("low"), ((high - low) / bins).alias("width"), "mean").alias("s")
    ).scalar()
    low, width = span["low"], span["width"]
    # a value within rounding of an edge goes where the edge itself says
    guess = F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1))
    index = (
        F.when(F.col("v") < low + guess * width, guess - 1)
        .when((F.col("v") >= low + (guess + 1) * width) & (guess < bins - 1), guess + 1)
        .otherwise(guess)
    )
    counts = values.groupBy(index.alias("bin")).agg(F.count("*").alias("n"))
    return (
        df.sparkSession.range(bins)
        .select(F.col("id").alias("bin"), low.alias("low"), width.alias("width"), span["mean"].alias("mean"))
        .filter(F.col("low").isNotNull())
        .join(counts, "bin", "left")
        .select(
            "bin",
            (F.col("low") + F.col("bin") * F.col("width")).alias("lo"),
            (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("hi"),
            F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
            "mean",
        )
    )


def yearly_frequency(clean: DataFrame) -> DataFrame:
    return clean.groupBy("year").agg(F.count("*").alias("n"))


def mag_count_fit(stats: DataFrame, count_col: str = "record_count") -> DataFrame:
    """Least squares line of log10(count) over mainshock magnitude."""
    log_n = F.log10(F.col(count_col).cast("double"))
    return stats.filter(F.col(count_col) > 0).agg(
        F.regr_slope(log_n, F.col("mainshock_mag")).alias("slope"),
        F.regr_intercept(log_n, F.col("mainshock_mag")).alias("intercept"),
        F.count("*").alias("n"),
    )


def sample_range(cat: DataFrame) -> DataFrame:
    """Range of magnitudes and years of a selection of mainshocks."""
    return cat.agg(
        F.min("mainshock_mag").alias("min_mag"),
        F.max("mainshock_mag").alias("max_mag"),
        F.min("year").alias("min_year"),
        F.max("year").alias("max_year"),
        F.count("*").alias("n"),
    )
