"""Incremental loads and their status."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

LOADED = ("ok", "cached", "truncated")
# A later load takes these again.
UNFINISHED = ("failed", "parse_error")


def new_only(cat: DataFrame, manifest: DataFrame, key: str = "eq_id") -> DataFrame:
    """Rows whose key the manifest of finished loads does not list."""
    return cat.join(manifest.select(key).distinct(), key, "left_anti")


def ingest_status(
    cat: DataFrame,
    counts: DataFrame,
    limit: int | None = None,
    cached: DataFrame | None = None,
    malformed: DataFrame | None = None,
    bad_files: DataFrame | None = None,
) -> DataFrame:
    """``eq_id, n_events, status`` per mainshock.

    ``counts`` is ``eq_id, n_events`` of this load, ``cached`` the same for
    earlier loads, ``malformed`` is ``eq_id, n_malformed``. Where a limit was asked
    for, counts within 100 of it are taken as cut off. A sequence of which only malformed rows
    arrived is a parse error. ``bad_files`` is ``eq_id, file_status``: a file that could not be
    read makes its sequence ``failed``, whatever else arrived of it, so that a later load takes
    it again; a file without a header makes it a parse error where nothing arrived.
    """
    rows = cat.select("eq_id", "mainshock_mag", "mainshock_lat", "mainshock_lon").join(
        counts.select("eq_id", F.col("n_events").alias("n_new")), "eq_id", "left"
    )
    n_old = n_bad = F.lit(None).cast("bigint")
    if cached is not None:
        rows = rows.join(cached.select("eq_id", F.col("n_events").alias("n_old")), "eq_id", "left")
        n_old = F.col("n_old")
    if malformed is not None:
        rows = rows.join(malformed.select("eq_id", "n_malformed"), "eq_id", "left")
        n_bad = F.col("n_malformed")
    file_status = F.lit(None).cast("string")
    if bad_files is not None:
        rows = rows.join(bad_files.select("eq_id", "file_status"), "eq_id", "left")
        file_status = F.col("file_status")
    n_new = F.coalesce("n_new", F.lit(0).cast("bigint"))
    return rows.select(
        "eq_id",
        F.col("mainshock_mag").alias("mag"),
        F.col("mainshock_lat").alias("lat"),
        F.col("mainshock_lon").alias("lon"),
        F.coalesce(n_old, n_new).alias("n_events"),
        F.when(n_old.isNotNull(), "cached")
        .when(file_status == "failed", "failed")
        .when((n_new == 0) & ((n_bad > 0) | file_status.isNotNull()), "parse_error")
        .when(n_new == 0, "empty")
        .when(F.lit(False) if limit is None else n_new >= limit - 100, "truncated")
        .otherwise("ok")
        .alias("status"),
    )


def ingest_summary(status: DataFrame) -> DataFrame:
    loaded = F.col("status").isin(*LOADED)
    n = F.when(loaded, F.col("n_events"))
    return status.agg(
        F.count_if(loaded).alias("n_success"),
        F.count_if(F.col("status") == "failed").alias("n_failed"),
        F.count_if(F.col("status") == "empty").alias("n_empty"),
        F.sum(n).alias("events_total"),
        F.avg(n).alias("events_mean"),
        F.max(n).alias("events_max"),
        F.min(n).alias("events_min"),
    )
