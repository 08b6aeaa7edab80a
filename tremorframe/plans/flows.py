"""The jobs end to end: from files to files.

Each job stages the one table its later steps share, so that events are joined
to mainshocks once however many results are taken from them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from tremorframe.operators import calibrate, forecast, models, profile, summaries
from tremorframe.operators.associate import associate, associated_counts
from tremorframe.operators.enrich import enrich, seq_stats, valid_events
from tremorframe.operators.features import seq_features
from tremorframe.session import job_scratch, settled, stage_table, tune
from tremorframe.sinks.submission import coverage, submission_lines, write_submission
from tremorframe.sinks.tables import read_back_count, write_event_table, write_table
from tremorframe.sources.catalog import (
    clean_catalog,
    mainshocks_from_catalog,
    top_mainshocks,
    unique_mainshocks,
)
from tremorframe.sources.incremental import UNFINISHED, ingest_status, ingest_summary, new_only
from tremorframe.sources.sequences import bad_files, load_counts, malformed_counts, read_with_report
from tremorframe.streaming.ingest import stream_ingest

# Events that one cell of the space-time join may hold.
ROWS_PER_CELL = 2_000_000
# Columns of a store's events written as CSV.
STORED = (
    "eq_id string, event_id bigint, t_us bigint, lat double, lon double, depth double, mag double, "
    "mag_type string, arc_deg double"
)


def job(flow: Callable) -> Callable:
    """A flow whose scratch tables go when it ends; its first argument is a DataFrame."""

    @wraps(flow)
    def run(first: DataFrame, *args, **options):
        with job_scratch(tune(first.sparkSession)):
            return flow(first, *args, **options)

    return run


@job
def explore(raw_catalog: DataFrame, ev: DataFrame, cat: DataFrame, out: str) -> None:
    """Clean the catalog, count the sequences, and write the data of the overview charts."""
    clean = stage_table(clean_catalog(raw_catalog, ordered=False), "clean")
    write_table(clean.orderBy(F.col("t_us").desc()), f"{out}/catalog_clean", "csv")
    stats = stage_table(seq_stats(ev, cat), "stats")
    write_table(stats, f"{out}/sequence_stats", "csv")
    for name, result in {
        "mag_histogram": summaries.histogram(clean, "mag", 30),
        "depth_histogram": summaries.histogram(clean, "depth", 50),
        "yearly_frequency": summaries.yearly_frequency(clean),
        "mag_count_fit": summaries.mag_count_fit(stats),
    }.items():
        write_table(result, f"{out}/{name}", "csv", single_file=True)


@job
def extract_features(
    ev: DataFrame, cat: DataFrame, out: str, flavor: str = "exact", rule: str = "after_t0"
) -> DataFrame:
    """Write the feature table as CSV and Parquet, check it, and return it.

    The ``spark`` flavor also writes its four reports and the scaled vectors.
    """
    precision = "second" if flavor == "spark" else "micro"
    seen = enrich(ev, cat, rule, precision).select("eq_id", "mag", "depth", "hours", "dist_km")
    rows = seq_features(stage_table(seen, "enriched"), cat, flavor)
    spark = ev.sparkSession
    written = Observation()
    write_table(rows, f"{out}/features", partition_by=["year"] if flavor == "spark" else (), counted=written)
    read_back_count(spark, f"{out}/features", written.get["n"])
    features = spark.read.parquet(f"{out}/features").select(*rows.columns)
    write_table(features, f"{out}/features_csv", "csv")
    if flavor == "spark":
        for name, report in {
            "global_summary": summaries.global_summary,
            "mag_class_summary": summaries.mag_class_summary,
            "top_sequences": summaries.top_sequences,
            "feature_corr": summaries.feature_corr,
        }.items():
            write_table(report(features), f"{out}/{name}", "csv", single_file=True)
        scaled, fitted = models.feature_vectors(features)
        write_table(scaled.select("eq_id", "features"), f"{out}/feature_vectors")
        models.save_model(fitted, f"{out}/vector_model")
    return features


@job
def train(features: DataFrame, out: str, folds: int | str = 5) -> DataFrame:
    """Compare the four models, save the best one, and return the metrics."""
    parts = [models.regression_metrics(models.cross_predict(features, m, folds)) for m in models.MODELS]
    metrics = parts[0]
    for part in parts[1:]:
        metrics = metrics.unionByName(part)
    metrics = stage_table(metrics, "metrics")
    write_table(metrics, f"{out}/model_metrics", "csv", single_file=True)
    best = models.pick_best(metrics).first()["model"]
    trees = ("RandomForest", "GradientBoosting")
    for model in {best, *trees}:
        fitted = models.fit_full(features, model)
        if model == best:
            models.save_model(fitted, f"{out}/best_model")
        if model in trees:
            top = models.importances(fitted)
            write_table(top, f"{out}/importances_{model}", "csv", single_file=True)
    return settled(metrics)


def _manifest(spark: SparkSession, store: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{store}/manifest")
    except AnalysisException:
        return None


@job
def load_sequences(
    raw_catalog: DataFrame,
    ev: DataFrame,
    store: str,
    n: int | None = None,
    limit: int | None = None,
    malformed: DataFrame | None = None,
    unusable: DataFrame | None = None,
) -> DataFrame:
    """Associate events with all mainshocks not loaded yet, or with the n largest.

    Events go to ``store/events``, the status of each mainshock to
    ``store/manifest``. A load owns one ``load=`` folder in both and writes the
    manifest last, so a load that failed half way is simply written again.
    ``malformed`` (``eq_id, n_malformed``) tells parse errors from empty sequences, ``unusable``
    (``eq_id, file_status``) names those whose file could not be used. Sequences that failed or
    were not parsed are taken again by the next load. Returns the summary of the load.
    """
    spark = raw_catalog.sparkSession
    cat = unique_mainshocks(mainshocks_from_catalog(clean_catalog(raw_catalog, ordered=False)))
    cat = stage_table(cat if n is None else top_mainshocks(cat, n), "mainshocks")
    done = _manifest(spark, store)
    cached, fresh, load = None, cat, 0
    if done is not None:
        load = done.agg(F.max("load")).first()[0] + 1
        done = done.filter(~F.col("status").isin(*UNFINISHED))
        cached = done.groupBy("eq_id").agg(F.max("n_events").alias("n_events"))
        fresh = new_only(cat, done)
    pairs = associate(fresh, ev, limit=limit, rows_per_cell=ROWS_PER_CELL)
    write_table(pairs, f"{store}/events/load={load}")
    found = spark.read.schema(pairs.schema).parquet(f"{store}/events/load={load}")
    status = ingest_status(cat, associated_counts(found, limit), limit, cached, malformed, unusable)
    status = stage_table(status, "status")
    write_table(status.filter("status <> 'cached'"), f"{store}/manifest/load={load}")
    return settled(ingest_summary(status))


@job
def forecast_all(
    ev: DataFrame, cat: DataFrame, out: str, issue_time_h: float | None = None
) -> DataFrame:
    """Calibrate, predict every window, write predictions and submission files.

    Events are read twice: for the profile that calibration and window maxima
    share, and for the epidemic sums of the empty windows. Returns the coverage row.
    """
    cat = stage_table(cat, "mainshocks")
    joined = enrich(valid_events(ev), cat, "all")
    seen = stage_table(profile.event_profile(joined, issue_time_h=issue_time_h), "profile")
    a, first_hour = calibrate.calibrated(seen.filter("known"), cat, converge=True)
    pred = forecast.predict(cat, joined, a, first_hour, issue_time_h=issue_time_h, profile=seen)
    pred = stage_table(pred, "pred")
    write_table(pred.orderBy("eq_id", "window"), f"{out}/predictions", "csv")
    write_table(forecast.strategy_mix(pred), f"{out}/strategy_mix", "csv")
    write_table(forecast.prediction_report(pred, cat), f"{out}/prediction_report", "csv")
    lines = submission_lines(pred, cat)
    write_submission(lines, f"{out}/submission")
    return settled(coverage(pred, lines))


def ingest(
    spark: SparkSession, sequences: str, out: str, layout: str = "iso", max_files: int = 10_000
) -> DataFrame:
    """Stream the sequence files not read yet into ``out/stream``, and lay all events out for loads.

    Writes the damaged lines by sequence to ``out/malformed``, the sequences of files that could
    not be used to ``out/unusable``, and the table ``out/events`` in ranges of sequence and
    time, which ``load`` takes. Returns the number of rows and sequences.
    """
    tune(spark)
    loaded = stream_ingest(spark, sequences, f"{out}/stream", f"{out}/checkpoint", layout, max_files)
    write_event_table(loaded, f"{out}/events")
    everything, report = read_with_report(spark, sequences, layout)
    write_table(bad_files(report), f"{out}/unusable")
    write_table(malformed_counts(everything).filter("n_malformed + n_unreadable > 0"), f"{out}/malformed")
    return load_counts(spark.read.parquet(f"{out}/events"))


def stored_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of all loads in a store, or of any Parquet or CSV table in engine columns."""
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, schema=STORED)
    return spark.read.parquet(path)
