"""The registered queries: every operator applied to the derived sequences.

Each takes ``(spark, sf_dir)`` and returns a DataFrame. Doubles are rounded to
six decimals, since engines sum in different orders. Columns that often lie
exactly between two such values get digits at which they cannot: a mean of
tenths over 64 events ends on a half after six, microseconds in hours never do
after ten.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from tremorframe.functions.clock import eq_stamp, format_utc
from tremorframe.functions.scalar import (
    first_chars,
    last_chars,
    mag_type_or_default,
    project_present,
    round_columns,
)
from tremorframe.operators import calibrate, completeness, etas, forecast, models, summaries
from tremorframe.operators.associate import associate, associated_counts, candidate_pairs
from tremorframe.operators.enrich import enrich, seq_stats
from tremorframe.operators.features import seq_features
from tremorframe.operators.profile import event_profile, merge_profiles, profile_bins, profile_max
from tremorframe.operators.ranks import with_rank
from tremorframe.operators.sketches import load_summary_rows, merged_features
from tremorframe.operators.windows import each_window, window_max
from tremorframe.plans.fixture import mainshocks, quakes
from tremorframe.session import scratch_path, stage_table, tune
from tremorframe.sinks.submission import coverage, submission_lines, write_submission
from tremorframe.sinks.tables import put_file, write_files, write_table
from tremorframe.sources.catalog import (
    clean_catalog,
    mainshocks_from_catalog,
    read_catalog,
    read_mainshocks,
    top_mainshocks,
    unique_mainshocks,
)
from tremorframe.sources.incremental import ingest_status, ingest_summary, new_only
from tremorframe.sources.sequences import (
    bad_files,
    load_counts,
    malformed_counts,
    read_sequences,
    read_with_report,
    well_formed,
)
from tremorframe.streaming.ingest import stream_ingest

Query = Callable[[SparkSession, str], DataFrame]

# Test events rarely reach magnitude 4, so decay is fitted from the smallest on.
OMORI_MIN_MAG = 3.0
# A load counts as finished up to this time (2024-01-01 06:00 UTC).
LOADED_BEFORE_US = 1_704_088_800_000_000
CV_FOLDS = 3
DIGITS = {"mag_mean": 7, "depth_mean": 7, "hours": 10, "time_span_hours": 10}

_QUERIES: dict[str, Query] = {}


def query(fn: Callable[["Tables"], DataFrame]) -> Callable[["Tables"], DataFrame]:
    """Register ``fn`` under its name; it gets the derived tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_columns(fn(Tables(tune(spark), sf_dir)), 6, DIGITS)

    _QUERIES[fn.__name__] = run
    return fn


class Tables:
    """The derived tables and the results several queries start from."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.ev = quakes(spark, sf_dir)

    @cached_property
    def cat(self) -> DataFrame:
        return mainshocks(self.ev)

    @cached_property
    def after(self) -> DataFrame:
        return enrich(self.ev, self.cat)

    @cached_property
    def joined(self) -> DataFrame:
        return enrich(self.ev, self.cat, rule="all")

    def features(self, **options) -> DataFrame:
        return seq_features(self.seen, self.cat, **options)

    @cached_property
    def main(self) -> DataFrame:
        """The mainshocks, written out."""
        return stage_table(self.cat, "mainshocks")

    @cached_property
    def seen(self) -> DataFrame:
        """What features need of the aftershocks, written out."""
        return stage_table(self.after.select("eq_id", "mag", "depth", "hours", "dist_km"), "aftershocks")

    def profile(self, **options) -> DataFrame:
        """The event profile, written out."""
        return stage_table(event_profile(enrich(self.ev, self.main, rule="all"), **options), "profile")

    def omori_fits(self) -> DataFrame:
        bins = calibrate.omori_bins(self.after, OMORI_MIN_MAG)
        return calibrate.omori_fit(bins, self.cat)

    def first_hour(self) -> DataFrame:
        return calibrate.omori_first_hour(calibrate.omori_medians(self.omori_fits()))

    def predictions(self, **options) -> DataFrame:
        seen = self.profile(issue_time_h=options.get("issue_time_h"))
        a, first_hour = calibrate.calibrated(seen, self.main, omori_min_mag=OMORI_MIN_MAG)
        joined = enrich(self.ev, self.main, rule="all")
        return forecast.predict(self.main, joined, a, first_hour, profile=seen, **options)

    def iso_rows(self) -> DataFrame:
        """Events as rows of an ISO sequence file, with the stamp of their mainshock."""
        return self.joined.select(
            eq_stamp(F.col("t0_us")).alias("stamp"),
            format_utc(F.col("t_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time"),
            F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
            "depth", "mag", F.col("mag_type").alias("magType"),
            F.concat(F.lit("place "), F.col("eq_id").cast("string")).alias("place"),
        )

    def write_sequences(self, rows: DataFrame, suffix: str, path: str | None = None) -> str:
        """The sequence files of the mainshocks."""
        columns = [c for c in rows.columns if c != "stamp"]
        lines = rows.select(
            F.concat("stamp", F.lit(suffix)).alias("file"),
            F.lit(",".join(columns)).alias("head"), F.to_csv(F.struct(*columns)).alias("value"),
        )
        return write_files(lines, path or scratch_path(self.spark, "sequences"))


# ---- events, windows, features ----------------------------------------------


@query
def window_max_per_sequence(t: Tables) -> DataFrame:
    return window_max(t.after)


@query
def aftershocks_enriched(t: Tables) -> DataFrame:
    return t.after.select("eq_id", "event_id", "hours", "dist_km", "mag", "depth")


@query
def aftershocks_first_row_rule(t: Tables) -> DataFrame:
    kept = enrich(t.ev, t.cat, rule="first_row", precision="second")
    return kept.select("eq_id", "event_id", "hours", "mag")


@query
def sequence_stats(t: Tables) -> DataFrame:
    return seq_stats(t.ev, t.cat)


@query
def sequence_features(t: Tables) -> DataFrame:
    return t.features()


@query
def sequence_features_sample(t: Tables) -> DataFrame:
    return t.features(flavor="spark")


@query
def sequence_features_as_of_72h(t: Tables) -> DataFrame:
    return t.features(as_of_hours=72.0)


@query
def sequence_features_merged(t: Tables) -> DataFrame:
    """Features from the stored rows of three loads; mc by whole tenths is left out."""
    path = scratch_path(t.spark, "summaries")
    seen = t.joined.filter("hours > 0").withColumn("load", F.pmod("event_id", F.lit(3)).cast("int"))
    for load in range(3):
        write_table(load_summary_rows(seen.filter(F.col("load") == load)), f"{path}/load={load}")
    return merged_features(t.spark.read.parquet(path), t.main).drop("mc")


@query
def associated_features(t: Tables) -> DataFrame:
    """The global branch: events by place and time, enriched, and one feature row per mainshock."""
    # columns of the events, which repeat from pair to pair and so take little space; hours and distances do not
    near = stage_table(associate(t.main, t.ev).select("eq_id", "t_us", "lat", "lon", "depth", "mag"), "near")
    return seq_features(enrich(near, t.main), t.main, flavor="spark")


@query
def completeness_edge(t: Tables) -> DataFrame:
    return completeness.completeness_mag(completeness.magnitude_counts(t.after))


@query
def completeness_grid(t: Tables) -> DataFrame:
    return completeness.completeness_mag(
        completeness.magnitude_counts(t.after), mc_mode="grid", small="null"
    )


@query
def b_value_above_mc(t: Tables) -> DataFrame:
    return completeness.gutenberg_richter(completeness.magnitude_counts(t.after))


@query
def b_value_above_min(t: Tables) -> DataFrame:
    return completeness.b_above_min(completeness.magnitude_counts(t.after))


# ---- reports ------------------------------------------------------------------


@query
def global_summary(t: Tables) -> DataFrame:
    return summaries.global_summary(t.features(flavor="spark"))


@query
def mag_class_summary(t: Tables) -> DataFrame:
    return summaries.mag_class_summary(t.features(flavor="spark"))


@query
def top_sequences(t: Tables) -> DataFrame:
    return summaries.top_sequences(t.features(flavor="spark"), 10)


@query
def sequence_ranks(t: Tables) -> DataFrame:
    """The rank of every sequence by its number of aftershocks."""
    features = stage_table(t.features().select("eq_id", "aftershock_count"), "features")
    return with_rank(features, "aftershock_count", "rank_by_count")


@query
def feature_corr(t: Tables) -> DataFrame:
    return summaries.feature_corr(t.features(flavor="spark"))


@query
def mag_histogram(t: Tables) -> DataFrame:
    return summaries.histogram(t.ev, "mag", 30)


@query
def depth_histogram(t: Tables) -> DataFrame:
    return summaries.histogram(t.ev, "depth", 50)


@query
def yearly_frequency(t: Tables) -> DataFrame:
    return summaries.yearly_frequency(t.cat)


@query
def mag_count_fit(t: Tables) -> DataFrame:
    return summaries.mag_count_fit(seq_stats(t.ev, t.cat))


@query
def mag_count_fit_metrics(t: Tables) -> DataFrame:
    """Errors of the fitted line, as of any other model."""
    stats = seq_stats(t.ev, t.cat)
    line = summaries.mag_count_fit(stats)
    y_hat = line.select("slope").scalar() * F.col("mainshock_mag") + line.select("intercept").scalar()
    return models.regression_metrics(
        stats.select(
            F.lit("Line").alias("model"), F.log10(F.col("record_count").cast("double")).alias("y"),
            y_hat.alias("y_hat"),
        )
    )


# ---- calibration and forecast -------------------------------------------------


@query
def bath_constant(t: Tables) -> DataFrame:
    largest = t.after.groupBy("eq_id", "mainshock_mag").agg(F.max("mag").alias("mag_max"))
    return calibrate.bath_constant(largest)


@query
def rj_a_per_sequence(t: Tables) -> DataFrame:
    return calibrate.rj_a_per_sequence(t.after)


@query
def rj_a(t: Tables) -> DataFrame:
    return calibrate.rj_a(t.after)


@query
def rj_estimates(t: Tables) -> DataFrame:
    return forecast.rj_table(t.cat, calibrate.rj_a(t.after).scalar())


@query
def etas_rate(t: Tables) -> DataFrame:
    return etas.etas_rate(t.joined, t.cat)


@query
def etas_max_mag(t: Tables) -> DataFrame:
    return etas.etas_max_mag(t.joined, each_window(t.cat.select("eq_id")))


@query
def etas_max_mag_days(t: Tables) -> DataFrame:
    return etas.etas_max_mag(t.joined, each_window(t.cat.select("eq_id")), etas_units="days")


@query
def omori_bins(t: Tables) -> DataFrame:
    return calibrate.omori_bins(t.after, OMORI_MIN_MAG, fill=True)


@query
def omori_fit(t: Tables) -> DataFrame:
    return t.omori_fits()


@query
def omori_fit_converged(t: Tables) -> DataFrame:
    """The fits carried on to convergence; no error grows."""
    bins = stage_table(profile_bins(t.profile(), OMORI_MIN_MAG), "bins")
    grid = calibrate.omori_fit(bins, t.main).select("eq_id", F.col("sse").alias("grid_sse"))
    fits = calibrate.omori_fit(bins, t.main, converge=True)
    return fits.join(grid, "eq_id").withColumn("no_worse", F.col("sse") <= F.col("grid_sse")).drop("grid_sse")


@query
def omori_medians(t: Tables) -> DataFrame:
    return calibrate.omori_medians(t.omori_fits())


@query
def omori_first_hour(t: Tables) -> DataFrame:
    return t.first_hour()


@query
def predictions(t: Tables) -> DataFrame:
    return t.predictions()


@query
def predictions_issued_24h(t: Tables) -> DataFrame:
    return t.predictions(issue_time_h=24.0)


@query
def predictions_uncalibrated(t: Tables) -> DataFrame:
    return forecast.predict(t.cat, t.joined, None, t.first_hour())


@query
def window_max_of_profile(t: Tables) -> DataFrame:
    """The window maxima again, from the profiles of two loads merged into one."""
    enriched = enrich(t.ev, t.main, rule="all")
    even = F.col("event_id") % 2 == 0
    loads = [stage_table(event_profile(enriched.filter(part)), "profile") for part in (even, ~even)]
    return profile_max(merge_profiles(*loads))


@query
def strategy_mix(t: Tables) -> DataFrame:
    return forecast.strategy_mix(t.predictions())


@query
def prediction_report(t: Tables) -> DataFrame:
    return forecast.prediction_report(t.predictions(), t.main)


@query
def forecast_score(t: Tables) -> DataFrame:
    return forecast.score(t.predictions(issue_time_h=24.0), window_max(t.after))


@query
def submission(t: Tables) -> DataFrame:
    return submission_lines(t.predictions(), t.main)


@query
def submission_files(t: Tables) -> DataFrame:
    """The submission files written and read back, without the mainshock key."""
    lines = submission_lines(t.predictions(), t.main)
    path = write_submission(lines, scratch_path(t.spark, "submission"))
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return t.spark.read.text(path).select(name.alias("file_name"), F.col("value").alias("line"))


@query
def submission_coverage(t: Tables) -> DataFrame:
    pred = stage_table(t.predictions(), "predictions")
    return coverage(pred, submission_lines(pred, t.main))


# ---- sources, association, loads ----------------------------------------------


@query
def catalog_clean(t: Tables) -> DataFrame:
    """Events written as a raw catalog file with a surplus column, read and cleaned."""
    path = scratch_path(t.spark, "catalog")
    write_table(t.iso_rows().withColumn("net", F.lit("us")).drop("stamp"), path, "csv")
    return clean_catalog(read_catalog(t.spark, path), ordered=False)


@query
def catalog_mainshocks(t: Tables) -> DataFrame:
    raw = project_present(t.iso_rows(), ["time", "latitude", "longitude", "depth", "mag", "magType", "place"])
    return mainshocks_from_catalog(clean_catalog(raw, ordered=False))


@query
def catalog_mainshocks_unique(t: Tables) -> DataFrame:
    rows = t.ev.select(
        eq_stamp(F.col("t_us")).alias("eq_id"), F.col("mag").alias("mainshock_mag"),
        (F.floor(F.col("t_us") / 1e6) * 1_000_000).alias("t0_us"), "lat", "lon", F.col("event_id").alias("nr"),
    )
    return unique_mainshocks(rows)


@query
def mainshocks_split_time(t: Tables) -> DataFrame:
    """Mainshocks written with the time in six columns, and read."""
    part = lambda pattern: format_utc(F.col("t0_us"), pattern).cast("int")
    rows = t.cat.select(
        part("yyyy").alias("Year"), part("MM").alias("Month"), part("dd").alias("Day"),
        part("HH").alias("Hour"), part("mm").alias("Minute"), part("ss").alias("Second"),
        F.col("mainshock_mag").alias("Mag"), F.col("mainshock_lat").alias("Lat"),
        F.col("mainshock_lon").alias("Lon"), F.col("mainshock_depth").alias("Depth"),
        F.lit("NEIC").alias("Source"),
    )
    path = write_table(rows, scratch_path(t.spark, "mainshocks"), "csv")
    return read_mainshocks(t.spark, path)


@query
def mainshocks_reordered(t: Tables) -> DataFrame:
    """Another column order, seconds with a fraction, no source."""
    part = lambda pattern: format_utc(F.col("t0_us"), pattern)
    rows = t.cat.select(
        F.col("mainshock_lon").alias("Lon"), part("ss.SSSSSS").alias("Second"), F.col("mainshock_mag").alias("Mag"),
        part("MM").alias("Month"), part("yyyy").alias("Year"), F.col("mainshock_lat").alias("Lat"),
        part("dd").alias("Day"), part("HH").alias("Hour"), F.col("mainshock_depth").alias("Depth"), part("mm").alias("Minute"),
    )
    path = write_table(rows, scratch_path(t.spark, "mainshocks"), "csv")
    return read_mainshocks(t.spark, path).drop("source")


@query
def mainshock_labels(t: Tables) -> DataFrame:
    """Short texts for listings: day and time of the id, clipped place."""
    stamp = eq_stamp(F.col("t0_us"))
    return t.cat.select(
        "eq_id",
        first_chars(stamp, 8).alias("day"),
        last_chars(stamp, 6).alias("clock"),
        first_chars(F.format_string("%.4f %.4f", "mainshock_lat", "mainshock_lon"), 12).alias("place"),
    )


@query
def mainshocks_top50(t: Tables) -> DataFrame:
    return top_mainshocks(t.cat, 50)


@query
def mainshocks_top50_range(t: Tables) -> DataFrame:
    return summaries.sample_range(top_mainshocks(t.cat, 50))


@query
def sequences_iso(t: Tables) -> DataFrame:
    glob = t.write_sequences(t.iso_rows(), "_seq.csv")
    return read_sequences(t.spark, glob, "iso").drop("event_id")


@query
def sequences_reordered(t: Tables) -> DataFrame:
    """Files of one set with different column orders, one of them with a surplus column."""
    rows = t.iso_rows()
    even = F.col("stamp").cast("long") % 2 == 0
    root = scratch_path(t.spark, "reordered")
    other = ["magType", "longitude", "net", "mag", "latitude", "place", "time", "depth"]
    t.write_sequences(rows.filter(even), "_seq.csv", f"{root}/a")
    t.write_sequences(rows.filter(~even).withColumn("net", F.lit("us")).select("stamp", *other), "_seq.csv", f"{root}/b")
    return read_sequences(t.spark, f"{root}/*/part-*", "iso").drop("event_id")


@query
def sequences_without_type(t: Tables) -> DataFrame:
    """Files without depth, type and place."""
    glob = t.write_sequences(t.iso_rows().drop("depth", "magType", "place"), "_seq.csv")
    ev = read_sequences(t.spark, glob, "iso")
    return ev.withColumn("mag_type", mag_type_or_default(F.col("mag_type"))).drop("event_id")


@query
def sequences_bad_depth(t: Tables) -> DataFrame:
    """Depths that are no number: the event stays, the depth is null."""
    rows = t.iso_rows().withColumn("depth", F.coalesce(F.col("depth").cast("string"), F.lit("deep")))
    return read_sequences(t.spark, t.write_sequences(rows, "_seq.csv"), "iso").drop("event_id")


def _damaged(t: Tables) -> DataFrame:
    """Events read from files in which rows without depth are cut short, and M above 5 are text."""
    rows = t.iso_rows().select(
        "stamp",
        F.concat_ws(
            ",", "time", "latitude", "longitude",
            F.when(F.col("mag") > 5, F.lit("x")).otherwise(F.col("depth").cast("string")), F.col("mag").cast("string"),
            F.when(F.col("depth").isNotNull() | (F.col("mag") > 5), F.concat_ws(",", "magType", "place")),
        ).alias("value"),
    )
    path = scratch_path(t.spark, "damaged")
    head = F.lit("time,latitude,longitude,depth,mag,magType,place").alias("head")
    files = rows.select(F.concat("stamp", F.lit("_seq.csv")).alias("file"), head, "value")
    return read_sequences(t.spark, write_files(files, path), "iso", keep_malformed=True)


@query
def malformed_lines(t: Tables) -> DataFrame:
    return malformed_counts(_damaged(t))


@query
def load_status_parse_error(t: Tables) -> DataFrame:
    """Mainshocks of which only damaged lines arrived, among all."""
    read = _damaged(t)
    cat = t.cat.withColumn("eq_id", eq_stamp(F.col("t0_us")))
    counts = well_formed(read).filter("mag < 4").groupBy("eq_id").agg(F.count("*").alias("n_events"))
    return ingest_status(cat, counts, malformed=malformed_counts(read))


@query
def catalog_line_breaks(t: Tables) -> DataFrame:
    """Places with a line break, a comma and quotes."""
    path = scratch_path(t.spark, "catalog")
    place = F.concat(F.lit('near\n"'), F.col("place"), F.lit('", north'))
    write_table(t.iso_rows().withColumn("place", place).drop("stamp"), path, "csv")
    return clean_catalog(read_catalog(t.spark, path), ordered=False).select("t_us", "mag", "place")


def _unusable(t: Tables) -> DataFrame:
    """Status of sequences of which the first one's file is no archive, some have no header, and some are blank."""
    kind = F.col("eq_id") % 7
    rows = t.joined.select(
        "eq_id",
        eq_stamp(F.col("t0_us")).alias("stamp"),
        F.when(kind == 2, "").otherwise(
            F.concat_ws(",", format_utc(F.col("t_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), "lat", "lon", F.col("mag").cast("string"))
        ).alias("value"),
    )
    first = t.main.orderBy("eq_id").select("eq_id", eq_stamp(F.col("t0_us")).alias("stamp")).first()
    rows = rows.filter(F.col("eq_id") != first["eq_id"])
    # mainshocks of one second share a file, with a header if one of them has one
    heads = rows.filter(~kind.isin(1, 2)).select("stamp").distinct().withColumn("head", F.lit("time,latitude,longitude,mag"))
    path = scratch_path(t.spark, "unusable")
    files = rows.join(heads, "stamp", "left").withColumn("file", F.concat("stamp", F.lit("_seq.csv")))
    folders = write_files(files, path)
    put_file(t.spark, f"{path}/part-x/{first['stamp']}_seq.csv.gz", b"no archive")
    ev, report = read_with_report(t.spark, folders)
    counts = well_formed(ev).groupBy("eq_id").agg(F.count("*").alias("n_events"))
    cat = t.main.withColumn("eq_id", eq_stamp(F.col("t0_us")))
    return ingest_status(cat, counts, malformed=malformed_counts(ev), bad_files=bad_files(report))


@query
def load_status_unusable_files(t: Tables) -> DataFrame:
    return _unusable(t)


@query
def load_summary_unusable_files(t: Tables) -> DataFrame:
    return ingest_summary(_unusable(t))


@query
def sequences_date_time(t: Tables) -> DataFrame:
    rows = t.joined.select(
        eq_stamp(F.col("t0_us")).alias("stamp"),
        format_utc(F.col("t_us"), "yyyy/MM/dd").alias("Date"),
        format_utc(F.col("t_us"), "HH:mm:ss.SSSSSS").alias("Time"),
        F.col("lon").alias("Lon"), F.col("lat").alias("Lat"), F.col("depth").alias("Depth"),
        F.when(F.col("depth").isNull(), "bad").otherwise(F.col("mag").cast("string")).alias("Mag"),
        F.col("mag_type").alias("MagType"),
    )
    glob = t.write_sequences(rows, "_eq.csv")
    return read_sequences(t.spark, glob, "date_time").drop("event_id")


@query
def sequence_load_counts(t: Tables) -> DataFrame:
    return load_counts(t.ev)


@query
def associate_space_time(t: Tables) -> DataFrame:
    return associate(t.cat, t.ev).select("eq_id", "event_id", "t_us", "mag", "arc_deg")


@query
def associate_limit_20000(t: Tables) -> DataFrame:
    """The limit on request."""
    return associate(t.cat, t.ev, limit=20_000).select("eq_id", "event_id", "t_us", "mag", "arc_deg")


@query
def associate_salted(t: Tables) -> DataFrame:
    pairs = candidate_pairs(t.cat, t.ev, salt=4)
    return pairs.select("eq_id", "event_id", "arc_deg")


@query
def associate_dense(t: Tables) -> DataFrame:
    """Cells that are cut where many events lie."""
    pairs = candidate_pairs(t.main, t.ev, rows_per_cell=20)
    return pairs.select("eq_id", "event_id", "arc_deg")


@query
def associate_newest_5(t: Tables) -> DataFrame:
    return associate(t.cat, t.ev, limit=5).select("eq_id", "event_id", "t_us")


@query
def incremental_new(t: Tables) -> DataFrame:
    done = t.cat.filter(F.col("t0_us") < LOADED_BEFORE_US)
    return new_only(t.cat, done).select("eq_id", "t0_us", "mainshock_mag")


def _status(t: Tables) -> DataFrame:
    done = t.cat.filter(F.col("t0_us") < LOADED_BEFORE_US)
    cached = associated_counts(candidate_pairs(done, t.ev), 110)
    counts = associated_counts(candidate_pairs(new_only(t.cat, done), t.ev), 110)
    return ingest_status(t.cat, counts, 110, cached)


@query
def load_status(t: Tables) -> DataFrame:
    return _status(t)


@query
def load_summary(t: Tables) -> DataFrame:
    return ingest_summary(_status(t))


@query
def stream_load(t: Tables) -> DataFrame:
    glob = t.write_sequences(t.iso_rows(), "_seq.csv")
    root = scratch_path(t.spark, "stream")
    return stream_ingest(t.spark, glob, f"{root}/table", f"{root}/checkpoint").drop("event_id")


def _stream_twice(t: Tables, max_files: int) -> DataFrame:
    """Every file twice, in batches of some files."""
    root = scratch_path(t.spark, "stream")
    # few files, since each batch is a job of its own
    rows = t.iso_rows().withColumn("stamp", F.concat(F.substring("stamp", 1, 9), F.lit("00000")))
    for copy in "ab":
        t.write_sequences(rows, "_seq.csv", f"{root}/in/{copy}")
    loaded = stream_ingest(
        t.spark, f"{root}/in/*/part-*", f"{root}/table", f"{root}/checkpoint", max_files=max_files
    )
    return loaded.drop("event_id")


@query
def stream_load_repeats_by_10(t: Tables) -> DataFrame:
    return _stream_twice(t, 10)


@query
def stream_load_repeats_by_1(t: Tables) -> DataFrame:
    return _stream_twice(t, 1)


@query
def feature_table_round_trip(t: Tables) -> DataFrame:
    path = write_table(
        t.features(flavor="spark"), scratch_path(t.spark, "features"), partition_by=["year"]
    )
    back = t.spark.read.parquet(path)
    return back.groupBy("year").agg(
        F.count("*").alias("n"), F.sum("aftershock_count").alias("aftershocks")
    )


@query
def single_file_round_trip(t: Tables) -> DataFrame:
    """The catalog report written as one CSV file, and read back from it."""
    rows = t.main.select("eq_id", "mainshock_mag", "mainshock_lat", "mainshock_lon", "year").repartition(5)
    path = write_table(rows, scratch_path(t.spark, "report"), "csv", single_file=True)
    back = t.spark.read.csv(path, header=True, schema="eq_id long, mainshock_mag double, mainshock_lat double, mainshock_lon double, year int")
    files = back.select(F.col("_metadata.file_path").alias("f"), "*")
    return files.withColumn("n_files", F.lit(files.select("f").distinct().count())).drop("f")


# ---- models -------------------------------------------------------------------


@query
def feature_vectors(t: Tables) -> DataFrame:
    scaled, _ = models.feature_vectors(t.features())
    values = scaled.select("eq_id", vector_to_array("features").alias("v"))
    return values.select(
        "eq_id", *[F.col("v")[i].alias(f"z_{c}") for i, c in enumerate(models.VECTOR_COLUMNS)]
    )


def _folds(rows: DataFrame) -> DataFrame:
    """``eq_id, fold, y`` of the rows the models are defined on."""
    return models.with_folds(models.training_rows(rows), CV_FOLDS).select("eq_id", "fold", F.col("label").alias("y"))


@query
def cross_ridge(t: Tables) -> DataFrame:
    """Leave one out."""
    return models.cross_predict(t.features(), "Ridge", "loo")


@query
def cross_lasso(t: Tables) -> DataFrame:
    """Leave one out; the weights meet the conditions of an optimum."""
    rows = stage_table(models.training_rows(t.features()), "rows")
    fitted = models.cross_predict_linear(rows, "Lasso", "loo", models.REGRESSION_COLUMNS)
    return fitted.select("eq_id", "model", "y", "y_hat", "optimal")


def _cross_tree(t: Tables, model: str) -> DataFrame:
    features = stage_table(t.features(), "features")
    folds = _folds(features).select("eq_id", "fold")
    return models.cross_predict(features, model, CV_FOLDS).join(folds, "eq_id")


@query
def cross_forest(t: Tables) -> DataFrame:
    """A forest predicts a mean of labels it was trained on, so it stays in their range."""
    pred = stage_table(_cross_tree(t, "RandomForest"), "forest")
    others = (
        pred.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(CV_FOLDS - 1))))
        .join(pred.select("eq_id", F.col("fold").alias("own")), "eq_id")
        .filter("fold <> own")
        .groupBy("fold")
        .agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    )
    inside = F.col("y_hat").between(F.col("lo") - 1e-9, F.col("hi") + 1e-9)
    return pred.join(others, "fold").select("eq_id", "fold", "y", "y_hat", inside.alias("in_range"))


@query
def cross_boosting(t: Tables) -> DataFrame:
    return _cross_tree(t, "GradientBoosting").select("eq_id", "fold", "y", "y_hat")


def _metrics(t: Tables) -> DataFrame:
    """Metrics of the four models, from features computed once."""
    features = stage_table(t.features(), "features")
    parts = [models.regression_metrics(models.cross_predict(features, m, CV_FOLDS)) for m in models.MODELS]
    return stage_table(reduce(DataFrame.unionByName, parts), "metrics")


@query
def model_metrics(t: Tables) -> DataFrame:
    """The errors of the four models, and what holds for any metrics."""
    return _metrics(t).select(
        "*",
        ((F.col("MAE") >= 0) & (F.col("logMAE") >= 0)).alias("errors_positive"),
        ((F.col("RMSE") >= F.col("MAE") - 0.1) & (F.col("logRMSE") >= F.col("logMAE") - 1e-4)).alias("squares_larger"),
        ((F.col("R2") <= 1) & (F.col("logR2") <= 1)).alias("r2_at_most_1"),
    )


@query
def model_best(t: Tables) -> DataFrame:
    """The model with the smallest error, and its errors."""
    return models.pick_best(_metrics(t))


def _trees(t: Tables) -> dict[str, DataFrame]:
    features = stage_table(t.features(), "features")
    trees = ("RandomForest", "GradientBoosting")
    every = len(models.REGRESSION_COLUMNS)
    return {m: models.importances(models.fit_full(features, m), every) for m in trees}


@query
def tree_importances(t: Tables) -> DataFrame:
    """Importances of all columns in both tree models."""
    return reduce(DataFrame.unionByName, [top.withColumn("model", F.lit(m)) for m, top in _trees(t).items()])


@query
def forest_importances(t: Tables) -> DataFrame:
    """The most important columns of the forest, in order."""
    return models.importances(models.fit_full(t.features(), "RandomForest"))


@query
def model_saved(t: Tables) -> DataFrame:
    """The model with the smallest error, saved, read back and applied: the same predictions."""
    rows = stage_table(models.training_rows(t.features()), "rows")
    fitted = models.fit_full(rows, models.pick_best(_metrics(t)).first()["model"])
    again = models.load_model(models.save_model(fitted, scratch_path(t.spark, "model")))
    one, two = (m.transform(rows).select("eq_id", F.col("prediction").alias(c)) for m, c in ((fitted, "p"), (again, "q")))
    return one.join(two, "eq_id").select("eq_id", F.col("p").alias("y_hat"), (F.col("p") == F.col("q")).alias("same"))


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)
