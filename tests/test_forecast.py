"""Calibration, epidemic rates, predictions and submission files."""

from __future__ import annotations

import math
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from conftest import HOUR, T0, rows_of

from tremorframe.functions.clock import DAY_US
from tremorframe.functions.seismo import EtasParams, etas_decay_sum
from tremorframe.operators import calibrate, etas, forecast, profile
from tremorframe.operators.enrich import enrich
from tremorframe.operators.windows import WINDOWS, each_window, window_max
from tremorframe.plans.queries import all_queries
from tremorframe.sinks.submission import coverage, submission_lines, write_submission


def test_bath_constant(spark):
    feats = spark.createDataFrame([(7.0, 5.8), (6.5, 5.5), (8.0, None), (7.1, 6.4)], "mainshock_mag double, mag_max double")
    assert calibrate.bath_constant(feats).first()["bath_delta"] == pytest.approx(-1.0)


def test_rj_a(make_events, make_cat):
    rows = [("a", 1 + i, 4.0) for i in range(10)] + [("b", 2, 4.5)] * 3 + [("c", 2, 3.9), ("b", 30 * 24 + 1, 5.0)]
    cat = make_cat([("a", 7.0), ("b", 6.0), ("c", 6.0)])
    after = enrich(make_events(rows), cat)
    integral = (30.05**-0.08 - 0.05**-0.08) / -0.08
    hats = [math.log10(n) - 0.91 * (m - 4) - math.log10(integral) for n, m in ((10, 7.0), (3, 6.0))]
    got = {r["eq_id"]: r["a_hat"] for r in calibrate.rj_a_per_sequence(after).collect()}
    assert got == {"a": pytest.approx(hats[0]), "b": pytest.approx(hats[1])}
    assert calibrate.rj_a(after).first()["a"] == pytest.approx(round(np.median(hats), 3))
    assert calibrate.rj_a(after.filter("mag > 9")).first()["a"] == -1.67


def test_omori_bins_clip_or_drop(make_events, make_cat):
    ev = make_events([("a", h, 4.0) for h in (1, 11.99, 12, 24 * 30, 24 * 40)] + [("a", 2, 3.9)])
    after = enrich(ev, make_cat([("a",)]))
    clip = {r["bin"]: r["n"] for r in calibrate.omori_bins(after).collect()}
    drop = {r["bin"]: r["n"] for r in calibrate.omori_bins(after, overflow="drop").collect()}
    assert clip == {0: 2, 1: 1, 59: 2} and drop == {0: 2, 1: 1, 59: 1}


def test_omori_fit_recovers_planted_parameters(spark, make_cat):
    k, c, p = 400.0, 0.3, 1.2
    mid = (np.arange(60) + 0.5) * 0.5
    n = np.round(1000 * k / (mid + c) ** p * 0.5).astype(int)
    bins = spark.createDataFrame([("a", i, int(v)) for i, v in enumerate(n)] + [("few", 0, 9)], "eq_id string, bin int, n bigint")
    got = {r["eq_id"]: r for r in calibrate.omori_fit(bins, make_cat([("a",), ("few",), ("none",)])).collect()}
    assert got["a"]["p"] == pytest.approx(p, rel=0.05) and got["a"]["c"] == pytest.approx(c, rel=0.2)
    model = got["a"]["k"] / (mid + got["a"]["c"]) ** got["a"]["p"] * 0.5
    assert np.abs(model - n).max() / n.max() < 0.01
    for key in ("few", "none"):
        assert (got[key]["k"], got[key]["c"], got[key]["p"]) == (50.0, 0.01, 1.0)


def test_omori_fit_is_the_least_squares_point_of_its_grid(spark, make_cat):
    rng = np.random.default_rng(0)
    y = rng.poisson(5 * np.exp(-np.arange(60) / 10.0)) + 1
    bins = spark.createDataFrame([("a", i, int(v)) for i, v in enumerate(y)], "eq_id string, bin int, n bigint")
    (row,) = calibrate.omori_fit(bins, make_cat([("a",)])).collect()
    mid = (np.arange(60) + 0.5) * 0.5
    best = math.inf
    for c in calibrate.omori_grid()[0]:
        for p in calibrate.omori_grid()[1]:
            g = 0.5 / (mid + c) ** p
            k = np.clip((y * g).sum() / (g * g).sum(), 1e-3, 1e6)
            best = min(best, ((y - k * g) ** 2).sum())
    assert row["sse"] <= best + 1e-9


def test_converged_omori_fits(spark, make_cat):
    rng = np.random.default_rng(3)
    mid = (np.arange(60) + 0.5) * 0.5
    rows, y = [], {}
    for i in range(60):
        k, c, p = 10 ** rng.uniform(0, 4), 10 ** rng.uniform(-3, 0.5), rng.uniform(0.4, 2.4)
        y[f"s{i}"] = rng.poisson(k / (mid + c) ** p * 0.5)
    y["flat"], y["last"], y["one"] = np.full(60, 3), np.eye(60, dtype=int)[59] * 40, np.eye(60, dtype=int)[0] * 40
    y = {name: n for name, n in y.items() if n.sum() >= 10}
    rows = [(name, i, int(v)) for name, n in y.items() for i, v in enumerate(n) if v]
    bins, cat = spark.createDataFrame(rows, "eq_id string, bin int, n bigint"), make_cat([(name,) for name in y])
    grid = {r["eq_id"]: r["sse"] for r in calibrate.omori_fit(bins, cat).collect()}
    lower = 0
    for r in calibrate.omori_fit(bins, cat, converge=True).collect():
        n, k, c, p = y[r["eq_id"]], r["k"], r["c"], r["p"]
        model = 0.5 * k / (mid + c) ** p
        assert r["sse"] <= grid[r["eq_id"]] and r["sse"] == pytest.approx(((n - model) ** 2).sum(), rel=1e-6, abs=1e-6)
        lower += r["sse"] < grid[r["eq_id"]] * (1 - 1e-9)
        # no way down inside the bounds
        slopes = {"k": model, "c": -p * c / (mid + c) * model, "p": -np.log(mid + c) * model}
        bounds = {"k": (1e-3, 1e6), "c": (1e-5, 5.0), "p": (0.3, 2.5)}
        for name, slope in slopes.items():
            toward = (slope * (n - model)).sum() / max(np.linalg.norm(slope) * np.linalg.norm(n - model), 1e-300)
            low, high = bounds[name]
            at_low, at_high = r[name] <= low * (1 + 1e-9), r[name] >= high * (1 - 1e-9)
            assert abs(toward) < 1e-5 or (at_low and toward < 0) or (at_high and toward > 0), (r, name, toward)
    assert lower > 40


def test_omori_medians_and_first_hour(spark):
    fits = spark.createDataFrame(
        [("a", 10.0, 0.01, 1.0), ("b", 50.0, 0.05, 1.1), ("c", 90.0, 0.02, 1.3)], "eq_id string, k double, c double, p double"
    )
    med = calibrate.omori_medians(fits)
    assert med.first().asDict() == {"k": 50.0, "c": 0.02, "p": 1.1}
    got = {r["window"]: r["first_hour"] for r in calibrate.omori_first_hour(med).collect()}
    for name, t1, t2 in WINDOWS:
        total, first = 0.0, t1
        for i in range(round((t2 - t1) / 0.1)):
            t = t1 + i * 0.1
            total += 50.0 / max(t / 24 + 0.02, 1e-9) ** 1.1 * 0.1 / 24
            if total >= 0.5:
                first = t
                break
        assert got[name] == pytest.approx(min(first, (t1 + t2) / 2))


def test_first_hour_without_crossing_or_late_crossing(spark):
    quiet = spark.createDataFrame([(1e-3, 0.01, 1.0)], "k double, c double, p double")
    slow = spark.createDataFrame([(0.6, 5.0, 0.3)], "k double, c double, p double")
    assert {r[0]: r[1] for r in calibrate.omori_first_hour(quiet).collect()} == {"T1": 0.0, "T2": 24.0, "T3": 72.0}
    assert {r[0]: r[1] for r in calibrate.omori_first_hour(slow).collect()}["T2"] == 48.0


def brute_etas(events, t1, t2, e=EtasParams()):
    rates = []
    for hour in range(int(t1), int(t2)):
        rate = e.mu
        for h, m in events:
            if h < t1:
                rate += e.k * math.exp(e.alpha * (m - e.m_min)) / ((hour - h) / 24 + e.c_days) ** e.p
        rates.append(rate)
    return rates


def test_etas_matches_brute_force(make_events, make_cat):
    events = [(-3.0, 4.0), (0.0, 7.0), (0.5, 5.0), (23.99, 4.1), (24.0, 6.0), (100.0, 5.0)]
    cat = make_cat([("a",), ("none",)])
    joined = enrich(make_events([("a", h, m) for h, m in events] + [("a", 1, None)]), cat, "all")
    rates = {(r["eq_id"], r["window"], r["hour"]): r["rate"] for r in etas.etas_rate(joined, cat).collect()}
    assert len(rates) == 2 * 168
    slots = each_window(cat.select("eq_id"))
    largest = {(r["eq_id"], r["window"]): r["etas_mag"] for r in etas.etas_max_mag(joined, slots).collect()}
    days = {(r["eq_id"], r["window"]): r["etas_mag"] for r in etas.etas_max_mag(joined, slots, etas_units="days").collect()}
    for key, own in (("a", events), ("none", [])):
        for name, t1, t2 in WINDOWS:
            want = brute_etas(own, t1, t2)
            got = [rates[key, name, h] for h in range(t1, t2)]
            assert got == pytest.approx(want)
            for total, found in ((sum(want), largest), (sum(want) / 24, days)):
                mag = 3.0 if total < 0.01 else min(max(3 + math.log(total) / (0.91 * math.log(10)), 3.0), 9.5)
                assert found[key, name] == pytest.approx(mag)


@pytest.mark.parametrize("p", [0.7, 1.0, 1.1, 2.0])
def test_sums_over_hours_are_exact_to_nine_digits(spark, p):
    e = EtasParams(p=p)
    cases = [(lag, n) for lag in (0.0, 1e-6, 0.3, 5.0, 400.0) for n in (1, 15, 16, 17, 24, 96, 5000)]
    df = spark.createDataFrame(cases, "lag double, n int")
    got = {(r["lag"], r["n"]): r["s"] for r in df.select("lag", "n", etas_decay_sum(F.col("lag"), F.col("n"), e).alias("s")).collect()}
    for lag, n in cases:
        want = math.fsum((lag + i / 24 + e.c_days) ** -p for i in range(n))
        assert got[lag, n] == pytest.approx(want, rel=1e-11), (lag, n)


def test_largest_magnitudes_need_no_row_per_hour(make_events, make_cat):
    cat = make_cat([("a",)])
    joined = enrich(make_events([("a", 1.0, 4.0)]), cat, "all")
    plan = etas.etas_max_mag(joined, each_window(cat.select("eq_id")))._jdf.queryExecution().executedPlan().toString()
    assert "explode(sequence" not in plan


@pytest.fixture
def predicted(spark, make_events, make_cat):
    cat = make_cat([("a", 7.6, 23.42, 70.23), ("b", 6.5)])
    rows = [("a", 4.2, 5.5, 0, 0, 10.0, "ms"), ("a", 47.9, 5.8, 0, 0, 10.0, "mwc"), ("a", 150, 4.9, 0, 0, 10.0, "mb"), ("b", 1, 4.0)]
    joined = enrich(make_events([(e, float(h), m, float(x), float(y), d, t) for e, h, m, x, y, d, t in [(*r, *(0, 0, 10.0, "mb")[len(r) - 3 :]) for r in rows]]), cat, "all")
    a = spark.createDataFrame([(-1.5,)], "a double")
    first = spark.createDataFrame([("T1", 0.5), ("T2", 30.0), ("T3", 80.0)], "window string, first_hour double")
    return cat, joined, a, first


def test_predictions_use_data_then_model(predicted):
    cat, joined, a, first = predicted
    got = {(r["eq_id"], r["window"]): r for r in forecast.predict(cat, joined, a, first).collect()}
    assert len(got) == 6
    assert {k for k, r in got.items() if r["source"] == "S1_data"} == {("a", "T1"), ("a", "T2"), ("a", "T3"), ("b", "T1")}
    row = got["b", "T2"]
    integral = ((3 + 0.05) ** -0.08 - (1 + 0.05) ** -0.08) / -0.08
    rj = min(max(6.5 - (math.log10(math.log(2) / integral) + 1.5) / 0.91, 3.0), 6.4)
    total = sum(brute_etas([(1.0, 4.0)], 24, 72))
    ep = max(3 + math.log(total) / (0.91 * math.log(10)), 3.0)
    assert row["pred_mag"] == pytest.approx(round(0.6 * rj + 0.4 * ep, 1))
    assert (row["source"], row["mag_type"], row["n_events"]) == ("S2_RJ+ETAS", "Mw", 0)
    assert row["pred_t_us"] == T0 + 30 * HOUR


def test_a_profile_gives_what_the_events_give(spark, make_events, make_cat):
    rng = np.random.default_rng(5)
    rows = [
        (str(rng.choice(list("abc"))), float(rng.choice([-1, 0, 24, 24.001, 72, 168, 720, 720.01, *rng.exponential(200, 9)])),
         None if i % 17 == 0 else float(rng.integers(30, 60)) / 10, 0.0, 0.0, 1.0, [None, "mb", "ms"][i % 3])
        for i in range(600)
    ]
    cat = make_cat([("a", 7.0), ("b", 6.0), ("c", 6.5)])
    ev = make_events(rows)
    joined = enrich(ev, cat, "all")
    after = joined.filter("t_us > t0_us")
    loads = [profile.event_profile(joined.filter(f"event_id % 3 = {i}")) for i in range(3)]
    for seen in (profile.event_profile(joined), profile.merge_profiles(*loads)):
        assert rows_of(profile.profile_max(seen)) == rows_of(window_max(after))
        assert rows_of(calibrate.rj_a_per_sequence_of(seen, cat)) == rows_of(calibrate.rj_a_per_sequence(after))
        for overflow in ("clip", "drop"):
            assert rows_of(profile.profile_bins(seen, 3.5, overflow)) == rows_of(calibrate.omori_bins(after, 3.5, overflow=overflow))
    issued = profile.event_profile(joined, issue_time_h=100.0)
    assert rows_of(profile.profile_max(issued)) == rows_of(window_max(after.filter("hours <= 100")))
    # the profile of all still holds what was not known yet
    assert rows_of(profile.profile_bins(issued)) == rows_of(calibrate.omori_bins(after))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables not present")
@pytest.mark.parametrize("name", ["predictions", "submission"])
def test_a_forecast_reads_the_events_once_more(spark, name):
    plan = all_queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet [^\n]*events\.parquet", plan)) <= 2
    assert len(re.findall(r"(?<!Broadcast)Exchange ", plan)) < 30


def test_predictions_issued_early_do_not_see_later_events(predicted):
    cat, joined, a, first = predicted
    got = {(r["eq_id"], r["window"]): r["source"] for r in forecast.predict(cat, joined, a, first, issue_time_h=24).collect()}
    assert got["a", "T1"] == "S1_data" and got["a", "T2"] == got["a", "T3"] == "S2_RJ+ETAS"


def test_predictions_without_calibration_fall_back(predicted):
    cat, joined, _, first = predicted
    got = {(r["eq_id"], r["window"]): r for r in forecast.predict(cat, joined, None, first).collect()}
    row = got["b", "T3"]
    assert (row["source"], row["pred_mag"], row["pred_t_us"]) == ("S3_Bath", 5.3, T0 + 120 * HOUR)
    mix = {r["eq_id"]: r["strategy"] for r in forecast.strategy_mix(forecast.predict(cat, joined, None, first)).collect()}
    assert mix == {"a": "S1_data", "b": "S1_data+S3_Bath"}


def test_perfect_forecast_scores_100(predicted):
    cat, joined, a, first = predicted
    truth = window_max(joined)
    pred = forecast.predict(cat, joined, a, first)
    assert forecast.score(pred, truth).first().asDict() == {"n_windows": 4, "score": pytest.approx(100.0)}
    assert forecast.score(pred.limit(0), truth).first()["score"] == 0.0


def test_submission_lines_and_files(spark, predicted, tmp_path):
    cat, joined, a, first = predicted
    pred = forecast.predict(cat, joined, a, first)
    lines = submission_lines(pred, cat)
    got = rows_of(lines.filter("eq_id = 'a'"), "file_name", "line_no")
    assert [r["line"] for r in got] == [
        "20010909014640 70.2300 23.4200 7.6 5.5 ms 2001090905",
        "20010909014640 70.2300 23.4200 7.6 5.8 mwc 2001091101",
        "20010909014640 70.2300 23.4200 7.6 4.9 mb 2001091507",
    ]
    assert [r["file_name"] for r in got] == ["20010909014640-T1-T2.csv"] * 2 + ["20010909014640-T3.csv"]
    cover = coverage(pred, lines).first()
    assert (cover["n_rows"], cover["n_files"]) == (6, 4)
    assert cover["data_share_pct"] == pytest.approx(100 * 4 / 6)

    only_a = submission_lines(pred.filter("eq_id = 'a'"), cat)
    path = write_submission(only_a, str(tmp_path / "out"))
    files = sorted(os.listdir(path))
    assert files == ["20010909014640-T1-T2.csv", "20010909014640-T3.csv"]
    texts = [open(f"{path}/{f}").read() for f in files]
    assert texts == ["".join(r["line"] + "\n" for r in got[:2]), got[2]["line"] + "\n"]
    # the second mainshock of that second, and a window that is not among the usual ones
    assert {r["file_name"] for r in lines.filter("eq_id = 'b'").collect()} == {
        "20010909014640-2-T1-T2.csv", "20010909014640-2-T3.csv",
    }
    other = submission_lines(pred.filter("eq_id = 'a'").withColumn("window", F.lit("T9")), cat)
    assert {r["file_name"] for r in other.collect()} == {"20010909014640-T9.csv"}


def test_days_constant():
    assert DAY_US == 24 * HOUR
