from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorframe.functions import clock, geo, scalar, seismo


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_haversine_known_distances(spark):
    quarter, zero, half, none = one(
        spark,
        geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(90.0), F.lit(10.0)),
        geo.haversine_km(F.lit(12.5), F.lit(3.0), F.lit(12.5), F.lit(3.0)),
        geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)),
        geo.haversine_km(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(0.0)),
    )
    assert quarter == pytest.approx(6371.0 * math.pi / 2)
    assert zero == 0.0
    assert half == pytest.approx(6371.0 * math.pi)
    assert none is None


def test_arc_crosses_antimeridian(spark):
    (arc,) = one(spark, geo.arc_degrees(F.lit(0.0), F.lit(179.9), F.lit(0.0), F.lit(-179.9)))
    assert arc == pytest.approx(0.2)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2011-03-11T06:00:00.100Z", 1299823200100000),
        ("2024-12-21 15:30:53.399000+00:00", 1734795053399000),
        ("2024-12-21 15:30:53+08:00", 1734766253000000),
        ("2024-12-21 15:30:53", 1734795053000000),
        ("bad", None),
        (None, None),
    ],
)
def test_parse_iso(spark, text, expected):
    assert one(spark, clock.parse_iso_micros(F.lit(text).cast("string"))) == (expected,)


@pytest.mark.parametrize(
    "date, time, expected",
    [
        ("2001/9/9", "01:46:40.5", 1_000_000_000_500_000),
        ("2001-09-09", "01:46:40", 1_000_000_000_000_000),
        (None, "01:46:40", None),
        ("x", "01:46:40", None),
    ],
)
def test_parse_date_time(spark, date, time, expected):
    cols = F.lit(date).cast("string"), F.lit(time).cast("string")
    assert one(spark, clock.parse_date_time_micros(*cols)) == (expected,)


@pytest.mark.parametrize("zone", ["UTC", "Asia/Shanghai", "America/St_Johns"])
def test_times_do_not_depend_on_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = one(
            spark,
            clock.eq_stamp(F.lit(1299823200100000)),
            clock.hour_stamp(F.lit(1299823200100000)),
            clock.parse_iso_micros(F.lit("2011-03-11T06:00:00.100Z")),
            clock.parse_date_time_micros(F.lit("2011-03-11"), F.lit("06:00:00.1")),
            clock.ntz_micros(F.lit("2011-03-11 06:00:00.1").cast("timestamp_ntz")),
        )
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == ("20110311060000", "2011031106", 1299823200100000, 1299823200100000, 1299823200100000)


def test_hours_precision(spark):
    t0, t = F.lit(900_000), F.lit(3_600_100_000)
    exact, whole = one(
        spark, clock.hours_between(t, t0), clock.hours_between(t, t0, precision="second")
    )
    assert exact == pytest.approx(3599.2 / 3600)
    assert whole == pytest.approx(1.0)
    with pytest.raises(ValueError):
        clock.hours_between(t, t0, precision="day")


def test_mag_class_edges(spark):
    classes = one(spark, *[scalar.mag_class(F.lit(m)) for m in (8.0, 7.9, 7.0, 6.5, 6.4)])
    assert classes == ("M8+", "M7-8", "M7-8", "M6.5-7", "M6-6.5")


def test_mag_type_default(spark):
    got = one(spark, *[scalar.mag_type_or_default(F.lit(t).cast("string")) for t in (" mb ", "", None)])
    assert got == ("mb", "Mw", "Mw")


def test_clip_and_logs(spark):
    got = one(
        spark,
        scalar.clip(F.lit(5.0), 0.0, 3.0),
        scalar.clip(F.lit(-5.0), 0.0, 3.0),
        scalar.clip(F.lit(None).cast("double"), 0.0, 3.0),
        scalar.log10_count(F.lit(1000)),
        scalar.count_from_log10(F.lit(2.0)),
    )
    assert got == (3.0, 0.0, None, pytest.approx(3.0), pytest.approx(100.0))


def test_digits14(spark):
    (got,) = one(spark, scalar.digits14(F.lit("/x/20110311054624_seq.csv"), r"_seq\.csv"))
    assert got == "20110311054624"


def test_text_clipping(spark):
    got = one(spark, scalar.first_chars(F.lit("20110311054624"), 8), scalar.last_chars(F.lit("20110311054624"), 6))
    assert got == ("20110311", "054624")


def test_fill_numeric_replaces_null_and_nan(spark):
    df = spark.createDataFrame([(1, None), (None, float("nan")), (3, 2.5)], "a int, b double")
    filled = scalar.fill_numeric(df, ["a", "b"])
    assert [tuple(r) for r in filled.collect()] == [(1.0, 0.0), (0.0, 0.0), (3.0, 2.5)]


def test_project_present_keeps_order(spark):
    df = spark.createDataFrame([(1, 2, 3)], "c int, x int, a int")
    assert scalar.project_present(df, ["a", "b", "c"]).columns == ["a", "c"]


def test_omori_integral_against_quadrature(spark):
    t = np.linspace(1.0, 3.0, 200_001)
    for p in (1.0, 1.08, 0.7):
        (got,) = one(spark, seismo.omori_integral(1.0, 3.0, 0.05, p))
        assert got == pytest.approx(np.trapezoid((t + 0.05) ** -p, t), rel=1e-6)


def test_omori_integral_is_continuous_at_p_one(spark):
    values = one(spark, *[seismo.omori_integral(0.0, 1.0, 0.05, p) for p in (1.0, 1 + 1e-7, 1 - 1e-7, 1 + 2e-6)])
    assert max(values) - min(values) < 1e-4


def test_omori_rate_has_a_floor(spark):
    low, normal = one(
        spark, seismo.omori_rate(-1.0, 2.0, 0.5, 1.0), seismo.omori_rate(1.5, 2.0, 0.5, 1.0)
    )
    assert low == pytest.approx(2.0e9)
    assert normal == pytest.approx(1.0)


def test_rj_largest_is_where_ln2_events_are_expected(spark):
    rj = seismo.RjParams(a=-1.2)
    (m,) = one(spark, seismo.rj_max_mag(F.lit(7.0), F.lit(0.0), F.lit(24.0), rj.a, rj))
    count, floor, cap = one(
        spark,
        seismo.rj_expected_count(F.lit(7.0), m, F.lit(0.0), F.lit(24.0), rj.a, rj),
        seismo.rj_max_mag(F.lit(7.0), F.lit(0.0), F.lit(24.0), -9.0, rj),
        seismo.rj_max_mag(F.lit(7.0), F.lit(0.0), F.lit(24.0), 9.0, rj),
    )
    assert count == pytest.approx(math.log(2))
    assert (floor, cap) == (3.0, pytest.approx(6.9))


def test_etas_max_from_total(spark):
    etas = seismo.EtasParams()
    got = one(spark, *[seismo.etas_max_from_total(F.lit(x), etas) for x in (0.001, 1.0, 10.0, 1e9)])
    assert got == (3.0, 3.0, pytest.approx(3 + 1 / 0.91), 9.5)


def test_error_credit(spark):
    got = one(spark, *[seismo.error_credit(F.lit(e), 0.3, 2.0) for e in (0.2, -0.3, 1.15, 2.0, 5.0)])
    assert got == (1.0, 1.0, pytest.approx(0.5), 0.0, 0.0)
