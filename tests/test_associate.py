from __future__ import annotations

import math
import random

import pytest
from conftest import CAT_SCHEMA, EVENT_SCHEMA, HOUR, T0, rows_of
from pyspark.sql import functions as F

from tremorframe.operators import associate as associate_module
from tremorframe.operators.associate import associate, associated_counts, candidate_pairs
from tremorframe.sources.incremental import ingest_status, ingest_summary, new_only


def arc(a, b):
    lat1, lon1, lat2, lon2 = map(math.radians, (*a, *b))
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return math.degrees(2 * math.atan2(math.sqrt(h), math.sqrt(1 - h)))


def scattered(seed: int, n: int):
    """Points all over the globe, crowded at the poles, the date line and one hot spot."""
    rng = random.Random(seed)
    spots = [(89.5, 0), (-89, 120), (0, 179.9), (10, -179.9), (45, 182.5), (30, 30), (86.9, -60), (0, 0)]
    out = []
    for _ in range(n):
        lat, lon = rng.choice(spots)
        lat = max(-90.0, min(90.0, lat + rng.uniform(-4, 4)))
        out.append((round(lat, 2), round(lon + rng.uniform(-6, 6), 2)))
    return out


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(3)
    mains = [(f"m{i}", T0 + rng.randrange(400 * HOUR), p) for i, p in enumerate(scattered(1, 120))]
    events = [(i, T0 + rng.randrange(600 * HOUR), p, rng.choice((1.9, 2.0, 4.5))) for i, p in enumerate(scattered(2, 1200))]
    events += [(5000 + i, T0 + 100 * HOUR, (30.0, 30.0), 3.0) for i in range(400)]  # one hot cell
    cat = spark.createDataFrame([(k, t, 7.0, 10.0, *p, 2001) for k, t, p in mains], CAT_SCHEMA)
    ev = spark.createDataFrame([("x", i, t, *p, None, m, "mb") for i, t, p, m in events], EVENT_SCHEMA)
    return mains, events, cat, ev


def naive(mains, events, radius=3.0, hours=168, min_mag=2.0):
    return {
        (k, i)
        for k, t0, p in mains
        for i, t, q, m in events
        if m >= min_mag and 0 <= t - t0 // 1_000_000 * 1_000_000 <= hours * HOUR and arc(p, q) <= radius + 1e-9
    }


@pytest.mark.parametrize("radius, hours, salt", [(3.0, 168, 1), (3.0, 168, 5), (7.0, 24, 1), (0.7, 300, 1), (50.0, 10, 1)])
def test_cells_find_exactly_the_naive_pairs(world, radius, hours, salt):
    mains, events, cat, ev = world
    got = [(r["eq_id"], r["event_id"]) for r in candidate_pairs(cat, ev, radius, hours, salt=salt).collect()]
    want = naive(mains, events, radius, hours)
    assert len(got) == len(set(got)) and set(got) == want and want


@pytest.mark.parametrize("rows", [1, 40])
@pytest.mark.parametrize("radius, hours", [(3.0, 168), (7.0, 24), (0.7, 300), (50.0, 10)])
def test_cut_cells_find_exactly_the_naive_pairs(world, radius, hours, rows):
    mains, events, cat, ev = world
    got = [(r["eq_id"], r["event_id"]) for r in candidate_pairs(cat, ev, radius, hours, rows_per_cell=rows).collect()]
    assert len(got) == len(set(got)) and set(got) == naive(mains, events, radius, hours)


def test_no_cell_stays_crowded(spark, make_cat):
    """A spread-out crowd is quartered, events on one spot are dealt, and both find the mainshock's events."""
    rng = random.Random(9)
    places = [(30.0 + rng.uniform(0, 2.9), 30.0 + rng.uniform(0, 2.9)) for _ in range(20_000)] + [(31.0, 31.0)] * 20_000
    ev = spark.createDataFrame([("x", i, T0 + i, *p, None, 3.0, "mb") for i, p in enumerate(places)], EVENT_SCHEMA)
    seen = {}
    whole = associate_module._by_density

    def kept(events, main, rows):
        seen["events"], seen["main"] = whole(events, main, rows)
        return seen["events"], seen["main"]

    associate_module._by_density = kept
    try:
        pairs = candidate_pairs(make_cat([("a", 7.0, 31.0, 31.0), ("far", 7.0, 32.95, 32.95)]), ev, radius_deg=1.0, rows_per_cell=500)
        n = {r["eq_id"]: r["count"] for r in pairs.groupBy("eq_id").count().collect()}
    finally:
        associate_module._by_density = whole
    assert n["a"] == sum(arc((31.0, 31.0), p) <= 1.0 + 1e-9 for p in places)
    keys = [*associate_module.QUARTER, "part"]
    assert seen["events"].groupBy(*keys).count().agg({"count": "max"}).first()[0] < 1500
    # a mainshock visits few of the quarters
    held = seen["events"].select(*keys).distinct()
    assert seen["main"].filter("eq_id = 'far'").join(held, keys).count() < held.count() / 2


def test_join_is_an_equi_join(world):
    _, _, cat, ev = world
    plan = candidate_pairs(cat, ev)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def cell_joins(plan):
    """The join operators of a plan that have the cell among their keys."""
    return {line.split("[")[0].split()[-1] for line in plan.splitlines() if "Join [" in line and "latb#" in line}


@pytest.mark.parametrize("salt", [1, 3])
def test_a_small_table_of_mainshocks_is_not_broadcast_in_its_cells(spark, world, tmp_path, salt):
    """Each mainshock is many rows there, however small its table is on disk."""
    _, _, cat, ev = world
    cat.write.parquet(f"{tmp_path}/cat")
    stored = spark.read.parquet(f"{tmp_path}/cat")
    assert cell_joins(plan_of(candidate_pairs(stored, ev, salt=salt))) == {"SortMergeJoin"}


def test_the_newest_are_found_without_broadcasting_the_cells(spark, world, tmp_path, monkeypatch):
    _, _, cat, ev = world
    cat.write.parquet(f"{tmp_path}/cat")
    stored = spark.read.parquet(f"{tmp_path}/cat")
    plans, stage = [], associate_module.stage_table
    monkeypatch.setattr(associate_module, "stage_table", lambda df, name: plans.append(plan_of(df)) or stage(df, name))
    plans.append(plan_of(associate(stored, ev, limit=7)))
    assert [cell_joins(p) for p in plans if "latb#" in p] and all(cell_joins(p) <= {"SortMergeJoin"} for p in plans)
    assert cell_joins(plans[0]) and cell_joins(plans[-1])  # where cells are counted, and the pairs


def test_limit_keeps_the_newest(world):
    mains, events, cat, ev = world
    when = {i: t for i, t, _, _ in events}
    got = {}
    for r in associate(cat, ev, limit=7).collect():
        got.setdefault(r["eq_id"], set()).add(r["event_id"])
    want = {}
    for k, i in naive(mains, events):
        want.setdefault(k, []).append(i)
    assert got == {k: set(sorted(v, key=lambda i: (-when[i], -i))[:7]) for k, v in want.items()}
    counts = {r["eq_id"]: r["n_events"] for r in associated_counts(candidate_pairs(cat, ev), 7).collect()}
    assert counts == {k: len(v) for k, v in got.items()}


def test_both_time_ends_count(make_cat, make_events):
    cat = make_cat([("a", 7.0, 0.0, 0.0, T0 + 500_000)])  # half a second after the full one
    ev = make_events([("x", 0, 3.0), ("x", 168, 3.0), ("x", 168 + 1 / HOUR, 3.0), ("x", -1 / HOUR, 3.0)])
    assert [r["event_id"] for r in rows_of(candidate_pairs(cat, ev), "event_id")] == [0, 1]


def test_radius_is_checked(world):
    with pytest.raises(ValueError):
        candidate_pairs(world[2], world[3], radius_deg=0)


def test_status_of_a_load(spark, make_cat):
    cat = make_cat([(k,) for k in ("cached", "empty", "ok", "full", "broken")])
    counts = spark.createDataFrame([("ok", 5), ("full", 19_900)], "eq_id string, n_events bigint")
    cached = spark.createDataFrame([("cached", 3)], "eq_id string, n_events bigint")
    bad = spark.createDataFrame([("broken", 2), ("ok", 1)], "eq_id string, n_malformed bigint")
    unlimited = ingest_status(cat, counts, cached=cached, malformed=bad)
    assert unlimited.filter("eq_id = 'full'").first()["status"] == "ok"  # no limit was asked for
    status = ingest_status(cat, counts, 20_000, cached, bad)
    assert {r["eq_id"]: (r["n_events"], r["status"]) for r in status.collect()} == {
        "cached": (3, "cached"), "empty": (0, "empty"), "ok": (5, "ok"),
        "full": (19_900, "truncated"), "broken": (0, "parse_error"),
    }
    assert ingest_summary(status).first().asDict() == {
        "n_success": 3, "n_failed": 0, "n_empty": 1, "events_total": 19_908,
        "events_mean": pytest.approx(6636.0), "events_max": 19_900, "events_min": 3,
    }


def test_new_only(spark, make_cat):
    done = spark.createDataFrame([("a",), ("a",)], "eq_id string")
    assert [r["eq_id"] for r in new_only(make_cat([("a",), ("b",)]), done).collect()] == ["b"]


@pytest.mark.parametrize("limit", [3, 40])
def test_the_newest_are_found_without_ranking_all_pairs(world, monkeypatch, limit):
    """Of a limit that no mainshock can exceed nothing is ranked; of a low one few pairs are."""
    cat, ev = world[2:]
    ranked, rank = [], associate_module.newest
    monkeypatch.setattr(associate_module, "newest", lambda pairs, n: ranked.append(pairs.count()) or rank(pairs, n))
    every = candidate_pairs(cat, ev, 30.0)
    want = {(r["eq_id"], r["event_id"]) for r in rank(every, limit).collect()}
    got = [(r["eq_id"], r["event_id"]) for r in associate(cat, ev, 30.0, limit=limit).collect()]
    assert len(got) == len(want) and set(got) == want
    n = every.groupBy("eq_id").count().agg(F.max("count")).first()[0]
    ranked.clear()
    assert associate(cat, ev, 30.0, limit=40 * n).count() == every.count() and sum(ranked) == 0


def test_a_limit_below_all_pairs_ranks_a_part_of_them(spark, make_cat, make_events, monkeypatch):
    ev = make_events([("a", 0.02 * i, 3.0) for i in range(8401)])
    cat = make_cat([("a", 7.0, 0.0, 0.0, T0)])
    ranked, rank = [], associate_module.newest
    monkeypatch.setattr(associate_module, "newest", lambda pairs, n: ranked.append(pairs.count()) or rank(pairs, n))
    want = {r["event_id"] for r in rank(candidate_pairs(cat, ev), 5).collect()}
    assert {r["event_id"] for r in associate(cat, ev, limit=5).collect()} == want
    assert 0 < sum(ranked) < 200


def test_a_mainshock_without_an_id_has_its_newest_too(make_cat, make_events):
    ev = make_events([("a", float(i), 3.0) for i in range(60)])
    cat = make_cat([("a", 7.0, 0.0, 0.0, T0)]).withColumn("eq_id", F.lit(None).cast("string"))
    assert sorted(r["event_id"] for r in associate(cat, ev, limit=5).collect()) == [55, 56, 57, 58, 59]
