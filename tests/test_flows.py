"""The jobs from CSV files to result files."""

from __future__ import annotations

import glob
import os

import numpy as np
import pytest

from tremorframe.__main__ import main
from tremorframe.plans import flows

N = 14


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    root = tmp_path_factory.mktemp("inputs")
    rng = np.random.default_rng(4)
    mains, catalog = ["Year,Month,Day,Hour,Minute,Second,Mag,Lat,Lon,Depth,Source"], [
        "time,latitude,longitude,depth,mag,magType,place"
    ]
    for i in range(N):
        stamp, day = f"200101{i + 1:02d}010203", f"2001-01-{i + 1:02d}"
        lat, lon, mag = rng.uniform(-50, 50), rng.uniform(-170, 170), round(6.5 + i / 10, 1)
        mains.append(f"2001,1,{i + 1},1,2,3,{mag},{lat:.2f},{lon:.2f},10,NEIC")
        catalog.append(f"{day}T01:02:03.400Z,{lat:.2f},{lon:.2f},10,{mag},mww,here")
        t0 = np.datetime64(f"{day}T01:02:03")
        a = ["Date,Time,Lon,Lat,Depth,Mag,MagType"]
        b = ["time,latitude,longitude,depth,mag,magType,place"]
        for h in np.sort(np.append(rng.exponential(60, 20 + 5 * i), 0.0)):
            t = t0 + np.timedelta64(int(h * 3600), "s")
            date, clock = str(t).split("T")
            m, d = round(3 + rng.exponential(0.5), 1), round(rng.uniform(1, 60), 1)
            y, x = lat + rng.uniform(-1, 1), lon + rng.uniform(-1, 1)
            a.append(f"{date},{clock},{x:.3f},{y:.3f},{d},{m},mb")
            b.append(f"{date}T{clock}.000Z,{y:.3f},{x:.3f},{d},{m},mb,x")
        (root / f"{stamp}_eq.csv").write_text("\n".join(a) + "\n", encoding="utf-8-sig")
        (root / f"{stamp}_seq.csv").write_text("\n".join(b) + "\n")
    (root / "mains.csv").write_text("\n".join(mains) + "\n")
    (root / "catalog.csv").write_text("\n".join(catalog) + "\n")
    return root


def test_explore(spark, inputs, tmp_path):
    main(
        ["explore", "--catalog", f"{inputs}/catalog.csv", "--mainshocks", f"{inputs}/mains.csv",
         "--sequences", f"{inputs}/*_eq.csv", "--out", str(tmp_path)], spark,
    )
    read = lambda name: spark.read.csv(f"{tmp_path}/{name}", header=True, inferSchema=True)
    assert read("catalog_clean").count() == N
    assert {r["record_count"] for r in read("sequence_stats").collect()} == {21 + 5 * i for i in range(N)}
    assert read("mag_histogram").agg({"n": "sum"}).first()[0] == N
    assert read("mag_count_fit").first()["slope"] > 0


def test_features_then_train(spark, inputs, tmp_path):
    out = str(tmp_path)
    main(["features", "--mainshocks", f"{inputs}/mains.csv", "--sequences", f"{inputs}/*_eq.csv", "--out", out], spark)
    features = spark.read.parquet(f"{out}/features")
    assert features.count() == N and len(features.columns) == 31
    # whole seconds: the first record is the mainshock itself
    assert {r["aftershock_count"] for r in features.collect()} == {20 + 5 * i for i in range(N)}
    metrics = flows.train(features.limit(N), out, 2).collect()
    assert {r["model"] for r in metrics} == {"Ridge", "Lasso", "RandomForest", "GradientBoosting"}
    assert glob.glob(f"{out}/best_model/stages/*") and glob.glob(f"{out}/importances_RandomForest/part-*")


def test_reports(spark, inputs, tmp_path):
    out = str(tmp_path)
    main(["reports", "--catalog", f"{inputs}/catalog.csv", "--sequences", f"{inputs}/*_seq.csv", "--out", out], spark)
    top = spark.read.csv(f"{out}/top_sequences", header=True, inferSchema=True).collect()
    assert len(top) == 10 and top[0]["rank_by_count"] == 1 and top[0]["aftershock_count"] == 20 + 5 * (N - 1)
    assert spark.read.parquet(f"{out}/feature_vectors").count() == N


def test_forecast(spark, inputs, tmp_path):
    out = str(tmp_path)
    args = ["forecast", "--mainshocks", f"{inputs}/mains.csv", "--sequences", f"{inputs}/*_eq.csv", "--out"]
    main([*args, out], spark)
    pred = spark.read.csv(f"{out}/predictions", header=True)
    assert pred.count() == 3 * N
    assert len(glob.glob(f"{out}/submission/*.csv")) == 2 * N
    main([*args, f"{out}/early", "--issue-time", "24"], spark)
    early = spark.read.csv(f"{out}/early/predictions", header=True)
    assert early.filter("window = 'T1' and source = 'S1_data'").count() > 0
    assert early.filter("window <> 'T1' and source = 'S1_data'").count() == 0


def test_load_twice(spark, inputs, tmp_path):
    from tremorframe.sources.sequences import read_sequences

    events, store = str(tmp_path / "events"), str(tmp_path / "store")
    read_sequences(spark, f"{inputs}/*_seq.csv").write.parquet(events)
    args = ["load", "--catalog", f"{inputs}/catalog.csv", "--events", events, "--out", store]
    main([*args, "--top", "5"], spark)
    first = spark.read.parquet(f"{store}/events").count()
    manifest = spark.read.parquet(f"{store}/manifest")
    assert manifest.count() == 5 and first > 0
    main([*args, "--top", "8"], spark)
    manifest = spark.read.parquet(f"{store}/manifest")
    assert manifest.count() == 8 and manifest.select("eq_id").distinct().count() == 8
    assert spark.read.parquet(f"{store}/events").count() > first


def test_ingest_load_and_reports(spark, inputs, tmp_path):
    raw, store, out = (str(tmp_path / d) for d in ("raw", "store", "out"))
    main(["ingest", "--sequences", f"{inputs}/*_seq.csv", "--out", raw], spark)
    main(["load", "--catalog", f"{inputs}/catalog.csv", "--events", f"{raw}/events", "--malformed", f"{raw}/malformed", "--out", store], spark)
    manifest = spark.read.parquet(f"{store}/manifest")
    assert manifest.count() == N
    main(["reports", "--catalog", f"{inputs}/catalog.csv", "--events", f"{store}/events", "--out", out], spark)
    counts = {r["eq_id"]: r["n_events"] for r in manifest.collect()}
    features = spark.read.parquet(f"{out}/features").collect()
    assert len(features) == N and sum(r["aftershock_count"] for r in features) > 0
    assert all(r["aftershock_count"] <= counts[r["eq_id"]] for r in features)
    assert spark.read.csv(f"{out}/top_sequences", header=True).columns[1] == "year"
    with pytest.raises(SystemExit):
        main(["reports", "--catalog", f"{inputs}/catalog.csv", "--out", out], spark)


def test_a_job_removes_its_scratch_tables(spark, inputs, tmp_path):
    root = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(root))
    main(["explore", "--catalog", f"{inputs}/catalog.csv", "--mainshocks", f"{inputs}/mains.csv", "--sequences", f"{inputs}/*_eq.csv", "--out", str(tmp_path)], spark)
    assert set(os.listdir(root)) == before


def test_missing_arguments(spark):
    with pytest.raises(SystemExit):
        main(["forecast", "--out", "x"], spark)
