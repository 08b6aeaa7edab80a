"""Sources, sinks and the stream, on tiny files written here."""

from __future__ import annotations

import os
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from conftest import T0, rows_of
from pyspark.sql import functions as F

from tremorframe import session
from tremorframe.sinks.tables import read_back_count, write_event_table, write_files, write_table
from tremorframe.sources import catalog, sequences
from tremorframe.sources.lines import read_csv
from tremorframe.sources.schemas import NEEDED, OPTIONAL
from tremorframe.streaming.ingest import stream_ingest

ISO_HEAD = "time,latitude,longitude,depth,mag,magType,place\n"


def put(folder, name, text, encoding="utf-8"):
    os.makedirs(folder, exist_ok=True)
    (folder / name).write_text(text, encoding=encoding)


@pytest.fixture
def iso_files(tmp_path):
    put(
        tmp_path / "iso", "20010909014640_seq.csv",
        ISO_HEAD
        + '2001-09-09T01:46:41.500Z,1.5,2.5,10,4.5,mb,"5 km N, of town"\n'
        + "2001-09-09T02:46:40.000Z,1.5,2.5,,3.1,mb,x\n"
        + "2001-09-09T03:46:40.000Z,1.5,bad,1,3.1,mb,x\n"
        + "notatime,1.5,2.5,1,3.1,mb,x\n"
        + "2001-09-09T04:46:40.000Z,1.5,2.5,1,,mb,x\n"
        + "2001-09-09T05:46:40.000Z,1.5\n",
    )
    put(tmp_path / "iso", "20020909014640_seq.csv", ISO_HEAD)
    return tmp_path / "iso"


def test_read_iso_sequences(spark, iso_files):
    ev = sequences.read_sequences(spark, f"{iso_files}/*_seq.csv")
    got = rows_of(ev, "t_us")
    assert [(r["eq_id"], r["t_us"], r["mag"], r["depth"]) for r in got] == [
        ("20010909014640", T0 + 1_500_000, 4.5, 10.0),
        ("20010909014640", T0 + 3_600_000_000, 3.1, None),
        ("20010909014640", T0 + 7_200_000_000, 3.1, 1.0),  # its longitude cannot be read
    ]
    assert [r["lon"] for r in got] == [2.5, 2.5, None]
    loose = sequences.read_sequences(spark, f"{iso_files}/*_seq.csv", strict=False)
    assert loose.count() == 5  # only the damaged line is gone
    assert loose.select("mag").collect() == loose.select("*").select("mag").collect()
    kept = sequences.read_sequences(spark, f"{iso_files}/*_seq.csv", keep_malformed=True)
    assert [tuple(r) for r in sequences.malformed_counts(kept).collect()] == [("20010909014640", 1, 1)]
    assert tuple(sequences.load_counts(ev).first()) == (3, 1)


def test_event_ids_do_not_depend_on_the_folder(spark, iso_files, tmp_path):
    text = (iso_files / "20010909014640_seq.csv").read_text()
    put(tmp_path / "again", "20010909014640_seq.csv", text)
    ids = lambda p: {r["event_id"] for r in sequences.read_sequences(spark, f"{p}/*_seq.csv").collect()}
    assert ids(iso_files) == ids(tmp_path / "again") and len(ids(iso_files)) == 3


def test_read_date_time_sequences_with_bom_and_bad_values(spark, tmp_path):
    put(
        tmp_path / "dt", "20010909014640_eq.csv",
        "Date,Time,Lon,Lat,Depth,Mag,MagType\n"
        "2001/9/9,01:46:41,2.5,1.5,,4.5,mb\n2001-09-09,01:46:42.25,2.5,1.5,3,bad,mb\n2001-09-09,01:46:43,2.5,1.5,3, 5.0 ,ms\n",
        "utf-8-sig",
    )
    got = rows_of(sequences.read_sequences(spark, f"{tmp_path}/dt/*_eq.csv", "date_time"), "t_us")
    assert [(r["t_us"], r["lat"], r["lon"], r["mag"]) for r in got] == [
        (T0 + 1_000_000, 1.5, 2.5, 4.5), (T0 + 3_000_000, 1.5, 2.5, 5.0),
    ]
    loose = sequences.read_sequences(spark, f"{tmp_path}/dt/*_eq.csv", "date_time", strict=False)
    assert loose.filter("mag is null").count() == 1
    with pytest.raises(ValueError):
        sequences.read_sequences(spark, str(tmp_path), "other")


@pytest.mark.parametrize("zone", ["UTC", "Asia/Shanghai"])
def test_catalog_is_read_the_same_in_every_zone(spark, tmp_path, zone):
    put(
        tmp_path, "query.csv",
        "time,latitude,longitude,depth,mag,magType,nst,place\n"
        "2001-09-09T01:46:40.500Z,1.5,2.5,10,7.5,mww,12,here\n"
        "2024-12-31 23:30:53.399000+00:00,1.5,2.5,10,6.5,mww,,there\n",
    )
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        clean = catalog.clean_catalog(catalog.read_catalog(spark, f"{tmp_path}/query.csv"))
        rows = clean.collect()
        mains = rows_of(catalog.mainshocks_from_catalog(clean), "eq_id")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [(r["year"], r["month"], r["place"]) for r in rows] == [(2024, 12, "there"), (2001, 9, "here")]
    assert [(r["eq_id"], r["t0_us"], r["year"]) for r in mains] == [
        ("20010909014640", T0, 2001), ("20241231233053", 1735687853000000, 2024),
    ]


def test_read_mainshocks(spark, tmp_path):
    put(tmp_path, "cat.csv", "Year,Month,Day,Hour,Minute,Second,Mag,Lat,Lon,Depth,Source\n2001,9,9,1,46,40,7.6,23.42,70.23,16,NEIC\n")
    (row,) = catalog.read_mainshocks(spark, f"{tmp_path}/cat.csv").collect()
    assert (row["eq_id"], row["t0_us"], row["mainshock_mag"], row["source"], row["year"]) == (
        "20010909014640", T0, 7.6, "NEIC", 2001,
    )


def test_top_mainshocks_prefers_newer_ones(make_cat):
    cat = make_cat([("a", 7.0, 0.0, 0.0, 1), ("b", 8.0, 0.0, 0.0, 1), ("c", 7.0, 0.0, 0.0, 2)])
    assert [r["eq_id"] for r in catalog.top_mainshocks(cat, 2).collect()] == ["b", "c"]


def test_write_table_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2001), (2, "b", 2002)], "x int, y string, year int")
    path = write_table(df, str(tmp_path / "p"), partition_by=["year"])
    assert sorted(d for d in os.listdir(path) if d.startswith("year=")) == ["year=2001", "year=2002"]
    assert read_back_count(spark, path, 2) == 2
    with pytest.raises(AssertionError):
        read_back_count(spark, path, 3)
    csv = write_table(df.repartition(3), str(tmp_path / "c"), "csv", single_file=True)
    (part,) = [f for f in os.listdir(csv) if f.startswith("part-")]
    assert open(f"{csv}/{part}").readline() == "x,y,year\n"
    with pytest.raises(ValueError):
        write_table(df, csv, "xml")


def test_event_table_splits_a_hot_sequence(spark, make_events, tmp_path):
    ev = make_events([("hot", i, 3.0) for i in range(300)] + [("a", 1, 3.0), ("z", 2, 3.0)])
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # tiny ranges would be merged again
    try:
        back = spark.read.parquet(write_event_table(ev, str(tmp_path / "ranged")))
    finally:
        spark.conf.set(key, "true")
    files = back.groupBy(F.input_file_name().alias("file")).agg(
        F.min(F.struct("eq_id", "t_us")).alias("lo"), F.max(F.struct("eq_id", "t_us")).alias("hi"), F.count("*").alias("n")
    )
    rows = sorted(files.collect(), key=lambda r: r["lo"])
    assert sum(r["n"] for r in rows) == 302 and max(r["n"] for r in rows) < 200
    assert all(a["hi"] < b["lo"] for a, b in zip(rows, rows[1:]))
    plan = back.filter("eq_id = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(eq_id), EqualTo(eq_id,a)]" in plan


def test_one_mainshock_per_second(make_cat):
    cat = make_cat([("a", 7.0), ("a", 7.5), ("b", 6.0)])
    got = rows_of(catalog.unique_mainshocks(cat), "eq_id")
    assert [(r["eq_id"], r["mainshock_mag"]) for r in got] == [("a", 7.5), ("b", 6.0)]
    assert catalog.unique_mainshocks(cat).columns == cat.columns


def test_scratch_root_is_the_configured_one(spark):
    assert session.scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")


def test_stage_table_keeps_rows_and_types(spark):
    df = spark.range(5).withColumnRenamed("id", "x")
    staged = session.stage_table(df, "staged")
    assert staged.dtypes == df.dtypes and staged.count() == 5


def test_staged_tables_that_only_pass_are_removed(spark):
    root = session.scratch_root(spark)

    def left(name):
        return sum(x.startswith(name) for x in os.listdir(root))

    def made():
        with session.passing_table(spark.range(5), "passing") as some:
            assert left("passing") == 1
            kept = session.stage_table(some, "between")
        assert left("passing") == 0
        inner = session.stage_apart(spark, lambda: session.stage_table(kept, "inside"), "inner")
        assert left("inside") == 0 and left("inner") == left("between") == 1
        return inner

    with ThreadPoolExecutor(1) as pool:
        other = []
        got = session.stage_apart(spark, lambda: other.append(pool.submit(session.stage_table, spark.range(3), "other").result()) or made(), "apart")
    assert got.count() == 5 and left("between") == left("inner") == 0
    assert other[0].count() == 3


def test_files_of_one_set_order_their_columns_differently(spark, tmp_path):
    put(tmp_path, "20010909014640_eq.csv", "Date,Time,Lat,Lon,Mag\n2001/9/9,01:46:41,10,100,4.5\n")
    put(
        tmp_path, "20020909014640_eq.csv",
        'MagType,Mag,x,Depth,Lon,Lat,Time,Date\nmb,5.5,"a, b",7,-20,-30,01:46:41,2002/9/9\nmb,6.5,y,deep,1,2,01:46:42,2002/9/9\n', "utf-8-sig",
    )
    got = rows_of(sequences.read_sequences(spark, f"{tmp_path}/*_eq.csv", "date_time"), "eq_id", "t_us")
    assert [(r["lat"], r["lon"], r["depth"], r["mag"], r["mag_type"]) for r in got] == [
        (10.0, 100.0, None, 4.5, None), (-30.0, -20.0, 7.0, 5.5, "mb"), (2.0, 1.0, None, 6.5, "mb"),
    ]


def test_catalog_files_are_read_by_their_own_headers(spark, tmp_path):
    put(tmp_path / "c", "a.csv", "time,latitude,longitude,depth,mag,magType,place\n2001-09-09T01:46:40Z,1,2,3,7,mb,x\n")
    put(tmp_path / "c", "b.csv", "time,longitude,latitude,mag\n2002-09-09T01:46:40Z,2,1,8\n")
    got = rows_of(catalog.read_catalog(spark, f"{tmp_path}/c"), "mag")
    assert [(r["latitude"], r["longitude"], r["depth"]) for r in got] == [(1.0, 2.0, 3.0), (1.0, 2.0, None)]


def test_a_file_without_a_needed_column_is_an_error_that_names_it(spark, tmp_path):
    put(tmp_path, "20010909014640_seq.csv", "time,latitude,depth,mag\n2001-09-09T01:46:40Z,1,3,7\n")
    with pytest.raises(Exception, match="no header with time, latitude, longitude, mag in .*20010909014640_seq.csv"):
        sequences.read_sequences(spark, f"{tmp_path}/*_seq.csv").collect()


def test_mainshock_seconds_and_damage(spark, tmp_path):
    head = "Lon,Lat,Second,Minute,Hour,Day,Month,Year,Mag\n"
    put(tmp_path, "cat.csv", head + "70.23,23.42,40.25,46,1,9,9,2001,7.6\n")
    (row,) = catalog.read_mainshocks(spark, f"{tmp_path}/cat.csv").collect()
    assert (row["t0_us"], row["mainshock_lat"], row["mainshock_lon"], row["source"]) == (T0 + 250_000, 23.42, 70.23, None)
    for n, bad in enumerate(["70.23,23.42,x,46,1,9,9,2001,7.6", "70.23,23.42,40", "70.23,23.42,40,46,1,9,13,2001,7.6"]):
        put(tmp_path, f"bad{n}.csv", head + bad + "\n")
        with pytest.raises(Exception, match=f"mainshock without a time.*bad{n}.csv"):
            catalog.read_mainshocks(spark, f"{tmp_path}/bad{n}.csv").collect()


def test_records_that_span_lines(spark, tmp_path):
    text = (
        "\n" + ISO_HEAD + '2001-09-09T01:46:41Z,1,2,10,4.5,mb,"a\nb, ""c"""\n'
        + "\n  \n2001-09-09T01:46:42Z,1,2,10,4.6,mb,x\n2001-09-09T01:46:43Z,1,2,10,4.7\n"
    )
    put(tmp_path / "s", "20010909014640_seq.csv", text)
    put(tmp_path / "s", "20020909014640_seq.csv", ISO_HEAD + '2002-09-09T01:46:41Z,1,2,10,4.5,mb,"say \\"a\\", b"\n')
    ev = sequences.read_sequences(spark, f"{tmp_path}/s/*_seq.csv")
    assert [(r["mag"], r["eq_id"][:4]) for r in rows_of(ev, "t_us")] == [(4.5, "2001"), (4.6, "2001"), (4.5, "2002")]
    kept = sequences.read_sequences(spark, f"{tmp_path}/s/*_seq.csv", keep_malformed=True)
    assert [tuple(r) for r in sequences.malformed_counts(kept).orderBy("eq_id").collect()][0] == ("20010909014640", 1, 0)
    raw = catalog.read_catalog(spark, f"{tmp_path}/s/*_seq.csv")
    assert sorted(r["place"] for r in raw.collect()) == ['a\nb, "c"', 'say "a", b', "x"]


def test_blank_files_and_names_like_patterns(spark, tmp_path):
    put(tmp_path / "s", "20010909014640_seq.csv", "\n")
    put(tmp_path / "s", "20020909014640_seq.csv", "")
    put(tmp_path / "s", "[a] {b}*20030909014640_seq.csv", ISO_HEAD + "2003-09-09T01:46:41Z,1,2,10,4.5,mb,x\n")
    ev = sequences.read_sequences(spark, f"{tmp_path}/s")
    assert [r["eq_id"] for r in ev.collect()] == ["20030909014640"]
    _, report = sequences.read_with_report(spark, f"{tmp_path}/s")
    assert [(r["eq_id"][:4], r["status"]) for r in rows_of(report, "eq_id")] == [("2001", "empty"), ("2002", "empty"), ("2003", "ok")]
    only = sequences.read_sequences(spark, f"{tmp_path}/s/2*_seq.csv")
    assert only.count() == 0 and only.columns == ev.columns
    plan = ev._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1 and "text" not in plan


@pytest.fixture
def unusable_files(tmp_path):
    """Two good files, one that is no archive, one cut off, and one without a header."""
    import gzip

    row = "2001-09-09T01:46:41Z,1,2,10,4.5,mb,x\n"
    folder = tmp_path / "bad"
    put(folder, "20010909014640_seq.csv", ISO_HEAD + row)
    whole = gzip.compress((ISO_HEAD + "".join(f"2001-09-09T01:46:{i % 60:02}.{i:06}Z,{i % 90},2,10,4.5,mb,p{i * 7919}\n" for i in range(90000))).encode())
    (folder / "20020909014640_seq.csv.gz").write_bytes(gzip.compress((ISO_HEAD + row).encode()))
    (folder / "20030909014640_seq.csv.gz").write_bytes(b"this is no archive")
    (folder / "20040909014640_seq.csv.gz").write_bytes(whole[: len(whole) // 2])
    put(folder, "20050909014640_seq.csv", row)
    return folder


def test_a_bad_file_does_not_stop_the_others(spark, unusable_files):
    ev, report = sequences.read_with_report(spark, str(unusable_files))
    assert sorted(r["eq_id"][:4] for r in sequences.well_formed(ev).collect()) == ["2001", "2002"]
    status = {r["eq_id"][:4]: r["status"] for r in report.collect()}
    assert status == {"2001": "ok", "2002": "ok", "2003": "failed", "2004": "failed", "2005": "parse_error"}
    with pytest.raises(ValueError, match="cannot read .*2003"):
        sequences.read_sequences(spark, str(unusable_files))


def test_stream_passes_over_bad_files_and_takes_them_when_mended(spark, unusable_files, tmp_path):
    def load():
        got = stream_ingest(spark, str(unusable_files), str(tmp_path / "sink"), str(tmp_path / "mark"))
        return sorted(r["eq_id"][:4] for r in got.collect())

    assert load() == ["2001", "2002"]
    put(unusable_files, "20050909014640_seq.csv", ISO_HEAD + "2005-09-09T01:46:41Z,1,2,10,4.5,mb,x\n")
    assert load() == ["2001", "2002", "2005"]
    assert load() == ["2001", "2002", "2005"]


def bytes_read(spark):
    return sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())


def test_a_batch_does_not_read_the_table(spark, tmp_path):
    folder, sink, mark = tmp_path / "in", str(tmp_path / "sink"), str(tmp_path / "mark")
    noise = lambda year, n: ISO_HEAD + "".join(
        f"{year}-09-09T01:46:{i % 60:02}.{i * 7919 % 1000000:06}Z,{i * 31 % 90}.{i * 7919 % 10**6},{i * 37 % 180}.{i * 104729 % 10**6},10,4.5,mb,x\n" for i in range(n)
    )

    def load(year, n):
        put(folder, f"{year}0909014640_seq.csv", noise(year, n))
        before = bytes_read(spark)
        stream_ingest(spark, str(folder), sink, mark)
        return bytes_read(spark) - before

    load(2001, 50)
    small = load(2002, 50)
    load(2003, 40_000)
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(sink) for f in names)
    large = load(2004, 50)
    assert size > 500_000 and large < small + size / 10
    # the large file again, of which every event is known
    put(folder, "20050909014640_seq.csv", noise(2003, 40_000))
    (folder / "again").mkdir()
    put(folder / "again", "20030909014640_seq.csv", noise(2003, 40_000))
    stream_ingest(spark, str(folder / "again"), sink, str(tmp_path / "other"))
    assert spark.read.parquet(sink).filter("eq_id like '2003%'").count() == 40_000


def test_stream_forgets_when_asked_to(spark, iso_files, tmp_path):
    got = stream_ingest(spark, str(iso_files), str(tmp_path / "sink"), str(tmp_path / "mark"), forget_after="1 day")
    assert got.count() == 3


def test_stream_takes_each_file_once(spark, iso_files, tmp_path):
    sink, mark = str(tmp_path / "sink"), str(tmp_path / "mark")

    def load():
        return stream_ingest(spark, str(iso_files), sink, mark)

    first = load()
    batch = sequences.read_sequences(spark, f"{iso_files}/*_seq.csv")
    assert rows_of(first, "t_us") == rows_of(batch, "t_us")
    assert load().count() == 3
    put(iso_files, "20030909014640_seq.csv", ISO_HEAD + "2003-09-09T01:46:41.500Z,1.5,2.5,10,4.5,mb,x\n" * 2)
    assert load().count() == 4  # the new file once, its repeated row once


@pytest.mark.parametrize("max_files", [1, 2, 10])
def test_stream_does_not_depend_on_the_size_of_batches(spark, iso_files, tmp_path, max_files):
    sink, mark = str(tmp_path / "sink"), str(tmp_path / "mark")
    text = (iso_files / "20010909014640_seq.csv").read_text()
    put(tmp_path / "iso2", "20010909014640_seq.csv", text + "2001-09-09T06:46:40.000Z,,2.5,1,3.5,mb,x\n")
    put(tmp_path / "iso3", "20010909014640_seq.csv", text)
    got = stream_ingest(spark, f"{iso_files}*", sink, mark, max_files=max_files)
    assert sorted(r["t_us"] - T0 for r in got.collect()) == [1_500_000, 3_600_000_000, 7_200_000_000, 18_000_000_000]


def test_a_repeated_stream_batch_replaces_itself(spark, iso_files, tmp_path):
    sink = str(tmp_path / "sink")
    for mark in ("one", "two"):  # a lost checkpoint runs batch 0 again
        got = stream_ingest(spark, str(iso_files), sink, str(tmp_path / mark))
    assert got.count() == 3


def test_many_files_take_a_folder_per_task_and_one_scan(spark, tmp_path, monkeypatch):
    rows = spark.range(600).selectExpr(
        "concat(20010909014640 + id % 300, '_seq.csv') AS file",
        "IF(id % 300 < 200, 'time,latitude,longitude,mag', IF(id % 300 < 299, 'mag,net,time,longitude,latitude', NULL)) AS head",
        "IF(id % 300 < 200, '2001-09-09T01:46:41Z,1,2,4.5', '4.5,us,2001-09-09T01:46:41Z,2,1') AS value",
    )
    folders = write_files(rows.unionByName(spark.sql("SELECT CAST(NULL AS STRING) AS file, 'x' AS head, 'y' AS value")), f"{tmp_path}/s")
    assert len(list((tmp_path / "s").iterdir())) < 20
    ev, report = sequences.read_with_report(spark, folders)
    assert {r["status"]: r["count"] for r in report.dropDuplicates(["eq_id"]).groupBy("status").count().collect()} == {"ok": 299, "parse_error": 1}
    plan = ev._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    found = sequences.well_formed(ev).groupBy("lat", "lon", "mag").agg(F.count("*"), F.countDistinct("eq_id")).collect()
    assert [tuple(r) for r in found] == [(1.0, 2.0, 4.5, 598, 299)]
    monkeypatch.setattr("tremorframe.sources.lines.MANY_FILES", 10)
    alike = write_files(rows.filter("head LIKE 'time%'"), f"{tmp_path}/t")
    ev = sequences.read_sequences(spark, alike)
    assert "FileScan csv" not in ev._jdf.queryExecution().executedPlan().toString()
    assert ev.count() == 400 and ev.select("eq_id").distinct().count() == 200


@pytest.mark.parametrize("many", [0, 1_000])
def test_lines_are_split_as_the_csv_reader_does(spark, tmp_path, monkeypatch, many):
    monkeypatch.setattr("tremorframe.sources.lines.MANY_FILES", many)
    time = "2001-09-09T01:46:41Z"
    lines = [f'{time},1,2,10,4.5,mb,"a ""b"", c"', f"{time},1,2,10,4.5,mb", f"{time},1,2,x,4.5,,", f"{time},1,2,10,4.5,mb,x,y", "   ", f'{time}, 1 ,2,"",4.5,mb,']
    put(tmp_path / "s", "20010909014640_seq.csv", ISO_HEAD + "\n".join(lines) + "\n" + ISO_HEAD)
    raw = read_csv(spark, f"{tmp_path}/s", NEEDED["iso"], OPTIONAL["iso"]).drop("source_file")
    assert sorted(raw.select("depth", "magType", "place", "_corrupt_record").collect(), key=str) == sorted(
        [("10", "mb", 'a "b", c', None), ("10", "mb", None, lines[1]), ("x", None, None, None), ("10", "mb", "x", lines[3]), (None, "mb", None, None)], key=str
    )


def test_a_staged_table_leaves_no_shuffle_files(spark):
    """They would stay until the driver collects its garbage, and take the place of the next tables."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled() -> set[str]:
        files = manager.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before = shuffled()
    grouped = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    kept = session.stage_table(grouped, "grouped")
    deadline = time.monotonic() + 30
    while shuffled() - before and time.monotonic() < deadline:
        time.sleep(0.2)
    assert not shuffled() - before
    assert kept.count() == 7 and grouped.count() == 7
    assert spark.conf.get(session.FREE_SHUFFLES) == "false"
    with session.freed_shuffles(spark):
        with session.freed_shuffles(spark):
            pass
        assert spark.conf.get(session.FREE_SHUFFLES) == "true"
