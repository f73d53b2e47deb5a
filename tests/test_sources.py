from roadpulse.operators import report
from roadpulse.sources import history, incidents as src
from roadpulse.streaming import sinks

GOOD = "a1,51.5,-1.25,90,Ford,M1,M1 J3,2019-01-02,10:11:12,Wed"
LINES = [
    GOOD,
    "a2,51.5,-1.25,90,Ford,M1",  # short, but all that is used is there
    "a3,51.5,-1.25,ninety,Ford,M1,x,y,z,w",
    "a4,51.5,-1.25,90,Ford",
    "a5,north,-1.25,90,Ford,M1,x,y,z,w",
    "a6,51.5,NaN,90,Ford,M1,x,y,z,w",
    "a7,51.5,-1.25,9.5,Ford,M1,x,y,z,w",
    'a8,51.5,-1.25,90,"Ford,M1,x,y,z,w',
    "a9,51.5,-1.25,90,Ford,M1,x,y,z,w,more,fields",
    "",
]


def test_lines(spark):
    df = spark.createDataFrame([(x,) for x in LINES], "value string")
    got = {r["value"].split(",")[0]: r for r in src.parse_incident_lines(df).collect()}
    reasons = {k: r["bad_reason"] for k, r in got.items()}
    assert reasons == {
        "a1": None, "a2": None, "a3": "bearing", "a4": "road", "a5": "latitude",
        "a6": "longitude", "a7": "bearing", "a8": None, "a9": None, "": "latitude",
    }
    r = got["a1"]
    assert (r["lat"], r["lon"], r["bearing"], r["road"], r["weekday"]) == (51.5, -1.25, 90, "M1", "Wed")
    assert got["a8"]["vehicle_make"] == '"Ford'


def test_files_and_quarantine(spark, tmp_path):
    (tmp_path / "inc_1.csv").write_text(GOOD + "\n" + LINES[2] + "\n")
    folder = tmp_path / "inc_12.csv"
    folder.mkdir()
    (folder / "part-0").write_text(GOOD + "\n")
    parsed = src.read_incident_csv(spark, str(tmp_path))
    assert sorted(r[0] for r in src.good_rows(parsed).select("interval_id").collect()) == [1, 12]
    bad = src.quarantine_rows(parsed).collect()
    assert [(r["interval_id"], r["value"], r["bad_reason"]) for r in bad] == [(1, LINES[2], "bearing")]


def test_intervals_and_event_time(spark):
    df = spark.sql("select * from values (timestamp_ntz'2024-01-01 00:00:00'), (timestamp_ntz'2024-01-01 03:59:59'), (timestamp_ntz'2024-01-01 04:00:00'), (timestamp_ntz'2024-01-02 00:00:00') t(ts)")
    got = src.assign_interval(df, 4, "2024-01-01 00:00:00")
    assert [r["interval_id"] for r in got.orderBy("ts").collect()] == [1, 1, 2, 7]
    t = spark.sql("select '2019-01-02' as date, '10:11:12' as time union all select 'x', 'y'")
    assert sorted(str(r["ts"]) for r in src.add_event_time(t).collect()) == ["2019-01-02 10:11:12", "None"]


def test_history_round_trip(spark, tmp_path):
    rows = spark.sql("select 1 as interval_id, 'M1' as road, 90 as bearing, 0.1D + 0.2D as lat, -1e-7D as lon, 5.0D as fitness, 3 as age")
    sinks.write_history(report.hotspot_history(rows), str(tmp_path / "h"))
    got = history.read_hotspot_history(spark, str(tmp_path / "h")).collect()
    assert [tuple(r) for r in got] == [(1, "M1", 90, 0.1 + 0.2, -1e-7, 5.0, 3)]


def test_text_sinks(spark, tmp_path):
    rows = spark.sql("select 7 as interval_id, 52.5D as lat, -1.0D as lon, 5.0D as fitness, 3 as age, 0.15D as sd, 'DENSE' as density_label, 0L as n_added")
    sinks.write_hotspots(rows, str(tmp_path / "out"), "tsv", fuzzy=True)
    sinks.write_hotspots(rows.selectExpr("8 as interval_id", "* except (interval_id)"), str(tmp_path / "out"), "tsv")
    got = {r["interval_id"]: r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()}
    assert got == {7: "52.5\t-1.0\t5.0\t3\t0.15\tDENSE\t0", 8: "52.5\t-1.0\t5.0\t3"}
    for _ in range(2):
        sinks.write_latest(rows, str(tmp_path / "latest"))
    assert spark.read.text(str(tmp_path / "latest")).count() == 1


def test_heatmap_frames(spark):
    rows = spark.sql("select cast(id % 3 as int) as DayID, 'M1' as Road, 0 as Bearing, 50D + id as Latitude, 1D as Longitude, 5D as Fitness, 1 as Age from range(100) where id % 3 <> 2 or id < 20")
    got = report.heatmap_frames(rows, 0, 2, 30)
    assert {r["DayID"] for r in got.collect()} == {0, 1}
    assert report.heatmap_frames(rows, 1, 2, 30).count() == 33


def test_metric_lines(spark):
    got = report.format_metrics(spark.sql("select 3L as n_state, 2.005D as fv_max, 'x' as note"))
    assert {r["metric"]: r["text"] for r in got.collect()} == {"n_state": "3", "fv_max": "2.01"}


def test_history_by_column_name(spark, tmp_path):
    (tmp_path / "h.tsv").write_text("extra\tLONGITUDE\tlatitude\tDayID\nx\t-1.1\t52.30000000000001\t7\ny\t\tbad\t8\n")
    got = history.read_hotspot_history(spark, str(tmp_path)).collect()
    assert [(r["DayID"], r["Latitude"], r["Longitude"], r["Road"]) for r in got] == [
        (7, 52.30000000000001, -1.1, None), (8, None, None, None)
    ]
