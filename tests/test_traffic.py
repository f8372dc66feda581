import datetime

import pytest
from pyspark.sql import functions as F

from clusterloom.operators.scan import text_like_range_scan
from clusterloom.plans import traffic
from clusterloom.sources import read_items, read_traffic_metadata, read_traffic_rawdata

META = (
    "POINT_1_STREET,DURATION_IN_SEC,POINT_1_NAME,POINT_1_CITY,POINT_2_NAME,POINT_2_LNG,POINT_2_STREET,"
    "NDT_IN_KMH,POINT_2_POSTAL_CODE,POINT_2_COUNTRY,POINT_1_STREET_NUMBER,ORGANISATION,POINT_1_LAT,"
    "POINT_2_LAT,POINT_1_POSTAL_CODE,POINT_2_STREET_NUMBER,POINT_2_CITY,EXT_ID,ROAD_TYPE,POINT_1_LNG,"
    "REPORT_ID,POINT_1_COUNTRY,DISTANCE_IN_METERS,REPORT_NAME,RBA_ID,_id"
)
RAW = "status,avgMeasuredTime,avgSpeed,extID,medianMeasuredTime,TIMESTAMP,vehicleCount,_id,REPORT_ID"


def test_dominant_cluster_ties_go_low(spark):
    df = spark.createDataFrame([(7, c) for c in (1, 0, 1, 0)] + [(8, 2), (8, None), (9, None)], "key int, cid int")
    plan = traffic.dominant_cluster(df, "key", 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortAggregate" not in plan
    got = {tuple(r) for r in traffic.dominant_cluster(df, "key", 3).collect()}
    assert got == {(7, 0, 2), (8, 2, 1)}


def test_csv_to_report(spark, tmp_path):
    (tmp_path / "meta.csv").write_text("\n".join([
        META,
        *[f"street,10,1,Aarhus,2,10.25,street2,50,8000,DK,1,org,56.5,56.75,8000,2,Aarhus,9,road,10.5,{r},DK,100,name,1,{r}"
          for r in (100, 200)],
    ]))
    (tmp_path / "raw").mkdir()
    for r, speed in ((100, 30), (200, 90), (300, 60)):
        (tmp_path / "raw" / f"{r}.csv").write_text("\n".join([
            RAW, *[f"OK,{60 + i},{speed + i},9,60,2014-02-13T1{i}:30:00,{i},{r + i},{r}" for i in range(5)]
        ]))
    raw = read_traffic_rawdata(spark, str(tmp_path / "raw" / "*.csv"))
    meta = read_traffic_metadata(spark, str(tmp_path / "meta.csv"))
    assert raw.count() == 15
    assert raw.schema["timestamp"].dataType.simpleString() == "timestamp_ntz"
    summary = traffic.cluster_reports(
        raw, "_id", "report_id", ["avg_measured_time", "avg_speed", "vehicle_count"], k=2
    )
    assert {r["report_id"] for r in summary.collect()} == {100, 200, 300}
    points = ["point_1_lat", "point_1_lng", "point_2_lat", "point_2_lng"]
    pages = traffic.map_report(summary, meta, "report_id", points).orderBy("page").collect()
    assert [r["url"].count("path=color:") for r in pages] == [1, 1]  # 300 has no road
    url = pages[0]["url"]
    assert "|weight:3|56.5,10.5|56.75,10.25" in url
    assert url.startswith(traffic.MAP_PREFIX) and url.endswith(traffic.MAP_SUFFIX)


def test_bad_csv_is_an_error(spark, tmp_path):
    (tmp_path / "raw.csv").write_text(RAW + "\nOK,notanumber,1,1,1,2014-02-13T11:30:00,1,1,1\n")
    with pytest.raises(Exception):
        read_traffic_rawdata(spark, str(tmp_path / "raw.csv")).collect()


def test_colours_and_every_road_on_some_page(spark):
    summary = spark.createDataFrame([(i, i % 6, 1) for i in range(200)], "k int, cid int, c bigint")
    roads = summary.select("k", *[F.lit(n).alias(f"p{n}") for n in range(4)])
    points = ["p0", "p1", "p2", "p3"]
    pages = traffic.map_report(summary, roads, "k", points).orderBy("page").collect()
    assert [(r["page"], r["url"].count("path=")) for r in pages] == [(0, 125), (1, 75)]
    url = pages[0]["url"]
    colours = [p.split("|")[0] for p in url.removeprefix(traffic.MAP_PREFIX).split("&") if "path" in p]
    with pytest.raises(Exception, match="more than one row"):
        traffic.map_report(summary, roads.unionByName(roads.limit(1)), "k", points).collect()
    assert colours[:6] == [f"path=color:{c}" for c in ("orange", "red", "blue", "green", "purple", "orange")]


@pytest.mark.parametrize("name, keep", [
    ("daytime", lambda t: 7 <= t.hour <= 17),
    ("night", lambda t: t.hour >= 18 or t.hour <= 7),
    ("weekend", lambda t: t.isoweekday() in (6, 7)),
    ("weekday", lambda t: t.isoweekday() <= 5),
])
def test_time_slices(spark, name, keep):
    times = [datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=5 * i) for i in range(60)]
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")
    got = {r["ts"] for r in traffic.time_slice(df, "ts", name).collect()}
    assert got == {t for t in times if keep(t)}


def test_text_scan(spark):
    df = spark.createDataFrame(
        [(99, "xaaax"), (100, "aaa"), (500, "aa"), (99900, "baaa"), (99901, "aaa")], "id bigint, t string"
    )
    assert [r["id"] for r in text_like_range_scan(df, "id", "t").orderBy("id").collect()] == [99, 100, 99900, 99901]
    found = text_like_range_scan(df, "id", "t", lowest=100, highest=99900)
    assert [r["id"] for r in found.orderBy("id").collect()] == [100, 99900]


def test_scan_range_reaches_the_source(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = text_like_range_scan(documents, "doc_id", "text", lowest=1)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,1" in plan  # the printed list is cut after 100 characters


def test_items_by_table_name_or_path(spark):
    path = "/root/testdata/sf0.001/nation.parquet"
    spark.read.parquet(path).createOrReplaceTempView("nation_items")
    by_name = read_items(spark, "nation_items", ["n_name"])
    assert by_name.columns == ["n_name"]
    assert by_name.exceptAll(read_items(spark, path, ["n_name"])).count() == 0
