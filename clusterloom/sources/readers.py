"""CSV, text and table readers with declared schemas (nothing is inferred)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Column names, types and order of the two traffic files.
TRAFFIC_METADATA_SCHEMA = """
    point_1_street string,
    duration_in_sec float,
    point_1_name int,
    point_1_city string,
    point_2_name int,
    point_2_lng float,
    point_2_street string,
    ndt_in_kmh float,
    point_2_postal_code int,
    point_2_country string,
    point_1_street_number string,
    organisation string,
    point_1_lat float,
    point_2_lat float,
    point_1_postal_code int,
    point_2_street_number string,
    point_2_city string,
    ext_id int,
    road_type string,
    point_1_lng float,
    report_id int,
    point_1_country string,
    distance_in_meters float,
    report_name string,
    rba_id int,
    _id int
"""
TRAFFIC_RAWDATA_SCHEMA = """
    status string,
    avg_measured_time float,
    avg_speed float,
    ext_id int,
    median_measured_time float,
    `timestamp` timestamp_ntz,
    vehicle_count float,
    _id int,
    report_id int
"""


def _read_csv(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    paths = path if isinstance(path, str) else list(path)
    return spark.read.schema(schema).options(header=True, mode="FAILFAST").csv(paths)


def read_traffic_metadata(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The road segments: one CSV file with a header."""
    return _read_csv(spark, path, TRAFFIC_METADATA_SCHEMA)


def read_traffic_rawdata(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The measurements: a CSV file, a folder, a glob or a list of them, as one table."""
    return _read_csv(spark, path, TRAFFIC_RAWDATA_SCHEMA)


def read_items(spark: SparkSession, table: str, columns: Sequence[str]) -> DataFrame:
    """The named columns of a catalog table or view, or of a parquet path."""
    source = spark.read.parquet(table) if "/" in table else spark.table(table)
    return source.select(*[F.col(c) for c in columns])


def read_audit_log(spark: SparkSession, path: str | Sequence[str], auid: int | None = None) -> DataFrame:
    """Raw audit lines (``value``), optionally only those of one login user id.

    Records without an ``auid`` belong to the session if another record of the
    same event does; they are found by the shared event stamp.
    """
    lines = spark.read.text(path if isinstance(path, str) else list(path))
    return lines if auid is None else session_lines(lines, auid)


def session_lines(lines: DataFrame, auid: int) -> DataFrame:
    """The lines of all events in which some record names this login user id."""
    stamp = F.regexp_extract("value", r" msg=(audit\([0-9.]+:[0-9]+\))", 1)
    # lines without a stamp belong to no event; left in, they would be one hot join key
    stamped = lines.withColumn("__stamp", stamp).filter(F.col("__stamp") != "")
    events = stamped.filter(F.col("value").rlike(rf" auid={auid}( |$)")).select("__stamp").distinct()
    return stamped.join(events, "__stamp", "left_semi").drop("__stamp")
