"""The traffic report: cluster measurements, colour each road by its usual cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterloom.operators.kmeans import kmeans, kmeans_sliced

# The colour of each cluster, the map request and the paths on one map.
CLUSTER_COLOURS = {1: "red", 2: "blue", 3: "green", 4: "purple"}
OTHER_COLOUR = "orange"
MAP_PREFIX = "http://maps.google.com/maps/api/staticmap?zoom=11&size=640x480&scale=2&"
MAP_SUFFIX = "&sensor=false"
PATHS_PER_MAP = 125


def _hour(ts: Column) -> Column:
    return F.hour(ts)


def _day(ts: Column) -> Column:
    """Day of week, Sunday = 0."""
    return F.dayofweek(ts) - 1


# Hours and days of the time slices.
TIME_SLICES = {
    "daytime": lambda ts: _hour(ts).between(7, 17),
    "night": lambda ts: _hour(ts).between(18, 23) | _hour(ts).between(0, 7),
    "weekend": lambda ts: _day(ts).isin(0, 6),
    "weekday": lambda ts: _day(ts).isin(1, 2, 3, 4, 5),
}


def time_slice(df: DataFrame, ts: str, name: str) -> DataFrame:
    """The rows of one of :data:`TIME_SLICES`."""
    return df.filter(TIME_SLICES[name](F.col(ts)))


def dominant_cluster(
    clusters: DataFrame, key: str | Sequence[str], k: int, cid: str = "cid"
) -> DataFrame:
    """``(*key, cid, c)``: the most frequent of clusters 0 to k - 1 per key, the lowest on ties.

    One aggregate counts all clusters side by side, with map-side partial counts,
    so a key that holds much of the table is a handful of rows in the shuffle.
    Rows without a cluster do not count; a key with no others is left out.
    """
    keys = [key] if isinstance(key, str) else list(key)
    counted = clusters.groupBy(*keys).agg(*[F.count_if(F.col(cid) == i).alias(f"__n{i}") for i in range(k)])
    counts = F.array(*[f"__n{i}" for i in range(k)])
    best = counted.select(*keys, counts.alias("__counts")).withColumn("c", F.array_max("__counts"))
    place = (F.array_position("__counts", F.col("c")) - 1).cast("int")
    return best.filter("c > 0").select(*keys, place.alias(cid), "c")


def dominant_label(df: DataFrame, key: str | Sequence[str], label: str) -> DataFrame:
    """``(*key, label, c)``: the most frequent label per key, the smallest on ties.

    For labels that are not known beforehand. Rows are counted for each key and label,
    with partial counts before the shuffle, and spread by both: a key that holds much of
    the table is spread over as many tasks as it has labels. The best of these counts is a
    second aggregate, of which each task sends one row for a key. Rows without a label do
    not count; a key with no others is left out. Null keys are a key.
    """
    keys = [key] if isinstance(key, str) else list(key)
    named = df.filter(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("__n"))
    best = named.groupBy(*keys).agg(F.min(F.struct((-F.col("__n")).alias("n"), F.col(label).alias("label"))).alias("__best"))
    return best.select(*keys, F.col("__best.label").alias(label), (-F.col("__best.n")).alias("c"))


def cluster_reports(
    measurements: DataFrame,
    pk: str,
    key: str,
    features: Sequence[str],
    k: int = 5,
    n_rounds: int = 10,
    seed: int = 1,
) -> DataFrame:
    """Cluster the measurements and take each key's dominant cluster."""
    clusters = kmeans(
        measurements, pk, features, k, init="hash", max_iter=n_rounds, empty="zero", seed=seed
    )
    return dominant_cluster(clusters, key, k)


def cluster_reports_by_slice(
    measurements: DataFrame,
    pk: str,
    key: str,
    ts: str,
    features: Sequence[str],
    k: int = 5,
    n_rounds: int = 10,
    seed: int = 1,
) -> DataFrame:
    """``(slice, key, cid, c)``: the same within each of :data:`TIME_SLICES`."""
    slices = {name: rule(F.col(ts)) for name, rule in TIME_SLICES.items()}
    clusters = kmeans_sliced(measurements, pk, features, k, slices, n_rounds, seed, keep=[key])
    return dominant_cluster(clusters, ["slice", key], k)


def map_paths(summary: DataFrame, roads: DataFrame, key: str, points: Sequence[str]) -> DataFrame:
    """``(key, path_entry)`` for every road with a dominant cluster.

    ``points`` names latitude and longitude of both ends, in that order.
    """
    colour = F.lit(OTHER_COLOUR)
    for cid, name in reversed(CLUSTER_COLOURS.items()):
        colour = F.when(F.col("cid") == cid, name).otherwise(colour)
    lat1, lng1, lat2, lng2 = [F.col(p).cast("string") for p in points]
    entry = F.concat(
        F.lit("path=color:"), colour, F.lit("|weight:3|"),
        lat1, F.lit(","), lng1, F.lit("|"), lat2, F.lit(","), lng2,
    )
    return summary.join(roads.select(key, *points), key).select(key, entry.alias("path_entry"))


def map_report(
    summary: DataFrame,
    roads: DataFrame,
    key: str,
    points: Sequence[str],
    paths_per_map: int = PATHS_PER_MAP,
) -> DataFrame:
    """``(page, url)``: maps that together draw every road.

    A page holds the roads with the same ``key div paths_per_map``, in key order,
    so no sort over all roads is needed. The key is integral and names one road;
    repeated roads, which could overfill a page, are an error.
    """
    page = F.floor(F.col(key) / paths_per_map).cast("long").alias("page")
    paths = map_paths(summary, roads, key, points).groupBy(page)
    joined = F.expr(f"listagg(path_entry, '&') WITHIN GROUP (ORDER BY `{key}`)")
    pages = paths.agg(joined.alias("joined"), F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("roads"))
    repeated = F.raise_error(F.lit(f"a road has more than one row of the same {key}"))
    url = F.concat(F.lit(MAP_PREFIX), F.col("joined"), F.lit(MAP_SUFFIX))
    return pages.select("page", F.when(F.col("n") != F.col("roads"), repeated).otherwise(url).alias("url"))
