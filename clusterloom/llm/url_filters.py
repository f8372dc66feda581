"""Url filters by a sort-merge range join.

A host is turned round into a canonical key, ``www.example.com`` into
``com.example.www.``, so that a rule for a host and its subdomains is an interval
of keys. Intervals of two rules are nested or apart. Urls and rules are dealt out
by key ranges and sorted, and one sweep over each range keeps the active rules on
a stack; the rules of the deepest fitting path are looked up there.

A busy host is cut over several ranges, because ranges go by key and a hash of
the row. A rule is copied into each range that its interval touches, so only
rules for very wide domains are copied often, and never more than once a range.
No rule is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterloom.llm.common import ascii_lower, partitions, range_bounds, range_of

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LOWEST = -(1 << 63)


def url_host(url: Column) -> Column:
    """After the first ``://``, A-Z lower-cased; empty if there is none."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``; empty if there is no host part."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def host_key(host: Column) -> Column:
    """The labels from right to left, each ended by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


class _Stack:
    """Active rules, outermost first: key, host, and verdicts by path."""

    def __init__(self):
        self.levels: list[tuple[str, str, dict[str, str]]] = []

    def close(self, key: str) -> None:
        while self.levels and not key.startswith(self.levels[-1][0]):
            self.levels.pop()

    def open(self, key: str, host: str, path: str, verdict: str) -> None:
        self.close(key)
        if not self.levels or self.levels[-1][0] != key:
            self.levels.append((key, host, {}))
        self.levels[-1][2][path] = verdict

    def lookups(self) -> list[tuple[str, dict[str, str], list[int]]]:
        return [(host, by, sorted({len(p) for p in by}, reverse=True)) for _, host, by in self.levels]


def _best(path: str, lookups) -> tuple[str | None, str | None]:
    """The longest fitting rule; of two as long, the one of the longer host."""
    best, rule, verdict = (-1, -1), None, None
    for host, by, lengths in lookups:
        for n in lengths:
            if n <= len(path) and path[:n] in by:
                if (len(host) + n, len(host)) > best:
                    best, rule, verdict = (len(host) + n, len(host)), host + path[:n], by[path[:n]]
                break
    return rule, verdict


def _sweep(batches: Iterator[pa.RecordBatch], default: str, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    stack, last, lookups = _Stack(), None, []
    for batch in batches:
        columns = {n: batch.column(n) for n in batch.schema.names}
        keys, hosts, paths, verdicts = (
            columns[n].to_pylist() for n in ("key", "host", "path", "verdict")
        )
        is_rule = columns["is_rule"].to_pylist()
        found: list[tuple[str | None, str]] = []
        for key, host, path, verdict, opens in zip(keys, hosts, paths, verdicts, is_rule):
            if opens:
                stack.open(key, host, path, verdict)
                last = None
                continue
            if key != last:
                stack.close(key)
                last, lookups = key, stack.lookups()
            rule, own = _best(path, lookups)
            found.append((rule, default if own is None else own))
        urls = batch.filter(pa.array([not r for r in is_rule], pa.bool_()))
        yield pa.RecordBatch.from_arrays(
            [
                urls.column("id"), urls.column("host"), urls.column("path"),
                pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.string()),
            ],
            schema=pa.schema(
                [pa.field(n, urls.column("id").type if n == out[0] else pa.string()) for n in out]
            ),
        )


def url_filter(
    urls: DataFrame,
    rules: DataFrame | Sequence[tuple[str, str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """``(id, host, path, rule, verdict)``, one row for each row of ``urls``.

    ``rules`` are ``(host, path, verdict)``. A rule fits its host and all
    subdomains if the url's path starts with its path; the longest one (host and
    path together) decides, and ``rule`` is its host and path. Without one,
    ``rule`` is null and ``verdict`` is ``default``.

    A url that is null or has no ``://`` has an empty host and path, and only a
    rule for the empty host could fit it. Repeated urls and null ids are rows like
    any other. Of a rule given twice with different verdicts ``block`` holds;
    rules with a null are no rules. Empty tables give empty results, and without
    rules every verdict is the default.
    """
    spark = urls.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    rules = (
        rules.select(ascii_lower(F.col("host")).alias("host"), "path", "verdict")
        .dropna()
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("key", host_key(F.col("host")))
    )
    url = F.col(url_col)
    rows = urls.select(
        F.col(id_col).alias("id"),
        url_host(url).alias("host"),
        url_path(url).alias("path"),
        F.xxhash64(F.col(id_col), url).alias("salt"),
    ).withColumn("key", host_key(F.col("host")))

    n = partitions(urls)
    bounds = range_bounds(rows, ["key", "salt"], n)
    types = ["string", "bigint"]
    id_type = dict(rows.dtypes)["id"]

    def bucket(key: Column, salt: Column) -> Column:
        return range_of([key, salt], bounds, types)

    # every key under "com." lies below "com/", because "/" follows "."
    end = F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/"))
    low = F.lit(_LOWEST)
    spread = rules.select(
        F.explode(F.sequence(bucket(F.col("key"), low), bucket(end, low))).alias("bucket"),
        "key", F.lit(True).alias("is_rule"), F.lit(None).cast(id_type).alias("id"),
        "host", "path", "verdict", F.lit(_LOWEST).alias("salt"),
    )
    dealt = rows.select(
        bucket(F.col("key"), F.col("salt")).alias("bucket"),
        "key", F.lit(False).alias("is_rule"), "id",
        "host", "path", F.lit(None).cast("string").alias("verdict"), "salt",
    )
    ordered = (
        spread.unionByName(dealt)
        .repartitionById(n, "bucket")
        .sortWithinPartitions("key", F.desc("is_rule"), "salt")
        .select("key", "is_rule", "id", "host", "path", "verdict")
    )
    names = [id_col, "host", "path", "rule", "verdict"]
    schema = f"`{id_col}` {id_type}, host string, path string, rule string, verdict string"
    return ordered.mapInArrow(lambda batches: _sweep(batches, default, names), schema)
