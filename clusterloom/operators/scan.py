"""Text scans: by key range, and with signatures that tell which files need not be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterloom.operators.ordered import quoted

# Fixed value: the pattern of the scan by default.
PATTERN = "%aaa%"


def text_like_range_scan(
    df: DataFrame,
    pk: str,
    text: str,
    pattern: str = PATTERN,
    lowest: object | None = None,
    highest: object | None = None,
) -> DataFrame:
    """Rows whose text matches ``pattern`` and whose key lies in the range, ends included.

    An end that is not given is open. The range is pushed to the source, so row
    groups outside it are skipped.
    """
    if lowest is not None:
        df = df.filter(F.col(pk) >= F.lit(lowest))
    if highest is not None:
        df = df.filter(F.col(pk) <= F.lit(highest))
    return df.filter(F.col(text).like(pattern))


# Bits of a signature: what one bitmap aggregate holds.
SIGNATURE_BITS = 32768
ROWS_PER_GROUP = 4096
GROUP = "scan_group"
# At each character, itself and the two behind it.
THREE = "(?s)(?=(...))."


def _bit(three: Column) -> Column:
    return F.pmod(F.xxhash64(three), F.lit(SIGNATURE_BITS))


def write_with_signatures(df: DataFrame, path: str, pk: str, text: str, rows_per_group: int = ROWS_PER_GROUP) -> None:
    """Writes ``df`` in groups of about ``rows_per_group`` rows, each with a signature.

    A signature has a bit for each three characters that follow each other in a text of
    the group. Rows are dealt to groups by a hash of the whole row, so a key that many
    rows share is no large group.
    """
    n_groups = max(1, -(-df.count() // rows_per_group))
    group = F.pmod(F.xxhash64(*map(quoted, df.columns)), F.lit(n_groups)).alias(GROUP)
    grouped = df.select("*", group).repartition(GROUP)
    grouped.write.partitionBy(GROUP).parquet(f"{path}/rows")
    written = df.sparkSession.read.parquet(f"{path}/rows").select(GROUP, quoted(text).alias("text"))
    # one pass over a text, whatever its length: substring() would count from its start for each place
    threes = F.array_distinct(F.regexp_extract_all("text", F.lit(THREE), F.lit(1)))
    # a group whose texts are all shorter has a signature too
    bits = written.select(GROUP, F.explode_outer(threes).alias("three")).select(GROUP, _bit(F.col("three")).alias("bit"))
    # each bit once, by hashes: the bitmap is an aggregate that sorts its rows
    signatures = bits.distinct().groupBy(GROUP).agg(F.bitmap_construct_agg("bit").alias("signature"))
    signatures.write.parquet(f"{path}/signatures")


def required_threes(pattern: str, escape: str = "\\") -> list[str]:
    """All runs of three characters that a text must have to be like ``pattern``."""
    literals, literal, at = [], "", 0
    while at < len(pattern):
        if pattern[at] == escape and at + 1 < len(pattern):
            literal += pattern[at + 1]
            at += 2
        elif pattern[at] in "%_":
            literals.append(literal)
            literal, at = "", at + 1
        else:
            literal, at = literal + pattern[at], at + 1
    literals.append(literal)
    return sorted({run[i:i + 3] for run in literals for i in range(len(run) - 2)})


def groups_in_question(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """The groups whose signatures have all bits of the pattern."""
    signatures = spark.read.parquet(f"{path}/signatures")
    for three in required_threes(pattern):
        # bits are counted from the lowest of the first byte
        byte = F.conv(F.hex(F.substring("signature", F.floor(_bit(F.lit(three)) / 8).cast("int") + 1, F.lit(1))), 16, 10)
        mask = F.call_function("shiftleft", F.lit(1), (_bit(F.lit(three)) % 8).cast("int"))
        signatures = signatures.filter(byte.cast("int").bitwiseAND(mask) != 0)
    return signatures.select(GROUP)


def signed_like_scan(spark: SparkSession, path: str, text: str, pattern: str) -> DataFrame:
    """The rows whose text matches ``pattern``, from a table with signatures.

    Groups that lack three characters of the pattern are left out by partition; a pattern
    without three characters in a row reads all of them. The result is the plain scan's.
    """
    rows = spark.read.parquet(f"{path}/rows")
    if required_threes(pattern):
        rows = rows.join(groups_in_question(spark, path, pattern), GROUP, "left_semi")
    return rows.filter(quoted(text).like(pattern)).drop(GROUP)
