"""Signed scans against plain ones, matrix blocks as a round trip, modes of open labels."""

import io
import random
import time
from collections import Counter
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from clusterloom.operators import matrix, scan
from clusterloom.plans import traffic


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    rng = random.Random(4)
    words = ["spark", "line", "Über", "a%b", "x_y", "naïve", "q"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(6)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "ab"), (303, "aaa once"), (304, "z\U0001F600zz")]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("kept", F.lit(1))
    path = str(tmp_path_factory.mktemp("signed"))
    scan.write_with_signatures(df, path, "id", "text", rows_per_group=10)
    return df, path


@pytest.mark.parametrize("pattern", ["%aaa%", "%park%l%", "a\\%b%", "%x\\_y", "%Über", "%na_ve%", "%", "q", "ab", "", "%\U0001F600zz", "%nothing like it%"])
def test_signed_scan_finds_what_the_plain_one_does(spark, texts, pattern):
    df, path = texts
    want = scan.text_like_range_scan(df, "id", "text", pattern)
    got = scan.signed_like_scan(spark, path, "text", pattern)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_signing_a_long_text_takes_one_pass(spark, tmp_path):
    rng = random.Random(5)
    long = "".join(rng.choices("abcdeé \n\U0001F600", k=300_000))
    df = spark.createDataFrame([(1, long + "qxz"), (2, "qx"), (3, "\nqx\n\U0001F600")], "id long, text string")
    began = time.monotonic()
    scan.write_with_signatures(df, str(tmp_path), "id", "text", rows_per_group=1)
    assert time.monotonic() - began < 40
    for pattern, want in (("%qxz%", [1]), ("qx%", [2]), ("%x\n\U0001F600", [3]), (f"%{long[-9:]}%", [1])):
        found = scan.signed_like_scan(spark, str(tmp_path), "text", pattern)
        assert [r["id"] for r in found.collect()] == want


def test_groups_without_the_characters_are_not_read(spark, texts):
    _, path = texts
    n = scan.groups_in_question(spark, path, "%").count()
    assert n > 20
    assert scan.groups_in_question(spark, path, "%aaa%").count() < n / 4
    assert scan.groups_in_question(spark, path, "%nothing like it%").count() == 0
    plan = io.StringIO()
    with redirect_stdout(plan):
        scan.signed_like_scan(spark, path, "text", "%aaa%").explain()
    assert "dynamicpruning" in plan.getvalue()


def test_required_threes():
    assert scan.required_threes("%aaa%") == ["aaa"]
    assert scan.required_threes("ab\\%cd_ef%ghij") == ["%cd", "ab%", "b%c", "ghi", "hij"]
    assert scan.required_threes("%ab%cd") == []


@pytest.mark.parametrize("height", [1, 7, 1000])
def test_blocks_come_apart_again(spark, height):
    rng = random.Random(height)
    rows = [(i * 3 % 101, rng.random(), float(i)) for i in range(101)]
    df = spark.createDataFrame(rows, "id long, `a.b` double, c double").repartition(4)
    blocks = matrix.matrix_blocks(df, "id", ["a.b", "c"], height)
    sizes = [len(r["matrix"]) for r in blocks.orderBy("block").collect()]
    assert sizes[:-1] == [height] * (len(sizes) - 1) and sum(sizes) == 101
    back = matrix.rows_of_blocks(blocks, "id", ["x", "c"]).orderBy("row").collect()
    assert [tuple(r) for r in back] == [(n, *row) for n, row in enumerate(sorted(rows), 1)]


def test_matrices_hold_no_nulls(spark):
    for rows in ([(1, None)], [(None, 1.0)]):
        with pytest.raises(Exception, match="cannot hold nulls"):
            matrix.matrix_blocks(spark.createDataFrame(rows, "id long, x double"), "id", ["x"]).collect()
    assert matrix.matrix_blocks(spark.createDataFrame([], "id long, x double"), "id", ["x"]).collect() == []


def test_mode_of_open_labels(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, "hot", "hot", "hot", "cold"]), rng.choice([None, *"abcdefgh"])) for _ in range(500)]
    rows += [("none", None), ("tie", "z"), ("tie", "y")]
    got = {r["key"]: (r["label"], r["c"]) for r in traffic.dominant_label(
        spark.createDataFrame(rows, "key string, label string"), "key", "label").collect()}
    want = {}
    for key in {k for k, _ in rows} - {"none"}:
        counts = Counter(l for k, l in rows if k == key and l is not None)
        want[key] = min(counts.items(), key=lambda x: (-x[1], x[0]))
    assert got == want
