import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clusterloom.functions import bits


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def binary(value):
    return F.lit(None).cast("binary") if value is None else F.lit(bytearray(value))


@pytest.mark.parametrize("value, expected", [(b"\xff\x01\x03", 11), (b"", 0), (None, None)])
def test_popc(spark, value, expected):
    assert one(spark, bits.popc(binary(value))) == expected


def test_pairs_of_bit_text(spark):
    df = spark.createDataFrame([("0101", "0011")], "x string, y string")
    a, b = bits.pack_bits("x"), bits.pack_bits("y")
    n = [F.length("x"), F.length("y")]
    row = df.select(
        bits.popc_and(a, b, *n), bits.popc_or(a, b, *n), bits.popc_xor(a, b, *n)
    ).first()
    assert tuple(row) == (1, 3, 2)


def test_pack_bits(spark):
    df = spark.createDataFrame([("",), ("1",), ("0101010111111111",), ("000000001",)], "x string")
    got = [bytes(r[0]) for r in df.select(bits.pack_bits("x")).collect()]
    assert got == [b"", b"\x80", b"\x55\xff", b"\x00\x80"]


@pytest.mark.parametrize("function", [bits.popc_and, bits.popc_or, bits.popc_xor])
def test_unequal_lengths_are_an_error(spark, function):
    with pytest.raises(Exception, match="same length"):
        one(spark, function(binary(b"\x01"), binary(b"\x01\x02")))
    with pytest.raises(Exception, match="same length"):
        one(spark, function(binary(b"\x10"), binary(b"\x10"), F.lit(4), F.lit(8)))
    assert one(spark, function(binary(None), binary(b"\x01"))) is None


@given(st.lists(st.tuples(st.binary(max_size=40), st.integers(0, 255)), min_size=1, max_size=20))
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_counts_against_python_integers(spark, pairs):
    rows = [(bytearray(a), bytearray((x ^ key) & 0xFF for x in a)) for a, key in pairs]
    df = spark.createDataFrame(rows, "a binary, b binary")
    bits.register_sql_functions(spark)
    got = df.select(
        bits.popc("a"), bits.popc_and(F.col("a"), F.col("b")),
        bits.popc_or(F.col("a"), F.col("b")), bits.popc_xor(F.col("a"), F.col("b")),
        F.expr("popc(a)"), F.expr("popc_and(a, b)"), F.expr("popc_or(a, b)"), F.expr("popc_xor(a, b)"),
    ).collect()
    for (a, b), row in zip(rows, got):
        x, y = int.from_bytes(a, "big"), int.from_bytes(b, "big")
        want = (x.bit_count(), (x & y).bit_count(), (x | y).bit_count(), (x ^ y).bit_count())
        assert tuple(row) == want + want


def test_sql_functions_reject_unequal_lengths(spark):
    bits.register_sql_functions(spark)
    with pytest.raises(Exception, match="same length"):
        spark.sql("SELECT popc_xor(X'01', X'0102')").collect()


def test_sign_words_and_binary(spark):
    values = [1.0 if i in (0, 33, 63) else -1.0 for i in range(64)]
    df = spark.createDataFrame([(values,)], "e array<double>")
    row = df.select(bits.sign_words("e", 64).alias("w")).select(
        "w", bits.words_to_binary("w", 2).alias("b")
    ).first()
    assert row["w"] == [1, 2**31 + 2]
    assert bytes(row["b"]) == bytes.fromhex("0000000180000002")
