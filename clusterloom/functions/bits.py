"""Population counts of bit strings, and similarity of bit fingerprints.

A bit string is a binary column; where its length is no multiple of eight, the
exact number of bits comes as a second column.  A fingerprint is an array of
words, each read as 32 bits, whatever its sign.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD_MASK = 0xFFFFFFFF
LENGTH_ERROR = "bit strings must have the same length"
# Bytes per chunk of the SQL functions: fits a positive bigint.
CHUNK = 7


def pack_bits(text: Column | str) -> Column:
    """``'0101'`` as binary, first bit highest, zero-filled to whole bytes."""
    column = F.col(text) if isinstance(text, str) else text
    n_bytes = F.ceil(F.length(column) / 8).cast("int")
    padded = F.rpad(column, n_bytes * 8, F.lit("0"))
    hex_bytes = F.transform(
        F.sequence(F.lit(0), n_bytes - 1),
        lambda i: F.lpad(F.conv(F.substring(padded, i * 8 + 1, F.lit(8)), 2, 16), 2, "0"),
    )
    return F.when(F.length(column) == 0, F.lit(b"")).otherwise(F.unhex(F.array_join(hex_bytes, "")))


def popc(bits: Column | str) -> Column:
    """Number of set bits; null in, null out."""
    return F.bitmap_count(bits).cast("int")


def _bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of binary values without nulls, laid end to end."""
    wide = strings.cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    values = np.frombuffer(data or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    return ends - ends[0], values


def _counter(combine: np.ufunc):
    """Arrow function that counts the bits of two combined bit strings.

    Binary has no integer view in SQL; through hexadecimal text the count takes
    five times as long as whole batches of bytes do here.
    """

    @F.arrow_udf(T.IntegerType())
    def count(a: pa.Array, b: pa.Array) -> pa.Array:
        both = pc.and_(a.is_valid(), b.is_valid())
        ends, left = _bytes(a.filter(both))
        other_ends, right = _bytes(b.filter(both))
        if not np.array_equal(ends, other_ends):
            raise ValueError(LENGTH_ERROR)
        running = np.r_[0, np.cumsum(np.bitwise_count(combine(left, right)), dtype=np.int64)]
        counts = np.zeros(len(a), dtype=np.int32)
        present = both.to_numpy(zero_copy_only=False)
        counts[present] = running[ends[1:]] - running[ends[:-1]]
        return pa.array(counts, mask=~present)

    return count


_count_and = _counter(np.bitwise_and)
_count_or = _counter(np.bitwise_or)
_count_xor = _counter(np.bitwise_xor)


def _same_bits(a_bits: Column | None, b_bits: Column | None, count: Column) -> Column:
    if a_bits is None or b_bits is None:
        return count
    return F.when(a_bits != b_bits, F.raise_error(F.lit(LENGTH_ERROR))).otherwise(count)


def popc_and(
    a: Column, b: Column, a_bits: Column | None = None, b_bits: Column | None = None
) -> Column:
    """Bits set in both; an error when the lengths differ."""
    return _same_bits(a_bits, b_bits, _count_and(a, b))


def popc_or(
    a: Column, b: Column, a_bits: Column | None = None, b_bits: Column | None = None
) -> Column:
    """Bits set in either; an error when the lengths differ."""
    return _same_bits(a_bits, b_bits, _count_or(a, b))


def popc_xor(
    a: Column, b: Column, a_bits: Column | None = None, b_bits: Column | None = None
) -> Column:
    """Hamming distance; an error when the lengths differ."""
    return _same_bits(a_bits, b_bits, _count_xor(a, b))


def word_count(a: Column, b: Column, operator: str, n_words: int) -> Column:
    """Bits set in two word arrays combined by ``bitwiseAND``, ``bitwiseOR`` or ``bitwiseXOR``.

    For fingerprints that are kept as words: generated code, no Python.
    """
    total = None
    for i in range(n_words):
        word = getattr(a[i].cast("bigint"), operator)(b[i].cast("bigint"))
        count = F.bit_count(word.bitwiseAND(F.lit(WORD_MASK)))
        total = count if total is None else total + count
    return total


def register_sql_functions(spark: SparkSession) -> None:
    """``popc``, ``popc_and``, ``popc_or`` and ``popc_xor`` for SQL users.

    The bodies are SQL expressions, so Catalyst optimises through them.
    """
    shared = f"""
        coalesce(aggregate(
            transform(
                filter(sequence(0, cast(ceil(octet_length(a) / {CHUNK}) AS INT)),
                       i -> i * {CHUNK} < octet_length(a)),
                i -> bit_count(
                    cast(conv(hex(substring(a, i * {CHUNK} + 1, {CHUNK})), 16, 10) AS BIGINT)
                    & cast(conv(hex(substring(b, i * {CHUNK} + 1, {CHUNK})), 16, 10) AS BIGINT))),
            0, (total, n) -> total + n), 0)"""
    bodies = {
        "popc_and": shared,
        "popc_or": f"bitmap_count(a) + bitmap_count(b) - {shared}",
        "popc_xor": f"bitmap_count(a) + bitmap_count(b) - 2 * {shared}",
    }
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION popc(a BINARY) RETURNS INT "
        "RETURN cast(bitmap_count(a) AS INT)"
    )
    for name, body in bodies.items():
        spark.sql(f"""
            CREATE OR REPLACE TEMPORARY FUNCTION {name}(a BINARY, b BINARY) RETURNS INT RETURN
            CASE WHEN octet_length(a) != octet_length(b)
                 THEN raise_error('{LENGTH_ERROR}')
                 WHEN a IS NOT NULL AND b IS NOT NULL THEN cast({body} AS INT) END""")


def sign_words(vector: str, size: int) -> Column:
    """Fingerprint of a numeric array: bit i is ``vector[i] > 0``, low bit first."""
    words = []
    for start in range(0, size, 32):
        bits = " + ".join(
            f"shiftleft(cast({vector}[{i}] > 0 AS BIGINT), {i - start})"
            for i in range(start, min(start + 32, size))
        )
        words.append(f"({bits})")
    return F.expr(f"array({', '.join(words)})")


def words_to_binary(words: Column | str, n_words: int) -> Column:
    """A fingerprint as a bit string of ``32 * n_words`` bits, words in order."""
    column = F.col(words) if isinstance(words, str) else words
    parts = [
        F.lpad(F.hex(column[i].cast("bigint").bitwiseAND(F.lit(WORD_MASK))), 8, "0")
        for i in range(n_words)
    ]
    return F.unhex(F.concat(*parts))


def tanimoto_sql(words: str, query: Sequence[int]) -> str:
    """SQL of the Tanimoto similarity between an array column and a fixed fingerprint."""
    shared = " + ".join(
        f"bit_count(cast({words}[{i}] AS BIGINT) & {q & WORD_MASK}L)" for i, q in enumerate(query)
    )
    joined = " + ".join(
        f"bit_count((cast({words}[{i}] AS BIGINT) & {WORD_MASK}L) | {q & WORD_MASK}L)"
        for i, q in enumerate(query)
    )
    return f"coalesce(try_divide({shared}, {joined}), 0.0D)"


def tanimoto(a: str, b: str) -> Column:
    """Tanimoto similarity of two fingerprint columns; 0 where no bit is set at all."""
    def total(operator: str) -> str:
        return (
            f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count("
            f"(cast(x AS BIGINT) {operator} cast(y AS BIGINT)) & {WORD_MASK}L)), "
            "0, (total, n) -> total + n)"
        )

    return F.expr(f"coalesce(try_divide({total('&')}, {total('|')}), 0.0D)")
