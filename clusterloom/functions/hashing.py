"""Seeded pseudo-randomness as plain Catalyst arithmetic.

``rand()`` depends on partitioning and changes when a lost task is recomputed.
Here every draw is a hash of (row key, salt), so a rerun, a retry or another
partition count gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

MASK = 0xFFFFFFFF

# Fixed values of Bob Jenkins' final mix (public domain, lookup3): the start
# constant for a 4-byte key, and (target, source, rotation) of its seven steps.
START = (0x9E3779B9 + 4 + 3923095) & MASK
STEPS = (
    ("c", "b", 14),
    ("a", "c", 11),
    ("b", "a", 25),
    ("c", "b", 16),
    ("a", "c", 4),
    ("b", "a", 14),
    ("c", "b", 24),
)


def mix32(x: int) -> int:
    """The hash of one number, for salts computed on the driver."""
    state = {"a": (START + x) & MASK, "b": START, "c": START}
    for target, source, bits in STEPS:
        s = state[source]
        rotated = ((s << bits) | (s >> (32 - bits))) & MASK
        state[target] = ((state[target] ^ s) - rotated) & MASK
    return state["c"]


def _mix_columns(prefix: str, x: str) -> tuple[list[str], str]:
    """Aliased SQL expressions, each reading earlier ones, and the result's name."""
    names = {"a": f"{prefix}_a", "b": str(START), "c": str(START)}
    columns = [f"({START} + ({x})) & {MASK} AS {names['a']}"]
    for i, (target, source, bits) in enumerate(STEPS):
        t, s = names[target], names[source]
        rotated = f"((shiftleft({s}, {bits}) & {MASK}) | shiftright({s}, {32 - bits}))"
        names[target] = f"{prefix}_{target}{i}"
        columns.append(f"(({t} ^ {s}) - {rotated}) & {MASK} AS {names[target]}")
    return columns, names["c"]


def _with_derived(df: DataFrame, columns: list[str], out: dict[str, str]) -> DataFrame:
    """Add ``out`` (name -> SQL), computed from the aliased ``columns``.

    The aliases are lateral: Spark stacks projections, so each step is evaluated
    once instead of being inlined twice per use.
    """
    results = [f"{sql} AS {name}" for name, sql in out.items()]
    steps = [c.rsplit(" AS ", 1)[1] for c in columns]
    return df.selectExpr("*", *columns, *results).drop(*steps)


def _key64(df: DataFrame, pk: str) -> str:
    """SQL for a 64-bit key: integral keys as they are, others hashed."""
    if isinstance(df.schema[pk].dataType, T.IntegralType):
        return f"CAST(`{pk}` AS BIGINT)"
    return f"xxhash64(`{pk}`)"


def with_mix32(df: DataFrame, pk: str, out: str, offset: int = 0) -> DataFrame:
    """Add ``out`` = 32-bit hash of ``pk + offset`` (bigint, 0 .. 2**32-1)."""
    columns, result = _mix_columns("__mix", f"({_key64(df, pk)} + {offset}) & {MASK}")
    return _with_derived(df, columns, {out: result})


def with_uniform(df: DataFrame, pk: str, out: str, seed: int, draw: int = 0) -> DataFrame:
    """Add ``out``, uniform in (0, 1], independent for every (seed, draw).

    Two chained hashes give 53 bits that depend on the whole 64-bit key, so the
    draws stay distinct on tables with far more than 2**32 rows.
    """
    salt = mix32((seed + mix32(draw)) & MASK)
    key = _key64(df, pk)
    low, h1 = _mix_columns("__lo", f"(({key} & {MASK}) + {salt}) & {MASK}")
    high, h2 = _mix_columns("__hi", f"({h1} + (shiftright({key}, 32) & {MASK})) & {MASK}")
    uniform = f"(CAST({h2} * 2097152 + shiftright({h1}, 11) AS DOUBLE) + 0.5D) / 9007199254740992D"
    return _with_derived(df, low + high, {out: uniform})
