"""64-bit arithmetic modulo 2^64 in DuckDB's SQL: what Spark's xxhash64 and the SplitMix64 generator compute."""

from __future__ import annotations

from tidemark.plans.sqltext import with_steps

_WRAP = "18446744073709551616::UHUGEINT"
# Fixed values of XXH64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261


def mul(x: str, by: int) -> str:
    return f"(({x})::UHUGEINT * {by}::UHUGEINT % {_WRAP})"


def add(x: str, y: int) -> str:
    return f"((({x})::UHUGEINT + {y}::UHUGEINT) % {_WRAP})"


def xor(x: str, y: str) -> str:
    return f"xor(({x})::UBIGINT, ({y})::UBIGINT)"


def left(x: str, by: int) -> str:
    """Rotated to the left."""
    return f"((({x})::UHUGEINT * {1 << by}::UHUGEINT % {_WRAP}) + ({x})::UHUGEINT // {1 << (64 - by)}::UHUGEINT)"


def shifted(x: str, by: int) -> str:
    """x ^ (x >>> by)."""
    return xor(x, f"({x})::UHUGEINT // {1 << by}::UHUGEINT")


#: Spark's xxhash64 of a long has the seed 42.
XXHASH64_MOD_8 = with_steps(
    "SELECT DISTINCT k, k AS x FROM mutations WHERE k >= 0",
    ["k"],
    [mul("x", P2), left("x", 31), mul("x", P1), xor("x", str((42 + P5 + 8) % (1 << 64))), left("x", 27), add(mul("x", P1), P4), shifted("x", 33), mul("x", P2), shifted("x", 29), mul("x", P3), shifted("x", 32)],
    'k, (x::UHUGEINT % 8::UHUGEINT)::BIGINT AS "partition"',
)
SPLITMIX = with_steps(
    "SELECT lsn, lsn AS x FROM mutations",
    ["lsn"],
    [add("x", 0x9E3779B97F4A7C15), shifted("x", 30), mul("x", 0xBF58476D1CE4E5B9), shifted("x", 27), mul("x", 0x94D049BB133111EB), shifted("x", 31)],
    "lsn, (CASE WHEN x::UHUGEINT >= 9223372036854775808::UHUGEINT THEN x::HUGEINT - 18446744073709551616::HUGEINT ELSE x::HUGEINT END)::BIGINT AS drawn",
)
