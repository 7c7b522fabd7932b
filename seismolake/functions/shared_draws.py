"""Draws that Spark and other SQL engines compute alike: whole-number arithmetic modulo a prime below 2 ** 31, in 64-bit integers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2_147_483_647


def _round(h: Column) -> Column:
    return (h * (h + F.lit(48271)) + F.lit(12345)) % F.lit(PRIME)


def uniform(seed: int, *keys: Column | str) -> Column:
    """In (0, 1), from the seed and whole numbers that aren't negative: two squaring rounds after each key."""
    cast = [(F.col(k) if isinstance(k, str) else k).cast("long") for k in keys]
    start, mixed = F.lit(seed % PRIME).cast("long"), lambda h, k: _round(_round((h + k) % F.lit(PRIME)))
    # written out for few keys, which Spark compiles; each key more makes the expression four times as long
    h = reduce(mixed, cast, start) if len(cast) <= 2 else F.aggregate(F.array(*cast), start, mixed)
    return (h.cast("double") + F.lit(0.5)) / F.lit(float(PRIME))


def uniform_sql(seed: int, *keys: str) -> str:
    """The same for DuckDB."""
    once = lambda x: f"(({x}) * ({x}) + 48271 * ({x}) + 12345) % {PRIME}"
    cast = ", ".join(f"CAST({k} AS BIGINT)" for k in keys)
    return f"((list_reduce([CAST({seed % PRIME} AS BIGINT), {cast}], lambda h, k: {once(once(f'(h + k) % {PRIME}'))}) + 0.5) / CAST({PRIME} AS DOUBLE))"
