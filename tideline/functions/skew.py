"""Joins of many rows to one row per group where a group may hold a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def join_stats(
    rows: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "inner", salt: Sequence[str] = ("ts",)
) -> DataFrame:
    """Join a table with at most one row per key to the rows of that key.

    Spark broadcasts ``stats`` where its measured size allows. Beyond that the join shuffles
    on (keys, salt), so a hot key is spread over 16 tasks and the small side copied 16 times.
    """
    keys = list(keys)
    by = [c for c in salt if c in rows.columns and c not in keys] or [c for c in rows.columns if c not in keys]
    copies = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("bigint"))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
