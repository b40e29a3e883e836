"""Carrying a caller's columns past an operator's own, whatever their names are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed(df: DataFrame, columns: dict[str, Column | str], without: Sequence[str] = ()) -> DataFrame:
    """``columns`` and, as one struct, the columns of ``df`` but for those named in ``without``."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in without]
    whole = F.struct(*kept) if kept else F.struct(F.lit(None).cast("string").alias("none"))
    return df.select(whole.alias("whole"), *[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def unpacked(df: DataFrame, like: DataFrame, without: Sequence[str] = (), **more: Column | str) -> DataFrame:
    """The packed columns again; ``more`` in their places where ``like`` has such names, the others after them."""
    more = {name: F.col(c) if isinstance(c, str) else c for name, c in more.items()}
    kept = [more.pop(c).alias(c) if c in more and c not in without else F.col("whole")[c].alias(c) for c in like.columns if c not in without]
    return df.select(*kept, *[c.alias(name) for name, c in more.items()])
