"""Bounded samples of labelled rows, and which rows may be learned from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def held_out(id_col: str) -> Column:
    return F.coalesce(fold(id_col) == 1, F.lit(False))


def bounded_ids(ids: DataFrame, id_col: str, most: int) -> DataFrame:
    """At most `most` distinct ids: those with the smallest hashes, so the choice doesn't depend on order or partitions."""
    return ids.select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(most)
