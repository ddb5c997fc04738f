"""Metadata as an inverted table, for looking at what keys and values there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entries(records: DataFrame, metadata: str = "metadata") -> DataFrame:
    """(id, key, kind, value): one row for each metadata entry; numbers of either type
    are written as doubles so that they meet."""
    rows = records.select("id", F.explode(metadata).alias("key", "v"))
    value = F.coalesce(F.col("v.s"), F.col("v.b").cast("string"), F.coalesce(F.col("v.f"), F.col("v.i").cast("double")).cast("string"))
    kind = F.when(F.col("v.s").isNotNull(), "string").when(F.col("v.b").isNotNull(), "boolean").otherwise("number")
    return rows.select("id", "key", kind.alias("kind"), value.alias("value"))


def postings(records: DataFrame, metadata: str = "metadata") -> DataFrame:
    """(key, kind, value, n): how many records hold each value."""
    return entries(records, metadata).groupBy("key", "kind", "value").agg(F.count(F.lit(1)).alias("n"))


def has_key(key: str, metadata: str = "metadata") -> Column:
    return F.coalesce(F.map_contains_key(metadata, F.lit(key)), F.lit(False))


def in_range(key: str, least: float | None = None, most: float | None = None, metadata: str = "metadata") -> Column:
    """Numbers of either type within inclusive bounds."""
    v = F.try_element_at(F.col(metadata), F.lit(key))
    number = F.coalesce(v["f"], v["i"].cast("double"))
    out = number.isNotNull()
    out = out if least is None else out & (number >= least)
    return F.coalesce(out if most is None else out & (number <= most), F.lit(False))
