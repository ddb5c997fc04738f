"""Clocks of several nodes: how far each has come, and the highest tag of all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def advanced(clocks: DataFrame, seen: DataFrame) -> DataFrame:
    """(node, seq): for each node the larger of what was known and what was seen."""
    return clocks.select("node", "seq").unionByName(seen.select("node", "seq")).groupBy("node").agg(F.max("seq").alias("seq"))


def high_water(clocks: DataFrame) -> DataFrame:
    """The largest (node, seq), compared by node first."""
    return clocks.agg(F.max(F.struct("node", "seq")).alias("tag")).select("tag.node", "tag.seq")


def unfenced(log: DataFrame, epoch: int) -> DataFrame:
    """The log up to the first operation whose epoch lies behind ``epoch``."""
    cut = log.where(F.col("epoch") < epoch).agg(F.min("seq").alias("cut"))
    return log.join(F.broadcast(cut)).where("cut is null or seq < cut").drop("cut")
