"""A bitmap of bounded size that tells, where rows lie, which keys another table may
have: what can't meet anything in a join needn't be shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap.
SIEVE = 1 << 23


def _place(key: Column, bits: int) -> tuple[Column, Column]:
    """The word of a sieve and the bit in it that a hash falls on."""
    at = key.bitwiseAND(F.lit(bits - 1))
    return F.shiftrightunsigned(at, 6), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))


def sieve(rows: DataFrame, key: Column, bits: int = SIEVE) -> DataFrame:
    """(word, bits): the places of the hashes ``key`` in a bitmap of bounded size."""
    word, bit = _place(key, bits)
    return rows.select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))


def sieved(rows: DataFrame, key: Column, through: DataFrame, caught: bool = True, bits: int = SIEVE) -> DataFrame:
    """The rows whose hash falls on a place that ``through`` has, or else the others.
    Those whose hash is in the sieve are caught, and a few more; more hashes than it has
    bits only make these more. Rows are told apart where they lie, without a shuffle."""
    word, bit = _place(key, bits)
    return rows.join(F.broadcast(through), (word == F.col("__word")) & (F.col("__bits").bitwiseAND(bit) != 0), "left_semi" if caught else "left_anti")
