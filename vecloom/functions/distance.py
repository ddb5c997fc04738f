"""Vector arithmetic as Column expressions, and the same over numpy blocks.

Everything is computed in double precision; smaller is closer in every space.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from vecloom.types import Space

#: Norms up to this are zero: such a vector has no direction.
TINY = 1e-32


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def l2_squared(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """The unit vector; a vector without length is returned as it is."""
    n = norm(v)
    return F.when(n <= TINY, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / (n + F.lit(TINY))))


def inner_product(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b)


def cosine(a: Column, b: Column) -> Column:
    """1 where either vector has no length."""
    lengths = norm(a) * norm(b)
    return F.when((norm(a) <= TINY) | (norm(b) <= TINY), F.lit(1.0)).otherwise(F.lit(1.0) - dot(a, b) / lengths)


def distance(space: Space | str, a: Column, b: Column) -> Column:
    return {Space.L2: l2_squared, Space.COSINE: cosine, Space.IP: inner_product}[Space.parse(space)](a, b)


def literal_vector(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def block(space: Space | str, queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Distances of every query (rows) to every vector (columns)."""
    space = Space.parse(space)
    q, v = queries.astype(np.float64, copy=False), vectors.astype(np.float64, copy=False)
    if space is Space.COSINE:
        q_len, v_len = np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)
        lengths = np.outer(q_len, v_len)
        some = np.outer(q_len > TINY, v_len > TINY)
        return 1.0 - np.divide(q @ v.T, lengths, out=np.zeros_like(lengths), where=some)
    products = q @ v.T
    if space is Space.IP:
        return 1.0 - products
    # the expanded square loses digits for near vectors, so only candidates are ranked by it; see exact()
    return np.maximum((q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2.0 * products, 0.0)


def exact(space: Space | str, query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Distances of one query to some vectors, by the definition."""
    if Space.parse(space) is Space.L2:
        d = vectors.astype(np.float64, copy=False) - query.astype(np.float64)
        return (d * d).sum(axis=1)
    return block(space, query[None, :], vectors)[0]
