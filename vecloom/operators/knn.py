"""Exact nearest neighbours.

Ties rank by id. Ranking only ever moves ids and distances; documents and metadata
are joined to the few rows that remain.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.functions.distance import block, distance, exact, literal_vector
from vecloom.types import Space

#: Queries that are sent to all vectors as they lie; more meet the vectors in a grid.
QUERY_BLOCK = 1_000
#: Queries and vectors of one cell of the grid, about.
GRID_QUERIES, GRID_VECTORS = 2_000, 50_000
#: Numbers in the vectors that are compared at once, and distances held at once, about;
#: rows of results in a batch.
NUMBERS, DISTANCES, ROWS = 8_000_000, 4_000_000, 50_000


def nearest(vectors: DataFrame, query: list[float], k: int, space: Space | str = Space.L2, id: str = "id", embedding: str = "embedding", digits: int | None = None) -> DataFrame:
    """The ``k`` nearest rows of one query: (id, distance). One pass with a bounded
    heap in each task and no shuffle of the rows. ``digits`` rounds before ranking."""
    d = rounded(distance(space, F.col(embedding), literal_vector(query)), digits)
    return vectors.where(F.col(embedding).isNotNull()).select(F.col(id), d.alias("distance")).orderBy("distance", id).limit(max(k, 1))


def rounded(d: Column, digits: int | None) -> Column:
    """Adding zero turns a negative zero into a plain one."""
    return d if digits is None else F.round(d, digits) + F.lit(0.0)


def ranked(pairs: DataFrame, k: int, id: str = "id") -> DataFrame:
    """The ``k`` nearest of each query."""
    order = W.partitionBy("query_id").orderBy("distance", id)
    return pairs.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= max(k, 1)).select("query_id", "rank", id, "distance")


def few(queries: DataFrame, at_most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids and vectors of ``queries`` (query_id, embedding), if they are that few."""
    rows = queries.select("query_id", "embedding").where("embedding is not null").limit(at_most + 1).collect()
    if len(rows) > at_most:
        return None
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float32).reshape(len(rows), len(rows[0][1]) if rows else 0)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as the rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Best:
    """Compares vectors, some at a time, with queries. The ``k`` nearest of each query
    among these, but for those that vectors seen before rule out, are given out at once
    as batches (query_id, id, distance), so what is held grows neither with the queries
    nor with ``k``."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, space: Space | str, digits: int | None, id: str, kind: str):
        self.query_ids, self.queries, self.k, self.space, self.digits = query_ids, queries, max(k, 1), space, digits
        self.names, self.kind = ["query_id", id, "distance"], kind
        self._squares = (queries.astype(np.float64) ** 2).sum(axis=1)
        self._farthest = np.full(len(queries), np.inf)  # of ``k`` vectors seen together

    def see(self, ids: pa.Array, vectors: np.ndarray, of: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """Compare more vectors with all queries, or with those numbered ``of``."""
        of = np.arange(len(self.queries)) if of is None else of
        if not len(ids) or not len(of):
            return
        order = pc.sort_indices(ids)  # so places rank as the ids do
        ids, vectors = ids.take(order), vectors[order.to_numpy()].astype(np.float64)
        some, largest = min(len(ids), self.k + 8), float((vectors**2).sum(axis=1).max())
        found, rows, step = [], 0, max(1, DISTANCES // len(ids))
        for start in range(0, len(of), step):
            part = of[start : start + step]
            near = np.empty((len(part), len(ids)))
            for at in range(0, len(ids), 8_192):  # what the distances are made of is larger than they are
                near[:, at : at + 8_192] = block(self.space, self.queries[part], vectors[at : at + 8_192])
            for row, i in zip(near, part.tolist()):
                limit = self._farthest[i] if some == len(row) else min(self._farthest[i], np.partition(row, some - 1)[some - 1])
                # neither the block form's rounding nor a tie of rounded distances may lose a candidate
                slack = 1e-12 * (1.0 + largest + self._squares[i]) + (0.0 if self.digits is None else 10.0**-self.digits)
                at = np.arange(len(row)) if limit == np.inf else np.flatnonzero(row <= limit + slack)
                d = exact(self.space, self.queries[i], vectors[at])
                if self.digits is not None:
                    d = np.round(d, self.digits) + 0.0
                best = np.lexsort((at, d))[: self.k]
                if len(best) == self.k:
                    self._farthest[i] = min(self._farthest[i], d[best[-1]])
                found.append((i, at[best], d[best]))
                rows += len(best)
                if rows >= ROWS:
                    yield self._batch(ids, found)
                    found, rows = [], 0
        if rows:
            yield self._batch(ids, found)

    def _batch(self, ids: pa.Array, found: list) -> pa.RecordBatch:
        of = np.repeat(self.query_ids[[i for i, _, _ in found]], [len(at) for _, at, _ in found])
        at, d = (np.concatenate([f[n] for f in found]) for n in (1, 2))
        return pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), ids.take(pa.array(at)).cast(arrow(self.kind)), pa.array(d, pa.float64())], self.names)


def together(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches whose second column is a vector, joined or cut to as many as ``NUMBERS`` allows."""
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        most = max(1, NUMBERS // max(1, len(batch.column(1)[0])))
        for start in range(0, batch.num_rows, most):
            part = batch.slice(start, most)
            if held and rows + part.num_rows > most:
                yield pa.concat_batches(held)
                held, rows = [], 0
            held.append(part)
            rows += part.num_rows
    if held:
        yield pa.concat_batches(held)


def nearest_blocks(vectors: DataFrame, queries: DataFrame, k: int, space: Space | str = Space.L2, id: str = "id", embedding: str = "embedding", digits: int | None = None, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` nearest rows of every row of ``queries`` (query_id, embedding), as
    (query_id, rank, id, distance). ``digits`` rounds distances before ranking.

    Up to ``query_block`` queries are sent to the vectors where these lie; more meet
    them in a grid. Either way numpy compares blocks, k of each query are kept of as many
    vectors as are compared at once, and only these are shuffled to be ranked.
    """
    source = vectors.where(F.col(embedding).isNotNull()).select(id, F.col(embedding).alias("embedding"))
    queries = queries.select("query_id", F.col(embedding).alias("embedding"))
    sent = few(queries, query_block)
    if sent is None:
        one = F.lit(0).alias("key")
        return ranked(grid(source.select("*", one), queries.where("embedding is not null").select("*", one), k, space, id, digits), k, id)
    sent = source.sparkSession.sparkContext.broadcast(sent)
    kind = source.schema[id].dataType.simpleString()

    def run(batches):
        best = Best(*sent.value, k, space, digits, id, kind)
        for batch in together(batches):
            yield from best.see(batch.column(0), matrix(batch.column(1)))

    return ranked(source.mapInArrow(run, f"query_id long, {id} {kind}, distance double"), k, id)


def grid(vectors: DataFrame, queries: DataFrame, k: int, space: Space | str, id: str, digits: int | None) -> DataFrame:
    """(query_id, id, distance): the ``k`` nearest of each query among the vectors of
    its key, for each cell of a grid. Vectors (id, embedding, key) and queries (query_id,
    embedding, key) of one key are dealt into parts of bounded size, and every part of
    the one meets every part of the other, so neither a common key nor many queries
    come to one task. What is broadcast are the numbers of parts of the keys."""
    parts = lambda rows, size, name: rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias(name))
    # many neighbours are sought among more vectors, as each part gives out as many
    counts = parts(vectors, max(GRID_VECTORS, GRID_VECTORS * k // 500), "v").join(parts(queries, GRID_QUERIES, "q"), "key").collect()  # one row a key: cells are bounded
    spark, kind = vectors.sparkSession, vectors.schema[id].dataType.simpleString()
    known = F.broadcast(spark.createDataFrame([tuple(r) for r in counts], "key int, v int, q int"))
    deal = lambda by, n: F.pmod(F.xxhash64(by), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = vectors.join(known, "key").select(id, "embedding", "key", deal(id, "v").alias("pv"), every("q").alias("pq"))
    right = queries.join(known, "key").select("query_id", "embedding", "key", deal("query_id", "q").alias("pq"), every("v").alias("pv"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        query_ids = right.column(0).to_numpy()
        best = Best(query_ids, matrix(right.column(1)) if right.num_rows else np.zeros((0, 1), np.float32), k, space, digits, id, kind)
        batches = [b for part in together(left.to_batches()) for b in best.see(part.column(0), matrix(part.column(1)))]
        return pa.Table.from_batches(batches, pa.schema([("query_id", pa.int64()), (id, arrow(kind)), ("distance", pa.float64())]))

    cell = ["key", "pv", "pq"]
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(run, f"query_id long, {id} {kind}, distance double")


def arrow(kind: str) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]


def nested(results: DataFrame, id: str = "id") -> DataFrame:
    """One row for each query: its ids and distances in the order of rank."""
    rows = F.sort_array(F.collect_list(F.struct("rank", id, "distance")))
    return results.groupBy("query_id").agg(rows.alias("r")).select("query_id", F.col(f"r.{id}").alias("ids"), F.col("r.distance").alias("distances"))


def materialized(results: DataFrame, records: DataFrame, include: tuple[str, ...] = ()) -> DataFrame:
    """Join what ``include`` asks for (distances, documents, metadatas) to ranked ids."""
    keep = [c for c in results.columns if c != "distance" or "distances" in include]
    out = results.select(keep)
    names = {"documents": "document", "metadatas": "metadata"}
    more = [names[x] for x in include if x in names]
    return out.join(records.select("id", *more), "id", "left").select(*keep, *more) if more else out
