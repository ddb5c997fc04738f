"""Approximate neighbours: an inverted file over k-means cells, kept in a folder.

Cells are fitted on a bounded, seeded sample and then hold every vector. A search
looks into the ``nprobe`` cells nearest to the query and ranks what they hold exactly;
with all cells it is the exact search.

The folder has a description that is written once, and Parquet parts that are
partitioned by cell, so a search reads the cells that it looks into and no others.
Later writes come as further parts: the vectors that were written, and the ids that
count no longer in the parts before. Which parts belong to the index is told by the
``entry`` of whoever holds it, so a part that was being written when its writer died
is never read.
"""

from __future__ import annotations

import json
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions.distance import doubles, normalize
from vecloom.operators import knn
from vecloom.operators.knn import Best, few, grid, matrix, nearest_blocks, ranked, together
from vecloom.sources.files import UNREADABLE, Store
from vecloom.types import CorruptionError, Space, ValidationError

#: Vectors that k-means is fitted on, about.
SAMPLE = 100_000
#: Cells, at most, and numbers in all centres: what is broadcast doesn't grow with the vectors.
CELLS, NUMBERS = 4_096, 4_000_000
SEED = 42
#: Recall that the number of cells is chosen for, and the queries that it is measured on,
#: at most; a little more than is wanted, as other queries differ from the measured ones.
RECALL, ASKED = 0.97, 200
#: Parts that are joined into one when there are more.
PARTS = 8
_META = "index.json"


class IvfIndex:
    """``entry``: {"path", "parts": [{"name", "rows"}], "dead": [names], "count", "old":
    [folders that no later search reads]}. Names grow from part to part; a dead id
    counts for the parts named before it."""

    def __init__(self, spark: SparkSession, entry: dict, meta: dict):
        self.spark, self.entry, self.meta = spark, entry, meta
        self.centers, self.space, self.kind = np.array(meta["centers"]), Space.parse(meta["space"]), meta["id"]

    @property
    def count(self) -> int:
        return self.entry["count"]

    @property
    def nprobe(self) -> int:
        return self.meta["nprobe"]

    @classmethod
    def build(cls, vectors: DataFrame, path: str, space: Space | str = Space.L2, k: int | None = None, seed: int = SEED, sample: int = SAMPLE) -> IvfIndex:
        """Fit and write an index of ``vectors`` (id, embedding) below a new folder."""
        spark, space = vectors.sparkSession, Space.parse(space)
        rows = vectors.where("embedding is not null").select("id", "embedding")
        count = rows.count()
        if not count:
            raise ValidationError("an index needs vectors")
        dimension = rows.select(F.size("embedding")).first()[0]
        k = min(count, k or max(1, min(CELLS, NUMBERS // dimension, round(math.sqrt(count)))))
        sample = min(sample, 16 * NUMBERS // dimension)
        order = F.xxhash64(F.lit(seed), F.col("id").cast("string"))
        some = rows if count <= sample else rows.where(F.pmod(order, F.lit(count)) < sample)
        centers = [[0.0] * dimension]
        if k > 1:
            fitted = KMeans(k=k, seed=seed, maxIter=10).fit(some.select(array_to_vector(_placed(space)).alias("features")))
            centers = np.array(fitted.clusterCenters()).tolist()
        meta = {"space": space.value, "dimension": dimension, "id": rows.schema["id"].dataType.simpleString(), "centers": centers, "nprobe": 0}
        index = cls(spark, {"path": path, "parts": [], "dead": [], "count": 0, "old": []}, meta).added(rows)
        meta["nprobe"] = index.measured_probes()
        Store(spark, path).put(_META, json.dumps(meta))
        return index

    @classmethod
    def load(cls, spark: SparkSession, entry: dict, space: Space | str | None = None, dimension: int | None = None) -> IvfIndex:
        store = Store(spark, entry["path"])
        if not store.exists(_META):
            raise CorruptionError(f"{entry['path']} has no {_META}")
        meta = json.loads(store.get(_META))
        if space is not None and meta["space"] != Space.parse(space).value or dimension not in (None, 0, meta["dimension"]):
            raise CorruptionError(f"{entry['path']} was built for {meta['space']} in {meta['dimension']} dimensions")
        index = cls(spark, entry, meta)
        want = {p["name"]: p["rows"] for p in entry["parts"] if p["rows"]}
        try:
            have = {r["part"]: r["count"] for r in index._cells().groupBy("part").count().collect()}
        except UNREADABLE as error:
            raise CorruptionError(f"{entry['path']} can't be read") from error
        if have != want:
            raise CorruptionError(f"{entry['path']} holds {have} vectors, not {want}")
        return index

    def _cells(self) -> DataFrame:
        """(id, embedding, part, cell) of the parts, dead vectors and all."""
        paths = [f"{self.entry['path']}/cells/part={p['name']}" for p in self.entry["parts"] if p["rows"]]
        kind = f"id {self.kind}, embedding array<float>, part string, cell int"
        if not paths:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).option("basePath", f"{self.entry['path']}/cells").parquet(*paths)

    def _dead(self) -> DataFrame:
        """(id, since): ids that count only in parts from ``since`` on."""
        path = f"{self.entry['path']}/dead"
        rows = self.spark.read.schema(f"id {self.kind}, since string").option("basePath", path).parquet(*[f"{path}/since={n}" for n in self.entry["dead"]])
        return rows.groupBy("id").agg(F.max("since").alias("since"))

    def vectors(self, after: str = "") -> DataFrame:
        """(id, embedding, cell) of all vectors that count, of parts named after ``after``."""
        rows = self._cells().where(F.col("part") > after) if after else self._cells()
        if self.entry["dead"]:
            rows = rows.alias("r").join(self._dead().alias("d"), (F.col("r.id") == F.col("d.id")) & (F.col("r.part") < F.col("d.since")), "left_anti")
        return rows.select("id", "embedding", "cell")

    def _next(self) -> str:
        before = self.entry["parts"][-1]["name"] if self.entry["parts"] else "0"
        return f"{int(before.split('-')[0]) + 1:012d}-{uuid.uuid4().hex}"

    def _written(self, rows: DataFrame, name: str) -> int:
        """Write one more part; cells are dealt to tasks by their size, several a large one."""
        path = f"{self.entry['path']}/cells/part={name}"
        _in_cells(rows, self.centers, "id", 1, self.space).hint("rebalance", F.col("cell")).write.partitionBy("cell").parquet(path)
        return self.spark.read.schema(f"id {self.kind}, cell int").parquet(path).count()

    def added(self, vectors: DataFrame, touched: DataFrame | None = None) -> IvfIndex:
        """The index with more vectors (id, embedding), after the ids ``touched`` have
        been taken out. Centres stay until the index is built again."""
        name, entry = self._next(), dict(self.entry)
        if touched is not None:
            touched.select("id").distinct().write.parquet(f"{entry['path']}/dead/since={name}")
            entry["dead"] = [*entry["dead"], name]
        n = self._written(vectors.where("embedding is not null").select("id", "embedding"), name)
        entry["parts"] = [*entry["parts"], {"name": name, "rows": n}]
        index = IvfIndex(self.spark, entry, self.meta)
        entry["count"] = n if len(entry["parts"]) == 1 else index.vectors().select("id").count()
        return index.joined() if len(entry["parts"]) > PARTS else index

    def without(self, ids: DataFrame) -> IvfIndex:
        """The index with some ids taken out."""
        return self.added(self.spark.createDataFrame([], f"id {self.kind}, embedding array<float>"), ids)

    def joined(self) -> IvfIndex:
        """The same index in fewer parts: the later ones become one, and the first as
        well once they have grown to a quarter of it. What they were made of stays until
        the next time, as searches that were planned before still read it."""
        entry, name = dict(self.entry), self._next()
        first, later = entry["parts"][0], entry["parts"][1:]
        small = 4 * sum(p["rows"] for p in later) < first["rows"]
        n = self._written(self.vectors(first["name"] if small else "").select("id", "embedding"), name)
        dead = []
        if small and entry["dead"]:
            self._dead().select("id").write.parquet(f"{entry['path']}/dead/since={name}")
            dead = [name]
        store = Store(self.spark, entry["path"])
        for folder in entry["old"]:
            store.delete(folder)
        entry["old"] = [f"cells/part={p['name']}" for p in (later if small else entry["parts"])] + [f"dead/since={d}" for d in entry["dead"]]
        entry["parts"] = [*([first] if small else []), {"name": name, "rows": n}]
        return IvfIndex(self.spark, {**entry, "dead": dead}, self.meta)

    def probes(self, ef: int) -> int:
        """Cells that hold about ``ef`` vectors."""
        return max(1, min(len(self.centers), math.ceil(ef * len(self.centers) / max(1, self.count))))

    def measured_probes(self, k: int = 10, least: float = RECALL, asked: int = ASKED) -> int:
        """The fewest cells with which a hash-chosen sample of the vectors finds the share
        ``least`` of its exact neighbours, itself left out."""
        order = F.xxhash64(F.lit(SEED), F.col("id").cast("string"))
        some = self.vectors().select(_number(F.col("id")).alias("query_id"), "embedding", order.alias("order")).orderBy("order", "query_id").limit(asked)
        ids, asked_vectors = few(some, asked)
        exact = nearest_blocks(self.vectors(), some, k + 1, self.space).select("query_id", "id").where(F.col("query_id") != _number(F.col("id")))
        held = exact.join(self.vectors().select("id", "cell"), "id").select("query_id", "cell").collect()  # bounded by ``asked`` and k
        if not held:
            return len(self.centers)
        turn = dict(zip(ids.tolist(), np.argsort(_order(asked_vectors, self.centers, self.space), axis=1)))
        turns = np.sort([turn[r["query_id"]][r["cell"]] for r in held])
        return int(turns[math.ceil(least * len(turns)) - 1]) + 1

    def search(self, queries: DataFrame, k: int, nprobe: int | None = None, digits: int | None = None, but: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
        """(query_id, rank, id, distance) of ``queries`` (query_id, embedding); ids of
        ``but`` are left out, and with ``only`` all others than its own. ``nprobe``: all
        cells if it is None."""
        nprobe = len(self.centers) if nprobe is None else nprobe
        rows = self.vectors()
        if but is not None:
            rows = rows.join(but.select("id"), "id", "left_anti")
        if only is not None:
            rows = rows.join(only.select("id"), "id", "left_semi")
        if nprobe >= len(self.centers):  # every query meets every vector, whatever the cell
            return nearest_blocks(rows, queries, k, self.space, digits=digits, query_block=knn.QUERY_BLOCK)
        sent = few(queries, knn.QUERY_BLOCK)
        if sent is None:
            asked = queries.select("query_id", "embedding").where("embedding is not null")
            probes = _in_cells(asked, self.centers, "query_id", nprobe, self.space).withColumnRenamed("cell", "key")
            return ranked(grid(rows.withColumnRenamed("cell", "key"), probes, k, self.space, "id", digits), k)
        ids, asked_vectors = sent
        kind, space = self.kind, self.space
        if not len(ids):
            return self.spark.createDataFrame([], f"query_id long, rank long, id {kind}, distance double")
        near = _order(asked_vectors, self.centers, space)[:, :nprobe]
        of: dict[int, list[int]] = {}
        for i, cells in enumerate(near.tolist()):
            for c in cells:
                of.setdefault(c, []).append(i)
        rows = rows.where(F.col("cell").isin(sorted(of)))
        sent = self.spark.sparkContext.broadcast((ids, asked_vectors, {c: np.array(x) for c, x in of.items()}))

        def run(batches):
            query_ids, q, of = sent.value
            best = Best(query_ids, q, k, space, digits, "id", kind)
            for batch in together(batches):
                v, cells = matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
                for c in np.unique(cells).tolist():
                    if c in of:
                        at = np.flatnonzero(cells == c)
                        yield from best.see(batch.column(0).take(pa.array(at)), v[at], of[c])

        return ranked(rows.select("id", "embedding", "cell").mapInArrow(run, f"query_id long, id {kind}, distance double"), k)


def _number(id):
    """Ids of any type as the numbers that queries are named by."""
    return F.xxhash64(id.cast("string"))


def _placed(space: Space):
    """Where a vector lies among the cells; for cosine only its direction counts."""
    return normalize(F.col("embedding")) if space is Space.COSINE else doubles(F.col("embedding"))


def _order(vectors: np.ndarray, centers: np.ndarray, space: Space) -> np.ndarray:
    """For each vector the cells from the nearest to the farthest; equal gaps by number."""
    v = vectors.astype(np.float64)
    if space is Space.COSINE:
        n = np.linalg.norm(v, axis=1, keepdims=True)
        v = np.divide(v, n, out=v.copy(), where=n > 1e-32)
    # the vector's own square is the same for all centres
    gap = (centers * centers).sum(axis=1)[None, :] - 2.0 * (v @ centers.T)
    return np.argsort(gap, axis=1, kind="stable")


def _in_cells(rows: DataFrame, centers: np.ndarray, id: str, nprobe: int, space: Space = Space.L2) -> DataFrame:
    """(id, embedding, cell): each vector with the ``nprobe`` cells nearest to it."""
    kind = rows.schema[id].dataType.simpleString()
    sent = rows.sparkSession.sparkContext.broadcast(centers)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            near = _order(matrix(batch.column(1)), sent.value, space)[:, :nprobe]
            at = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(near.ravel().astype(np.int32))], [id, "embedding", "cell"])

    return rows.select(id, "embedding").mapInArrow(run, f"{id} {kind}, embedding array<float>, cell int")
