"""Collections of records: writes go to an operation log, reads to its folded state."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions.filters import compile_filter
from vecloom.operators.fold import fold_onto
from vecloom.operators.ivf import IvfIndex
from vecloom.operators.knn import materialized
from vecloom.plans.catalog import Catalog
from vecloom.plans.planner import SearchOptions, search
from vecloom.sources.files import UNREADABLE, Store
from vecloom.sources.oplog import Moved, OpLog
from vecloom.types import MAX_DIMENSION, MAX_ID_BYTES, MAX_IDS, MAX_QUERIES, MAX_RESULTS, AlreadyExistsError, CollectionConfig, CorruptionError, IndexOptions, NotFoundError, Space, ValidationError, tagged_map


@dataclass(frozen=True)
class OptimizeStats:
    records: int
    indexed: int
    log_bytes_before: int
    log_bytes_after: int


def _checked(ids: list[str], **lists) -> None:
    if not ids:
        raise ValidationError("ids are empty")
    if len(ids) > MAX_IDS:
        raise ValidationError(f"at most {MAX_IDS} ids at once")
    for id in ids:
        if not isinstance(id, str) or not 1 <= len(id.encode()) <= MAX_ID_BYTES:
            raise ValidationError(f"an id has 1 to {MAX_ID_BYTES} bytes")
    for name, values in lists.items():
        if values is not None and len(values) != len(ids):
            raise ValidationError(f"{len(values)} {name} for {len(ids)} ids")


class Collection:
    """A handle; any number of them may read and write one collection."""

    def __init__(self, engine: Engine, config: CollectionConfig):
        self._engine, self.config = engine, config
        self.log = OpLog(engine.spark, engine.store.path(config.id))
        self._index: IvfIndex | None = None

    @property
    def spark(self) -> SparkSession:
        return self._engine.spark

    def records(self) -> DataFrame:
        return self.log.refresh().records()

    def _existing(self, records: DataFrame, ids: list[str]) -> set[str]:
        asked = self.spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id string")
        return {r["id"] for r in records.select("id").join(F.broadcast(asked), "id", "left_semi").collect()}

    def _dimension(self, embeddings) -> int:
        """Of a batch, which must agree with the collection's; nothing is changed yet."""
        have = self.config.dimension
        for e in embeddings:
            if not 0 < len(e) <= MAX_DIMENSION:
                raise ValidationError(f"a vector has 1 to {MAX_DIMENSION} dimensions")
            have = have or len(e)
            if len(e) != have:
                raise ValidationError(f"{len(e)} dimensions where {have} are expected")
        return have

    def _settle(self, dimension: int) -> None:
        """Fix the dimension in the catalog before anything of it is written."""
        if dimension and not self.config.dimension:
            self._engine.catalog.update_dimension(self.config.id, dimension)
            self.config = self.config.with_dimension(dimension)

    def _write(self, op: str, ids, embeddings, metadatas, documents, dimension: int, check: Callable[[DataFrame], None] | None = None) -> int:
        """``check`` sees the records that the batch is written after: where another
        handle writes in between, both are done again."""
        at = lambda values, i: None if values is None else values[i]
        rows = []
        for i, id in enumerate(ids):
            vector = at(embeddings, i)
            rows.append({"id": id, "op": op, "embedding": None if vector is None else [float(x) for x in vector], "metadata": tagged_map(at(metadatas, i)), "document": at(documents, i)})
        self._settle(dimension)
        while True:
            after = self.log.refresh().last_seq
            try:
                if check is not None:
                    check(self.log.records())
                seq = self.log.append(rows, after if check is not None else None)
                break
            except Moved:
                continue
            except UNREADABLE:
                if self.log.refresh().last_seq == after:
                    raise
        return self._wrote(seq)

    def _wrote(self, seq: int) -> int:
        self._engine.catalog.advance(self.config.id, seq)
        self.flush()
        if seq - self.log.snapshot_seq >= self.config.options.sync_threshold:
            self.checkpoint()
        return seq

    def add(self, ids, embeddings, metadatas=None, documents=None) -> int:
        _checked(ids, embeddings=embeddings, metadatas=metadatas, documents=documents)
        dimension = self._dimension(embeddings)
        if len(set(ids)) < len(ids):
            raise ValidationError("an id stands twice in the batch")

        def free(records: DataFrame) -> None:
            if taken := self._existing(records, ids):
                raise AlreadyExistsError(f"ids are there already: {sorted(taken)[:5]}")

        return self._write("add", ids, embeddings, metadatas, documents, dimension, free)

    def upsert(self, ids, embeddings, metadatas=None, documents=None) -> int:
        _checked(ids, embeddings=embeddings, metadatas=metadatas, documents=documents)
        return self._write("upsert", ids, embeddings, metadatas, documents, self._dimension(embeddings))

    def upsert_frame(self, rows: DataFrame) -> int:
        """Upsert the rows (id, embedding, metadata, document) of a DataFrame of any
        length, in the order of their ids; only counts come to the driver."""
        told = rows.agg(F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most"), F.min(F.octet_length("id")).alias("short"), F.max(F.octet_length("id")).alias("long"), F.count_if(F.col("id").isNull()).alias("none")).first()
        if told["least"] is None and told["short"] is None and not told["none"]:
            return self.log.last_seq
        if told["none"] or not 1 <= told["short"] <= told["long"] <= MAX_ID_BYTES:
            raise ValidationError(f"an id has 1 to {MAX_ID_BYTES} bytes")
        if told["least"] is None or told["least"] != told["most"] or not 0 < told["most"] <= MAX_DIMENSION:
            raise ValidationError("vectors must be there and have one dimension")
        if self.config.dimension not in (0, told["most"]):
            raise ValidationError(f"{told['most']} dimensions where {self.config.dimension} are expected")
        self._settle(told["most"])
        self.log.refresh()
        return self._wrote(self.log.append_frame(rows.select("id", "embedding", "metadata", "document", F.lit("upsert").alias("op")), "id"))

    def update(self, ids, metadatas=None, documents=None) -> int:
        """Metadata and document are replaced, by nothing where none are given."""
        _checked(ids, metadatas=metadatas, documents=documents)

        def there(records: DataFrame) -> None:
            if missing := set(ids) - self._existing(records, ids):
                raise NotFoundError(f"no such ids: {sorted(missing)[:5]}")

        return self._write("update", ids, None, metadatas, documents, 0, there)

    def delete(self, ids) -> int:
        _checked(ids)
        return self._write("delete", ids, None, None, None, 0)

    def count(self) -> int:
        return self.records().count()

    def get(self, ids: list[str] | None = None, where=None, limit: int | None = None, include: tuple[str, ...] = ("metadatas", "documents")) -> DataFrame:
        """With ids: one row for each of them in their order, nulls where none is live
        (pos, id, found, ...). Else the records that ``where`` lets through."""
        columns = ["metadata", "document", *(["embedding"] if "embeddings" in include else [])]
        rows = self.records()
        if where is not None:
            rows = rows.where(compile_filter(where, two_valued=False))
        if ids is None:
            rows = rows.select("id", *columns).orderBy("id")
            return rows if limit is None else rows.limit(limit)
        asked = self.spark.createDataFrame(list(enumerate(ids)), "pos long, id string")
        return F.broadcast(asked).join(rows.select("id", *columns, F.lit(True).alias("found")), "id", "left").select("pos", "id", F.coalesce("found", F.lit(False)).alias("found"), *columns).orderBy("pos")

    def query(self, embeddings, k: int = 10, where=None, include: tuple[str, ...] = (), ef: int = 0, oversampling: int = 4, digits: int | None = None) -> DataFrame:
        """(query_id, rank, id, ...) for a list of vectors, or a DataFrame of
        (query_id, embedding) of any length."""
        if isinstance(embeddings, DataFrame):
            queries = embeddings
        else:
            if not 0 < len(embeddings) <= MAX_QUERIES:
                raise ValidationError(f"1 to {MAX_QUERIES} queries at once")
            if k > MAX_RESULTS:
                raise ValidationError(f"at most {MAX_RESULTS} results")
            self._dimension(embeddings)
            queries = self.spark.createDataFrame([(i, [float(x) for x in e]) for i, e in enumerate(embeddings)], "query_id long, embedding array<float>")
        records = self.records()
        index = self.index()
        buffered = None
        if index is not None and self.log.last_seq > self.flushed_seq():
            buffered = self.log.read(self.flushed_seq() + 1).select("id").distinct()
        found = search(records, queries, k, self.config.space, self.config.options, SearchOptions(where, ef, oversampling, digits), index, buffered)
        return materialized(found, records, include)

    def index(self) -> IvfIndex | None:
        """The index that the manifest names, as last seen; it is checked when it is
        opened. One that is damaged, or that the log no longer reaches back to, isn't
        used; it can be built again."""
        entry = self.log.index
        if entry is None or entry["seq"] < self.log.kept_from:
            self._index = None
        elif self._index is None or self._index.entry != entry["index"]:
            try:
                self._index = IvfIndex.load(self.spark, entry["index"], self.config.space, self.config.dimension)
            except CorruptionError:
                self._index = None
        return self._index

    def build_index(self, cells: int | None = None) -> IvfIndex:
        """Fit and write an index of all vectors, and name it in the manifest."""
        records, seq = self.records(), self.log.last_seq
        index = IvfIndex.build(records, self.log.store.path(f"index/{uuid.uuid4().hex}"), self.config.space, cells)
        self.log.set_index(lambda now: {"seq": seq, "index": index.entry} if now is None or now["seq"] <= seq else now)
        return self.index() or index

    def flush(self, force: bool = False) -> bool:
        """Bring the index up to date once ``batch_size`` operations wait for it."""
        entry, last = self.log.refresh().index, self.log.last_seq
        waiting = last - entry["seq"] if entry else 0
        if entry is None or not (force or waiting >= self.config.options.batch_size):
            return False
        if not waiting:
            return True
        index = self.index()
        if index is None:
            self.build_index()
            return True
        touched = self.log.read(entry["seq"] + 1, last).select("id").distinct()
        live = self.log.records().join(touched, "id", "left_semi").select("id", "embedding")
        newer = index.added(live, touched)
        # where another handle was faster, its parts stand
        self.log.set_index(lambda now: {"seq": last, "index": newer.entry} if now == entry else now)
        return True

    def indexed_count(self) -> int:
        """Vectors that a search sees: those of the index and those written since."""
        return self.records().where("embedding is not null").count()

    def committed_count(self) -> int:
        index = self.index()
        return index.count if index else 0

    def flushed_seq(self) -> int:
        return self.log.index["seq"] if self.log.index else 0

    def checkpoint(self) -> int:
        """A snapshot, with the index up to date, as the log before it goes."""
        self.flush(force=True)
        return self.log.checkpoint()

    def optimize(self) -> OptimizeStats:
        before = self.log.refresh().log_bytes()
        index = self.index()
        if index is not None:
            self.build_index(len(index.centers))
        self.checkpoint()
        return OptimizeStats(self.count(), self.committed_count(), before, self.log.log_bytes())

    def delta(self, first: int) -> DataFrame:
        """What a follower that has seen all before ``first`` still lacks; raises where
        the log no longer has all of it."""
        return self.log.refresh().read(first)

    def apply(self, operations: DataFrame) -> DataFrame:
        """The state as it would be after more operations, without logging them."""
        return fold_onto(self.records(), operations)


class Engine:
    """``root``: a folder in any store that Spark can write to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)
        self.catalog = Catalog(spark, root)

    def create_collection(self, name: str, dimension: int = 0, space: Space | str = Space.L2, *, tenant: str = "default_tenant", database: str = "default_database", metadata: dict | None = None, options: IndexOptions | None = None, get: bool = False) -> Collection:
        config = CollectionConfig(name, dimension, Space.parse(space), tenant, database, metadata, options or IndexOptions())
        return Collection(self, self.catalog.create(config, get))

    def collection(self, name_or_id: str, tenant: str = "default_tenant", database: str = "default_database") -> Collection:
        return Collection(self, self.catalog.get(name_or_id, tenant, database))

    def list_collections(self, tenant: str | None = None, database: str | None = None) -> list[CollectionConfig]:
        return self.catalog.list(tenant, database)

    def delete_collection(self, name_or_id: str, tenant: str = "default_tenant", database: str = "default_database") -> None:
        id = self.catalog.get(name_or_id, tenant, database).id
        self.catalog.delete(id)
        self.store.delete(id)

    def snapshot(self, path: str) -> None:
        """The records of all collections below another folder."""
        for config in self.catalog.list():
            rows = Collection(self, config)
            rows.records().write.mode("overwrite").parquet(f"{path}/{config.id}/{rows.log.last_seq}")

    def restore(self, path: str) -> None:
        """Put back the records of every collection that ``path`` has."""
        theirs = Store(self.spark, path)
        for config in self.catalog.list():
            for seq in sorted(theirs.list(config.id), key=int)[-1:]:
                Collection(self, config).log.replace(self.spark.read.parquet(f"{path}/{config.id}/{seq}"), int(seq))

    def sql(self, text: str, current: str | None = None) -> DataFrame:
        from vecloom.plans.sql import execute

        return execute(self, text, current)
