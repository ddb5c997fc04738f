"""The operation log and the snapshots of one collection.

Both are Parquet folders that a manifest names. Every change of the manifest is a new
numbered version (see ``Versioned``), so a batch is in the log or it isn't, and of
writers that append at once all but one number their batch anew. Sequence numbers
start at 1 and have no gaps.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.operators.fold import COLUMNS, fold, fold_onto
from vecloom.sources.files import UNREADABLE, Store, Versioned
from vecloom.types import OPERATION, RECORD, CorruptionError, PrunedError

MANIFEST = "manifest"
_LOG = [f.name for f in OPERATION.fields]


class Moved(Exception):
    """The log has grown since the caller looked."""


class OpLog:
    """``heal``: cut back a log that doesn't hold what its manifest says; whoever only
    reads the log of another leaves that to its owner."""

    def __init__(self, spark: SparkSession, root: str, epoch: int = 0, heal: bool = True):
        self.spark, self.store, self.epoch = spark, Store(spark, root), epoch
        self._manifest = Versioned(self.store, MANIFEST, {"epoch": epoch, "last": 0, "kept_from": 0, "batches": [], "snapshots": [], "index": None})
        self.refresh()
        # what a batch should weigh is in the manifest, so a whole log opens without a job
        if heal and any(self.store.size(b["path"]) != b["bytes"] for b in self._state["batches"]):
            self.recover()

    def refresh(self) -> OpLog:
        """See what other handles have written."""
        self._number, self._state = self._manifest.read()
        return self

    def _commit(self, how: Callable[[dict], dict]) -> None:
        self._number, self._state = self._manifest.change(how)

    @property
    def last_seq(self) -> int:
        return self._state["last"]

    @property
    def kept_from(self) -> int:
        """Operations up to this one are gone."""
        return self._state["kept_from"]

    @property
    def snapshot_seq(self) -> int:
        return self._state["snapshots"][-1]["seq"] if self._state["snapshots"] else 0

    @property
    def index(self) -> dict | None:
        """What the manifest says of the index, see ``Collection``."""
        return self._state.get("index")

    def set_index(self, how: Callable[[dict | None], dict | None]) -> None:
        """Name another index; the folder of one that is replaced goes later."""

        def named(state: dict) -> tuple[dict, list[str]]:
            old, new = state.get("index"), how(state.get("index"))
            folder = lambda x: x["index"]["path"].removeprefix(f"{self.store.root}/") if x else None
            return {**state, "index": new}, [folder(old)] if old and folder(old) != folder(new) else []

        self._replace(named)

    def append(self, operations: list[dict], after: int | None = None) -> int:
        """Add operations in their order, as one batch; the last sequence number. With
        ``after``, raises ``Moved`` unless that is the last number so far."""
        if not operations:
            return self.last_seq
        rows = [tuple({**o, "seq": i, "epoch": self.epoch}.get(c) for c in _LOG) for i, o in enumerate(operations)]
        return self._add(self.spark.createDataFrame(rows, OPERATION), len(rows), after)

    def append_frame(self, operations: DataFrame, order: str, after: int | None = None) -> int:
        """Add the rows of a DataFrame in the order of a column. Rows are numbered by
        partition: only a count for each partition comes to the driver."""
        aside = f"aside-{uuid.uuid4().hex}"
        columns = [c for c in _LOG if c not in ("seq", "epoch")]
        operations.orderBy(order).select(*columns, F.monotonically_increasing_id().alias("at")).write.parquet(self.store.path(aside))
        rows = self.spark.read.parquet(self.store.path(aside))
        part = F.shiftrightunsigned("at", 33)
        total, before = 0, []
        for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
            before.append((r["part"], total))
            total += r["n"]
        try:
            if total:
                offsets = self.spark.createDataFrame(before, "part long, before long")
                seq = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
                numbered = rows.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("seq", seq).withColumn("epoch", F.lit(self.epoch).cast("long")).select(_LOG)
                self._add(numbered, total, after)
        finally:
            self.store.delete(aside)
        return self.last_seq

    def _add(self, rows: DataFrame, n: int, after: int | None) -> int:
        """``rows`` are numbered from 0. They are written with the numbers that come next,
        and again where another batch has taken these meanwhile."""
        while True:
            first = (self.last_seq if after is None else after) + 1
            name = f"oplog/{first:020d}-{uuid.uuid4().hex}"
            rows.withColumn("seq", F.col("seq") + F.lit(first)).write.parquet(self.store.path(name))
            batch = {"path": name, "from": first, "to": first + n - 1, "bytes": self.store.size(name)}

            def grown(state: dict) -> dict:
                if state["last"] != first - 1:
                    raise Moved
                return {**state, "last": batch["to"], "batches": [*state["batches"], batch]}

            try:
                self._commit(grown)
                return batch["to"]
            except Moved:
                self.store.delete(name)
                self.refresh()
                if after is not None:
                    raise

    def read(self, first: int | None = None, last: int | None = None) -> DataFrame:
        """Operations first <= seq <= last, by default all there are; none where first
        is beyond last. Raises where some that were asked for have been pruned."""
        last = self.last_seq if last is None else last
        first = self.kept_from + 1 if first is None else first
        if first <= min(self.kept_from, last):
            raise PrunedError(f"operations up to {self.kept_from} are gone; the snapshot has them")
        paths = [self.store.path(b["path"]) for b in self._state["batches"] if b["from"] <= last and b["to"] >= first]
        if not paths or first > last:
            return self.spark.createDataFrame([], OPERATION)
        return self.spark.read.schema(OPERATION).parquet(*paths).where(F.col("seq").between(first, last))

    def prune(self, keep_from: int) -> None:
        """Forget operations up to ``keep_from``, or as far as the index has seen them; a
        batch that reaches beyond is rewritten."""
        self._replace(lambda state: self._cut(state, keep_from))

    def _replace(self, how: Callable[[dict], tuple[dict, list[str]]]) -> None:
        """A change after which some folders are needed no more. They stay until the next
        such change, as readers of the version before may still be at work."""
        due: list[str] = []

        def changed(state: dict) -> dict:
            new, gone = how(state)
            due[:] = state.get("trash", []) if gone else []
            return {**new, "trash": gone} if gone else new

        self._commit(changed)
        for name in due:
            self.store.delete(name)

    def _cut(self, state: dict, keep_from: int) -> tuple[dict, list[str]]:
        kept, gone = [], []
        if state.get("index"):
            keep_from = min(keep_from, state["index"]["seq"])
        for b in state["batches"]:
            if b["from"] > keep_from:
                kept.append(b)
                continue
            gone.append(b["path"])
            if b["to"] > keep_from:
                name = f"oplog/{keep_from + 1:020d}-{uuid.uuid4().hex}"
                rows = self.spark.read.schema(OPERATION).parquet(self.store.path(b["path"]))
                rows.where(F.col("seq") > keep_from).write.parquet(self.store.path(name))
                kept.append({"path": name, "from": keep_from + 1, "to": b["to"], "bytes": self.store.size(name)})
        return {**state, "batches": kept, "kept_from": max(state["kept_from"], keep_from)}, gone

    def recover(self) -> int:
        """Keep the longest prefix of the log that can be read, has no gap and whose
        epochs don't fall behind the log's; returns how many operations were cut."""
        state = self._state
        good, expected, epoch = [], state["kept_from"] + 1, state["epoch"]
        for b in state["batches"]:
            try:
                rows = self.spark.read.schema(OPERATION).parquet(self.store.path(b["path"]))
                told = rows.agg(F.count("seq").alias("n"), F.countDistinct("seq").alias("d"), F.min("seq").alias("a"), F.max("seq").alias("z"), F.min("epoch").alias("e")).first()
            except UNREADABLE:
                break
            if b["from"] != expected or (told["n"], told["d"], told["a"], told["z"]) != (b["to"] - b["from"] + 1,) * 2 + (b["from"], b["to"]) or told["e"] < epoch:
                break
            good.append({**b, "bytes": self.store.size(b["path"])})
            expected = b["to"] + 1
        kept_from, last = state["kept_from"], expected - 1
        snap = self._whole()
        if snap is not None and snap[1] > last:  # it stands for the operations before it
            good, kept_from, last = [], snap[1], snap[1]
        cut = state["last"] - last

        def cut_back(now: dict) -> dict:
            if now["batches"] != state["batches"]:
                raise Moved
            index = now.get("index")
            return {**now, "batches": good, "kept_from": kept_from, "last": last, "index": None if index and index["seq"] > last else index}

        try:
            self._commit(cut_back)
        except Moved:
            return self.refresh().recover()
        return cut

    def log_bytes(self) -> int:
        return sum(self.store.size(b["path"]) for b in self._state["batches"])

    def records(self) -> DataFrame:
        """The state now: the last snapshot that is whole, and the operations after it."""
        snap = self.snapshot()
        if snap is None:
            return fold(self.read())
        base, seq = snap
        return base if seq == self.last_seq else fold_onto(base, self.read(seq + 1))

    def snapshot(self) -> tuple[DataFrame, int] | None:
        """The last snapshot that is whole, and its sequence number."""
        found = self._whole()
        if found is None and self.kept_from:
            raise CorruptionError("no snapshot is whole, and the log before it is gone")
        return found

    def _whole(self) -> tuple[DataFrame, int] | None:
        for snap in reversed(self._state["snapshots"]):
            try:
                return self._snapshot(snap), snap["seq"]
            except CorruptionError:
                continue
        return None

    def _snapshot(self, snap: dict) -> DataFrame:
        try:
            rows = self.spark.read.schema(RECORD).parquet(self.store.path(snap["path"])).select(*COLUMNS)
            n = rows.count()
        except UNREADABLE as error:
            raise CorruptionError(f"{snap['path']} can't be read") from error
        if n != snap["count"]:
            raise CorruptionError(f"{snap['path']} has {n} records, not {snap['count']}")
        return rows

    def checkpoint(self) -> int:
        """Write the state as a snapshot and prune the log. The snapshot before stays
        with the operations since, until another one has been verified."""
        seq = self.refresh().last_seq
        if seq == self.snapshot_seq:
            return seq
        name = f"snapshot/{seq:020d}-{uuid.uuid4().hex}"
        self.records().write.parquet(self.store.path(name))
        snap = {"path": name, "seq": seq, "count": self.spark.read.parquet(self.store.path(name)).count()}
        self._snapshot(snap)

        def added(state: dict) -> tuple[dict, list[str]]:
            before = state["snapshots"]
            if before and before[-1]["seq"] >= seq:  # another handle was faster
                return state, []
            new = {**state, "snapshots": [*before[-1:], snap]}
            new, gone = self._cut(new, before[-1]["seq"]) if before else (new, [])
            return new, [*gone, *(old["path"] for old in before[:-1])]

        self._replace(added)
        if snap not in self._state["snapshots"]:
            self.store.delete(name)
        return seq

    def replace(self, records: DataFrame, seq: int) -> None:
        """Restore: the state is ``records``, as of ``seq``."""
        name = f"snapshot/{seq:020d}-{uuid.uuid4().hex}"
        records.select(*COLUMNS).write.parquet(self.store.path(name))
        count = self.spark.read.parquet(self.store.path(name)).count()

        def restored(state: dict) -> tuple[dict, list[str]]:
            old = [x["path"] for x in (*state["batches"], *state["snapshots"])]
            return {**state, "last": seq, "kept_from": seq, "batches": [], "snapshots": [{"path": name, "seq": seq, "count": count}], "index": None}, old

        self._replace(restored)
