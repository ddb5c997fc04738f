"""A follower: the versions of a log's manifest as a stream, folded into a copy of the state."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vecloom.operators.clock import unfenced
from vecloom.operators.fold import fold_onto
from vecloom.sources.files import UNREADABLE, Store, Versioned
from vecloom.sources.oplog import MANIFEST, OpLog
from vecloom.types import RECORD, CorruptionError, FencedError, PrunedError


class Follower:
    """Keeps a copy of the state of the log below ``log_root`` under ``target``.

    The stream carries the small manifest versions alone, as signals; operations are
    then read by their numbers, each exactly once and in order, so neither a file that
    is listed again nor one that was rewritten does harm, and a delete needs no trace.
    Where the log no longer has what the follower lacks, it starts from the snapshot.

    The state lies in buckets by the hash of the id. A batch rewrites the buckets that
    it touches; a pointer that is replaced as a whole names all of them and the number
    of the last operation, so a batch that runs again after a failure changes nothing.
    """

    def __init__(self, spark: SparkSession, log_root: str, target: str, epoch: int = 0, buckets: int = 64, attempts: int = 5):
        self.spark, self.log_root, self.epoch = spark, log_root.rstrip("/"), epoch
        self.store, self.attempts = Store(spark, target), attempts
        self._current = Versioned(self.store, "current", {"applied": 0, "n": buckets, "paths": {}, "before": {}})

    def _pointer(self) -> dict:
        return self._current.read()[1]

    @property
    def applied(self) -> int:
        return self._pointer()["applied"]

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], RECORD)
        return self.spark.read.schema(RECORD).parquet(*[self.store.path(p) for p in paths])

    def state(self) -> DataFrame:
        return self._read(sorted(self._pointer()["paths"].values()))

    def catch_up(self) -> int:
        """Apply what the log has and this copy lacks; the last operation applied."""
        log, now = OpLog(self.spark, self.log_root, heal=False), self._pointer()
        if log.last_seq <= now["applied"]:
            return now["applied"]
        try:
            log.read(now["applied"] + 1)
            base = None
        except PrunedError:
            base = log.snapshot()
        since = now["applied"] if base is None else base[1]
        tail = log.read(since + 1)
        # operations of an older writer, and all after them, are not taken
        kept = unfenced(tail, self.epoch)
        last = kept.agg(F.max("seq")).first()[0] or since
        if last < log.last_seq and last == now["applied"]:
            raise FencedError(f"operation {last + 1} comes from an epoch before {self.epoch}")
        bucket = F.pmod(F.xxhash64("id"), F.lit(now["n"])).cast("int")
        if base is None:
            touched = sorted(r[0] for r in kept.select(bucket.alias("b")).distinct().collect())  # at most ``buckets``
            old = self._read([now["paths"][str(b)] for b in touched if str(b) in now["paths"]])
        else:
            touched, old = list(range(now["n"])), base[0]
        name = f"state/{last:020d}-{time.time_ns()}"
        fold_onto(old, kept).withColumn("bucket", bucket).write.partitionBy("bucket").parquet(self.store.path(name))
        made = {n.removeprefix("bucket="): f"{name}/{n}" for n in self.store.list(name) if n.startswith("bucket=")}
        paths = {b: p for b, p in now["paths"].items() if int(b) not in set(touched)} | made
        new = {"applied": last, "n": now["n"], "paths": paths, "before": now["paths"]}
        if self._current.change(lambda state: new if state == now else state)[1] != new:
            return self.applied  # another run of this batch was faster
        # what the version before the last one still needed
        for gone in set(now["before"].values()) - set(paths.values()) - set(now["paths"].values()):
            self.store.delete(gone)
        return last

    def _apply(self, batch: DataFrame, batch_id: int) -> None:
        """Try again for a while: files may go between reading a manifest and them."""
        for attempt in range(self.attempts):
            try:
                self.catch_up()
                return
            except FencedError:
                raise
            except (*UNREADABLE, CorruptionError, PrunedError):
                if attempt + 1 == self.attempts:
                    raise
                time.sleep(0.1 * 2**attempt)

    def start(self, checkpoint: str, available_now: bool = False, every: str = "1 second") -> StreamingQuery:
        stream = self.spark.readStream.schema("value string").option("pathGlobFilter", "*.json").option("ignoreMissingFiles", "true").option("wholetext", "true").text(f"{self.log_root}/{MANIFEST}")
        writer = stream.writeStream.foreachBatch(self._apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()
