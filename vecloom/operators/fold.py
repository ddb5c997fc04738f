"""The state of a collection as a fold over its operation log.

An add or upsert sets everything, an update sets metadata and document and keeps the
embedding, a delete forgets all before it. The last operation of an id wins. An update
of an id that isn't there leaves a record without an embedding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("id", "embedding", "metadata", "document", "seq")


def fold(log: DataFrame) -> DataFrame:
    """Records from operations (id, embedding, metadata, document, seq, op).

    First which operations count, from ids and numbers alone: hashed partial maxima.
    Then what these operations hold, joined by (id, seq); what was overwritten is never
    sorted or kept, and embeddings and documents are read by the join that needs them.
    """
    seq = F.col("seq")
    of = lambda *ops: F.max(F.when(F.col("op").isin(*ops), seq))
    last = log.groupBy("id").agg(of("delete").alias("gone"), F.max(F.when(F.col("op") != "delete", seq)).alias("seq"), of("add", "upsert").alias("at"))
    live = last.where("seq > coalesce(gone, -1)").select("id", "seq", F.when(F.col("at") > F.coalesce("gone", F.lit(-1)), F.col("at")).alias("at"))
    told = log.where("op <> 'delete'").select("id", "seq", "metadata", "document")
    vectors = log.where("op in ('add', 'upsert')").select("id", seq.alias("at"), "embedding")
    return live.join(told, ["id", "seq"]).join(vectors, ["id", "at"], "left").select(*COLUMNS)


def fold_onto(snapshot: DataFrame, tail: DataFrame) -> DataFrame:
    """The same state from a snapshot and the operations after it."""
    columns = [*COLUMNS, "op"]
    return fold(snapshot.withColumn("op", F.lit("upsert")).select(columns).unionByName(tail.select(columns)))


def supersede(indexed: DataFrame, buffered: DataFrame, key: str = "id") -> DataFrame:
    """Rows of both; where both have an id, the buffered one."""
    return indexed.join(buffered.select(key), key, "left_anti").unionByName(buffered)
