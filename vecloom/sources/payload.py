"""JSON payload files: parallel lists of ids, embeddings, metadatas and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.types import METADATA

#: Metadata is read as JSON text first, so that each value keeps its own type.
_FILE = "ids array<string>, embeddings array<array<float>>, metadatas array<string>, documents array<string>"


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    """(id, embedding, metadata, document) from files of parallel lists."""
    rows = spark.read.schema(_FILE).json(path, multiLine=True)
    wide = rows.select(F.explode(F.arrays_zip("ids", "embeddings", "metadatas", "documents")).alias("r"))
    return wide.select(F.col("r.ids").alias("id"), F.col("r.embeddings").alias("embedding"), metadata_from_json(F.col("r.metadatas")).alias("metadata"), F.col("r.documents").alias("document"))


def metadata_from_json(text):
    """A flat JSON object as a metadata map. The JSON kind of each value decides its
    type: quoted, true or false, whole number, other number."""
    plain = F.from_json(text, "map<string,variant>")

    def typed(_, v):
        kind = F.schema_of_variant(v)
        whole = kind == "BIGINT"
        return F.struct(
            F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).alias("s"),
            F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).alias("b"),
            F.when(whole, F.try_variant_get(v, "$", "bigint")).alias("i"),
            F.when((kind == "DOUBLE") | kind.startswith("DECIMAL"), F.try_variant_get(v, "$", "double")).alias("f"),
        )

    return F.transform_values(plain, typed).cast(METADATA)
