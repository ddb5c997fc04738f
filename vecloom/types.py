"""Schemas, settings, limits and errors."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import types as T


class VecloomError(Exception):
    """Base of all errors that callers are meant to catch."""


class ValidationError(VecloomError):
    """A request that can't be carried out as it is; nothing has been changed."""


class NotFoundError(VecloomError):
    """No such collection, tenant or database."""


class AlreadyExistsError(VecloomError):
    """The name is taken."""


class CorruptionError(VecloomError):
    """Stored data that doesn't agree with its manifest."""


class PrunedError(VecloomError):
    """Operations that the log no longer has."""


class FencedError(VecloomError):
    """Operations of a writer whose epoch is over."""


class Space(str, Enum):
    L2 = "l2"
    COSINE = "cosine"
    IP = "ip"

    @classmethod
    def parse(cls, name: str | Space) -> Space:
        try:
            return cls(name.value if isinstance(name, Space) else name.strip().lower())
        except ValueError:
            raise ValidationError(f"unknown distance space {name!r}; known: l2, cosine, ip") from None


#: A metadata value: exactly one field is not null.
VALUE = T.StructType([T.StructField("s", T.StringType()), T.StructField("b", T.BooleanType()), T.StructField("i", T.LongType()), T.StructField("f", T.DoubleType())])
METADATA = T.MapType(T.StringType(), VALUE)
EMBEDDING = T.ArrayType(T.FloatType())

RECORD = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("embedding", EMBEDDING),
        T.StructField("metadata", METADATA),
        T.StructField("document", T.StringType()),
        T.StructField("seq", T.LongType()),
    ]
)
OPERATION = T.StructType([*RECORD.fields, T.StructField("op", T.StringType()), T.StructField("epoch", T.LongType())])

OPS = ("add", "update", "upsert", "delete")

#: Limits of one request.
MAX_IDS, MAX_ID_BYTES, MAX_NAME, MAX_DIMENSION = 10_000, 512, 512, 65_536
MAX_QUERIES, MAX_RESULTS = 100, 1_000


@dataclass(frozen=True)
class IndexOptions:
    """The defaults. ``m`` and ``ef_construction`` describe a graph
    index; an inverted file has no use for them, so they are only kept."""

    m: int = 16
    ef_construction: int = 200
    ef_search: int = 100
    batch_size: int = 100
    sync_threshold: int = 1_000
    max_scan: int = 10_000


@dataclass(frozen=True)
class CollectionConfig:
    name: str
    dimension: int = 0
    space: Space = Space.L2
    tenant: str = "default_tenant"
    database: str = "default_database"
    metadata: dict | None = None
    options: IndexOptions = field(default_factory=IndexOptions)
    id: str = field(default_factory=lambda: str(uuid.uuid4()))
    created_at_ms: int = 0

    def with_dimension(self, dimension: int) -> CollectionConfig:
        return replace(self, dimension=dimension)


def tagged(value) -> dict | None:
    """A Python or JSON scalar as a metadata value. Whole numbers that fit 64 bits are
    integers; larger ones are floats."""
    if isinstance(value, bool):
        return {"s": None, "b": value, "i": None, "f": None}
    if isinstance(value, int):
        if -(1 << 63) <= value < 1 << 63:
            return {"s": None, "b": None, "i": value, "f": None}
        return {"s": None, "b": None, "i": None, "f": float(value)}
    if isinstance(value, float):
        return {"s": None, "b": None, "i": None, "f": value}
    if isinstance(value, str):
        return {"s": value, "b": None, "i": None, "f": None}
    raise ValidationError(f"metadata values are strings, booleans or numbers, not {type(value).__name__}")


def tagged_map(metadata: dict | None) -> dict | None:
    return None if metadata is None else {k: tagged(v) for k, v in metadata.items()}


def untagged(value) -> object:
    if value is None:
        return None
    fields = value.asDict() if hasattr(value, "asDict") else value
    return next((v for v in fields.values() if v is not None), None)


def untagged_map(metadata) -> dict | None:
    return None if metadata is None else {k: untagged(v) for k, v in metadata.items()}
