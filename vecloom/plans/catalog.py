"""Tenants, databases and collections, as one small JSON document of numbered versions."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession

from vecloom.sources.files import Store, Versioned
from vecloom.types import MAX_DIMENSION, MAX_NAME, AlreadyExistsError, CollectionConfig, IndexOptions, NotFoundError, Space, ValidationError


class Catalog:
    """Every call sees what all handles have written; of two that change the catalog
    at once one is checked again against what the other wrote."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self._file = Versioned(Store(spark, root), "catalog", {"tenants": ["default_tenant"], "databases": [["default_tenant", "default_database"]], "collections": []})

    @property
    def _rows(self) -> dict:
        return self._file.read()[1]

    def _change(self, how: Callable[[dict], None]) -> None:
        def changed(rows: dict) -> dict:
            new = {k: [dict(x) if isinstance(x, dict) else x for x in v] for k, v in rows.items()}
            how(new)
            return rows if new == rows else new

        self._file.change(changed)

    def _change_one(self, id: str, how: Callable[[dict], None]) -> dict:
        """``how`` changes the row of one collection, which is returned."""
        out: dict = {}

        def changed(rows: dict) -> None:
            row = self._row(rows, id, "", "")
            how(row)
            out.clear()
            out.update(row)

        self._change(changed)
        return out

    def create_tenant(self, name: str) -> None:
        def added(rows: dict) -> None:
            if name in rows["tenants"]:
                raise AlreadyExistsError(f"tenant {name}")
            rows["tenants"].append(name)

        self._change(added)

    def create_database(self, tenant: str, name: str) -> None:
        def added(rows: dict) -> None:
            if tenant not in rows["tenants"]:
                raise NotFoundError(f"tenant {tenant}")
            if [tenant, name] in rows["databases"]:
                raise AlreadyExistsError(f"database {tenant}.{name}")
            rows["databases"].append([tenant, name])

        self._change(added)

    def create(self, config: CollectionConfig, get: bool = False) -> CollectionConfig:
        if not config.name or len(config.name) > MAX_NAME:
            raise ValidationError(f"a collection's name has 1 to {MAX_NAME} characters")
        if not 0 <= config.dimension <= MAX_DIMENSION:
            raise ValidationError(f"a dimension is at most {MAX_DIMENSION}")
        made = [replace(config, created_at_ms=config.created_at_ms or time.time_ns() // 1_000_000)]

        def added(rows: dict) -> None:
            for row in rows["collections"]:
                if (row["tenant"], row["database"], row["name"]) == (config.tenant, config.database, config.name):
                    if not get:
                        raise AlreadyExistsError(f"collection {config.tenant}.{config.database}.{config.name}")
                    made[0] = self._config(row)
                    return
            rows["collections"].append({**asdict(made[0]), "space": config.space.value, "max_seq": 0})

        self._change(added)
        return made[0]

    @staticmethod
    def _config(row: dict) -> CollectionConfig:
        own = {k: v for k, v in row.items() if k != "max_seq"}
        return CollectionConfig(**{**own, "space": Space.parse(row["space"]), "options": IndexOptions(**row["options"])})

    @staticmethod
    def _row(rows: dict, name_or_id: str, tenant: str, database: str) -> dict:
        rows = rows["collections"]
        found = next((r for r in rows if r["id"] == name_or_id), None) or next((r for r in rows if (r["tenant"], r["database"], r["name"]) == (tenant, database, name_or_id)), None)
        if found is None:
            raise NotFoundError(f"collection {name_or_id}")
        return found

    def get(self, name_or_id: str, tenant: str = "default_tenant", database: str = "default_database") -> CollectionConfig:
        """By id, or else by name within a database."""
        return self._config(self._row(self._rows, name_or_id, tenant, database))

    def list(self, tenant: str | None = None, database: str | None = None) -> list[CollectionConfig]:
        return [self._config(r) for r in self._rows["collections"] if tenant in (None, r["tenant"]) and database in (None, r["database"])]

    def delete(self, id: str) -> None:
        self._change(lambda rows: rows["collections"].remove(self._row(rows, id, "", "")))

    def update_metadata(self, id: str, metadata: dict | None) -> None:
        self._change_one(id, lambda row: row.update(metadata=metadata))

    def update_dimension(self, id: str, dimension: int) -> None:
        """What the first vectors say; later ones, also of other writers, must agree."""

        def told(row: dict) -> None:
            if row["dimension"] not in (0, dimension):
                raise ValidationError(f"{dimension} dimensions where {row['dimension']} are expected")
            row["dimension"] = dimension

        self._change_one(id, told)

    def advance(self, id: str, seq: int) -> int:
        """The collection's highest known sequence number, which never falls."""
        return self._change_one(id, lambda row: row.update(max_seq=max(row["max_seq"], seq)))["max_seq"]

    def frame(self) -> DataFrame:
        rows = [(r["tenant"], r["database"], r["name"], r["id"], r["dimension"], r["space"], r["max_seq"], r["created_at_ms"]) for r in self._rows["collections"]]
        return self.spark.createDataFrame(rows, "tenant string, database string, name string, id string, dimension int, space string, max_seq long, created_at_ms long")
