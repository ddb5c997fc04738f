"""Requests and responses as plain dictionaries, in columns: what a web server in
front of an engine would hand on. Every handler takes a body and returns a body;
errors are raised and ``handle`` turns them into a status.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame

from vecloom.plans.engine import Collection, Engine
from vecloom.types import MAX_IDS, AlreadyExistsError, NotFoundError, Space, ValidationError, VecloomError, untagged_map

VERSION = "1.0.0"
INCLUDE = ("embeddings", "documents", "metadatas", "distances")


def _include(body: dict) -> tuple[str, ...]:
    wanted = tuple(body.get("include") or ())
    if unknown := set(wanted) - set(INCLUDE):
        raise ValidationError(f"include knows {', '.join(INCLUDE)}, not {sorted(unknown)}")
    return wanted


def _where(body: dict):
    """Either spelling of the filter."""
    return body.get("where", body.get("where_filter"))


def described(config) -> dict:
    return {"id": config.id, "name": config.name, "tenant": config.tenant, "database": config.database, "dimension": config.dimension or None, "space": config.space.value, "metadata": config.metadata}


class Requests:
    def __init__(self, engine: Engine, tenant: str = "default_tenant", database: str = "default_database"):
        self.engine, self.tenant, self.database = engine, tenant, database

    def _at(self, name_or_id: str) -> Collection:
        return self.engine.collection(name_or_id, self.tenant, self.database)

    # collections

    def create(self, body: dict) -> dict:
        options = {"tenant": self.tenant, "database": self.database, "metadata": body.get("metadata"), "get": bool(body.get("get_or_create"))}
        made = self.engine.create_collection(body.get("name", ""), int(body.get("dimension") or 0), Space.parse(body.get("space", "l2")), **options)
        return described(made.config)

    def list(self, body: dict | None = None) -> list[dict]:
        body = body or {}
        found = [described(c) for c in self.engine.list_collections(self.tenant, self.database)]
        start = int(body.get("offset") or 0)
        return found[start : None if body.get("limit") is None else start + int(body["limit"])]

    def describe(self, name_or_id: str) -> dict:
        return described(self._at(name_or_id).config)

    def drop(self, name_or_id: str) -> dict:
        self.engine.delete_collection(name_or_id, self.tenant, self.database)
        return {}

    # records

    def add(self, name_or_id: str, body: dict) -> dict:
        return {"seq": self._at(name_or_id).add(body.get("ids") or [], body.get("embeddings") or [], body.get("metadatas"), body.get("documents"))}

    def upsert(self, name_or_id: str, body: dict) -> dict:
        return {"seq": self._at(name_or_id).upsert(body.get("ids") or [], body.get("embeddings") or [], body.get("metadatas"), body.get("documents"))}

    def update(self, name_or_id: str, body: dict) -> dict:
        """Embeddings may be sent along; an update keeps those that are there."""
        return {"seq": self._at(name_or_id).update(body.get("ids") or [], body.get("metadatas"), body.get("documents"))}

    def delete(self, name_or_id: str, body: dict) -> dict:
        return {"seq": self._at(name_or_id).delete(body.get("ids") or [])}

    def count(self, name_or_id: str) -> int:
        return self._at(name_or_id).count()

    def get(self, name_or_id: str, body: dict) -> dict:
        """Live records in columns that belong together row by row."""
        ids, include = body.get("ids"), _include(body)
        if ids is not None and len(ids) > MAX_IDS:
            raise ValidationError(f"at most {MAX_IDS} ids at once")
        limit = MAX_IDS + 1 if body.get("limit") is None else int(body["limit"])
        found = self._at(name_or_id).get(ids, _where(body), limit, include).collect()
        if ids is None and len(found) > MAX_IDS:
            raise ValidationError(f"more than {MAX_IDS} records: ask for a part of them by a limit or a filter")
        rows = [r for r in found if ids is None or r["found"]]
        out = {"ids": [r["id"] for r in rows], "metadatas": [untagged_map(r["metadata"]) for r in rows], "documents": [r["document"] for r in rows]}
        return out | ({"embeddings": [r["embedding"] for r in rows]} if "embeddings" in include else {})

    def query(self, name_or_id: str, body: dict) -> dict:
        """Nested lists, one for each query; without ``include`` only ids."""
        vectors, include = body.get("query_embeddings") or [], _include(body)
        at = self._at(name_or_id)
        found = at.query(vectors, int(body.get("n_results", 10)), _where(body), include, int(body.get("ef") or 0))
        return nested(found, len(vectors), include, bool(body.get("pad")))


def nested(found: DataFrame, n: int, include: tuple[str, ...], pad: bool = False) -> dict:
    """``pad``: fill every list to the length of the longest, with "" and infinity."""
    lists: list[list] = [[] for _ in range(n)]
    for row in found.orderBy("query_id", "rank").collect():
        lists[row["query_id"]].append(row)
    wide = max(map(len, lists), default=0) if pad else 0
    fill = lambda values, empty: values + [empty] * (wide - len(values))
    out = {"ids": [fill([r["id"] for r in rows], "") for rows in lists]}
    if "distances" in include:
        out["distances"] = [fill([r["distance"] for r in rows], float("inf")) for rows in lists]
    if "metadatas" in include:
        out["metadatas"] = [fill([untagged_map(r["metadata"]) for r in rows], None) for rows in lists]
    if "documents" in include:
        out["documents"] = [fill([r["document"] for r in rows], None) for rows in lists]
    return out


def heartbeat() -> dict:
    return {"nanosecond heartbeat": time.time_ns()}


def preflight() -> dict:
    return {"max_batch_size": MAX_IDS}


def handle(call, *args) -> tuple[int, object]:
    """Status and body of a call; the body of a failure says what is wrong."""
    try:
        return 200, call(*args)
    except NotFoundError as error:
        return 404, {"error": str(error)}
    except AlreadyExistsError as error:
        return 409, {"error": str(error)}
    except (ValidationError, TypeError, ValueError) as error:
        return 400, {"error": str(error)}
    except VecloomError as error:
        return 500, {"error": str(error)}
