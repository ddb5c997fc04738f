"""How a search is carried out, decided from counts before the plan is built."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from vecloom.functions.filters import MapKeys, compile_filter
from vecloom.operators.ivf import IvfIndex
from vecloom.operators.knn import nearest_blocks, ranked
from vecloom.types import IndexOptions, Space

EXACT, FILTERED, HYBRID, POST_FILTER = "exact", "filtered", "hybrid", "post_filter"
#: Candidates of a query that are looked for before the filter is applied, at most. More
#: would cost more than the filter does: it is then applied inside the search.
CANDIDATES = 1_000


@dataclass(frozen=True)
class SearchOptions:
    where: object = None
    ef: int = 0
    oversampling: int = 4
    digits: int | None = None


def choose(n: int, eligible: int | None, options: IndexOptions, indexed: bool) -> str:
    """The index is only worth its inexactness beyond ``max_scan`` candidates."""
    if eligible is None:
        return HYBRID if indexed and n > options.max_scan else EXACT
    return POST_FILTER if indexed and eligible > options.max_scan else FILTERED


def search(records: DataFrame, queries: DataFrame, k: int, space: Space, options: IndexOptions, how: SearchOptions = SearchOptions(), index: IvfIndex | None = None, buffered: DataFrame | None = None, keys=None) -> DataFrame:
    """(query_id, rank, id, distance). ``records`` are all live records; ``index`` may
    lag behind them by ``buffered``, the ids written since it was built."""
    vectors = records.where("embedding is not null")
    k = max(k, 1)
    if how.where is not None:
        # without an index every path is the filtered scan, so nothing needs counting
        vectors = vectors.where(compile_filter(how.where, keys or MapKeys(), two_valued=False))
    path = EXACT
    if index is not None:
        eligible = None if how.where is None else vectors.count()
        path = choose(index.count, eligible, options, True)
    if path in (EXACT, FILTERED):
        return nearest_blocks(vectors, queries, k, space, digits=how.digits)
    nprobe = index.probes(how.ef) if how.ef else max(index.probes(options.ef_search), index.nprobe)
    if path == POST_FILTER and k * how.oversampling > CANDIDATES:
        # the same cells: what is near enough to be among the candidates is found here as well
        found = index.search(queries, k, nprobe, how.digits, buffered, vectors)
    elif path == POST_FILTER:
        found = index.search(queries, k * how.oversampling, nprobe, how.digits, buffered).join(vectors.select("id"), "id", "left_semi")
    else:  # what the index has without ``buffered`` is live
        found = index.search(queries, k, nprobe, how.digits, buffered)
    found = found.select("query_id", "id", "distance")
    if buffered is not None:
        # what the index doesn't know yet is scanned
        tail = vectors.join(buffered.select("id"), "id", "left_semi")
        found = found.unionByName(nearest_blocks(tail, queries, k, space, digits=how.digits).select("query_id", "id", "distance"))
    return ranked(found, k)
