"""Mixing sources to target weights as a min-cost flow.

Documents may belong to several sources at once. They are aggregated by membership
pattern (the set of their sources), so the flow network has one node for each pattern
and one for each source, however many documents there are. A pattern's tokens can
flow to each of its sources once for free, a second time at a higher price (a convex
cost of repetition), and not more often than ``repeats`` times in all; the sources'
quotas are the sinks. The cheapest flow says how many tokens of each pattern the mix
takes. Documents then are selected in a seeded order: each is taken as often as the
whole passes over its pattern say, and those first in the order once more, until the
pattern's tokens are reached as closely as whole documents allow.

Running sums over one pattern are formed in hashed parts of the order, and only the
part in which the tokens run out is ordered row by row, so a source that holds a third
of all rows is not ordered by one task. What comes of it is a place in the order for
each pattern; rows are compared with it where they lie.

Defined results: a null text has no words, and no words are taken of it; a null
source is a source of its own, after all others; repeated rows are selected each by
itself, as many of them as reach the target, no matter which; with nothing to mix
every target is zero; an empty table gives an empty result; other columns are ignored by ``mix``.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.llm.common import SPACES, cut, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
SEED = 17
#: Parts of the seeded order of each pattern, by the leading bits of its hash.
PARTS = 4096


def n_words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))).cast("long")


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> dict[str | None, float]:
    """What each source should give: ``share`` of all tokens by weight; what exceeds
    ``repeats`` times a source is shared again among the others until nothing does."""
    ordered = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8", "surrogatepass")) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(ordered)}
    out = {s: 0.0 for s in ordered}
    total, free = share * sum(sizes.values()), list(ordered)
    while free:
        each = total / sum(weight[s] for s in free)
        full = [s for s in free if each * weight[s] > repeats * sizes[s]]
        if not full:
            out.update({s: each * weight[s] for s in free})
            break
        for s in full:
            out[s] = float(repeats * sizes[s])
            total -= out[s]
        gone = set(full)
        free = [s for s in free if s not in gone]
    return out


def flow(capacity: dict[tuple, int], quota: dict, repeats: int = REPEATS) -> dict[tuple, float]:
    """Tokens that each pattern (a tuple of sources) gives each of its sources, as
    {(pattern, source): tokens}: the cheapest flow that meets the quotas as far as the
    patterns allow. The k-th pass over a pattern costs k - 1 a token.

    Successive cheapest paths: with costs that only depend on the pass, the cheapest
    augmenting path is one over residual arcs whose last pattern has the lowest pass
    with room; a pass is filled before the next is opened.
    """
    given: dict[tuple, float] = defaultdict(float)
    missing = {s: float(q) for s, q in quota.items()}
    patterns = sorted(capacity, key=repr)
    of = defaultdict(list)
    for p in patterns:
        for s in p:
            of[s].append(p)
    for used in range(1, repeats + 1):
        room = {p: used * capacity[p] - sum(given[p, s] for s in p) for p in patterns}
        for start in sorted(quota, key=repr):
            while missing[start] > 1e-6:
                # breadth first from the source over patterns with room; residual arcs lead from a full pattern to a source it feeds
                back: dict = {start: None}
                queue, end = [start], None
                while queue and end is None:
                    s = queue.pop(0)
                    for p in of[s]:
                        if ("p", p) in back:
                            continue
                        back["p", p] = s
                        if room[p] > 1e-6:
                            end = p
                            break
                        for t in p:
                            if t not in back and given[p, t] > 1e-6:
                                back[t] = p
                                queue.append(t)
                if end is None:
                    break
                path, p = [], end
                while True:
                    s = back["p", p]
                    path.append((p, s))
                    if back[s] is None:
                        break
                    p = back[s]
                # from the end backwards: pattern gives source s, which frees what a pattern before gave it
                amount = min([missing[start], room[end], *(given[q, s] for (q, _), (_, s) in zip(path[1:], path))])
                for i, (p, s) in enumerate(path):
                    given[p, s] += amount
                    if i + 1 < len(path):
                        given[path[i + 1][0], s] -= amount
                room[end] -= amount
                missing[start] -= amount
    return dict(given)


def _placed(docs: DataFrame, sources: str, seed: int) -> DataFrame:
    """``docs`` with its size, its pattern and its place in the seeded order."""
    many = dict(docs.dtypes)[sources].startswith("array")
    pattern = F.array_sort(F.array_distinct(F.col(sources))) if many else F.array(F.col(sources).cast("string"))
    pattern = F.coalesce(pattern, F.array(F.lit(None).cast("string")))
    h = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))
    part = F.pmod(F.shiftrightunsigned(h, 40), F.lit(PARTS)).cast("int")
    size = n_words(F.col("text"))
    # arrays with a null in them never equal each other in a join, so the key is text
    columns = {"__mix_size": size, "__mix_pattern": pattern, "__mix_key": F.to_json(F.struct(pattern.alias("pattern"))), "__mix_at": F.struct(part.alias("part"), h.alias("h"), size.alias("size"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("of"))}
    return docs.withColumns(columns)


def planned(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """One row for each pattern: key, source_size and target (of its first source),
    full (how often all its documents are taken), last (the place in the order up to
    which they are taken once more) and ties, how many rows at that place are, where
    not all of them are. ``rows`` has the columns of ``_placed``."""
    rows = rows.select(F.col("__mix_key").alias("key"), F.col("__mix_pattern").alias("pattern"), F.col("__mix_at").alias("at"))
    counted = cut(rows.groupBy("key", F.col("at.part").alias("part")).agg(F.sum("at.size").alias("sum"), F.first("pattern").alias("pattern")))
    known = counted.groupBy("key").agg(F.sum("sum").alias("sum"), F.first("pattern").alias("pattern")).collect()  # one row a pattern
    capacity = {tuple(r["pattern"]): r["sum"] for r in known}
    sizes: dict = defaultdict(int)
    for p, n in capacity.items():
        for s in p:
            sizes[s] += n
    quota = targets(dict(sizes), weights, share, repeats)
    given: dict = defaultdict(float)
    for (p, _), n in flow(capacity, quota, repeats).items():
        given[p] += n
    told = []
    for r in known:
        p, n = tuple(r["pattern"]), r["sum"]
        full = min(int(given[p] // n), repeats) if n else 0
        told.append((r["key"], sizes[p[0]], quota[p[0]], full, given[p] - full * n if full < repeats else 0.0))
    plan = rows.sparkSession.createDataFrame(told, "key string, source_size long, target double, full int, rest double")
    # running sums: of the parts before, then within the part that holds the end
    upto = F.sum("sum").over(W.partitionBy("key").orderBy("part"))
    parts = counted.select("key", "part", "sum", upto.alias("upto")).join(F.broadcast(plan), "key").where("upto - sum < rest")
    whole = parts.where("upto <= rest").groupBy("key").agg(F.max("part").alias("whole"))
    edge = parts.where("upto > rest").select("key", "part", (F.col("upto") - F.col("sum")).alias("before"), "rest")
    # rows that repeat each other are one place in the order, with a count
    inside = rows.select("key", "at", F.col("at.part").alias("part")).join(F.broadcast(edge), ["key", "part"])
    places = inside.groupBy("key", "at").agg(F.count(F.lit(1)).alias("n"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    within = W.partitionBy("key").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    size = F.col("at.size")
    begin = F.col("before") + F.sum(F.col("n") * size).over(within) - F.col("n") * size
    # a document is taken if that brings the sum nearer to what is still wanted
    some = F.when(size > 0, F.least(F.col("n"), F.ceil((F.col("rest") - begin) / size - F.lit(0.5)))).when(begin < F.col("rest"), F.col("n"))
    taken = places.withColumn("some", some).where("some > 0").groupBy("key").agg(F.max_by(F.struct("at", "n", "some"), "at").alias("end"))
    last = taken.select("key", F.col("end.at").alias("last"), F.when(F.col("end.some") < F.col("end.n"), F.col("end.some")).alias("ties"))
    return plan.join(whole, "key", "left").join(last, "key", "left").select("key", "source_size", "target", "full", "whole", "last", "ties")


def _decided(placed: DataFrame, plan: DataFrame) -> DataFrame:
    """``placed`` with the plan of its pattern and ``__mix_copies``."""
    plan = cut(plan).withColumnsRenamed({c: f"__mix_p_{c}" for c in plan.columns})
    split = not plan.where("__mix_p_ties is not null").isEmpty()
    told = placed.join(F.broadcast(plan), F.col("__mix_key") == F.col("__mix_p_key"))
    more = F.coalesce(F.col("__mix_at.part") <= F.col("__mix_p_whole"), F.lit(False)) | F.coalesce(F.col("__mix_at") <= F.col("__mix_p_last"), F.lit(False))
    copies = lambda more: F.when(F.col("__mix_size") > 0, F.col("__mix_p_full") + more.cast("int")).otherwise(0)
    if not split:
        return told.withColumn("__mix_copies", copies(more))
    tied = F.coalesce((F.col("__mix_at") == F.col("__mix_p_last")) & F.col("__mix_p_ties").isNotNull(), F.lit(False))
    numbered = _numbered(told.where(tied), "__mix_key").withColumn("__mix_copies", copies(F.col("__mix_no") <= F.col("__mix_p_ties"))).drop("__mix_no")
    return told.where(~tied).withColumn("__mix_copies", copies(more)).unionByName(numbered)


def _numbered(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with __mix_no, their number among those of their key from 1. They are
    written, and numbered by the parts that they are read in, so no task has all of them."""
    rows = cut(rows).withColumns({"__mix_of": F.spark_partition_id(), "__mix_no": F.monotonically_increasing_id()})
    counted = rows.groupBy(key, "__mix_of").agg(F.count(F.lit(1)).alias("__mix_n"))
    before = counted.select(key, "__mix_of", (F.sum("__mix_n").over(W.partitionBy(key).orderBy("__mix_of")) - F.col("__mix_n")).alias("__mix_before"))
    own = rows.withColumn("__mix_no", F.row_number().over(W.partitionBy(key, "__mix_of").orderBy("__mix_no")).cast("long"))
    return own.join(before, [key, "__mix_of"]).withColumn("__mix_no", F.col("__mix_no") + F.col("__mix_before")).drop("__mix_of", "__mix_before")


def mix(docs: DataFrame, sources: str = "source", weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, pattern, source_size, target, copies) for every row of ``docs``.

    ``sources`` is a column of strings, or of arrays of strings where documents belong
    to several sources; ``pattern`` is the sorted array. source_size and target are
    those of the pattern's first source. ``copies``: how often the mix takes the row.
    """
    rows = cut(_placed(docs.select("doc_id", "text", sources), sources, seed).drop("text", sources))
    told = _decided(rows, planned(rows, weights, share, repeats))
    return told.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__mix_size").alias("size"), F.col("__mix_pattern").alias("pattern"), F.col("__mix_p_source_size").alias("source_size"), F.col("__mix_p_target").alias("target"), F.col("__mix_copies").alias("copies"))


def mixed(docs: DataFrame, sources: str = "source", weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them. Each row is decided where it
    lies, from a table with one row for each pattern, so no text is shuffled."""
    columns = docs.columns
    narrow = cut(_placed(docs.select("doc_id", "text", sources), sources, seed).drop("doc_id", "text", sources))
    told = _decided(_placed(docs, sources, seed), planned(narrow, weights, share, repeats)).where("__mix_copies > 0")
    return told.select(*columns, F.explode(F.sequence(F.lit(1), F.col("__mix_copies"))).alias("__mix_copy")).select(columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
