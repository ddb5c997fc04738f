"""SimHash near-duplicates: bit fingerprints linked within a Hamming radius.

Candidates come from agreeing bit blocks: when 64 bits are cut into ``b`` blocks and
two fingerprints differ in at most ``r`` bits, at least ``b - r`` blocks are equal.
Within each set of equal blocks a table of Hamming distances to many reference
fingerprints (pivots) discards pairs: by the triangle inequality two fingerprints
within ``r`` bits have distances to every pivot that differ by ``r`` at most, so a
larger maximum coordinate difference rules a pair out. Survivors are verified bit
by bit. Pivot distances alone can't bring candidates together without all pairs
(one pivot lets about half of random pairs pass), hence the blocks.

Fingerprints of texts whose five-word shingles are 0.8 alike differ in 10 bits on
average and in 4 to 14 and more now and then; blocks for such radii are so short that
their buckets grow with the square of the rows. ``near_texts`` therefore brings texts
together by bands of minima of the same hashes, discards by the same pivot table at a
wide radius and by the marks of the sets of shingles (see ``shingles``), and verifies on
the shingles. Where many texts share a band and aren't linked, the marks rule pairs out
inside the join, before they become rows. Two sets that are 0.8 alike share one of 24
bands of five minima with probability 0.9999; fingerprints of such sets differ by more
than 26 bits with a probability of about one in 100,000 for sets of five shingles and
less for larger ones.

Defined results: a null text counts as empty; a text without words has fingerprint 0
and links like any other; repeated rows share a fingerprint and a component; a null
doc_id never is a component id unless its whole component has null ids; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import random
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm import shingles
from vecloom.llm.common import components, cut, linked, sieve, sieved, slices, table

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
#: The setting of ``near_texts``: words of a shingle, least likeness as a fraction, and bits.
WIDE_SHINGLE, LEAST, WIDE_RADIUS = 5, (4, 5), 26
#: Distinct fingerprints that one task compares with each other; larger sets are divided by further blocks.
BUCKET = 4096
_CHUNK = 1 << 15


def pivots(n: int = 16) -> list[int]:
    """Reference fingerprints, by rule: seeded random bits."""
    rng = random.Random(64)
    return [rng.getrandbits(BITS) for _ in range(n)]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    last = max(1, len(words) - shingle + 1)
    hashed, total = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for start in range(0, last, _CHUNK):
        part = words[start : start + _CHUNK + shingle - 1]
        if len(part) <= shingle:
            grams = [b" ".join(part)]
        elif shingle == 3:
            grams = [b"%b %b %b" % g for g in zip(part, part[1:], part[2:])]
        else:
            grams = [b" ".join(g) for g in zip(*(part[i:] for i in range(shingle)))]
        hashes = np.fromiter((hashed(g, SEED) for g in grams), np.uint64, len(grams))
        total += shingles.bit_counts(hashes)
    return shingles.majority(total, last)


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, key, fp): the fingerprint of every whole text as a signed long, and
    xxhash64 of the text."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = part.column(2)
                fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fps.view(np.int64))], ["doc_id", "key", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("key"), text.alias("text")).mapInArrow(run, "doc_id long, key long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _parts(bits: list[int], n: int) -> list[int]:
    """``bits`` dealt into n blocks, each as a mask."""
    return [sum(1 << b for b in bits[len(bits) * i // n : len(bits) * (i + 1) // n]) for i in range(n)]


def first_masks(rows: int, radius: int = RADIUS) -> list[int]:
    """Block sets of which near fingerprints share one. More blocks give longer keys,
    so that a key stays shared by about one random fingerprint at any number of rows."""
    blocks = radius + 2
    while rows > 1 << (BITS * (blocks - radius) // blocks) and blocks < 3 * radius:
        blocks += 1
    parts = _parts(list(range(BITS)), blocks)
    assert len(parts) == blocks and comb(blocks, radius)
    return [sum(c) for c in combinations(parts, blocks - radius)]


def finer_masks(mask: int, radius: int = RADIUS) -> list[int]:
    rest = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | m for m in _parts(rest, radius + 1)] if len(rest) > 12 else []


def _linked(fp: np.ndarray, pv: np.ndarray, radius: int) -> np.ndarray:
    """Each fingerprint's smallest index reachable among those of one bucket."""
    order = np.argsort(pv[:, 0], kind="stable")
    f, p, n = fp[order], pv[order].astype(np.int16), len(fp)
    stop = np.searchsorted(p[:, 0], p[:, 0] + radius, side="right")
    up = np.arange(n)

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    start = 0
    while start < n:
        end, size = start, 0
        while end < n and (size == 0 or size + stop[end] - end < 1 << 18):
            size += stop[end] - end
            end += 1
        counts = stop[start:end] - np.arange(start, end) - 1
        i = np.repeat(np.arange(start, end), counts)
        j = np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts) + i + 1
        for k in range(1, p.shape[1]):
            near = np.abs(p[i, k] - p[j, k]) <= radius
            i, j = i[near], j[near]
        near = np.bitwise_count(f[i] ^ f[j]) <= radius
        i, j = i[near], j[near]
        while len(i):
            new = up[i] != up[j]
            i, j = i[new], j[new]
            if len(i) == 0:
                break
            for x, y in zip(i[:512].tolist(), j[:512].tolist()):
                x, y = find(x), find(y)
                up[max(x, y)] = min(x, y)
            while (up != up[up]).any():
                up = up[up]
        start = end
    out = np.empty(n, np.int64)
    out[order] = order[up]
    return out


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fps`` (fp: long), enough to connect
    every pair within ``radius`` bits; no more than a forest from each bucket."""
    refs = pivots()
    fps = cut(fps.select("fp", F.unhex(F.concat(*[F.lpad(F.hex(F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p))))), 2, "0") for p in refs])).alias("pv")))
    masks = first_masks(fps.count(), radius)

    def keyed(rows: DataFrame, of: list[int]) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for m in of])
        return rows.select("fp", "pv", F.explode(keys).alias("k")).select("k.mask", "k.key", "fp", "pv")

    keys = keyed(fps, masks)
    shared = cut(keys.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    done, members = [], keys.join(shared, ["mask", "key"])
    level = masks
    while True:
        finer = {m: finer_masks(m, radius) for m in level}
        # the extra blocks of each mask, as one table bounded by the number of masks; without any
        # 12 bits are left at most, and a bucket can't hold more than they can tell apart
        more = fps.sparkSession.createDataFrame([(_signed(m), [_signed(x) for x in finer[m]]) for m in level], "mask long, finer array<long>")
        ends = [_signed(m) for m in level if not finer[m]]
        ready = (F.col("n") <= bucket) | F.col("mask").isin(ends) if ends else F.col("n") <= bucket
        done.append(members.where(ready).drop("n"))
        if shared.where(~ready).isEmpty():
            break
        large = members.where(~ready)
        keys = large.drop("n", "key").join(F.broadcast(more), "mask").select(F.explode("finer").alias("mask"), "fp", "pv").select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "pv").distinct()
        keys = cut(keys)
        shared = cut(keys.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        members = keys.join(shared, ["mask", "key"])
        level = sorted({x for m in level for x in finer[m]})
    buckets = done[0]
    for more_rows in done[1:]:
        buckets = buckets.union(more_rows)
    buckets = buckets.groupBy("mask", "key").agg(F.collect_list(F.struct("fp", "pv")).alias("rows")).select("rows")
    width = len(refs)

    def run(batches):
        for batch in batches:
            rows = batch.column(0)
            ends, flat = rows.offsets.to_numpy(), rows.values
            fp = flat.field("fp").to_numpy().view(np.uint64)
            pv = np.frombuffer(b"".join(flat.field("pv").to_pylist()), np.uint8).reshape(-1, width)
            a, b = [], []
            for s, e in zip(ends[:-1].tolist(), ends[1:].tolist()):
                if e - s == 2:
                    x, y = fp[s], fp[s + 1]
                    if np.abs(pv[s].astype(np.int16) - pv[s + 1]).max() <= radius and np.bitwise_count(x ^ y) <= radius:
                        a.append(x)
                        b.append(y)
                    continue
                root = _linked(fp[s:e], pv[s:e], radius)
                own = np.flatnonzero(root != np.arange(e - s))
                a.extend(fp[s:e][own])
                b.extend(fp[s:e][root[own]])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], ["a", "b"])

    return buckets.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, key, fp, root, component_id) for every row of ``docs`` (doc_id, text):
    ``key`` is xxhash64 of the text, ``root`` the smallest fingerprint of the component."""
    rows = cut(with_fingerprints(docs, shingle))
    own = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    return _named(rows, "fp", own, components(links(own.select("fp"), radius, bucket)))


def _named(rows: DataFrame, by: str, own: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the root and the smallest doc_id of the component of their ``by``."""
    roots = cut(roots)
    linked = roots.join(own, roots.node == own[by]).groupBy("root").agg(F.min("first").alias("least"))
    reached = roots.join(linked, "root").select(F.col("node").alias("of"), F.col("root").alias("to"), "least")
    # written, so that both sides of the last join are plain exchanges, whose large partitions can be split
    ids = cut(own.join(reached, own[by] == reached.of, "left").select(F.col(by).alias("of"), F.coalesce("to", by).alias("root"), F.coalesce("least", "first").alias("component_id")))
    return rows.join(ids, rows[by] == ids.of).drop("of")


def _within(a: str, b: str, radius: int) -> Column:
    """Whether the pivot table leaves two sets' fingerprints to be compared, and whether
    they then are within the radius."""
    gap = F.greatest(*[F.abs(F.get(f"{a}pv", F.lit(i)) - F.get(f"{b}pv", F.lit(i))) for i in range(len(pivots()))])
    return (gap <= radius) & (F.bit_count(F.col(f"{a}fp").bitwiseXOR(F.col(f"{b}fp"))) <= radius)


def near_texts(docs: DataFrame, shingle: int = WIDE_SHINGLE, least: tuple[int, int] = LEAST, radius: int = WIDE_RADIUS) -> DataFrame:
    """(doc_id, key, root, component_id) as ``near_duplicates`` gives them, but linked
    where the sets of shingles are ``least`` (a fraction) alike or more. Candidates share
    a band of minima of the shingles' hashes; the pivot table discards those among them
    that differ by more than ``radius``; the others are verified on the shingles."""
    rows = cut(shingles.sketched(docs, shingle))
    fields = ["n", "fp", "bands"]
    own = rows.groupBy("of").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("at"), *[F.first(c).alias(c) for c in fields])
    table = F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p)))) for p in pivots()])
    own = cut(own.select(F.col("of").alias("id"), F.col("at.doc_id").alias("first"), F.col("at.key").alias("key"), *fields, table.alias("pv")))
    members = own.select(F.explode("bands").alias("bucket"), "id", "n")
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("bucket")
    members = cut(members.join(shared, "bucket"))
    held = cut(own.join(members.select("id").distinct(), "id", "left_semi").select("id", "first", "key", "n", "fp", "pv"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("of"))
    # most texts share no band: they are left where they lie, and only the others are shuffled
    keyed = sieved(keyed, F.xxhash64("doc_id", "of"), sieve(held, F.xxhash64("first", "key")))
    mine = keyed.doc_id.eqNullSafe(held["first"]) & (keyed.of == held.key)
    sets = cut(shingles.sets(keyed.join(held.select("first", "key").hint("merge"), mine, "left_semi"), shingle).dropDuplicates(["id"]))
    told = cut(held.drop("first", "key").join(sets.select("id", "marks"), "id"))

    def verified(pairs: DataFrame) -> DataFrame:
        x, y = (told.select(F.col("id").alias(c), *[F.col(v).alias(f"{c}_{v}") for v in ("n", "fp", "pv", "marks")]) for c in "ab")
        near = pairs.join(x, "a").join(y, "b").where(_within("a_", "b_", radius) & shingles.marks_fit("a_", "b_", least)).select("a", "b")
        return shingles.verified(near, sets, least)

    finer = told.select("id", "marks"), lambda a, b: shingles.marks_fit(a, b, least)
    roots = linked(members, lambda a, b: _sizes_fit(f"{a}n", f"{b}n", least), verified, ["n"], finer)
    return _named(rows.select("doc_id", "key", F.col("of").alias("id")), "id", own.select("id", "first"), roots).select("doc_id", "key", "root", "component_id")


def _sizes_fit(a: str, b: str, least: tuple[int, int]) -> Column:
    return F.lit(least[0]) * F.greatest(a, b) <= F.lit(least[1]) * F.least(a, b)


def keep_one(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` with one document of each component of ``found`` (by
    default ``near_texts``): that with the smallest doc_id, equal ones by the hash of
    the text. Of rows that repeat both doc_id and text one stays."""
    found = cut(near_texts(docs) if found is None else found)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best")
    chosen = found.groupBy("root").agg(best).select(F.col("best.doc_id").alias("__doc"), F.col("best.key").alias("__of"))
    rows = found.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n"))
    rows = cut(rows.join(chosen, rows.doc_id.eqNullSafe(F.col("__doc")) & (rows.key == F.col("__of")), "left").select(F.col("doc_id").alias("__doc"), F.col("key").alias("__of"), "n", F.col("__of").isNotNull().alias("kept")))
    kept, others = rows.where("kept").drop("kept"), sieve(rows.where("not kept or n > 1"), F.xxhash64("__doc", "__of"))
    keyed = docs.withColumn("__key", F.xxhash64(F.col("text").cast("string")))
    # the same plan at every size: what the sieve of the others doesn't catch stays and is left
    # where it lies, the rest is shuffled and told apart exactly, and no set of ids is broadcast
    hashed = F.xxhash64(keyed.doc_id.cast("long"), keyed["__key"])
    sure, keyed = sieved(keyed, hashed, others, caught=False), sieved(keyed, hashed, others)
    same = keyed.doc_id.cast("long").eqNullSafe(F.col("__doc")) & (keyed["__key"] == F.col("__of"))
    once = sure.select(docs.columns).union(keyed.join(kept.where("n = 1").hint("merge"), same, "left_semi").select(docs.columns))
    again = kept.where("n > 1")
    if again.isEmpty():
        return once
    return once.union(keyed.join(again.hint("merge"), same, "left_semi").dropDuplicates(["doc_id", "__key"]).select(docs.columns))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
