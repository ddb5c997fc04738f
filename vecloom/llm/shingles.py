"""Sets of word shingles: their names, bands of minima, marks, and their likeness.

The marks of a set are ``MARKS`` bits, one for each slice of the hashes: whether the set
has an odd number of hashes there. Where two sets' marks differ, one of them has a hash
that the other has not, so marks never differ in more bits than the sets in hashes, and
sets of n and m hashes of which the fraction p/q is common differ in (n + m)(q - p)/(q + p)
hashes at most. That rules pairs out without a loss; it tells little about sets of
several thousand shingles, whose marks differ in half of the bits.

Part of the near-duplicate operator, see ``simhash.near_texts``.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import cut, slices

SEED = 42
BANDS, WIDTH = 24, 5
MARKS = 1024
_CHUNK = 1 << 10


def bit_counts(found: np.ndarray) -> np.ndarray:
    """In how many of the hashes each bit is set."""
    return np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    """The fingerprint whose bits are set in over half of ``n`` hashes."""
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of the distinct shingles, sorted; those of a short text are its words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = xxhash.xxh64_intdigest
    grams = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    return np.unique(np.fromiter((hashed(b" ".join(g), SEED) for g in grams), np.uint64, max(1, len(words) - shingle + 1)))


def _name(found: np.ndarray) -> int:
    """The name of a set, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64))


def _factors() -> tuple[np.ndarray, np.ndarray]:
    """Permutations of 32 bits, as odd factors and summands."""
    rng = random.Random(SEED)
    a, b = ([rng.getrandbits(32) for _ in range(BANDS * WIDTH)] for _ in "ab")
    return np.array(a, np.uint32)[:, None] | np.uint32(1), np.array(b, np.uint32)[:, None]


def bands(found: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A key for each band, from the upper halves of the hashes; a set without shingles
    has none, as it needs no search."""
    a, b = factors
    if not len(found):
        return np.zeros(0, np.int64)
    upper = (found >> np.uint64(32)).astype(np.uint32)
    least = np.min([(a * upper[s : s + _CHUNK] + b).min(axis=1) for s in range(0, len(upper), _CHUNK)], axis=0).reshape(BANDS, WIDTH)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least)], np.uint64).view(np.int64)


def marks(found: np.ndarray) -> np.ndarray:
    """Whether each slice of the hashes, by their lowest bits, holds an odd number of them."""
    odd = np.bincount((found & np.uint64(MARKS - 1)).astype(np.int64), minlength=MARKS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def marks_fit(a: str, b: str, least: tuple[int, int]) -> Column:
    """Whether the marks of two sets, behind prefixes, allow them to be alike enough."""
    apart = F.lit(0)
    for i in range(MARKS // 64):
        apart = apart + F.bit_count(F.get(f"{a}marks", F.lit(i)).bitwiseXOR(F.get(f"{b}marks", F.lit(i))))
    return F.lit(least[0] + least[1]) * apart <= F.lit(least[1] - least[0]) * (F.col(f"{a}n") + F.col(f"{b}n"))


def sketched(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, key, of, n, fp, bands) of every text: the name, size, fingerprint and
    band keys of its set of shingles, and xxhash64 of the text as ``key``."""
    names = ["doc_id", "key", "of", "n", "fp", "bands"]

    def run(batches):
        factors = _factors()
        for batch in batches:
            for part in slices(batch):
                sets = [hashes(t.as_py(), shingle) for t in part.column(2)]
                fps = np.array([majority(sum(bit_counts(s[i : i + _CHUNK]) for i in range(0, len(s), _CHUNK)), len(s)) if len(s) else 0 for s in sets], np.uint64)
                columns = [part.column(0), part.column(1), pa.array([_name(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps.view(np.int64)), pa.array([bands(s, factors) for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names)

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("key"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, key long, of long, n long, fp long, bands array<long>")


def sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, s, marks): the name, the shingles and the marks of every text's set."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 32):
                found = [hashes(t.as_py(), shingle) for t in part.column(0)]
                yield pa.RecordBatch.from_arrays([pa.array([_name(s) for s in found], pa.int64()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64())), pa.array([marks(s) for s in found], pa.list_(pa.int64()))], ["id", "s", "marks"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "id long, s array<long>, marks array<long>")


def verified(pairs: DataFrame, known: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets (``known``: id, s) are alike enough."""
    x, y = known.select(F.col("id").alias("a"), F.col("s").alias("x")), known.select(F.col("id").alias("b"), F.col("s").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    alike = least[1] * both >= least[0] * (F.size("x") + F.size("y") - both)
    return cut(pairs.join(x, "a").join(y, "b").where(alike).select("a", "b"))
