"""Best-fit packing of tokenized documents into sequences of one length.

Documents longer than a sequence are cut into full pieces, the first piece being the
shorter one. Lengths are whole numbers up to the capacity, so the packing is planned
on the histogram of lengths alone, which has ``capacity`` entries however many
documents there are: pieces above one third of the capacity fit at most twice into a
sequence and are matched greedily, the largest with the largest partner that fits;
the smaller ones then go, largest first, to the smallest gap that holds them. The
plan is a list of patterns (lengths side by side, how often). Each piece finds its
slot by its rank among the pieces of its length; ranks are counted in salted parts
whose number grows with the pieces of that length, so that no task orders them all.

Defined results: a null or empty text is one piece that holds the end token alone;
repeated rows are packed as often as they occur; an empty table packs nothing; other
columns are ignored.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from codecs import charmap_decode
from collections import Counter
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.llm.common import cut, slices, table

CAPACITY = 1024
END = 2
#: Pieces of one length that one task puts in order; more are dealt to several.
TOGETHER = 100_000
#: Pieces of text in each of the two memories of their ids that a worker has.
REMEMBERED = 200_000


class Encoder:
    """Ids as the named tokenizer gives them, remembered by piece.

    A text is divided as the tokenizer's own pattern does it, and each piece that isn't
    known yet is merged by the tokenizer's model. In texts with characters whose classes
    depend on the version of Unicode, or that hold a special token, the whole tokenizer
    reads chunks instead: some white space with what follows it, as the pattern never
    goes from a character that isn't white space to one that is. Where other white space
    stands before a chunk's end, it reads the text as a whole.
    """

    def __init__(self, name: str = "byte_bpe_50k", end: int = END):
        import public_tokenizers
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        self._special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self._end = _packed([end])
        model, letters = tokenizer.model, _byte_letters()
        self._whole = lambda text: _packed(tokenizer.encode(text, add_special_tokens=False).ids)
        self._pieces = _Known(lambda piece: _packed([t.id for t in model.tokenize(charmap_decode(piece.encode(), "strict", letters)[0])]))
        self._chunks = _Known(self._whole)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids, the end token's last."""
        if _STABLE.fullmatch(text) and not any(t in text for t in self._special):
            return b"".join(map(self._pieces.__getitem__, _PIECE.findall(text))) + self._end
        if _ODD_END.search(text):
            return self._whole(text) + self._end
        return b"".join(map(self._chunks.__getitem__, _CHUNK.findall(text))) + self._end


class _Known(dict):
    """What ``make`` gives for short strings, remembered. A full memory becomes the earlier
    one, from which strings that are met again come back; what was left in that one goes."""

    def __init__(self, make):
        self._make = make
        self._earlier: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        value = self._earlier.get(key)
        if value is None:
            value = self._make(key)
        if len(key) < 64:
            if len(self) >= REMEMBERED:
                self._earlier = dict(self)
                self.clear()
            self[key] = value
        return value


_CHUNK = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
#: Other white space right before one of these four: there chunks depend on each other.
_ODD_END = re.compile(r"[^\S \t\n\r][ \t\n\r]")
#: The tokenizer's pattern for texts of such characters as ``_STABLE`` has.
_PIECE = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ɏ0-9]+|\s+(?!\S)|\s+")
#: Characters that are letters, digits, white space or neither in every version of Unicode alike.
_STABLE = re.compile("[ -~\\t\\n\\rÀ-ɏ\u2010-\u2027\u2030-\u205e]*")


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _byte_letters() -> str:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes
    for themselves, the others by letters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(others)) for b in range(256))


@cache
def _encoder(name: str, end: int) -> Encoder:
    """One for all tasks of a worker process, so that it is loaded once and what one task
    has met is known to the next."""
    return Encoder(name, end)


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k", end: int = END, ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): ids are little-endian unsigned
    32-bit, and are null without ``ids``."""
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]

    def run(batches):
        encoder = _encoder(tokenizer, end)
        for batch in batches:
            for part in slices(batch, 128):
                rows: list[list] = [[] for _ in kinds]
                for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                    held = encoder.ids(text.as_py() or "")
                    n, at = len(held) // 4, 0
                    for piece in range(-(-n // capacity)):
                        size = (n - at) % capacity or capacity
                        own = held[4 * at : 4 * (at + size)]
                        for column, value in zip(rows, (doc, piece, at, size, zlib.crc32(own), own if ids else None)):
                            column.append(value)
                        at += size
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used, for so many pieces of each length."""
    left = Counter({k: n for k, n in histogram.items() if n})
    bins: dict[int, Counter] = {}  # gap: patterns
    gaps: list[int] = []

    def put(gap: int, pattern: tuple[int, ...], n: int) -> None:
        if gap not in bins:
            bins[gap] = Counter()
            insort(gaps, gap)
        bins[gap][pattern] += n

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        at = bisect_left(large, capacity - a + 1) - 1
        while at >= 0 and not left[large[at]]:
            large.pop(at)
            at -= 1
        if at < 0:
            put(capacity - a, (a,), left[a])
            left[a] = 0
            continue
        b = large[at]
        if a == b and left[a] == 1:
            # its only equal is itself: the next smaller one is its partner
            at -= 1
            while at >= 0 and not left[large[at]]:
                large.pop(at)
                at -= 1
            if at < 0:
                put(capacity - a, (a,), 1)
                left[a] = 0
                continue
            b = large[at]
        n = left[a] // 2 if a == b else min(left[a], left[b])
        put(capacity - a - b, (a, b), n)
        left[a] -= n
        left[b] -= n
    for size in sorted((k for k in left if left[k]), reverse=True):
        count = left[size]
        while count:
            at = bisect_left(gaps, size)
            if at == len(gaps):
                each = capacity // size
                if full := count // each:
                    put(capacity - each * size, (size,) * each, full)
                if rest := count % each:
                    put(capacity - rest * size, (size,) * rest, 1)
                break
            gap = gaps[at]
            pattern, n = next(iter(bins[gap].items()))
            each = gap // size
            used = min(n, count // each)
            if used:
                put(gap - each * size, pattern + (size,) * each, used)
            elif count:
                each, used = count, 1
                put(gap - each * size, pattern + (size,) * each, 1)
            count -= each * used
            bins[gap][pattern] -= used
            if not bins[gap][pattern]:
                del bins[gap][pattern]
                if not bins[gap]:
                    del bins[gap]
                    gaps.remove(gap)
    return [(pattern, n) for gap in sorted(bins) for pattern, n in bins[gap].items()]


def _slots(patterns) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from rank, to rank, first sequence, offset): the slots of each length
    in turn. Their number is bounded by the patterns, and so by the capacity."""
    out, at, sequence = [], Counter(), 0
    for pattern, n in patterns:
        for size, offset in zip(pattern, [0, *accumulate(pattern)]):
            out.append((size, at[size], at[size] + n, sequence, offset))
            at[size] += n
        sequence += n
    return out


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` (doc_id, piece, length, ...) with sequence_id and offset."""
    spark = rows.sparkSession
    # written, so that a row's place among its equals stays the same when tasks run again
    rows = cut(rows.withColumn("mix", F.xxhash64(F.monotonically_increasing_id())))
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    # the slots of one length lie side by side from rank 0, so a search in their first ranks finds a piece's own
    by_length: dict[int, list] = {}
    for size, start, _, sequence, offset in _slots(plan(histogram, capacity)):
        by_length.setdefault(size, []).append((start, sequence, offset))
    told = [(k, -(-histogram[k] // TOGETHER), [x[0] for x in v], [x[1] for x in v], [x[2] for x in v]) for k, v in by_length.items()]
    found = F.broadcast(spark.createDataFrame(told, "length long, salts long, starts array<long>, firsts array<long>, offsets array<long>"))
    salted = rows.join(found.select("length", "salts"), "length").withColumn("salt", F.pmod("mix", "salts")).drop("salts")
    counted = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = counted.select("length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    own = F.row_number().over(W.partitionBy("length", "salt").orderBy("mix")) - 1
    ranked = salted.withColumn("own", own).join(before, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "salt", "mix")
    # halvings find one of up to 2^20 slots; the plan of one length is far smaller
    steps = F.array(*[F.lit(1 << k) for k in range(19, -1, -1)])
    low = F.aggregate(steps, F.lit(0), lambda lo, k: F.when(F.get("starts", lo + k) <= F.col("rank"), lo + k).otherwise(lo))
    placed = ranked.join(found, "length").withColumn("at", low)
    return placed.withColumn("sequence_id", F.get("firsts", F.col("at")) + F.col("rank") - F.get("starts", F.col("at"))).withColumn("offset", F.get("offsets", F.col("at"))).drop("at", "rank", "starts", "firsts", "offsets", "salts")


def packed(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k", end: int = END, ids: bool = True) -> DataFrame:
    """All pieces with their ids (``ids``: little-endian unsigned 32-bit) and places.
    Without ``ids`` only their CRC-32 is kept."""
    rows = pieces(docs, capacity, tokenizer, end, ids)
    return pack(rows if ids else rows.drop("ids"), capacity)


def sequences(rows: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the packed pieces joined in their order. A sequence
    has ``capacity`` ids at most, so a group is small."""
    joined = rows.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return joined.select("sequence_id", "length", F.unhex(F.array_join(F.transform("parts", lambda x: F.hex(x["ids"])), "")).alias("ids"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packed(table(spark, sf_dir, "documents"), ids=False)
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"))
