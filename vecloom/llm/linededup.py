"""Line dedup: repeated runs of lines, found over the suffixes of line sequences.

Every text is a sequence of its lines that hold a word. Distributed prefix doubling
ranks the suffixes by their first 1, 2, 4, ... lines: the rank of ``2k`` lines is the
place of the pair (rank of ``k`` lines here, rank of ``k`` lines ``k`` further on) in
a sorted table of the pairs, as in the construction of a suffix array. A suffix whose
prefix nothing else shares is alone in its interval for all longer prefixes too and
leaves the rounds, so only repeated lines are ever moved.

Suffixes with a common prefix of ``n`` lines are one interval of the suffix array
with a longest common prefix of ``n`` or more; two overlapping ranks of the largest
power of two name it. Which ``n`` counts is told by the words: a run must hold
``min_words`` words, and a suffix shares such a run with another exactly if it
shares its shortest prefix of so many words. Together with the shortest suffixes of so
many words these windows cover each maximal repeated run from its first line to its
last. In every interval the first occurrence, by doc_id and line, stays; the lines
of all others are deleted.

Defined results: a null text stays null, texts without words are returned as they
are; rows that repeat both doc_id and text count as one and are edited alike; the
order of equal doc_ids is that of their texts' hashes, null doc_ids come first; a run
that overlaps its own earlier occurrence is deleted as any later copy is; an empty
table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.llm.common import cut, slices, table

#: Words that a repeated run of lines must hold to be deleted.
MIN_WORDS = 25

_LINES = "doc_id long, key long, pos int, h1 long, h2 long, windows array<struct<n:int,first:int,last:int>>"
_WINDOWS = pa.list_(pa.struct([("n", pa.int32()), ("first", pa.int32()), ("last", pa.int32())]))
_SIGNED = 1 << 63


def _long(x: int) -> int:
    return x - (_SIGNED << 1) if x >= _SIGNED else x


def split(text: bytes, min_words: int = MIN_WORDS) -> list[tuple[bytes, list[tuple[int, int, int]]]]:
    """The lines with a word, each with the windows (n lines, first and last line of
    the text) that begin with it: the shortest of ``min_words`` words, and those that
    are the shortest of so many words before their last line."""
    lines, at, ends = [], [], [0]
    for i, line in enumerate(text.split(b"\n")):
        if n := len(line.split()):
            lines.append(line)
            at.append(i)
            ends.append(ends[-1] + n)
    windows: list[list] = [[] for _ in lines]
    for p in range(len(lines)):
        end = bisect_left(ends, ends[p] + min_words, p + 1)
        if end < len(ends):
            windows[p].append((end - p, at[p], at[end - 1]))
        start = bisect_right(ends, ends[p + 1] - min_words, 0, p + 1) - 1
        if start >= 0 and (w := (p + 1 - start, at[start], at[p])) not in windows[start]:
            windows[start].append(w)
    return list(zip(lines, windows))


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch, 64):
                rows: list[list] = [[] for _ in range(6)]
                for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                    raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                    key = _long(xxhash.xxh64_intdigest(raw, 42))
                    for pos, (line, windows) in enumerate(split(raw, min_words)):
                        h = xxhash.xxh3_128_intdigest(line)
                        for column, value in zip(rows, (doc, key, pos, _long(h >> 64), _long(h & (1 << 64) - 1), [{"n": n, "first": a, "last": b} for n, a, b in windows])):
                            column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), _WINDOWS)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds)], ["doc_id", "key", "pos", "h1", "h2", "windows"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _LINES)


def _ranked(pairs: DataFrame, a: str, b: str, rank: str) -> DataFrame:
    """A rank in the order of (a, b) for every pair that occurs twice or more: ids that
    grow over a sorted table keep its order without numbering it in one task."""
    twice = pairs.groupBy(a, b).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(a, b)
    return cut(twice.orderBy(a, b).withColumn(rank, F.monotonically_increasing_id()))


def deletions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, key, first, last): runs of lines to delete, by their numbers in the
    text from 0; they may overlap. ``key`` is xxhash64 of the text."""
    lines = cut(_lines(docs, min_words))
    where = ["doc_id", "key", "pos"]
    ranks = _ranked(lines, "h1", "h2", "r1")
    rows = cut(lines.join(ranks, ["h1", "h2"]).select(*where, "windows", "r1"))
    by_text = W.partitionBy("doc_id", "key").orderBy("pos")
    # repeated rows hold every position twice; one of each is enough
    rows = rows.dropDuplicates(where)
    k, levels = 1, [1]
    while 2 * k <= min_words:
        wide = cut(rows.withColumn("next", F.when(F.lead("pos", k).over(by_text) == F.col("pos") + k, F.lead(f"r{k}", k).over(by_text))))
        pairs = wide.where(F.col(f"r{k}").isNotNull() & F.col("next").isNotNull())
        ranks = _ranked(pairs, f"r{k}", "next", f"r{2 * k}")
        if ranks.isEmpty():
            rows = wide.drop("next")
            break
        rows = wide.join(ranks, [f"r{k}", "next"], "left").drop("next")
        k *= 2
        levels.append(k)
    rows = cut(rows)
    # a window of n lines is named by the ranks of its first and its last 2^j lines, which overlap
    power = lambda n: F.pow(F.lit(2), F.floor(F.log2(n))).cast("int")
    begin = rows.select(*where, *[f"r{x}" for x in levels], F.explode("windows").alias("w")).withColumn("k", power(F.col("w.n")))
    pick = lambda prefix="": F.coalesce(*[F.when(F.col("k") == x, F.col(f"{prefix}r{x}")) for x in levels])
    begin = begin.select(*where, "w", "k", pick().alias("a")).where("a is not null")
    other = rows.select(F.col("doc_id").alias("o_doc"), F.col("key").alias("o_key"), F.col("pos").alias("o_pos"), *[F.col(f"r{x}").alias(f"o_r{x}") for x in levels])
    on = begin.doc_id.eqNullSafe(other.o_doc) & (begin.key == other.o_key) & (begin.pos + F.col("w.n") - F.col("k") == other.o_pos)
    named = cut(begin.join(other, on).withColumn("b", pick("o_")).where("b is not null").select(F.struct(*where).alias("at"), F.col("w.n").alias("n"), F.col("w.first").alias("first"), F.col("w.last").alias("last"), "a", "b"))
    # written, so that both sides of the join are plain exchanges and a very common run can be split
    intervals = cut(named.groupBy("n", "a", "b").agg(F.min("at").alias("earliest"), F.count(F.lit(1)).alias("members")).where("members > 1").drop("members"))
    later = named.join(intervals, ["n", "a", "b"]).where("at > earliest")
    return later.select("at.doc_id", "at.key", "first", "last")


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the later copies of repeated runs deleted from ``text``, and
    ``_lines_deleted``, the number of lines deleted."""
    runs = cut(deletions(docs, min_words))
    of = runs.groupBy(F.col("doc_id").alias("__doc"), F.col("key").alias("__of")).agg(F.collect_set(F.struct("first", "last")).alias("__runs"))
    keyed = docs.withColumn("__key", F.xxhash64(F.col("text").cast("string")))
    # the same plan at every size: texts are shuffled once, and no set of runs is broadcast
    joined = keyed.join(of.hint("merge"), keyed.doc_id.cast("long").eqNullSafe(of["__doc"]) & (keyed["__key"] == of["__of"]), "left").drop("__doc", "__of", "__key")
    gone = F.array_distinct(F.flatten(F.transform("__runs", lambda r: F.sequence(r["first"], r["last"]))))
    lines = F.split(F.col("text"), "\n", -1)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i))
    edited = joined.withColumn("_lines_deleted", F.when(F.col("__runs").isNull(), 0).otherwise(F.size(gone)))
    text = F.when(F.col("__runs").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return edited.withColumn("text", text).drop("__runs")


def op6_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lines deleted, characters and SHA-256 of what is left of every text."""
    found = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return found.select("doc_id", F.col("_lines_deleted").cast("long").alias("n_deleted"), F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))
