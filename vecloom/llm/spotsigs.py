"""SpotSigs fingerprints, with DataFrame functions only.

A signature is a common word (an anchor) with the chain of the two content words that
follow it; the set of a text's signatures is its fingerprint. Likeness is the Jaccard
coefficient of two sets. Two sets can't be more alike than their lengths are, so
``near_classes`` divides the sets into partitions by length, of which only equal and
neighbouring ones can hold near pairs, looks for candidates among the rarest
signatures that a near pair must share one of, and verifies them.

Texts without anchors chain every content word instead; texts of anchors alone are
one signature. Signatures are 64 bits of MD5, in hex.

Defined results: a null text counts as empty; an empty text has an empty fingerprint,
which is wholly like another empty one and wholly unlike all others; the only
document of a table follows itself; equal doc_ids follow each other by their texts'
hashes, null doc_ids come after all others; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.llm.common import cut, linked, lit_array, partitions, table

#: Common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au aux avec ce dans de des du elle en est et il la le les ne par pas pour qui que se sur un une "
    "als auch auf aus bei das dem den der des die ein eine für ist mit nicht sich sie und von zu "
    "al como con del el es lo los las no para por su una y"
).split()

CHAIN = 2
#: Ranges of doc_id that the rows are dealt to, at most.
RANGES = 4_096
_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    bare = F.btrim(F.regexp_replace(F.lower(text), _SEPARATORS, " "))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " "))


def _signature(*parts: Column) -> Column:
    return F.left(F.md5(F.concat_ws(" ", *parts)), F.lit(16))


def _content(w: Column) -> Column:
    """Places of the content words, from 1."""
    return F.when(F.size(w) > 0, F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: ~F.get(w, i - 1).isin(ANCHORS))).otherwise(F.array().cast("array<int>"))


def _word(w: Column, p: Column, k: Column) -> Column:
    return F.get(w, F.get(p, k) - 1)


def _every(p: Column) -> Column:
    return F.sequence(F.lit(0), F.size(p) - 1)


_NONE = "array<string>"


def _anchored(w: Column, p: Column) -> Column:
    """The signatures that begin with an anchor, from the words and the places of content words."""

    def at(k):
        before = F.coalesce(F.get(p, k - 1), F.lit(0))
        rest = [_word(w, p, k + j) for j in range(CHAIN)]
        return F.transform(F.slice(w, before + 1, F.get(p, k) - before - 1), lambda a: _signature(a, *rest))

    return F.when(F.size(p) > 0, F.flatten(F.transform(_every(p), at))).otherwise(F.array().cast(_NONE))


def _signatures(w: Column, p: Column, found: Column) -> Column:
    """The sorted set of signatures: ``found``, those with an anchor, or else plain chains."""
    plain = F.when(F.size(p) > 0, F.transform(_every(p), lambda k: _signature(*[_word(w, p, k + j) for j in range(CHAIN + 1)]))).when(F.size(w) > 0, F.array(_signature(F.array_join(w, " ")))).otherwise(F.array().cast(_NONE))
    return F.sort_array(F.array_distinct(F.when(F.size(found) > 0, found).otherwise(plain)))


def with_signatures(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the signature set of its column ``text``; each step is a projection, as
    Spark evaluates a lambda expression as often as it is named in one."""
    kept = df.columns
    df = df.withColumn("_w", words(F.col(text)))
    df = df.withColumn("_p", _content(F.col("_w")))
    df = df.withColumn("_f", _anchored(F.col("_w"), F.col("_p")))
    return df.select(*kept, _signatures(F.col("_w"), F.col("_p"), F.col("_f")).alias(name))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two sets. Sets of which one is empty aren't compared."""
    shared = F.size(F.array_intersect(a, b))
    both = F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
    return both.when(F.least(F.size(a), F.size(b)) == 0, F.lit(0.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def _bucket(col: Column, cuts: list[int]) -> Column:
    """Number of cuts below a value, by halving, so that many cuts cost little."""
    at = lit_array(cuts, "bigint")
    steps = F.array(*[F.lit(1 << k) for k in range(max(1, len(cuts)).bit_length() - 1, -1, -1)])
    return F.coalesce(F.aggregate(steps, F.lit(0), lambda lo, k: F.when(F.get(at, lo + k - 1) < col, lo + k).otherwise(lo)), F.lit(0))


def with_next(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, W]:
    """``docs`` (doc_id: long) dealt into ranges of doc_id, and the window in which
    ``lead`` gives the next document by descending doc_id (after the last: the first).

    The ranges are divided at doc_ids of the table; the document at the upper end of a
    range is dealt to the range above as well, where it stands behind all others
    (``guest``). So there is one shuffle, and no order over all rows in one task.
    Rows with ``guest`` are to be left out after the window has been evaluated.
    """
    # ranges of more rows than memory holds are sorted on disk, so their number is bounded
    n = min(4 * partitions(docs.sparkSession), RANGES)
    shares = [i / n for i in range(1, n + 1)]
    got = docs.agg(F.percentile_approx("doc_id", shares, 20 * n).alias("cuts"), F.max("doc_id").alias("last")).first()
    cuts = sorted({*(got["cuts"] or []), *([] if got["last"] is None else [got["last"]])})
    own = _bucket(F.col("doc_id"), cuts[:-1])
    if len(cuts) > 1:
        upper = F.get(lit_array(cuts, "bigint"), own) == F.col("doc_id")
        above = F.when(upper & (own < len(cuts) - 1), own + 1).when(upper, F.lit(0))
    else:
        above = F.when(F.col("doc_id") == F.lit(cuts[0] if cuts else None).cast("bigint"), F.lit(0))
    if cuts:
        places = F.array_compact(F.array(F.struct(own.alias("bucket"), F.lit(False).alias("guest")), F.when(above.isNotNull(), F.struct(above.alias("bucket"), F.lit(True).alias("guest")))))
    else:  # no doc_ids at all
        places = F.array(F.struct(F.lit(0).alias("bucket"), F.lit(False).alias("guest")))
    dealt = docs.select("doc_id", *columns, F.explode(places).alias("_to")).select("doc_id", *columns, "_to.bucket", "_to.guest")
    # rows without doc_id are the last of range 0; its guest, the first document, follows them
    order = [F.col("guest").asc(), F.col("doc_id").desc_nulls_last(), *[F.xxhash64(c) for c in columns]]
    return dealt, W.partitionBy("bucket").orderBy(*order)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text, edited (the text whose last third is replaced by the beginning of
    the next document), their signature sets, and that of the next document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    dealt, window = with_next(docs.select(F.col("doc_id").cast("long"), text.alias("text")), ["text"])
    n, third = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.left("text", n - third), F.left(F.coalesce(F.lead("text").over(window), F.col("text")), third))
    rows = with_signatures(dealt.withColumn("edited", edited), "text", "signatures")
    rows = rows.withColumn("next_signatures", F.coalesce(F.lead("signatures").over(window), F.col("signatures"))).where(~F.col("guest"))
    return with_signatures(rows, "edited", "edited_signatures").drop("bucket", "guest")


def near_classes(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, class_id, near_id): class_id is the smallest doc_id of the same
    fingerprint, near_id the smallest reachable through fingerprints that are ``least``
    alike or more. An empty fingerprint is like no other."""
    rows = fingerprinted(docs)
    sets = cut(rows.where(F.size("signatures") > 0).groupBy("of").agg(F.min("doc_id").alias("first"), F.first("signatures").alias("s")).withColumn("n", F.size("s")).withColumn("id", F.conv(F.left("of", F.lit(15)), 16, 10).cast("long")))
    # hashes of signatures, as two that fall together only bring more candidates
    spread = sets.select("id", "n", F.explode(F.transform("s", lambda x: F.xxhash64(x))).alias("s"))
    often = cut(spread.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    # what only one set has can't bring two together; it still counts for the prefix, of which it is the beginning
    rare = spread.join(often, "s").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("by"))
    # a near pair shares one of the first n - ceil(least * n) + 1 signatures of either
    first = F.slice("by", 1, F.greatest(F.lit(0), F.size("by") - F.ceil(F.lit(least) * F.col("n")).cast("int") + 1))
    part = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(1 / least))).cast("int")
    # lengths of a near pair differ by a factor of 1 / least at most: the same partition or the next one
    places = F.explode(F.array(part, part + 1))
    members = cut(rare.select("id", "n", F.explode(first).alias("k"), part.alias("part")).select("id", "n", "k.s", places.alias("part")).select(F.xxhash64("part", "s").alias("bucket"), "id", "n"))

    def verified(pairs: DataFrame) -> DataFrame:
        x, y = (sets.select(F.col("id").alias(c), F.col("s").alias(f"s_{c}")) for c in "ab")
        return cut(pairs.join(x, "a").join(y, "b").where(likeness(F.col("s_a"), F.col("s_b")) >= least).select("a", "b"))

    fit = lambda a, b: F.least(f"{a}n", f"{b}n") >= F.lit(least) * F.greatest(f"{a}n", f"{b}n")
    roots = cut(linked(members, fit, verified, ["n"]))
    best = roots.join(sets, roots.node == sets.id).groupBy("root").agg(F.min("first").alias("near_id"))
    named = cut(roots.join(best, "root").join(sets.select("id", "of"), F.col("node") == F.col("id")).select(F.col("of").alias("of_text"), "near_id"))
    found = _classes(rows).join(named, F.col("of") == F.col("of_text"), "left")
    return found.select("doc_id", "class_id", F.coalesce("near_id", "class_id").alias("near_id"))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, signatures and ``of``, their hash, written."""
    # written before anything filters rows by ``of``: Spark would evaluate that filter on the texts, with
    # the words of a text found again wherever a step of its signatures names them
    rows = with_signatures(docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), "text", "signatures")
    return cut(rows.select("doc_id", "signatures", F.sha2(F.array_join("signatures", ","), 256).alias("of")))


def classes(docs: DataFrame) -> DataFrame:
    return _classes(fingerprinted(docs))


def _classes(rows: DataFrame) -> DataFrame:
    """doc_id, class_id, the smallest doc_id with the same fingerprint, and ``of``."""
    first = rows.groupBy("of").agg(F.min("doc_id").alias("class_id"))
    return rows.select("doc_id", "of").join(first, "of").select("doc_id", "class_id", "of")


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.array_join("signatures", ",").alias("fingerprint"),
        F.array_join("edited_signatures", ",").alias("edited_fingerprint"),
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
    )


def spotsigs_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search for near pairs over all documents."""
    return near_classes(table(spark, sf_dir, "documents"))


_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(ANCHORS))


def _sql_sets(name: str, source: str) -> str:
    """Signature sets of a relation with an id and a text, step by step."""
    return f"""
{name}_w AS (SELECT id, words, unnest(range(1, len(words) + 1)) AS i FROM (SELECT id, regexp_extract_all(lower(t), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM {source})),
{name}_p AS (SELECT id, i, words[i] AS w, words[i] IN ({_STOP}) AS stop FROM {name}_w),
{name}_c AS (SELECT id, i, w, row_number() OVER x AS k, lag(i, 1, 0) OVER x AS p, lead(w) OVER x AS w2, lead(w, 2) OVER x AS w3
             FROM {name}_p WHERE NOT stop WINDOW x AS (PARTITION BY id ORDER BY i)),
{name}_a AS (SELECT c.id, concat_ws(' ', a.w, c.w, c.w2) AS chain FROM {name}_c c JOIN {name}_p a ON a.id = c.id AND a.stop AND a.i > c.p AND a.i < c.i),
{name}_b AS (SELECT id, concat_ws(' ', w, w2, w3) AS chain FROM {name}_c WHERE id NOT IN (SELECT id FROM {name}_a)),
{name}_o AS (SELECT id, string_agg(w, ' ' ORDER BY i) AS chain FROM {name}_p WHERE id NOT IN (SELECT id FROM {name}_c) GROUP BY id),
{name} AS (SELECT id, list_sort(list_distinct(list(left(md5(chain), 16)))) AS s FROM (FROM {name}_a UNION ALL FROM {name}_b UNION ALL FROM {name}_o) GROUP BY id)"""


_SHARED = "len(list_intersect({a}, {b}))"


def _sql_likeness(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))::DOUBLE"
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {both} / (len({a}) + len({b}) - {both}) END"


ORACLE = f"""
WITH d AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents),
n AS (SELECT id, t, coalesce(lead(id) OVER (ORDER BY id DESC), (SELECT max(id) FROM d)) AS next FROM d),
e AS (SELECT n.id, n.next, n.t AS own, left(n.t, length(n.t) - length(n.t) // 3) || left(x.t, length(n.t) // 3) AS t FROM n JOIN d x ON x.id = n.next),
{_sql_sets("s", "d")},
{_sql_sets("z", "e")},
j AS (SELECT e.id, length(e.own) AS n_chars, sha256(e.t) AS edited_sha256, coalesce(s.s, []) AS a, coalesce(z.s, []) AS b, coalesce(y.s, []) AS c
      FROM e LEFT JOIN s ON s.id = e.id LEFT JOIN z ON z.id = e.id LEFT JOIN s y ON y.id = e.next)
SELECT id AS doc_id, CAST(n_chars AS BIGINT) AS n_chars, edited_sha256, array_to_string(a, ',') AS fingerprint, array_to_string(b, ',') AS edited_fingerprint,
       {_sql_likeness("a", "b")} AS near_edited, {_sql_likeness("a", "c")} AS near_next
FROM j
"""
