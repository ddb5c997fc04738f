"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.operators import sieve as bitmap

#: The ASCII white space that ends a word: space and the characters 9 to 13.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name that driver and executors can all reach, under
    ``spark.checkpoint.dir``. Only a session on one machine may do without the setting."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if base is None:
        if not context._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="vecloom-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/vecloom-{uuid.uuid4().hex}"


#: Tables that ``cut`` has written and nobody has deleted.
_written: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: a short lineage, and
    rows that stay the same when a lost executor's tasks run again. The table stays
    until ``release``, as results are read from it later."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """The place in the list of written tables, for ``release``."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete the tables written since ``mark`` said so, but those that ``keep`` reads.
    To be called once the results that were made of them are written."""
    used = set() if keep is None else {f.rsplit("/", 1)[0].rsplit("/", 1)[1] for f in keep.inputFiles()}
    kept = []
    for path in _written[since:]:
        if path.rsplit("/", 1)[1] in used:
            kept.append(path)
        else:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _written[since:] = kept


def _drop(spark: SparkSession, start: int, end: int) -> None:
    """Delete the tables from one place in the list of written ones to another."""
    for path in _written[start:end]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    del _written[start:end]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lit_array(values, kind: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def slices(batch, rows: int = 256):
    """Short runs of an Arrow batch, so that few decoded texts are in memory at once."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


#: Bits of a ``sieve``.
SIEVE = 1 << 23


def sieve(rows: DataFrame, key: Column) -> DataFrame:
    return bitmap.sieve(rows, key, SIEVE)


def sieved(rows: DataFrame, key: Column, through: DataFrame, caught: bool = True) -> DataFrame:
    return bitmap.sieved(rows, key, through, caught, SIEVE)


#: How often ``linked`` compares all sets of a bucket with one of them, at most.
STARS = 3


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): one row (node, root) for each
    node of an edge, root being the smallest node reachable.

    Alternating star contraction: every round is two joins with partially
    aggregated minima, so a node with very many edges is split like any skewed
    join key, and the number of rounds grows with the logarithm of the nodes.
    """
    before = mark()
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        # every larger neighbour of a node gets the node's smallest neighbour
        big = edges.join(low, edges.b == low.k).select("a", F.col("m").alias("b")).where("a <> b").distinct()
        # every node hands its smallest neighbour to its other smaller ones
        least = big.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = big.join(least, big.a == least.k).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = cut(small.select("e.a", "e.b").where("a <> b").distinct())
        # whole sums of 64-bit hashes, in decimals, which don't overflow
        whole = lambda h: F.sum(h.cast("decimal(20,0)"))
        now = edges.agg(F.count(F.lit(1)), whole(F.xxhash64("a", "b")), whole(F.xxhash64("b", "a"))).first()
        if now == seen:
            _drop(edges.sparkSession, before, len(_written) - 1)
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = now


def linked(members: DataFrame, alike, verified, attributes: list[str], finer=None) -> DataFrame:
    """Connected components (node, root) of sets that share a bucket: ``members`` (bucket,
    id, ``attributes``), written. ``alike(a, b)`` says, from the attributes behind the
    prefixes a and b, whether two sets are worth comparing; ``verified`` keeps those of
    the pairs (a, b) that are linked, and writes them.

    First each set of a bucket is compared with one of them only, another one in each
    bucket, so that a large group of copies costs a comparison a member and meets many
    of its own. While sets outside their buckets' largest groups would still meet too
    many others, this is done again with other sets in the middle. Then what that left
    apart: sets outside a bucket's largest group with all others of the bucket. No pair
    that shares a bucket and isn't connected by then stays unlooked at. ``finer`` (a table
    by id, and what it says of two sets behind prefixes) is asked there, inside the join:
    only pairs that it can't rule out become rows.
    """
    one = ["id", *attributes]
    members = members.select("bucket", *one)
    prefixed = lambda rows, side: rows.select(*[F.col(c).alias(f"{side}{c}") for c in rows.columns])
    pair = (F.greatest("x_id", "y_id").alias("a"), F.least("x_id", "y_id").alias("b"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("bucket")
    members = cut(members.join(shared, "bucket"))
    total = members.count()
    # at first every set is a group of its own, and no group is the largest
    parted = members.withColumns({"group": F.col("id"), "main": F.lit(None).cast("long")})
    edges = tried = None
    for turn in range(STARS):
        inside = F.coalesce(F.col("group") == F.col("main"), F.lit(False)).alias("inside")
        centers = parted.groupBy("bucket", inside).agg(F.min_by(F.struct(*one, "group"), F.xxhash64(F.lit(turn), "bucket", "id")).alias("c"))
        centers = prefixed(centers.select("bucket", *[F.col(f"c.{c}") for c in (*one, "group")]), "y_")
        stars = prefixed(parted.drop("main"), "x_").join(centers, F.col("x_bucket") == F.col("y_bucket")).where((F.col("x_group") != F.col("y_group")) & alike("x_", "y_"))
        new = stars.select(*pair).distinct()
        new = cut(new if tried is None else new.join(tried, ["a", "b"], "left_anti"))
        tried = new if tried is None else tried.union(new)
        edges = verified(new) if edges is None else edges.union(verified(new))
        roots = cut(components(edges))
        grouped = cut(members.join(roots, members.id == roots.node, "left").withColumn("group", F.coalesce("root", "id")).drop("node", "root"))
        main = grouped.groupBy("bucket", "group").agg(F.count(F.lit(1)).alias("rows")).groupBy("bucket").agg(F.max(F.struct("rows", "group")).alias("m"), F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
        main = cut(main.select("bucket", F.col("m.group").alias("main"), "rows", (F.col("rows") - F.col("m.rows")).alias("outside")))
        parted = cut(grouped.join(main.select("bucket", "main"), "bucket"))
        if (main.agg(F.sum(F.col("rows") * F.col("outside"))).first()[0] or 0) <= 2 * total:
            break
    maybe = (F.col("x_group") != F.col("y_group")) & alike("x_", "y_")
    # two sets outside the largest group meet twice
    maybe &= (F.col("y_group") == F.col("x_main")) | (F.col("x_id") > F.col("y_id"))
    if finer is not None:
        parted = cut(parted.join(finer[0], "id"))
        maybe &= finer[1]("x_", "y_")
    outside = prefixed(parted.where("group <> main"), "x_")
    more = outside.join(prefixed(parted.drop("main"), "y_"), F.col("x_bucket") == F.col("y_bucket")).where(maybe)
    more = cut(more.select(*pair).distinct().join(tried, ["a", "b"], "left_anti"))
    return components(edges.union(verified(more)))
