import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names that operators use inside.
CLASHES = ("words", "lines", "pos", "key", "size", "pattern", "fp", "bucket", "guest", "rank", "salt", "n", "h", "score", "signatures", "votes", "row", "base", "component_id")


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randint(0, vocabulary)}x" for _ in range(n))


def texts(rng):
    """Plain, near, equal, empty, blank, odd and very long texts."""
    base = [words(rng, rng.randint(1, 120)) for _ in range(25)]
    near = [t.rsplit(" ", 1)[0] + " zz" for t in base[:8] if " " in t]
    lines = ["\n".join(words(rng, 9) for _ in range(rng.randint(1, 9))) for _ in range(10)]
    odd = [None, "", " \t\n ", "a", "a\n\n\nb", "x" * 3000, "éß 中文 \U0001f600 words", "Mail a@b.co now", "\r\n", "the the the the", "a\x0bb\x0cc", words(rng, 40_000)]
    return base + near + base[:5] + lines + lines[:3] + odd


@pytest.fixture(scope="session")
def rows():
    rng = random.Random(11)
    out = [(i * 3, t, "en", None if i % 11 == 0 else f"s{i % 4}", None if t is None else len(t)) for i, t in enumerate(texts(rng))]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture
def make(spark):
    return lambda rows: spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], DOCS)


@pytest.fixture(scope="session")
def clashing(spark, docs):
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(1).alias(c) for c in CLASHES])
