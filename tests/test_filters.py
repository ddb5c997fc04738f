import random

import pytest
from pyspark.sql import types as T

from vecloom.functions.filters import ColumnKeys, FilterError, Test, compile_filter, filter_to_json, matches, parse_filter
from vecloom.types import METADATA, tagged_map

RECORDS = [
    {"tag": "a", "score": 5},
    {"tag": "b", "score": 5.0},
    {"tag": "a", "score": 6, "flag": True},
    {"score": "5"},
    {"tag": 5, "flag": False},
    {"score": True},
    {"score": 2**53 + 1},
    {"score": 2**53},
    {},
    None,
]
FILTERS = [
    {"tag": "a"}, {"score": 5}, {"score": 5.0}, {"score": {"$eq": True}}, {"score": {"$ne": 5}}, {"flag": True}, {"flag": {"$ne": True}},
    {"score": {"$gt": 5}}, {"score": {"$gte": 5.0}}, {"score": {"$lt": 6}}, {"score": {"$lte": 5}}, {"score": {"$in": [5, "5", True]}},
    {"score": {"$nin": [5]}}, {"score": {"$in": []}}, {"score": {"$nin": []}}, {"missing": {"$nin": [1]}}, {"missing": {"$ne": 1}},
    {"score": 2**53 + 1}, {"$and": [{"tag": "a"}, {"score": {"$gt": 5}}]}, {"$or": [{"tag": "b"}, {"flag": False}]}, {"tag": "a", "score": {"$gt": 4, "$lt": 6}},
    {"$and": [{"$or": [{"tag": "a"}, {"tag": "b"}]}, {"score": {"$ne": 6}}], "score": {"$gte": 1}},
]


@pytest.fixture(scope="module")
def records(spark):
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("metadata", METADATA)])
    return spark.createDataFrame([(i, tagged_map(m)) for i, m in enumerate(RECORDS)], schema).cache()


@pytest.mark.parametrize("test", FILTERS, ids=str)
def test_compiled_filter_agrees_with_python(records, test):
    node = parse_filter(test)
    want = [i for i, m in enumerate(RECORDS) if matches(node, m)]
    for two_valued in (True, False):
        assert sorted(r["n"] for r in records.where(compile_filter(node, two_valued=two_valued)).collect()) == want
    assert parse_filter(filter_to_json(node)) == node


def test_compiled_filter_is_never_null(records):
    for test in FILTERS:
        assert records.where(compile_filter(test).isNull()).isEmpty()


def test_random_filters(records):
    rng = random.Random(3)
    values = ["a", "b", 5, 5.0, 6, True, False, "5"]

    def some(depth):
        if depth and rng.random() < 0.5:
            return {rng.choice(["$and", "$or"]): [some(depth - 1) for _ in range(rng.randint(1, 3))]}
        op = rng.choice(["$eq", "$ne", "$gt", "$lte", "$in", "$nin"])
        value = rng.sample(values, rng.randint(0, 3)) if op in ("$in", "$nin") else rng.choice([5, 5.5, 6]) if op in ("$gt", "$lte") else rng.choice(values)
        return {rng.choice(["tag", "score", "flag", "none"]): {op: value}}

    for _ in range(25):
        node = parse_filter(some(2))
        assert sorted(r["n"] for r in records.where(compile_filter(node)).collect()) == [i for i, m in enumerate(RECORDS) if matches(node, m)]
        assert parse_filter(filter_to_json(node)) == node


# The names of errors that users of the filter language know.
@pytest.mark.parametrize(
    "source, kind",
    [
        ([], "ExpectedObject"), ({}, "EmptyList"), ({"$or": []}, "EmptyList"), ({"$and": []}, "EmptyList"), ({"a": {}}, "EmptyOps"), ({"a": {"$x": 1}}, "UnknownOperator"),
        ({"$or": [{"a": 1}], "b": 1}, "OrWithOtherKeys"), ({"$or": [{"a": 1}], "$and": [{"a": 1}]}, "AndOrConflict"), ({"a": {"$gt": "x"}}, "ExpectedNumber"), ({"a": {"$gt": True}}, "ExpectedNumber"),
        ({"a": {"$in": 1}}, "ExpectedArray"), ({"a": None}, "InvalidValue"), ({"a": [1]}, "InvalidValue"), ({"a": {"$in": [None]}}, "InvalidValue"), ("{", "InvalidJson"),
    ],
)
def test_parse_errors(source, kind):
    with pytest.raises(FilterError) as error:
        parse_filter(source)
    assert error.value.kind == kind


def test_parser_shapes():
    assert parse_filter({"$and": [], "x": 1}) == Test("x", "$eq", 1)
    assert parse_filter({"$foo": 1}) == Test("$foo", "$eq", 1)
    assert parse_filter({"$or": [{"x": 1}]}) == Test("x", "$eq", 1)
    assert parse_filter({"x": 2**64}) == Test("x", "$eq", float(2**64))


def test_column_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, "b")], "n long, lang string").write.parquet(path)
    df = spark.read.parquet(path).where(compile_filter({"lang": "a", "n": {"$gte": 1}}, ColumnKeys({"lang": ("lang", "s"), "n": ("n", "i")}), two_valued=False))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(lang,a)" in plan and "GreaterThanOrEqual(n,1)" in plan
    assert [r["n"] for r in df.collect()] == [1]
