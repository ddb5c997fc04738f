"""Metadata filters: JSON to a small tree, and the tree to a Column.

A filter decides which records are eligible and never how they rank. Values are typed:
a string never equals a number, a boolean never equals either, integers and floats
compare as numbers. An absent key fails every test but ``$nin``; ``$ne`` asks for a
key that is present and differs.

``compile_filter`` gives a two-valued Column, so callers may negate or combine it.
Two resolvers turn a key into Columns: ``MapKeys`` reads a metadata map, ``ColumnKeys``
reads physical columns, which lets Parquet skip row groups.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vecloom.types import ValidationError

COMPARE = ("$gt", "$gte", "$lt", "$lte")
MEMBER = ("$in", "$nin")
FIELD_OPS = ("$eq", "$ne", *COMPARE, *MEMBER)


class FilterError(ValidationError):
    """``kind``: what is wrong with the filter."""

    def __init__(self, kind: str, message: str):
        super().__init__(f"{kind}: {message}")
        self.kind = kind


@dataclass(frozen=True)
class Test:
    __test__ = False  # not a test case
    key: str
    op: str
    value: object  # a scalar, or a tuple of scalars for $in and $nin


@dataclass(frozen=True)
class Every:
    parts: tuple


@dataclass(frozen=True)
class Some:
    parts: tuple


Node = Test | Every | Some


def parse_filter(source: str | dict) -> Node:
    if isinstance(source, str):
        try:
            source = json.loads(source)
        except ValueError as error:
            raise FilterError("InvalidJson", str(error)) from None
    return _object(source)


def _object(source) -> Node:
    if not isinstance(source, dict):
        raise FilterError("ExpectedObject", "a filter is an object")
    if "$and" in source and "$or" in source:
        raise FilterError("AndOrConflict", "$and and $or can't stand side by side")
    if "$or" in source:
        if len(source) > 1:
            raise FilterError("OrWithOtherKeys", "$or stands alone")
        return _one_or(Some, [_object(x) for x in _list("$or", source["$or"])])
    parts: list[Node] = []
    for key, value in source.items():
        if key == "$and":
            parts += [_object(x) for x in _list(key, value)]
        else:
            parts += _field(key, value)
    return _one_or(Every, parts)


def _one_or(kind, parts: list[Node]) -> Node:
    if not parts:
        raise FilterError("EmptyList", "nothing to test")
    return parts[0] if len(parts) == 1 else kind(tuple(parts))


def _list(op: str, value) -> list:
    if not isinstance(value, list):
        raise FilterError("ExpectedArray", f"{op} takes a list")
    return value


def _field(key: str, value) -> list[Node]:
    """A field's tests; several of them hold together, as one node."""
    if not isinstance(value, dict):
        return [Test(key, "$eq", _scalar(value))]
    if not value:
        raise FilterError("EmptyOps", f"no test for {key!r}")
    tests = []
    for op, operand in value.items():
        if op in MEMBER:
            tests.append(Test(key, op, tuple(_scalar(x) for x in _list(op, operand))))
        elif op in COMPARE:
            if isinstance(operand, bool) or not isinstance(operand, int | float):
                raise FilterError("ExpectedNumber", f"{op} takes a number")
            tests.append(Test(key, op, _scalar(operand)))
        elif op in FIELD_OPS:
            tests.append(Test(key, op, _scalar(operand)))
        else:
            raise FilterError("UnknownOperator", op)
    return [_one_or(Every, tests)]


def _scalar(value):
    if value is None or isinstance(value, list | dict):
        raise FilterError("InvalidValue", "a value is a string, a boolean or a number")
    if isinstance(value, int) and not isinstance(value, bool) and not -(1 << 63) <= value < 1 << 63:
        return float(value)
    return value


def filter_to_json(node: Node) -> dict:
    """The canonical form: every test spelled with its operator."""
    if isinstance(node, Test):
        value = list(node.value) if isinstance(node.value, tuple) else node.value
        return {node.key: {node.op: value}}
    return {"$and" if isinstance(node, Every) else "$or": [filter_to_json(p) for p in node.parts]}


def matches(node: Node, metadata: dict | None) -> bool:
    """The same decision for one record in Python; tests compare the two."""
    if isinstance(node, Every):
        return all(matches(p, metadata) for p in node.parts)
    if isinstance(node, Some):
        return any(matches(p, metadata) for p in node.parts)
    have = (metadata or {}).get(node.key)
    if node.op == "$nin":
        return have is None or not any(_same(have, v) for v in node.value)
    if have is None:
        return False
    if node.op == "$in":
        return any(_same(have, v) for v in node.value)
    if node.op in ("$eq", "$ne"):
        return _same(have, node.value) == (node.op == "$eq")
    if isinstance(have, bool | str):
        return False
    return {"$gt": have > node.value, "$gte": have >= node.value, "$lt": have < node.value, "$lte": have <= node.value}[node.op]


def _kind(value) -> type:
    return bool if isinstance(value, bool) else str if isinstance(value, str) else float


def _same(a, b) -> bool:
    return _kind(a) is _kind(b) and a == b


@dataclass(frozen=True)
class Typed:
    """A key as one Column for each type that it may have; None: never has it."""

    present: Column
    s: Column | None = None
    b: Column | None = None
    i: Column | None = None
    f: Column | None = None


class MapKeys:
    """Keys of a metadata map column."""

    def __init__(self, column: str | Column = "metadata"):
        self.map = F.col(column) if isinstance(column, str) else column

    def __call__(self, key: str) -> Typed:
        value = F.try_element_at(self.map, F.lit(key))
        return Typed(value.isNotNull(), *(value.getField(k) for k in "sbif"))


class ColumnKeys:
    """Keys that are columns: {key: (column, kind)}, kind being one of s, b, i, f."""

    def __init__(self, columns: dict[str, tuple[str, str]]):
        self.columns = columns

    def __call__(self, key: str) -> Typed:
        if key not in self.columns:
            return Typed(F.lit(False))
        name, kind = self.columns[key]
        return Typed(F.col(name).isNotNull(), **{kind: F.col(name)})


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def _yes(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def _as_is(test: Column) -> Column:
    return test


def _equals(at: Typed, values, yes=_yes) -> Column:
    """Whether the key equals one of the values, each within its type."""
    tests = []
    strings = [v for v in values if isinstance(v, str)]
    flags = [v for v in values if isinstance(v, bool)]
    whole = [v for v in values if isinstance(v, int) and not isinstance(v, bool)]
    reals = [v for v in values if isinstance(v, float)]
    if strings and at.s is not None:
        tests.append(yes(at.s.isin(strings)))
    if flags and at.b is not None:
        tests.append(yes(at.b.isin(flags)))
    if at.i is not None:
        # integers compare as integers, so that those beyond 2^53 stay apart
        if whole:
            tests.append(yes(at.i.cast("long").isin(whole)))
        if reals:
            tests.append(yes(at.i.cast("double").isin(reals)))
    if at.f is not None and (whole or reals):
        tests.append(yes(at.f.isin([float(v) for v in whole + reals])))
    return _any(tests)


def _ordered(at: Typed, op: str, value, yes=_yes) -> Column:
    def test(have: Column, want: Column) -> Column:
        return yes({"$gt": have > want, "$gte": have >= want, "$lt": have < want, "$lte": have <= want}[op])

    tests = []
    if at.i is not None:
        tests.append(test(at.i, F.lit(value).cast("long")) if isinstance(value, int) else test(at.i.cast("double"), F.lit(value)))
    if at.f is not None:
        tests.append(test(at.f, F.lit(float(value))))
    return _any(tests)


def compile_filter(node: Node | dict | str, keys=None, two_valued: bool = True) -> Column:
    """A Column that is true for eligible records. With ``two_valued`` it is never
    null; without, null stands for false, which ``where`` treats alike and Parquet
    readers can push down."""
    keys = keys or MapKeys()
    if isinstance(node, dict | str):
        node = parse_filter(node)
    if isinstance(node, Every | Some):
        parts = [compile_filter(p, keys, two_valued) for p in node.parts]
        return reduce((lambda a, b: a & b) if isinstance(node, Every) else (lambda a, b: a | b), parts)
    at, yes = keys(node.key), _yes if two_valued else _as_is
    if node.op == "$eq":
        return _equals(at, [node.value], yes)
    if node.op == "$ne":
        return at.present & ~_equals(at, [node.value])
    if node.op == "$in":
        return _equals(at, node.value, yes)
    if node.op == "$nin":
        return ~_equals(at, node.value)
    return _ordered(at, node.op, node.value, yes)
