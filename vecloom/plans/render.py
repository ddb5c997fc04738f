"""Results as text: a table, JSON, CSV or one field a line."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame

from vecloom.types import MAX_IDS, ValidationError, untagged_map

#: Characters of a document that a table shows.
WIDTH = 40


def _plain(row: dict) -> dict:
    return {k: untagged_map(v) if k == "metadata" else v for k, v in row.items()}


def _cell(name: str, value, width: int | None) -> str:
    if value is None:
        return ""
    if name == "distance":
        return f"{value:.4f}"
    text = json.dumps(value, ensure_ascii=False) if isinstance(value, dict | list) else str(value)
    return text if width is None or len(text) <= width else text[: width - 3] + "..."


def render(df: DataFrame, how: str = "table") -> str:
    """The rows of a result of at most ``MAX_IDS`` rows; they are collected."""
    rows = [_plain(r.asDict()) for r in df.limit(MAX_IDS + 1).collect()]
    if len(rows) > MAX_IDS:
        raise ValidationError(f"more than {MAX_IDS} rows to show: add a LIMIT")
    names = df.columns
    if how == "json":
        return json.dumps(rows, ensure_ascii=False, indent=2)
    if how == "csv":
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(names)
        writer.writerows([_cell(n, r[n], None) for n in names] for r in rows)
        return out.getvalue()
    if not rows:
        return "Empty set"
    if how == "vertical":
        wide = max(map(len, names))
        return "\n".join(f"*** row {i} ***\n" + "\n".join(f"{n:>{wide}}: {_cell(n, r[n], None)}" for n in names) for i, r in enumerate(rows, 1))
    if how != "table":
        raise ValueError(f"unknown format {how!r}")
    cells = [[_cell(n, r[n], WIDTH) for n in names] for r in rows]
    wide = [max(len(x) for x in column) for column in zip(names, *cells)]
    line = "+" + "+".join("-" * (w + 2) for w in wide) + "+"
    show = lambda values: "|" + "|".join(f" {v:<{w}} " for v, w in zip(values, wide)) + "|"
    return "\n".join([line, show(names), line, *map(show, cells), line, f"{len(rows)} rows in set"])
