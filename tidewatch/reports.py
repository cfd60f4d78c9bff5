"""Small reports of query results: JSON and Markdown. Reports are of bounded size; whole results go to stores."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.stores import Files

TOP = 15


def plain(value):
    return str(value) if isinstance(value, (datetime.date, datetime.datetime)) else value


def top_rows(frame: DataFrame, by: str | None = None, most: int = TOP) -> list[dict]:
    """The first rows by a column, greatest first, ties by all columns; a report's length is its point."""
    order = [F.desc(by)] if by else []
    rows = frame.orderBy(*order, *(c for c in frame.columns if c != by)).limit(most).collect()
    return [{c: plain(r[c]) for c in frame.columns} for r in rows]


def summary(frame: DataFrame) -> dict:
    """Rows in all, and for each number its least, mean and greatest, in one pass."""
    numbers = [f.name for f in frame.schema if f.dataType.typeName() in ("integer", "long", "double", "float")]
    r = frame.agg(F.count(F.lit(1)).alias("_n"), *(f(c).alias(f"{c}:{k}") for c in numbers for k, f in (("min", F.min), ("mean", F.avg), ("max", F.max)))).first()
    return {"rows": r["_n"], "numbers": {c: {k: r[f"{c}:{k}"] for k in ("min", "mean", "max")} for c in numbers}}


def write_json(spark, path: str, report: dict) -> None:
    Files(spark, path).write(path, json.dumps(report, indent=1, sort_keys=True, default=str))


def markdown(title: str, rows: list[dict]) -> str:
    if not rows:
        return f"# {title}\n\nNo rows.\n"
    names = list(rows[0])
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"| {' | '.join(names)} |", f"|{'-|' * len(names)}", *(f"| {' | '.join(cell(r[c]) for c in names)} |" for r in rows)]
    return f"# {title}\n\n" + "\n".join(lines) + "\n"
