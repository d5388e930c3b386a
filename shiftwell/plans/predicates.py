"""Key comparisons and lexicographic ranges as Columns that are pushed to the scan."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SIGNS = {"<": Column.__lt__, "<=": Column.__le__, "=": Column.__eq__, ">=": Column.__ge__, ">": Column.__gt__, "!=": Column.__ne__}


def compare(column: str, value, sign: str, kind: T.DataType | None = None) -> Column:
    """column <sign> value, value as a literal of the column's type."""
    if not column:
        raise ValueError("a comparison needs a column")
    if sign not in _SIGNS:
        raise ValueError(f"no such sign: {sign}")
    v = F.lit(value)
    return _SIGNS[sign](F.col(column), v.cast(kind) if kind is not None else v)


def _kinds(columns: Sequence[str], schema: T.StructType | None) -> list[T.DataType | None]:
    return [schema[c].dataType if schema is not None else None for c in columns]


def equals(columns: Sequence[str], values: Sequence, schema: T.StructType | None = None) -> Column:
    """All columns equal their values."""
    _check(columns, values)
    return reduce(Column.__and__, (compare(c, v, "=", k) for c, v, k in zip(columns, values, _kinds(columns, schema), strict=True)))


def lexicographic(columns: Sequence[str], values: Sequence, sign: str, schema: T.StructType | None = None) -> Column:
    """The tuple comparison (columns) <sign> (values) as an OR of conjunctions.

    Plain three-valued comparisons: a null key fits no range.  Unlike a
    comparison of structs, this form is pushed down to Parquet.
    """
    _check(columns, values)
    strict, kinds = sign.rstrip("="), _kinds(columns, schema)
    if strict not in ("<", ">"):
        raise ValueError(f"no range sign: {sign}")
    parts, same = [], None
    for c, v, k in zip(columns, values, kinds, strict=True):
        less = compare(c, v, strict, k)
        parts.append(less if same is None else same & less)
        eq = compare(c, v, "=", k)
        same = eq if same is None else same & eq
    if sign.endswith("="):
        parts.append(same)
    return reduce(Column.__or__, parts)


def between(columns: Sequence[str], start: Sequence, end: Sequence, inclusive: bool = False, schema: T.StructType | None = None) -> Column:
    """A chunk: keys above start (from start on if inclusive) up to end.

    Bounds on the first column are implied; said aloud they prune row groups.
    """
    bounds = compare(columns[0], start[0], ">=", _kinds(columns, schema)[0]) & compare(columns[0], end[0], "<=", _kinds(columns, schema)[0])
    return bounds & lexicographic(columns, start, ">=" if inclusive else ">", schema) & lexicographic(columns, end, "<=", schema)


def union_ranges(df: DataFrame, columns: Sequence[str], start: Sequence, end: Sequence, inclusive: bool = False) -> DataFrame:
    """The rows of ``between`` for a key of two columns as a union of disjoint ranges."""
    a, b = columns
    first, low, high = (">=" if inclusive else ">"), lexicographic, compare
    if start[0] == end[0]:
        return df.where(equals([a], [start[0]]) & high(b, start[1], first) & high(b, end[1], "<="))
    head = df.where(equals([a], [start[0]]) & high(b, start[1], first))
    body = df.where(low([a], [start[0]], ">") & low([a], [end[0]], "<"))
    tail = df.where(equals([a], [end[0]]) & high(b, end[1], "<="))
    return head.unionAll(body).unionAll(tail)


def _check(columns: Sequence[str], values: Sequence) -> None:
    if not columns or len(columns) != len(values):
        raise ValueError("as many values as columns, and at least one, are needed")
