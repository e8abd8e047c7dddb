"""Nested documents: predicates, projection, unnesting and aggregates over dotted paths through structs and arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPS: dict[str, Callable[[Column, object], Column]] = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def _walk(c: Column, t: T.DataType, path: list[str], at_leaf: Callable[[Column, T.DataType], Column]) -> Column:
    """at_leaf over whatever a path leads to; below an array it is an array of what its elements lead to."""
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _walk(x, t.elementType, path, at_leaf))
    if not path:
        return at_leaf(c, t)
    return _walk(c[path[0]], t[path[0]].dataType, path[1:], at_leaf)


def _any(c: Column, t: T.DataType, path: list[str], test: Callable[[Column], Column]) -> Column:
    if isinstance(t, T.ArrayType):
        return F.exists(c, lambda x: F.coalesce(_any(x, t.elementType, path, test), F.lit(False)))
    if not path:
        return test(c)
    return _any(c[path[0]], t[path[0]].dataType, path[1:], test)


def path_filter(docs: DataFrame, path: str, value, op: str = "=") -> DataFrame:
    """Rows where any value that the path leads to compares so; nulls don't."""
    root, *rest = path.split(".")
    return docs.where(_any(F.col(root), docs.schema[root].dataType, rest, lambda x: OPS[op](x, F.lit(value))))


def path_project(docs: DataFrame, *paths: str) -> DataFrame:
    """One column a path, named by it; below arrays an array."""
    out = []
    for p in paths:
        root, *rest = p.split(".")
        out.append(_walk(F.col(root), docs.schema[root].dataType, rest, lambda c, t: c).alias(p))
    return docs.select(*out)


def path_unnest(docs: DataFrame, path: str, name: str = "element") -> DataFrame:
    """A row for each element of the array at a path, with _unnest_index."""
    root, *rest = path.split(".")
    c = F.col(root)
    for p in rest:
        c = c[p]
    return docs.select("*", F.posexplode(c).alias("_unnest_index", name))


def path_aggregate(docs: DataFrame, path: str, how: str, name: str | None = None) -> DataFrame:
    """count, sum, avg, min or max over the array that a path leads to in each row, nulls left out; of nothing null, count 0."""
    root, *rest = path.split(".")
    values = _walk(F.col(root), docs.schema[root].dataType, rest, lambda c, t: c)
    some = F.filter(values, lambda x: x.isNotNull())
    total = F.aggregate(some, F.lit(0.0), lambda s, x: s + x.cast("double"))
    n = F.size(some)
    made = {"count": F.coalesce(n, F.lit(0)), "sum": F.when(n > 0, total), "avg": F.when(n > 0, total / n), "min": F.array_min(some), "max": F.array_max(some)}[how]
    return docs.withColumn(name or f"{how}_{path.replace('.', '_')}", made)
