"""Scalar expressions that Spark has no single function for. All are built-in Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8
_PATH = re.compile(r"\$(\.[A-Za-z_][\w\-]*|\[\d+\]|\[\*\]|\['[^']+'\])*")


def json_path(path: str) -> str:
    """path, or an error if it isn't a well-formed JSONPath (Spark would quietly give nulls)."""
    if not _PATH.fullmatch(path):
        raise ValueError(f"malformed JSONPath: {path!r}")
    return path


def doc_get(doc: Column, path: str, default: Column | None = None) -> Column:
    """The value at path as text, or `default` where there is none."""
    found = F.get_json_object(doc, json_path(path))
    return found if default is None else F.coalesce(found, default)


def doc_exists(doc: Column, path: str) -> Column:
    """Whether path leads to a value; a JSON null is one."""
    return F.try_variant_get(F.try_parse_json(doc), json_path(path), "variant").isNotNull()


def doc_array_contains(doc: Column, path: str, value: object) -> Column:
    """Whether the array at path holds the value (compared as text)."""
    items = F.from_json(F.get_json_object(doc, json_path(path)), "array<string>")
    return F.coalesce(F.array_contains(items, F.lit(str(value))), F.lit(False))


def ts_stddev(x: Column) -> Column:
    """Population standard deviation; null below two inputs."""
    return F.when(F.count(x) >= 2, F.stddev_pop(x))


def exact_sum(x: Column) -> Column:
    """A sum that integers can't overflow."""
    return F.sum(x.cast("decimal(38,0)"))


def exact_total(x: Column) -> Column:
    """A sum of doubles that doesn't depend on the order of rows, where all values have at most 10 decimals (and 18 digits before them); else the sum of doubles."""
    d = x.try_cast("decimal(28,10)")
    exact = F.bool_and(F.coalesce(d.cast("double") == x, x.isNull()))
    return F.when(exact, F.sum(d).cast("double")).otherwise(F.sum(x.cast("double")))


def exact_avg(x: Column) -> Column:
    """An average that doesn't depend on the order of rows, as far as exact_total() doesn't."""
    return exact_total(x) / F.nullif(F.count(x), F.lit(0))


def negated(condition: Column) -> Column:
    """NOT as `condition = false`: null stays null."""
    return condition == F.lit(False)


def glob(key: Column, pattern: str) -> Column:
    """Whether key matches a pattern of * and ?."""
    parts = [".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern]
    return key.rlike("(?s)^" + "".join(parts) + "$")


def _total(pairs: Column) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def _zipped(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))


def _dot(a: Column, b: Column) -> Column:
    return _total(_zipped(a, b, lambda x, y: x * y))


METRICS = ("l2", "cosine", "inner_product", "manhattan", "chebyshev", "hamming", "jaccard", "pearson")


def vector_distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """The distance of two numeric arrays; less is nearer. Arrays of different lengths raise an error.

    inner_product is the negative dot product; cosine and pearson are one minus the similarity (1 where a norm or
    variance is zero); hamming counts places that differ; jaccard is one minus the share of places where both are
    non-zero among those where either is.
    """
    n = F.size(a)
    norm = lambda v: F.sqrt(_total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    if metric == "l2":
        d = F.sqrt(_total(_zipped(a, b, lambda x, y: (x - y) * (x - y))))
    elif metric == "cosine":
        size = norm(a) * norm(b)
        d = F.when(size == 0, F.lit(1.0)).otherwise(F.lit(1.0) - _dot(a, b) / F.nullif(size, F.lit(0.0)))
    elif metric in ("inner_product", "dot"):
        d = -_dot(a, b)
    elif metric == "manhattan":
        d = _total(_zipped(a, b, lambda x, y: F.abs(x - y)))
    elif metric == "chebyshev":
        d = F.aggregate(_zipped(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, x: F.greatest(acc, x))
    elif metric == "hamming":
        d = _total(_zipped(a, b, lambda x, y: F.when(x != y, 1.0).otherwise(0.0)))
    elif metric == "jaccard":
        both = _total(_zipped(a, b, lambda x, y: F.when((x != 0) & (y != 0), 1.0).otherwise(0.0)))
        either = _total(_zipped(a, b, lambda x, y: F.when((x != 0) | (y != 0), 1.0).otherwise(0.0)))
        d = F.when(either == 0, F.lit(0.0)).otherwise(F.lit(1.0) - both / F.nullif(either, F.lit(0.0)))
    elif metric == "pearson":
        mean = lambda v: _total(F.transform(v, lambda x: x.cast("double"))) / F.size(v)
        ma, mb = mean(a), mean(b)
        xy = _dot(a, b) - n * ma * mb
        size = F.sqrt((_dot(a, a) - n * ma * ma) * (_dot(b, b) - n * mb * mb))
        d = F.when(size == 0, F.lit(1.0)).otherwise(F.lit(1.0) - xy / F.nullif(size, F.lit(0.0)))
    else:
        raise ValueError(f"unknown metric {metric!r}")
    return F.when(n == F.size(b), d).otherwise(F.raise_error(F.lit("vectors have different dimensions")).cast("double"))


def vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres on a sphere."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * (2 * EARTH_M)
