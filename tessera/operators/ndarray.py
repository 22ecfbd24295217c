"""Sparse N-dimensional arrays as long tables: one row for each version of a cell.

Columns: the dimensions, the attributes, `sys` (when the version was written), `tag` ('live', 'tombstone' or 'erased'), and
valid_from, valid_until. A cell's current version is its newest; an erased cell has no history either.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

META = ("sys", "tag", "valid_from", "valid_until")


def _others(df: DataFrame, dims: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in dims]


def live(cells: DataFrame, dims: Sequence[str], as_of: int | None = None, valid_at: int | None = None) -> DataFrame:
    """The newest version of each cell (written no later than as_of) if it is live (and valid at valid_at)."""
    gone = cells.where("tag = 'erased'").select(*dims).distinct()
    own = cells.join(gone, list(dims), "left_anti")
    if as_of is not None:
        own = own.where(F.col("sys") <= as_of)
    rest = _others(own, dims)
    newest = own.groupBy(*dims).agg(F.max_by(F.struct(*rest), "sys").alias("_v")).select(*dims, "_v.*").where("tag = 'live'")
    if valid_at is not None:
        newest = newest.where((F.col("valid_from") <= valid_at) & (F.col("valid_until").isNull() | (F.col("valid_until") > valid_at)))
    return newest


def array_slice(cells: DataFrame, dims: Sequence[str], ranges: dict[str, tuple[int | None, int | None]], attrs: Sequence[str] | None = None, as_of: int | None = None, valid_at: int | None = None, limit: int | None = None) -> DataFrame:
    """Live cells with every dimension in its inclusive range; ranges are applied before versions are resolved."""
    for d, (lo, hi) in ranges.items():
        if lo is not None:
            cells = cells.where(F.col(d) >= lo)
        if hi is not None:
            cells = cells.where(F.col(d) <= hi)
    attrs = [c for c in _others(cells, dims) if c not in META] if attrs is None else attrs
    out = live(cells, dims, as_of, valid_at).select(*dims, *attrs, "valid_from", "valid_until")
    return out if limit is None else out.orderBy(*dims).limit(limit)


def array_project(cells: DataFrame, dims: Sequence[str], attrs: Sequence[str]) -> DataFrame:
    return live(cells, dims).select(*dims, *attrs, "valid_from", "valid_until")


def array_aggregate(cells: DataFrame, dims: Sequence[str], attr: str, how: str, by: str | None = None) -> DataFrame:
    """`value`, or `key` and `value` by one dimension, of the live cells; how: sum, count, min, max, mean."""
    f = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "mean": F.avg}[how](attr).alias("value")
    own = live(cells, dims)
    return own.agg(f) if by is None else own.groupBy(F.col(by).alias("key")).agg(f)


def array_elementwise(a: DataFrame, b: DataFrame, dims: Sequence[str], attr: str, op: str) -> DataFrame:
    """dims and `value` = a op b of live cells; a cell that only one side has is null."""
    x, y = live(a, dims).select(*dims, F.col(attr).alias("_x")), live(b, dims).select(*dims, F.col(attr).alias("_y"))
    u, v = F.col("_x"), F.col("_y")
    value: Column = {"add": u + v, "sub": u - v, "mul": u * v, "div": u / v}[op]
    return x.join(y, list(dims), "full").select(*dims, value.alias("value"))


def array_put(cells: DataFrame, new: DataFrame, dims: Sequence[str], bounds: dict[str, tuple[int, int]] | None = None, required: Sequence[str] = ()) -> DataFrame:
    """cells with new versions; a coordinate out of bounds or a missing required attribute is an error."""
    bad = F.lit(False)
    for d, (lo, hi) in (bounds or {}).items():
        bad = bad | ~F.col(d).between(lo, hi) | F.col(d).isNull()
    for a in required:
        bad = bad | F.col(a).isNull()
    first = cells.columns[0]
    checked = new.withColumn(first, F.when(bad, F.raise_error(F.lit("cell out of bounds or incomplete")).cast(new.schema[first].dataType)).otherwise(F.col(first)))
    return cells.unionByName(checked)


def array_delete(cells: DataFrame, keys: DataFrame, dims: Sequence[str], sys: int, tag: str = "tombstone") -> DataFrame:
    """cells with a tombstone (or, tag 'erased', an erasure that hides the history) for each key."""
    rest = [c for c in _others(cells, dims) if c not in META]
    marks = keys.select(*dims, *[F.lit(None).cast(cells.schema[c].dataType).alias(c) for c in rest], F.lit(sys).cast(cells.schema["sys"].dataType).alias("sys"), F.lit(tag).alias("tag"), F.lit(None).cast(cells.schema["valid_from"].dataType).alias("valid_from"), F.lit(None).cast(cells.schema["valid_until"].dataType).alias("valid_until"))
    return cells.unionByName(marks)


def array_compacted(cells: DataFrame, dims: Sequence[str], keep_since: int | None = None) -> DataFrame:
    """Current versions only, or with those written since keep_since."""
    rest = _others(cells, dims)
    newest = cells.groupBy(*dims).agg(F.max_by(F.struct(*rest), "sys").alias("_v")).select(*dims, "_v.*").select(*cells.columns)
    if keep_since is None:
        return newest
    return newest.unionByName(cells.where(F.col("sys") >= keep_since)).distinct()


def surrogates(cells: DataFrame, dims: Sequence[str], ranges: dict[str, tuple[int | None, int | None]], id_col: str) -> DataFrame:
    """The distinct ids in a slice, as a prefilter for a search."""
    return array_slice(cells, dims, ranges, [id_col]).select(id_col).distinct()
