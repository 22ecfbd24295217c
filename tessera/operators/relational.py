"""Scans, joins, aggregation, set operations and top-k as functions of DataFrames.

Semantics are those of standard SQL: null keys never join, a global aggregate over no rows gives one row, nulls sort last
ascending and first descending unless told otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Order = tuple[str, str]  # column, "asc" or "desc"
BROADCAST_BYTES = 64 << 20


def constant_result(spark: SparkSession, columns: Sequence[str], values: Sequence[object]) -> DataFrame:
    """One row of literals; what isn't a scalar becomes null."""
    scalar = lambda v: v if isinstance(v, (bool, int, float, str, type(None))) else None
    return spark.range(1).select(*[F.lit(scalar(v)).alias(c) for c, v in zip(columns, values, strict=True)])


def ordering(keys: Sequence[Order]) -> list[Column]:
    """Sort keys with nulls last ascending, first descending."""
    return [F.col(c).asc_nulls_last() if d == "asc" else F.col(c).desc_nulls_first() for c, d in keys]


def scan(df: DataFrame, where: Column | None = None, computed: dict[str, Column] | None = None, order: Sequence[Order] = (), distinct: bool = False, offset: int = 0, limit: int | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Filter, compute (later columns see earlier ones), sort, project, deduplicate, skip and cut, in this order."""
    if where is not None:
        df = df.where(where)
    for name, value in (computed or {}).items():
        df = df.withColumn(name, value)
    if order:
        df = df.orderBy(*ordering(order))
    if columns is not None:
        df = df.select(*columns)
    if distinct:
        df = df.distinct()
        if order and all(c in df.columns for c, _ in order):
            df = df.orderBy(*ordering(order))
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def point_get(df: DataFrame, key: str, value: object, columns: Sequence[str] | None = None) -> DataFrame:
    """The rows of one key; the filter is pushed to the files."""
    return scan(df, F.col(key) == F.lit(value), columns=columns)


def range_scan(df: DataFrame, field: str, lower: object = None, upper: object = None, limit: int | None = None) -> DataFrame:
    """Rows with lower <= field <= upper (None: open), the least first if limited."""
    conditions = [F.col(field) >= F.lit(lower)] * (lower is not None) + [F.col(field) <= F.lit(upper)] * (upper is not None)
    if conditions:
        df = df.where(reduce(lambda a, b: a & b, conditions))
    return df if limit is None else df.orderBy(F.col(field).asc_nulls_last()).limit(limit)


JOINS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}


def prefixed(df: DataFrame, alias: str | None) -> DataFrame:
    return df if alias is None else df.select(*[F.col(f"`{c}`").alias(f"{alias}_{c}") for c in df.columns])


def equi_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], how: str = "inner", residual: Column | None = None, aliases: tuple[str | None, str | None] = (None, None), strategy: str | None = None) -> DataFrame:
    """Join on pairs of columns. Spark picks the strategy; `strategy` ("merge", "shuffle_hash") is a hint.

    No keys join every pair (inner only).
    """
    left, right = prefixed(left, aliases[0]), prefixed(right, aliases[1])
    names = [((f"{aliases[0]}_{a}" if aliases[0] else a), (f"{aliases[1]}_{b}" if aliases[1] else b)) for a, b in keys]
    if strategy:
        right = right.hint(strategy)
    if not names:
        return left.crossJoin(right) if residual is None else left.join(right, residual, JOINS[how])
    on = reduce(lambda a, b: a & b, [left[a] == right[b] for a, b in names])
    return left.join(right, on if residual is None else on & residual, JOINS[how])


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its planned size is within the limit; else as it is, for a shuffled join."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= limit else df


def theta_join(left: DataFrame, right: DataFrame, condition: Column, how: str = "inner") -> DataFrame:
    """Join on any condition."""
    return left.join(small_side(right), condition, JOINS[how])


def lateral_top_k(outer: DataFrame, inner: DataFrame, keys: Sequence[tuple[str, str]], order: Sequence[Order], k: int, how: str = "inner", where: Column | None = None) -> DataFrame:
    """For each outer row the first k inner rows with equal keys. Inner rows are ranked once per key, before the join."""
    inner = inner if where is None else inner.where(where)
    best = Window.partitionBy(*[b for _, b in keys]).orderBy(*ordering(order))
    return equi_join(outer, inner.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= k).drop("_k"), keys, how)


def lateral_all(outer: DataFrame, inner: DataFrame, keys: Sequence[tuple[str, str]], how: str = "inner", outer_row_cap: int | None = None) -> DataFrame:
    """For each outer row all inner rows with equal keys; more outer rows than the cap are an error."""
    if outer_row_cap is not None and outer.limit(outer_row_cap + 1).count() > outer_row_cap:
        raise ValueError(f"more than {outer_row_cap} outer rows")
    return equi_join(outer, inner, keys, how)


def aggregate(df: DataFrame, by: Sequence[str | Column], aggs: dict[str, Column], having: Column | None = None, order: Sequence[Order] = (), limit: int | None = None) -> DataFrame:
    """Group, aggregate, filter the groups, sort and cut."""
    return scan(df.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()]), having, order=order, limit=limit)


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], aggs: dict[str, Column]) -> DataFrame:
    """One aggregate for each set of columns, in one pass; columns outside a set are null."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(*[c.alias(n) for n, c in aggs.items()])


def partial_aggregate(df: DataFrame, by: Sequence[str], aggs: dict[str, Column]) -> DataFrame:
    """The aggregate, marked as partial."""
    return aggregate(df, by, aggs).select(F.lit(True).alias("partial"), *by, *aggs)


def facets(df: DataFrame, fields: Sequence[str], limit: int) -> DataFrame:
    """(field, value, count): the `limit` most frequent values of each field; ties by value."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select("x.*")
    counts = long.where("value is not null").groupBy("field", "value").agg(F.count(F.lit(1)).alias("count"))
    best = Window.partitionBy("field").orderBy(F.desc("count"), "value")
    return counts.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= limit).drop("_r")


def union(frames: Sequence[DataFrame], distinct: bool = False) -> DataFrame:
    """By position; names are the first input's."""
    out = reduce(DataFrame.union, frames)
    return out.distinct() if distinct else out


def intersect(a: DataFrame, b: DataFrame, all_: bool = False) -> DataFrame:
    return a.intersectAll(b) if all_ else a.intersect(b)


def except_(a: DataFrame, b: DataFrame, all_: bool = False) -> DataFrame:
    return a.exceptAll(b) if all_ else a.subtract(b)


def top_k(df: DataFrame, order: Sequence[Order], k: int) -> DataFrame:
    """The first k rows: a bounded heap in each task, not a sort."""
    return df.orderBy(*ordering(order)).limit(k)


def describe(df: DataFrame) -> DataFrame:
    """(column, type, nullable) of a collection."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema], "column string, type string, nullable boolean")
