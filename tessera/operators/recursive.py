"""Recursive queries as driver loops over DataFrames; each round is checkpointed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import cut


def recursive_scan(df: DataFrame, anchor: Column, link: tuple[str, str], distinct: bool = True, max_iterations: int = 100) -> DataFrame:
    """Rows that match the anchor, then again and again rows whose link[0] equals a link[1] of the last round's.

    distinct: a row is taken once, so cycles end; else every round is kept. Stops silently after max_iterations.
    """
    total = work = cut(df.where(anchor))
    for _ in range(max_iterations):
        keys = work.select(F.col(link[1]).alias("_link")).distinct()
        step = df.join(keys, df[link[0]] == keys["_link"], "left_semi")
        if distinct:
            step = step.distinct().subtract(total)
        work = cut(step)
        if work.isEmpty():
            return total
        total = cut(total.union(work))
    return total


def recursive_value(spark: SparkSession, name: str, init: str, step: str, condition: str | None = None, distinct: bool = False, max_depth: int = 100) -> DataFrame:
    """A column of init, step(init), step(step(init)), ... while the condition holds for the value before the step.

    init, step and condition are SQL expressions over `name`. Without a condition only the anchor is returned. With
    distinct, a value seen before ends the recursion. Going beyond max_depth is an error.
    """
    row = spark.range(1).select(F.expr(init).alias(name))
    values = [row.first()[0]]
    kind = row.schema[0].dataType
    while condition is not None:
        last = spark.createDataFrame([(values[-1],)], f"{name} {kind.simpleString()}")
        nxt = last.where(F.expr(condition)).select(F.expr(step).cast(kind)).first()
        if nxt is None or (distinct and nxt[0] in values):
            break
        values.append(nxt[0])
        if len(values) > max_depth:
            raise RuntimeError(f"recursion is deeper than {max_depth}")
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind.simpleString()}")
