"""Materialised copies of a table, kept up by its change log, and aggregates over them.

A log has columns lsn (order), op ('insert', 'update', 'delete'), and those of the table. Of several changes of one key the last counts, so a log, or a
part of it, may be applied again without harm.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_changes(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest change of each key."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "lsn").alias("_c")).select(*keys, "_c.*")


def refreshed(copy: DataFrame, log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The copy after the changes of the log."""
    last = last_changes(log, keys)
    kept = copy.join(last.select(*keys), list(keys), "left_anti").select(*copy.columns)
    return kept.unionByName(last.where("op <> 'delete'").select(*copy.columns))


def counts_refreshed(view: DataFrame, old: DataFrame, log: DataFrame, keys: Sequence[str], by: Sequence[str], value: str) -> DataFrame:
    """A view (by..., n, total) of a table after the changes of a log: only the changed rows are looked up in the old table."""
    last = last_changes(log, keys)
    gone = old.join(last.select(*keys), list(keys), "left_semi").select(*by, F.lit(-1).alias("n"), (-F.col(value)).alias("total"))
    come = last.where("op <> 'delete'").select(*by, F.lit(1).alias("n"), F.col(value).alias("total"))
    every = view.select(*by, "n", "total").unionByName(gone).unionByName(come)
    return every.groupBy(*by).agg(F.sum("n").cast("long").alias("n"), F.sum("total").alias("total")).where("n > 0")


def read_source(columns: Sequence[str], aggregates: bool, point_keys: bool) -> str:
    """Where a read goes: 'columnar' for aggregates or few columns of many rows, 'rows' for look-ups by key."""
    return "rows" if point_keys or not (aggregates or len(columns) <= 3) else "columnar"
