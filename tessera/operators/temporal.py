"""Bitemporal histories: rows (id, system_from, valid_from, valid_until, tag, ...) of which nothing is overwritten."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_of(history: DataFrame, system: int | None = None, valid: int | None = None, id_col: str = "id") -> DataFrame:
    """Each id's last version written no later than `system`, if it is live and (if asked) valid at `valid`."""
    own = history if system is None else history.where(F.col("system_from") <= system)
    rest = [c for c in own.columns if c != id_col]
    last = own.groupBy(id_col).agg(F.max_by(F.struct(*rest), "system_from").alias("_v")).select(id_col, "_v.*").where("tag = 'live'")
    if valid is not None:
        last = last.where((F.col("valid_from") <= valid) & (F.col("valid_until").isNull() | (F.col("valid_until") > valid)))
    return last.select(*history.columns)


def current(history: DataFrame, id_col: str = "id") -> DataFrame:
    return as_of(history, id_col=id_col)


def valid_at(df: DataFrame, t: int, start: str = "valid_from", end: str = "valid_until") -> DataFrame:
    """Rows with start <= t < end; a null end is open."""
    return df.where((F.col(start) <= t) & (F.col(end).isNull() | (F.col(end) > t)))


def purged(df: DataFrame, cutoff: int, system_to: str = "system_to") -> DataFrame:
    """Without versions that ended before the cutoff; open ones stay."""
    return df.where(F.col(system_to).isNull() | (F.col(system_to) >= cutoff))


def last_writer(df: DataFrame, by: Sequence[str], ts: str) -> DataFrame:
    """One row for each key: the one of the latest ts."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), ts).alias("_v")).select(*by, "_v.*")


def list_insert(df: DataFrame, col: str, at: int, value: object) -> DataFrame:
    """An element put before place `at` (from 0) of a list column."""
    return df.withColumn(col, F.array_insert(col, at + 1, F.lit(value)))


def list_delete(df: DataFrame, col: str, at: int) -> DataFrame:
    c = F.col(col)
    return df.withColumn(col, F.concat(F.slice(c, 1, at), F.slice(c, at + 2, 1 << 30)))


def list_move(df: DataFrame, col: str, source: int, target: int) -> DataFrame:
    """The element at `source` taken out and put before place `target` of what is left."""
    moved = df.withColumn("_x", F.get(F.col(col), F.lit(source)))
    out = list_delete(moved, col, source)
    return out.withColumn(col, F.array_insert(col, target + 1, F.col("_x"))).drop("_x")
