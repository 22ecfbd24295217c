"""Changes to tables as functions from a DataFrame to the new state, which the caller writes.

A failing row (duplicate key, division by zero) fails the whole change when it is written, so nothing is half done.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _no_duplicates(target: DataFrame, new: DataFrame, keys: Sequence[str]) -> None:
    if not new.groupBy(*keys).count().where("count > 1").isEmpty() or not new.join(target, list(keys), "left_semi").isEmpty():
        raise ValueError("duplicate key")


def insert(target: DataFrame, new: DataFrame, keys: Sequence[str] = (), on_conflict: str = "error", update: dict[str, Column] | None = None) -> DataFrame:
    """target and new rows by name; missing columns are null.

    on_conflict: 'error' (all or nothing), 'nothing' (old rows stay), 'update' (old rows take `update`: values over columns of
    the row, and of the new one under excluded_<column>).
    """
    if not keys:
        return target.unionByName(new, allowMissingColumns=True)
    if on_conflict == "error":
        _no_duplicates(target, new, keys)
        return target.unionByName(new, allowMissingColumns=True)
    if on_conflict == "update":
        changed = update_from(target, new, keys, update or {})
        return changed.unionByName(new.join(target, list(keys), "left_anti"), allowMissingColumns=True)
    return target.unionByName(new.dropDuplicates(list(keys)).join(target, list(keys), "left_anti"), allowMissingColumns=True)


def upsert(target: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace the fields they have a value for; others are added."""
    fields = [c for c in new.columns if c not in keys]
    renamed = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in fields])
    both = target.join(renamed, list(keys), "full")
    every = [*target.columns, *[c for c in fields if c not in target.columns]]
    pick = lambda c: F.col(c) if c in keys or c not in fields else F.coalesce(F.col(f"_new_{c}"), F.col(c)) if c in target.columns else F.col(f"_new_{c}")
    return both.select(*[pick(c).alias(c) for c in every])


def update(target: DataFrame, sets: dict[str, Column], where: Column | None = None) -> DataFrame:
    """Right-hand sides see the row as it was, so columns can be swapped; rows for which `where` is null stay."""
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return target.select(*[F.when(hit, sets[c].cast(target.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in target.columns])


def delete(target: DataFrame, where: Column | None = None) -> DataFrame:
    return target.limit(0) if where is None else target.where(~F.coalesce(where, F.lit(False)))


def insert_select(target: DataFrame, source: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """target and one row for each of source, with columns mapped."""
    return target.unionByName(source.select(*[v.cast(target.schema[c].dataType).alias(c) for c, v in columns.items()]), allowMissingColumns=True)


def update_from(target: DataFrame, source: DataFrame, keys: Sequence[str], sets: dict[str, Column]) -> DataFrame:
    """Rows with a partner in source take `sets`, over their columns and the partner's under excluded_<column>. Keys of source are unique."""
    other = source.select(*keys, *[F.col(c).alias(f"excluded_{c}") for c in source.columns if c not in keys], F.lit(True).alias("_hit"))
    both = target.join(other, list(keys), "left")
    return both.select(*[F.when(F.col("_hit"), sets[c].cast(target.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in target.columns])


def merge(target: DataFrame, source: DataFrame, keys: Sequence[str], matched: str | dict[str, Column] | None = None, not_matched: dict[str, Column] | None = None, not_matched_by_source: str | dict[str, Column] | None = None, last_by: str | None = None) -> DataFrame:
    """MERGE: matched rows are updated (a dict of values; source columns as excluded_<column>), deleted ('delete') or kept;
    source rows without a partner are inserted as `not_matched` says; target rows without a partner likewise.

    Of source rows with one key the last by `last_by` counts (without it, one of them).
    """
    if last_by:
        rest = [c for c in source.columns if c not in keys]
        source = source.groupBy(*keys).agg(F.max_by(F.struct(*rest), last_by).alias("_s")).select(*keys, "_s.*")
    else:
        source = source.dropDuplicates(list(keys))
    other = source.select(*keys, *[F.col(c).alias(f"excluded_{c}") for c in source.columns if c not in keys], F.lit(True).alias("_in_s"))
    both = target.withColumn("_in_t", F.lit(True)).join(other, list(keys), "full")
    kind = F.when(F.col("_in_t") & F.col("_in_s"), "m").when(F.col("_in_s"), "n").otherwise("s")
    both = both.withColumn("_kind", kind)
    for name, arm in (("m", matched), ("s", not_matched_by_source)):
        if arm == "delete":
            both = both.where(F.col("_kind") != name)
    if not_matched is None:
        both = both.where("_kind <> 'n'")

    def value(c: str) -> Column:
        out = F.col(c)
        for name, arm in (("m", matched), ("n", not_matched), ("s", not_matched_by_source)):
            if isinstance(arm, dict) and c in arm:
                out = F.when(F.col("_kind") == name, arm[c].cast(target.schema[c].dataType)).otherwise(out)
        return out.alias(c)

    return both.select(*[F.col(c) if c in keys else value(c) for c in target.columns])


def truncate(target: DataFrame) -> DataFrame:
    return target.limit(0)


def unique_check(df: DataFrame, keys: Sequence[str], where: Column | None = None, ignore_case: bool = False) -> DataFrame:
    """Keys that break a unique (partial, case-insensitive) index, with their counts."""
    own = df if where is None else df.where(where)
    own = own.select(*[F.lower(c).alias(c) if ignore_case else F.col(c) for c in keys])
    return own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def to_document(df: DataFrame, id_col: str) -> DataFrame:
    """A typed table as (id, document JSON)."""
    return df.select(F.col(id_col).cast("string").alias("id"), F.to_json(F.struct(*df.columns)).alias("document"))


def to_typed(df: DataFrame, schema: str, doc_col: str = "document") -> DataFrame:
    """Documents as a typed table; one that doesn't parse fails the conversion."""
    return df.select(F.from_json(doc_col, schema, {"mode": "FAILFAST"}).alias("_d")).select("_d.*")


def apply_batch(target: DataFrame, steps: Sequence) -> DataFrame:
    """Several changes (functions of the state) as one."""
    for step in steps:
        target = step(target)
    return target
