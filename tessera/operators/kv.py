"""Key-value tables (key, value, expires_at in epoch ms or null) and leaderboards over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.expressions import glob
from tessera.operators.ranking import ranked


def alive(kv: DataFrame, now: int) -> DataFrame:
    """Entries that haven't expired."""
    return kv.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def get(kv: DataFrame, keys: Sequence[object], now: int) -> DataFrame:
    return alive(kv, now).where(F.col("key").isin(list(keys)))


def field_get(kv: DataFrame, key: object, fields: Sequence[str], now: int) -> DataFrame:
    """Fields of a JSON value."""
    return get(kv, [key], now).select("key", *[F.get_json_object("value", f"$.{f}").alias(f) for f in fields])


def ttl(kv: DataFrame, keys: Sequence[object], now: int) -> DataFrame:
    """(key, ttl_ms): -1 without an expiry."""
    return get(kv, keys, now).select("key", F.coalesce(F.col("expires_at") - now, F.lit(-1)).cast("long").alias("ttl_ms"))


def scan(kv: DataFrame, now: int, pattern: str | None = None, after: object = None, count: int | None = None) -> DataFrame:
    """Live entries in order of keys, after a cursor, whose keys match a glob."""
    own = alive(kv, now)
    own = own if pattern is None else own.where(glob(F.col("key"), pattern))
    own = own if after is None else own.where(F.col("key") > F.lit(after))
    own = own.orderBy("key")
    return own if count is None else own.limit(count)


def key_range(kv: DataFrame, now: int, start: object = None, end: object = None, limit: int | None = None) -> DataFrame:
    """Live entries with start <= key < end, in order."""
    own = alive(kv, now)
    own = own if start is None else own.where(F.col("key") >= F.lit(start))
    own = own if end is None else own.where(F.col("key") < F.lit(end))
    own = own.orderBy("key")
    return own if limit is None else own.limit(limit)


def as_rows(kv: DataFrame, now: int, fields: dict[str, str]) -> DataFrame:
    """JSON values as columns in order of names, null where a value lacks one."""
    return alive(kv, now).select("key", *[F.get_json_object("value", f"$.{f}").cast(t).alias(f) for f, t in sorted(fields.items())])


def put(kv: DataFrame, new: DataFrame, if_absent: bool = False, now: int = 0) -> DataFrame:
    """Entries replaced, or only added where no live one is."""
    if if_absent:
        held = alive(kv, now)
        return held.unionByName(new.join(held, "key", "left_anti"))
    return kv.join(new, "key", "left_anti").unionByName(new)


def remove(kv: DataFrame, keys: Sequence[object]) -> DataFrame:
    return kv.where(~F.col("key").isin(list(keys)))


def expire(kv: DataFrame, keys: Sequence[object], at: int | None) -> DataFrame:
    """A new expiry for keys; None keeps them for good."""
    return kv.withColumn("expires_at", F.when(F.col("key").isin(list(keys)), F.lit(at).cast("long")).otherwise(F.col("expires_at")))


def compacted(kv: DataFrame, now: int) -> DataFrame:
    return alive(kv, now)


def increment(kv: DataFrame, key: object, by: float, now: int, kind: str = "long") -> DataFrame:
    """The number at key plus `by`; a missing or expired one starts at 0."""
    held = alive(kv, now)
    spark = kv.sparkSession
    if held.where(F.col("key") == F.lit(key)).isEmpty():
        new = spark.range(1).select(F.lit(key).cast(kv.schema["key"].dataType).alias("key"), F.lit(by).cast(kind).cast("string").alias("value"), F.lit(None).cast("long").alias("expires_at"))
        return held.unionByName(new)
    return held.withColumn("value", F.when(F.col("key") == F.lit(key), (F.col("value").cast(kind) + F.lit(by).cast(kind)).cast("string")).otherwise(F.col("value")))


def compare_and_set(kv: DataFrame, key: object, expected: str, new: str, now: int) -> DataFrame:
    return alive(kv, now).withColumn("value", F.when((F.col("key") == F.lit(key)) & (F.col("value") == expected), F.lit(new)).otherwise(F.col("value")))


def get_and_set(kv: DataFrame, key: object, new: str, now: int) -> tuple[DataFrame, DataFrame]:
    """The table with `new` at key (added if it isn't there), and one row `value`: what was there before, or null."""
    held = alive(kv, now)
    old = held.where(F.col("key") == F.lit(key)).agg(F.max("value").alias("value"))
    one = kv.sparkSession.range(1).select(F.lit(key).cast(kv.schema["key"].dataType).alias("key"), F.lit(new).alias("value"), F.lit(None).cast("long").alias("expires_at"))
    return held.where(F.col("key") != F.lit(key)).unionByName(one), old


def transfer(kv: DataFrame, source: object, target: object, amount: float, now: int) -> DataFrame:
    """Move a number from one key to another; too little there is an error."""
    held = alive(kv, now)
    has = held.where(F.col("key") == F.lit(source)).select(F.col("value").cast("double")).first()
    if has is None or has[0] < amount:
        raise ValueError("not enough to transfer")
    delta = F.when(F.col("key") == F.lit(source), F.lit(-amount)).when(F.col("key") == F.lit(target), F.lit(amount))
    return held.withColumn("value", F.coalesce((F.col("value").cast("double") + delta).cast("string"), F.col("value")))


def field_set(kv: DataFrame, key: object, field: str, value: Column, fields: Sequence[str], now: int) -> DataFrame:
    """One field of a JSON object (with the given fields) set."""
    held = alive(kv, now)
    parts = [(value if f == field else F.get_json_object("value", f"$.{f}")).alias(f) for f in dict.fromkeys([*fields, field])]
    return held.withColumn("value", F.when(F.col("key") == F.lit(key), F.to_json(F.struct(*parts))).otherwise(F.col("value")))


def transfer_item(kv: DataFrame, source: object, target: object, field: str, fields: Sequence[str], now: int) -> DataFrame:
    """Move one field of a JSON object (with the given fields) to another key's; a source without it, or no target, is an error."""
    held = alive(kv, now)
    found = {r.key: r.item for r in held.where(F.col("key").isin([source, target])).select("key", F.get_json_object("value", f"$.{field}").alias("item")).collect()}
    if found.get(source) is None or target not in found:
        raise ValueError("nothing to transfer")
    moved = F.when(F.col("key") == F.lit(target), F.lit(found[source]))
    parts = [(moved if f == field else F.get_json_object("value", f"$.{f}")).alias(f) for f in dict.fromkeys([*fields, field])]
    return held.withColumn("value", F.when(F.col("key").isin([source, target]), F.to_json(F.struct(*parts))).otherwise(F.col("value")))


def field_index(kv: DataFrame, field: str, now: int) -> DataFrame:
    """(item, key): a secondary index over a field of JSON values, for a table sorted or bucketed by item."""
    return alive(kv, now).select(F.get_json_object("value", f"$.{field}").alias("item"), "key").where(F.col("item").isNotNull())


def by_field(index: DataFrame, kv: DataFrame, item: str, now: int) -> DataFrame:
    """Live entries whose indexed field is `item`."""
    return alive(kv, now).join(index.where(F.col("item") == item).select("key"), "key", "left_semi")


def leaderboard(df: DataFrame, score: str = "score", key: str = "key", descending: bool = True, window: str | None = None, now: str | None = None, ts: str = "ts", custom: tuple[str, str] | None = None) -> DataFrame:
    """df's scored rows with `rank` by (score, key). window 'day', 'week' or 'month' keeps those since the start of now's; custom keeps [start, end)."""
    own = df.where(F.col(score).isNotNull())
    if custom:
        own = own.where((F.col(ts) >= F.lit(custom[0]).cast("timestamp_ntz")) & (F.col(ts) < F.lit(custom[1]).cast("timestamp_ntz")))
    elif window:
        own = own.where(F.col(ts) >= F.date_trunc(window, F.lit(now).cast("timestamp")).cast("timestamp_ntz"))
    return ranked(own, score, key, descending)


def rank_of(board: DataFrame, key: object, key_col: str = "key") -> DataFrame:
    """One row: the rank of a key, or null."""
    return board.where(F.col(key_col) == F.lit(key)).agg(F.max("rank").alias("rank"))


def top(board: DataFrame, k: int) -> DataFrame:
    return board.where(F.col("rank") <= k).orderBy("rank")


def score_range(board: DataFrame, least: float | None, most: float | None, score: str = "score") -> DataFrame:
    """Rows with least <= score <= most, with their global ranks."""
    own = board if least is None else board.where(F.col(score) >= least)
    return own if most is None else own.where(F.col(score) <= most)
