"""Time series: raw scans, tumbling buckets, gap filling, downsampling, continuous aggregates, retention.

Times are epoch milliseconds (long). Buckets start at multiples of the width, below zero as well.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.expressions import exact_avg

UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}
MAX_BUCKETS = 10_000_000  # of a gap-filled series


def interval_ms(text: str) -> int:
    """'5m' -> 300000."""
    m = re.fullmatch(r"\s*(\d+)\s*(ms|s|m|h|d|w)\s*", text)
    if not m:
        raise ValueError(f"not an interval: {text!r}")
    return int(m[1]) * UNITS[m[2]]


def epoch_ms(ts: Column) -> Column:
    """Milliseconds of a timestamp with or without zone (in the session's zone, UTC)."""
    return F.unix_millis(ts.cast("timestamp"))


def bucket_of(ts: Column, width: int) -> Column:
    return ts - F.pmod(ts, F.lit(width))


def series_scan(df: DataFrame, start: int | None = None, end: int | None = None, where: Column | None = None, as_of: int | None = None, ts: str = "ts") -> DataFrame:
    """Samples with start <= ts <= end, and no later than as_of, sorted by time."""
    for bound, op in ((start, ">="), (end, "<="), (as_of, "<=")):
        if bound is not None:
            df = df.where(F.expr(f"{ts} {op} {int(bound)}"))
    df = df if where is None else df.where(where)
    return df.orderBy(ts)


AGGREGATES = {
    "count": lambda v, t: F.count(v), "sum": lambda v, t: F.sum(v), "min": lambda v, t: F.min(v), "max": lambda v, t: F.max(v), "avg": lambda v, t: exact_avg(v), "mean": lambda v, t: exact_avg(v),
    "first": lambda v, t: F.min_by(v, t), "last": lambda v, t: F.max_by(v, t), "count_distinct": lambda v, t: F.approx_count_distinct(v),
    "topk": lambda v, t: F.least(F.count_distinct(v), F.lit(10)), "stddev": lambda v, t: F.when(F.count(v) >= 2, F.stddev_pop(v)),
}


def aggregate_of(name: str, value: Column, ts: Column) -> Column:
    """An aggregate by name; 'topk(5)' takes an argument, an unknown one is null. topk: how many different values are tracked, at most k."""
    if m := re.fullmatch(r"topk\(([0-9.]+)\)", name):
        return F.least(F.count_distinct(value), F.lit(int(m[1])))
    return AGGREGATES[name](value, ts) if name in AGGREGATES else F.lit(None).cast("double")


def quantile_of(name: str) -> Decimal | None:
    """0.9 of 'percentile(0.9)', a half of 'percentile', None of other aggregates."""
    m = re.fullmatch(r"percentile(?:\(([0-9.]+)\))?", name)
    if m and not 0 <= (q := Decimal(m[1] or "0.5")) <= 1:
        raise ValueError(f"{name} is not between 0 and 1")
    return q if m else None


def _percentiles(samples: DataFrame, keys: Sequence[str], asked: dict[str, Decimal]) -> DataFrame:
    """(keys..., one column for each percentile) of samples (keys..., _value): the least value that the share of samples doesn't exceed. Different values are counted, sorted and added up, which may spill."""
    counts = samples.where("_value IS NOT NULL").groupBy(*keys, "_value").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys)
    upto = counts.select(*keys, "_value", F.sum("_n").over(group.orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"), F.sum("_n").over(group).alias("_all"))
    return upto.groupBy(*keys).agg(*[F.min(F.when(F.col("_upto") >= F.ceil(F.col("_all") * F.lit(q)), F.col("_value"))).alias(name) for name, q in asked.items()])


def bucketed(df: DataFrame, width: int, aggs: Sequence[str] = ("count", "sum", "min", "max"), by: Sequence[str] = (), ts: str = "ts", value: str = "value", having: Column | None = None) -> DataFrame:
    """(bucket, by..., one column for each aggregate); unknown aggregates are null, percentiles are values of the samples."""
    asked = {a: q for a in aggs if (q := quantile_of(a)) is not None}
    start = bucket_of(F.col(ts), width).alias("bucket")
    out = df.groupBy(start, *by).agg(*[aggregate_of(a, F.col(value), F.col(ts)).alias(a) for a in aggs if a not in asked] or [F.lit(None).alias("_none")])
    if asked:
        keys = ["bucket", *by]
        own = _percentiles(df.select(start, *by, F.col(value).alias("_value")), keys, asked).withColumnsRenamed({k: f"_{i}" for i, k in enumerate(keys)})
        same = [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)]
        out = out.join(own, same, "left").select(*keys, *[F.col(f"`{a}`") for a in aggs])
    return out if having is None else out.where(having)


def gap_filled(buckets: DataFrame, width: int, start: int, end: int, fill: str | float | None = None, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """Every bucket from that of start to that of end, for each group.

    fill: None (or '', 'null', 'none') leaves nulls, 'prev' carries the last value of the group on, a number fills in.
    """
    columns = [c for c in buckets.columns if c not in ("bucket", *by)] if columns is None else list(columns)
    first, last = start - start % width, end - end % width
    if (last - first) // width >= MAX_BUCKETS:
        raise ValueError("the range has too many buckets; give one within the data")
    if isinstance(fill, str) and fill.lower() not in ("", "null", "none", "prev"):
        try:
            fill = float(fill)
        except ValueError:
            raise ValueError(f"fill {fill!r} is not supported") from None
    spine = F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(width))).alias("bucket")
    groups = buckets.select(*by).distinct() if by else buckets.sparkSession.range(1).select()
    full = groups.select(*by, spine).join(buckets, ["bucket", *by], "left")
    if isinstance(fill, str) and fill.lower() == "prev":
        upto = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        full = full.select("bucket", *by, *[F.last(c, ignorenulls=True).over(upto).alias(c) for c in columns])
    elif isinstance(fill, (int, float)):
        full = full.select("bucket", *by, *[F.coalesce(F.col(c), F.lit(fill)).alias(c) for c in columns])
    return full.select("bucket", *by, *columns)


def downsampled(df: DataFrame, width: int, by: Sequence[str] = ("series_id",), ts: str = "ts", value: str = "value", midpoint: bool = False, closed_only: bool = False) -> DataFrame:
    """The mean of each window of each series, at its start or middle; closed_only leaves out the newest window of a series."""
    start = bucket_of(F.col(ts), width)
    out = df.groupBy(*by, start.alias("bucket")).agg(F.avg(value).alias("value"))
    if closed_only:
        newest = out.groupBy(*by).agg(F.max("bucket").alias("_newest"))
        out = out.join(newest, list(by)).where(F.col("bucket") < F.col("_newest")).drop("_newest")
    return out.withColumn("bucket", F.col("bucket") + width // 2) if midpoint else out


def merge_rollup(old: DataFrame, new: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rollups (bucket, by..., count, sum, min, max) of two sets of samples as that of both; late samples reach old buckets."""
    return merged_rollup(old.unionByName(new), by)


def merged_rollup(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rollups of parts of the samples, in one table, as that of all."""
    return parts.groupBy("bucket", *by).agg(F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"))


def rollup_last(rollup: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The newest bucket of each group."""
    rest = [c for c in rollup.columns if c not in by]
    newest = rollup.groupBy(*by).agg(F.max_by(F.struct(*rest), "bucket").alias("_x"))
    return newest.select(*by, "_x.*")


def rollup_range(rollup: DataFrame, start: int, end: int, by: Sequence[str] = ()) -> DataFrame:
    return rollup.where(F.col("bucket").between(start, end)).orderBy("bucket", *by)


def rollup_watermark(rollup: DataFrame) -> DataFrame:
    """The greatest bucket seen."""
    return rollup.agg(F.max("bucket").alias("watermark"))


def rollup_retained(rollup: DataFrame, now: int, retention: int) -> DataFrame:
    return rollup.where(F.col("bucket") > now - retention)


def series_retained(df: DataFrame, cutoff: int, width: int, ts: str = "ts") -> DataFrame:
    """Without the partitions (of `width`) that end before the cutoff; a partition stays or goes as a whole."""
    part = bucket_of(F.col(ts), width)
    gone = df.groupBy(part.alias("_p")).agg(F.max(ts).alias("_m")).where(F.col("_m") < cutoff).select("_p")
    return df.withColumn("_p", part).join(gone, "_p", "left_anti").drop("_p")


def compacted(df: DataFrame, files: int, ts: str = "ts") -> DataFrame:
    """The samples in `files` partitions of consecutive times, sorted."""
    return df.repartitionByRange(files, ts).sortWithinPartitions(ts)


def replay_deduplicated(df: DataFrame, keys: Sequence[str] = ("collection", "lsn")) -> DataFrame:
    """One sample for each log position."""
    return df.dropDuplicates(list(keys))


def routed(local: DataFrame, cached: DataFrame, boundary: int, ts: str = "ts") -> DataFrame:
    """Cached samples before the boundary, local ones from it on."""
    return cached.where(F.col(ts) < boundary).unionByName(local.where(F.col(ts) >= boundary))
