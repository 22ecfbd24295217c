"""Global row numbers without a window over everything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranked(df: DataFrame, score: str, key: str, descending: bool = True, out: str = "rank", per_bucket: int = 1_000_000) -> DataFrame:
    """df with `out`: 1-based place by (score, key); rows are numbered in buckets of scores and shifted by the buckets before.

    Equal scores share a bucket. Null scores come last.
    """
    n = df.count()
    parts = min(10_000, max(1, -(-n // per_bucket)))
    bounds: list = []
    if parts > 1:
        probs = F.array(*[F.lit(i / parts) for i in range(1, parts)])
        bounds = sorted(set(df.select(F.percentile_approx(score, probs, F.lit(100 * parts)).alias("b")).first().b or []))
    place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(score))) if bounds else F.lit(0)
    bucket = F.when(F.col(score).isNull(), F.lit(len(bounds) + 1)).otherwise(F.lit(len(bounds)) - place if descending else place)
    cut = df.withColumn("_bucket", bucket)
    by = F.col(score).desc_nulls_last() if descending else F.col(score).asc_nulls_last()
    number = cut.withColumn("_n", F.row_number().over(Window.partitionBy("_bucket").orderBy(by, F.col(key).asc_nulls_last())))
    if not bounds:
        first = cut.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_c"))
        before = first.withColumn("_o", F.when(F.col("_bucket") == 0, F.lit(0)).otherwise(F.lit(n) - F.col("_c"))).drop("_c")
    else:
        before = cut.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_c")).withColumn("_o", F.coalesce(F.sum("_c").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    return number.join(F.broadcast(before), "_bucket").withColumn(out, (F.col("_o") + F.col("_n")).cast("long")).drop("_bucket", "_n", "_o")
