"""Sources and sinks: Parquet tables, NDJSON and CSV imports, line protocol, sample batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def views(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Temporary views of the tables, for SQL."""
    for n in names:
        table(spark, folder, n).createOrReplaceTempView(n)


def ndjson(spark: SparkSession, path: str) -> DataFrame:
    """(id, document): one JSON object a line; blank lines and those that begin with # are skipped; a missing or non-string id becomes a UUID."""
    lines = spark.read.text(path).select(F.trim("value").alias("document")).where("document <> '' AND NOT startswith(document, '#')")
    return with_ids(lines)


def with_ids(docs: DataFrame) -> DataFrame:
    parsed = F.parse_json("document")
    text = F.when(F.schema_of_variant(F.variant_get(parsed, "$.id", "variant")) == "STRING", F.variant_get(parsed, "$.id", "string"))
    return docs.select(F.coalesce(text, F.uuid()).alias("id"), "document")


def csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header; types are inferred over all rows."""
    return spark.read.csv(path, header=True, inferSchema=True)


def line_protocol(lines: DataFrame, now_ms: int, value_col: str = "value") -> DataFrame:
    """(measurement, tags, ts, value): the first numeric field is the value (0.0 without one); nanoseconds become milliseconds; no time is now.

    Blank lines and comments are skipped.
    """
    line = F.trim(F.col(value_col))
    own = lines.select(line.alias("l")).where("l <> '' AND NOT startswith(l, '#')")
    head, fields, time = (F.get(F.split("l", " +"), F.lit(i)) for i in range(3))
    parts = F.split(head, ",")
    tags = F.map_from_entries(F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda t: F.struct(F.substring_index(t, "=", 1).alias("k"), F.substring_index(t, "=", -1).alias("v"))))
    numbers = F.filter(F.transform(F.split(fields, ","), lambda f: F.regexp_replace(F.substring_index(f, "=", -1), "[iu]$", "").try_cast("double")), lambda x: x.isNotNull())
    return own.select(
        F.get(parts, F.lit(0)).alias("measurement"), tags.alias("tags"), F.coalesce(F.floor(time.try_cast("long") / 1_000_000), F.lit(now_ms)).cast("long").alias("ts"), F.coalesce(F.get(numbers, F.lit(0)), F.lit(0.0)).alias("value")
    )


def samples(payload: DataFrame, kind: str, now_ms: int = 0) -> DataFrame:
    """Ingest payloads as (measurement, tags, ts, value): 'ilp' lines, or 'samples' with those columns."""
    return line_protocol(payload, now_ms) if kind == "ilp" else payload.select("measurement", "tags", "ts", "value")


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def union_rows(*frames: DataFrame) -> DataFrame:
    """All rows under the union of their columns, in order of names, null where a frame lacks one."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*sorted(out.columns))


def next_values(df: DataFrame, order: list[Column], start: int, step: int = 1, out: str = "nextval") -> DataFrame:
    """Sequence values in the given order. The order is total, so the rows meet in one task: for result-sized frames."""
    from pyspark.sql.window import Window

    return df.withColumn(out, F.lit(start) + (F.row_number().over(Window.orderBy(*order)) - 1) * step)


class Sequence:
    """A sequence on the driver: next values for rows, the current value, and setting it."""

    def __init__(self, start: int = 1, step: int = 1):
        if not step:
            raise ValueError("a sequence needs a step")
        self.step, self._next, self._current = step, start, None

    def nextval(self, df: DataFrame, order: list[Column], out: str = "nextval") -> DataFrame:
        """df with the next values in the given order; they are taken at once, so a plan that runs twice gives the same."""
        first, n = self._next, df.count()
        if n:
            self._next, self._current = first + n * self.step, first + (n - 1) * self.step
        return next_values(df, order, first, self.step, out)

    def currval(self) -> int:
        if self._current is None:
            raise ValueError("no value has been taken yet")
        return self._current

    def setval(self, value: int, called: bool = True) -> int:
        """The next value follows `value`, or is it if `called` is false."""
        self._current = value if called else self._current
        self._next = value + self.step if called else value
        return value
