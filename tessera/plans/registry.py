"""How queries are written down: a Spark function and SQL that says the same."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
Run = Callable[[SparkSession, str], DataFrame]
Query = tuple[Run, str | None]


class Tables:
    """The tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def sql_query(text: str) -> Run:
    """A query that runs `text` with every table it names as a DataFrame argument."""
    template = text.replace("{", "{{").replace("}", "}}")
    used = []
    for t in TABLES:
        template, n = re.subn(rf"\b(FROM|JOIN)\s+{t}\b(?!\s*\()", rf"\1 {{{t}}} AS {t}", template)
        template = re.sub(rf"AS {t}\s+(?!JOIN|WHERE|ON|GROUP|ORDER|LEFT|RIGHT|FULL|INNER|CROSS|SEMI|ANTI|UNION|LIMIT|INTERSECT|EXCEPT|HAVING|QUALIFY|WINDOW|LATERAL|NATURAL|OFFSET|SET|USING)([A-Za-z]\w*)", r"AS \1", template)
        if n:
            used.append(t)

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return spark.sql(template, **{t: spark.read.parquet(f"{folder}/{t}.parquet") for t in used})

    return run


def same(text: str) -> Query:
    """The same SQL for both engines."""
    return sql_query(text), text


def pair(run: Callable[[Tables], DataFrame], sql: str | None = None) -> Query:
    return (lambda spark, folder: run(Tables(spark, folder))), sql


def differing(spark_sql: str, oracle: str) -> Query:
    return sql_query(spark_sql), oracle
