"""Collections: named DataFrames of a kind, with a key, that statements can be run over."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

KINDS = ("document", "strict", "columnar", "timeseries", "spatial", "array", "kv", "rollup")


@dataclass
class Collection:
    name: str
    kind: str
    df: DataFrame
    key: str | None = None
    options: dict = field(default_factory=dict)


class Catalog:
    """Collections by name; each is a temporary view as well."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.collections: dict[str, Collection] = {}

    def register(self, name: str, df: DataFrame, kind: str = "columnar", key: str | None = None, **options: object) -> Collection:
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}")
        df.createOrReplaceTempView(name)
        self.collections[name] = Collection(name, kind, df, key, dict(options))
        return self.collections[name]

    def get(self, name: str) -> Collection:
        if name not in self.collections:
            raise KeyError(f"no collection {name!r}")
        return self.collections[name]

    def drop(self, name: str) -> None:
        self.collections.pop(name, None)
        self.spark.catalog.dropTempView(name)

    def alter_add_column(self, name: str, column: str, kind: str, default: object = None) -> Collection:
        from pyspark.sql import functions as F

        c = self.get(name)
        return self.register(name, c.df.withColumn(column, F.lit(default).cast(kind)), c.kind, c.key, **c.options)

    def convert(self, name: str, kind: str, schema: str | None = None) -> Collection:
        """To 'document' as (id, document), or from there to typed columns."""
        from tessera.operators import dml

        c = self.get(name)
        if kind == "document":
            return self.register(name, dml.to_document(c.df, c.key or c.df.columns[0]), kind, "id")
        return self.register(name, dml.to_typed(c.df, schema or "id string, data string"), kind, c.key)
