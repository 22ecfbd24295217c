"""Statements that Spark SQL lacks, over a catalog of collections; everything else goes to spark.sql."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.catalog import Catalog
from tessera.operators import graph, kv, ndarray, relational, textindex, timeseries

_NAME = r"(\w+)"


class Router:
    """sql(text, args): DDL of collections, arrays, rollups, search and sorted indexes, leaderboard, search and array functions, MATCH, DESCRIBE, TRUNCATE; SELECTs as they are."""

    def __init__(self, catalog: Catalog):
        self.catalog = catalog
        self.spark = catalog.spark
        self.sorted: dict[str, dict] = {}
        self.rollups: dict[str, dict] = {}
        self.indexes: dict[str, textindex.TextIndex] = {}

    def sql(self, text: str, args: dict | list | None = None) -> DataFrame:
        t = text.strip().rstrip(";").strip()
        if re.search(r"\bRETURNING\b", t, re.I) and not re.match(r"select", t, re.I):
            raise ValueError("RETURNING is not supported")
        for pattern, run in (
            (rf"CREATE CONTINUOUS AGGREGATE {_NAME} ON {_NAME} BUCKET '([^']+)' AGGREGATE (.+?)(?: GROUP BY (.+?))?(?: WITH \((.+)\))?$", self._create_rollup),
            (rf"DROP CONTINUOUS AGGREGATE {_NAME}$", self._drop_rollup),
            (r"SHOW CONTINUOUS AGGREGATES$", self._show_rollups),
            (rf"CREATE SORTED INDEX {_NAME} ON {_NAME} \((\w+)(?: (ASC|DESC))?\) KEY (\w+)(?: WINDOW (NONE|DAILY|WEEKLY|MONTHLY)(?: ON (\w+))?)?$", self._create_sorted),
            (rf"DROP SORTED INDEX {_NAME}$", self._drop_sorted),
            (rf"SELECT RANK\({_NAME}, '([^']*)'\)$", lambda i, k: kv.rank_of(self._board(i), k)),
            (rf"SELECT TOPK\({_NAME}, (\d+)\)$", lambda i, k: kv.top(self._board(i), int(k)).select("rank", "key")),
            (rf"SELECT RANGE\({_NAME}, ([^,]+), ([^)]+)\)$", self._range),
            (rf"SELECT SORTED_COUNT\({_NAME}\)$", lambda i: self._board(i).agg(F.count(F.lit(1)).alias("count"))),
            (rf"SELECT SCORE\({_NAME}, '([^']*)'\)$", lambda i, k: self._board(i).where(F.col("key") == k).select("score")),
            (rf"SELECT \* FROM NDARRAY_SLICE\({_NAME}(?:, (.+))?\)$", self._slice),
            (rf"SELECT \* FROM NDARRAY_AGG\({_NAME}, '(\w+)', '(\w+)'(?:, '(\w+)')?\)$", lambda a, attr, how, by: ndarray.array_aggregate(self.catalog.get(a).df, self._dims(a), attr, how, by)),
            (rf"DESCRIBE {_NAME}$", lambda n: relational.describe(self.catalog.get(n).df)),
            (rf"TRUNCATE (?:TABLE )?{_NAME}$", self._truncate),
            (rf"DROP (?:COLLECTION|TABLE|ARRAY) {_NAME}$", self._drop),
            (rf"CREATE (COLLECTION|TABLE) {_NAME}(?: \((.+?)\))?(?: (?:WITH|ENGINE) ?(.+))?$", self._create),
            (rf"CREATE ARRAY {_NAME} DIMS \((.+?)\) ATTRS \((.+?)\)(?: TILE_EXTENTS \((.+?)\))?$", self._create_array),
            (rf"ALTER ARRAY {_NAME} SET \((.+)\)$", self._alter_array),
            (rf"ALTER COLLECTION {_NAME} ADD COLUMN (\w+) (\w+)(?: DEFAULT '?([^']*?)'?)?$", self._add_column),
            (rf"CONVERT COLLECTION {_NAME} TO (\w+)(?: \((.+)\))?$", self._convert),
            (rf"CREATE SEARCH INDEX ON {_NAME} \(([^)]+)\)(?: ANALYZER '(\w+)')?(?: FUZZY (\d+))?$", self._create_search),
            (rf"DROP SEARCH INDEX ON {_NAME}$", self._drop_search),
            (rf"REINDEX {_NAME}$", self._reindex),
            (rf"SELECT \* FROM TEXT_SEARCH\({_NAME}, '([^']*)'(?:, FIELD '(\w+)')?(?:, LIMIT (\d+))?\)$", self._text_search),
            (rf"(MATCH .+?)(?: ON {_NAME})?$", self._match),
        ):
            m = re.match(pattern, t, re.I | re.S)
            if m:
                return run(*m.groups())
        return self.spark.sql(text, args) if args is not None else self.spark.sql(text)

    def _done(self, what: str) -> DataFrame:
        return self.spark.createDataFrame([(what,)], "result string")

    def _create_rollup(self, name: str, on: str, width: str, aggs: str, by: str | None, options: str | None) -> DataFrame:
        calls = re.findall(r"(\w+)\((\w+|\*)\)(?: AS (\w+))?", aggs, re.I)
        keys = [c.strip() for c in by.split(",")] if by else []
        if unknown := [f for f, _, _ in calls if f.lower() not in timeseries.AGGREGATES]:
            raise ValueError(f"unknown aggregate {unknown[0]!r}")
        c = self.catalog.get(on)
        ts = str(c.options.get("time", "ts"))
        cols = [timeseries.AGGREGATES[f.lower()](F.col(col) if col != "*" else F.lit(1), F.col(ts)).alias(a or f"{f.lower()}_{col}") for f, col, a in calls]
        df = c.df.groupBy(timeseries.bucket_of(F.col(ts), timeseries.interval_ms(width)).alias("bucket"), *keys).agg(*cols)
        self.rollups[name] = {"on": on, "bucket": width, "options": options or ""}
        self.catalog.register(name, df, "rollup")
        return self._done("created")

    def _drop_rollup(self, name: str) -> DataFrame:
        self.rollups.pop(name)
        self.catalog.drop(name)
        return self._done("dropped")

    def _show_rollups(self) -> DataFrame:
        return self.spark.createDataFrame([(n, r["on"], r["bucket"], r["options"]) for n, r in sorted(self.rollups.items())], "name string, source string, bucket string, options string")

    def _create_sorted(self, name: str, on: str, score: str, direction: str | None, key: str, window: str | None, ts: str | None) -> DataFrame:
        self.catalog.get(on)
        span = {"DAILY": "day", "WEEKLY": "week", "MONTHLY": "month"}.get((window or "NONE").upper())
        self.sorted[name] = {"on": on, "score": score, "desc": (direction or "ASC").upper() == "DESC", "key": key, "window": span, "ts": ts or "ts"}
        return self._done("created")

    def _drop_sorted(self, name: str) -> DataFrame:
        self.sorted.pop(name)
        return self._done("dropped")

    def _board(self, name: str) -> DataFrame:
        i = self.sorted[name]
        c = self.catalog.get(i["on"])
        now = c.options.get("now") or self.spark.sql("SELECT cast(current_timestamp() AS string)").first()[0]
        own = c.df.withColumnRenamed(i["score"], "score").withColumnRenamed(i["key"], "key")
        return kv.leaderboard(own, "score", "key", i["desc"], i["window"], str(now), i["ts"])

    def _range(self, name: str, lo: str, hi: str) -> DataFrame:
        bound = lambda x: None if x.strip().upper() in ("NULL", "NONE", "*", "'*'") else float(x)
        return kv.score_range(self._board(name), bound(lo), bound(hi)).select("rank", "key", "score").orderBy("rank")

    def _dims(self, name: str) -> list[str]:
        return list(self.catalog.get(name).options["dims"])

    def _slice(self, name: str, ranges: str | None) -> DataFrame:
        found = re.findall(r"'(\w+)', (-?\d+|NULL), (-?\d+|NULL)", ranges or "", re.I)
        bound = lambda x: None if x.upper() == "NULL" else int(x)
        return ndarray.array_slice(self.catalog.get(name).df, self._dims(name), {d: (bound(a), bound(b)) for d, a, b in found})

    def _create(self, what: str, name: str, columns: str | None, options: str | None) -> DataFrame:
        """An empty collection: COLLECTION is schemaless and TABLE strict unless an engine is named."""
        named = {k.lower(): v.strip("'\" ") for k, v in re.findall(r"(\w+)\s*=\s*('[^']*'|\w+)", options or "")}
        kind = named.pop("engine", None) or (re.fullmatch(r"\w+", (options or "").strip()) or [None])[0] or ("strict" if what.upper() == "TABLE" else "document")
        kind = {"schemaless": "document"}.get(kind.lower(), kind.lower())
        if name in self.catalog.collections:
            raise ValueError(f"collection {name!r} is there already")
        key = re.search(r"(\w+)\s+[\w()]+\s+PRIMARY KEY", columns or "", re.I)
        plain = re.sub(r"\s+PRIMARY KEY", "", columns or "id STRING, document STRING", flags=re.I)
        plain = re.sub(r"\bTEXT\b", "STRING", re.sub(r"\b(TIMESTAMPTZ)\b", "TIMESTAMP", plain, flags=re.I), flags=re.I)
        if named.get("bitemporal", "").lower() == "true":
            plain += ", system_from BIGINT, valid_from BIGINT, valid_until BIGINT, tag STRING"
        self.catalog.register(name, self.spark.createDataFrame([], plain), kind, key[1] if key else None, **named)
        return self._done("created")

    def _create_array(self, name: str, dims: str, attrs: str, tiles: str | None) -> DataFrame:
        """An empty array of versioned cells; DIMS (x INT64 [0..63], ...)."""
        found = re.findall(r"(\w+)\s+(\w+)\s*\[\s*(-?\d+)\s*(?:\.\.|,)\s*(-?\d+)\s*\]", dims)
        if not found:
            raise ValueError("an array needs dimensions")
        types = {"int64": "bigint", "text": "string", "float64": "double", "int32": "int"}
        sql_type = lambda t: types.get(t.lower(), t)
        cols = [f"{d} {sql_type(t)}" for d, t, _, _ in found] + [f"{a} {sql_type(t)}" for a, t in re.findall(r"(\w+)\s+(\w+)", attrs)]
        schema = ", ".join([*cols, "sys bigint", "tag string", "valid_from bigint", "valid_until bigint"])
        self.catalog.register(name, self.spark.createDataFrame([], schema), "array", dims=[d for d, *_ in found], bounds={d: (int(a), int(b)) for d, _, a, b in found}, tiles=[int(x) for x in (tiles or "").split(",") if x.strip()])
        return self._done("created")

    def _alter_array(self, name: str, options: str) -> DataFrame:
        c = self.catalog.get(name)
        self.catalog.register(name, c.df, c.kind, c.key, **(c.options | {k.lower(): v.strip("'") for k, v in re.findall(r"(\w+)\s*=\s*('[^']*'|\w+)", options)}))
        return self._done("altered")

    def _add_column(self, name: str, column: str, kind: str, default: str | None) -> DataFrame:
        self.catalog.alter_add_column(name, column, {"text": "string"}.get(kind.lower(), kind), default)
        return self._done("altered")

    def _convert(self, name: str, kind: str, schema: str | None) -> DataFrame:
        self.catalog.convert(name, {"schemaless": "document"}.get(kind.lower(), kind.lower()), schema)
        return self._done("converted")

    def _create_search(self, name: str, fields: str, analyzer: str | None, fuzzy: str | None) -> DataFrame:
        c = self.catalog.get(name)
        names = [f.strip() for f in fields.split(",")]
        if missing := [f for f in names if f not in c.df.columns]:
            raise ValueError(f"collection {name!r} has no field {missing[0]!r}")
        self.indexes[name] = textindex.build(c.df, names, c.key or "id", analyzer or "standard", int(fuzzy or 0))
        return self._done("created")

    def _drop_search(self, name: str) -> DataFrame:
        self.indexes.pop(name)
        return self._done("dropped")

    def _reindex(self, name: str) -> DataFrame:
        """Build the search index of a collection again, from what it holds now."""
        i, c = self.indexes[name], self.catalog.get(name)
        self.indexes[name] = textindex.build(c.df, i.fields, c.key or "id", i.analyzer, i.fuzzy, i.synonyms)
        return self._done("reindexed")

    def _text_search(self, name: str, query: str, field: str | None, limit: str | None) -> DataFrame:
        self.catalog.get(name)
        if name not in self.indexes:
            return self.spark.createDataFrame([], "id string, score double")
        found = self.indexes[name].search(query, field).orderBy(F.desc("score"), "id")
        return found.limit(int(limit)) if limit else found

    def _match(self, text: str, on: str | None) -> DataFrame:
        """MATCH ... RETURN ... [ON edges]; node labels come from the option `labels` of the collection."""
        c = self.catalog.get(on or "edges")
        labels = c.options.get("labels")
        return graph.match_text(c.df, text, self.catalog.get(str(labels)).df if labels else None)

    def _truncate(self, name: str) -> DataFrame:
        c = self.catalog.get(name)
        self.catalog.register(name, c.df.limit(0), c.kind, c.key, **c.options)
        return self._done("truncated")

    def _drop(self, name: str) -> DataFrame:
        self.catalog.drop(name)
        return self._done("dropped")
