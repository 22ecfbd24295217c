"""Time series and continuous aggregates (inventory rows 78 to 99)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.catalog import Catalog
from tessera.operators import timeseries as T
from tessera.operators import views
from tessera.plans.registry import pair
from tessera.plans.router import Router
from tessera.session import shared_dir
from tessera.sources import readers
from tessera.streaming import continuous

DAY, HOUR, START = T.UNITS["d"], T.UNITS["h"], 1704067200000  # 2024-01-01
_MS = "epoch_us(ts) // 1000"
_SERIES = f"SELECT {_MS} AS ts, value, user_id AS series_id, event_type FROM events"


def series(t):
    return t.events.select(T.epoch_ms(F.col("ts")).alias("ts"), "value", F.col("user_id").alias("series_id"), "event_type")


def _r(df, *cols):
    return df.select(*[F.round(c, 4).alias(c) if c in cols else F.col(c) for c in df.columns])


def rollup(df, by=()):
    return T.bucketed(df, HOUR, continuous.ROLLUP, by)


def _router(t):
    catalog = Catalog(t.spark)
    catalog.register("metrics_src", series(t), "timeseries", time="ts")
    r = Router(catalog)
    r.sql("CREATE CONTINUOUS AGGREGATE hourly_rollup ON metrics_src BUCKET '1h' AGGREGATE sum(value) AS total, count(value) AS n GROUP BY event_type")
    return r


def _hourly(where="1=1", by="", name="s"):
    return f"SELECT ts - ts % {HOUR} AS bucket{', ' + by if by else ''}, CAST(count(value) AS BIGINT) AS count, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max FROM ({_SERIES}) {name} WHERE {where} GROUP BY ALL"


def _stream(t):
    df = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events.parquet*")
    samples = df.select(T.epoch_ms(F.col("ts")).alias("ts"), "value", "event_type")
    return _r(continuous.run_rollup(t.spark, samples, DAY, f"{shared_dir(t.spark)}/rollup-{uuid.uuid4().hex}", ["event_type"]), "sum")


def _order_log(t):
    """Changes of orders: all of the first kinds are new, those of one priority are deleted, finished ones get cheaper."""
    o = t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    key = F.col("o_orderkey")
    new = o.where("o_orderstatus <> 'F'").select((key * 3).alias("lsn"), F.lit("insert").alias("op"), *o.columns)
    gone = o.where("o_orderpriority = '1-URGENT'").select((key * 3 + 2).alias("lsn"), F.lit("delete").alias("op"), *o.columns)
    less = o.where("o_orderstatus = 'F'").withColumn("o_totalprice", F.col("o_totalprice") / 2).select((key * 3 + 1).alias("lsn"), F.lit("update").alias("op"), *o.columns)
    return new.union(gone).union(less)


def _copied(t):
    return t.orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")


_AFTER = "(SELECT o_orderkey, o_orderpriority, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 2 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderpriority <> '1-URGENT')"


def _described(t):
    catalog = Catalog(t.spark)
    catalog.register("described_nation", t.nation.select("n_nationkey", "n_name"), "strict", "n_nationkey")
    return Router(catalog).sql("DESCRIBE described_nation")


_SPINE = f"(SELECT * FROM (SELECT DISTINCT series_id FROM ({_SERIES}) s) i, (SELECT unnest(generate_series({START}, {START + 29 * DAY}, {DAY // 4})) AS bucket) x)"
_SPARSE = f"(SELECT series_id, ts - ts % {DAY // 4} AS bucket, avg(value) AS v FROM ({_SERIES}) s GROUP BY ALL)"


def _gap(fill):
    def run(t):
        b = T.bucketed(series(t), DAY // 4, ["avg"], ["series_id"]).withColumnRenamed("avg", "v")
        return _r(T.gap_filled(b, DAY // 4, START, START + 29 * DAY, fill, ["series_id"]), "v")

    return run


def _exported(t):
    """A series written as CSV and read back."""
    path = f"{shared_dir(t.spark)}/series-{uuid.uuid4().hex}"
    readers.export_csv(series(t).select("ts", "value", "series_id"), path)
    return readers.csv(t.spark, path)


QUERIES = {
    "ts_scan": pair(lambda t: T.series_scan(series(t), START, START + 3 * DAY, F.col("event_type") == "click").select("ts", "value", "series_id"), f"SELECT ts, value, series_id FROM ({_SERIES}) s WHERE ts BETWEEN {START} AND {START + 3 * DAY} AND event_type = 'click'"),
    "ts_as_of": pair(lambda t: T.series_scan(series(t), as_of=START + 5 * DAY).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last")), f"SELECT CAST(count(*) AS BIGINT) AS n, max(ts) AS last FROM ({_SERIES}) s WHERE ts <= {START + 5 * DAY}"),
    "ts_bucket": pair(lambda t: _r(rollup(series(t)), "sum"), _hourly()),
    "ts_bucket_group": pair(lambda t: _r(rollup(series(t).where("value > 10"), ["event_type"]), "sum"), _hourly("value > 10", "event_type")),
    "ts_bucket_having": pair(lambda t: T.bucketed(series(t), HOUR, ["count", "avg"], having=F.col("count") > 15).select("bucket", "count", F.round("avg", 4).alias("avg")).orderBy("bucket").limit(50), f"SELECT ts - ts % {HOUR} AS bucket, CAST(count(value) AS BIGINT) AS count, round(avg(value), 4) AS avg FROM ({_SERIES}) s GROUP BY ALL HAVING count(value) > 15 ORDER BY bucket LIMIT 50"),
    "ts_gap_null": pair(_gap(None), f"SELECT bucket, series_id, round(v, 4) AS v FROM {_SPINE} a LEFT JOIN {_SPARSE} b USING (bucket, series_id)"),
    "ts_gap_prev": pair(_gap("prev"), f"SELECT bucket, series_id, round(last_value(v IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS v FROM {_SPINE} a LEFT JOIN {_SPARSE} b USING (bucket, series_id)"),
    "ts_gap_literal": pair(_gap("-1.5"), f"SELECT bucket, series_id, round(coalesce(v, -1.5), 4) AS v FROM {_SPINE} a LEFT JOIN {_SPARSE} b USING (bucket, series_id)"),
    "ts_downsample": pair(lambda t: _r(T.downsampled(series(t), DAY), "value"), f"SELECT series_id, ts - ts % {DAY} AS bucket, round(avg(value), 4) AS value FROM ({_SERIES}) s GROUP BY ALL"),
    "ts_downsample_ingest": pair(
        lambda t: _r(T.downsampled(series(t), DAY, midpoint=True, closed_only=True), "value"),
        f"SELECT series_id, bucket + {DAY // 2} AS bucket, value FROM (SELECT *, max(bucket) OVER (PARTITION BY series_id) AS m FROM (SELECT series_id, ts - ts % {DAY} AS bucket, round(avg(value), 4) AS value FROM ({_SERIES}) s GROUP BY ALL)) WHERE bucket < m",
    ),
    "ca_create": pair(lambda t: _router(t).sql("SELECT bucket, event_type, round(total, 4) AS total, n FROM hourly_rollup"), f"SELECT ts - ts % {HOUR} AS bucket, event_type, round(sum(value), 4) AS total, CAST(count(value) AS BIGINT) AS n FROM ({_SERIES}) s GROUP BY ALL"),
    "ca_show": pair(lambda t: _router(t).sql("SHOW CONTINUOUS AGGREGATES"), "SELECT 'hourly_rollup' AS name, 'metrics_src' AS source, '1h' AS bucket, '' AS options"),
    "ca_first_last": pair(
        lambda t: T.bucketed(series(t).groupBy("series_id", "ts").agg(F.max("value").alias("value")), DAY, ["first", "last", "avg", "nothing"], ["series_id"]).select("series_id", "bucket", "first", "last", F.round("avg", 4).alias("avg"), "nothing"),
        f"SELECT series_id, ts - ts % {DAY} AS bucket, arg_min(value, ts) AS first, arg_max(value, ts) AS last, round(avg(value), 4) AS avg, CAST(NULL AS DOUBLE) AS nothing FROM (SELECT series_id, ts, max(value) AS value FROM ({_SERIES}) s GROUP BY ALL) u GROUP BY ALL",
    ),
    "ca_count_distinct": pair(lambda t: T.bucketed(series(t).withColumn("value", F.floor("value") % 5), 30 * DAY, ["count_distinct"]), f"SELECT ts - ts % {30 * DAY} AS bucket, CAST(count(DISTINCT floor(value) % 5) AS BIGINT) AS count_distinct FROM ({_SERIES}) s GROUP BY ALL"),
    "ca_refresh_late_data": pair(lambda t: _r(T.merge_rollup(rollup(series(t).where("value > 40")), rollup(series(t).where("value <= 40"))), "sum"), _hourly()),
    "ca_watermark": pair(lambda t: T.rollup_watermark(rollup(series(t))), f"SELECT max(ts - ts % {HOUR}) AS watermark FROM ({_SERIES}) s"),
    "ca_last_values": pair(lambda t: _r(T.rollup_last(rollup(series(t), ["event_type"]), ["event_type"]), "sum"), f"SELECT event_type, bucket, count, sum, min, max FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY bucket DESC) AS r FROM ({_hourly(by='event_type')}) x) WHERE r = 1"),
    "ca_range": pair(lambda t: _r(T.rollup_range(rollup(series(t)), START, START + 2 * DAY), "sum"), f"SELECT * FROM ({_hourly()}) x WHERE bucket BETWEEN {START} AND {START + 2 * DAY}"),
    "ca_retention": pair(lambda t: _r(T.rollup_retained(rollup(series(t)), START + 29 * DAY, 4 * DAY), "sum"), f"SELECT * FROM ({_hourly()}) x WHERE bucket > {START + 25 * DAY}"),
    "ts_retention": pair(lambda t: T.series_retained(series(t), START + 20 * DAY, 7 * DAY).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first")), f"SELECT CAST(count(*) AS BIGINT) AS n, min(ts) AS first FROM (SELECT *, max(ts) OVER (PARTITION BY ts - ts % {7 * DAY}) AS m FROM ({_SERIES}) s) WHERE m >= {START + 20 * DAY}"),
    "ts_compaction": pair(lambda t: T.compacted(series(t), 4).select("ts", "value"), f"SELECT ts, value FROM ({_SERIES}) s"),
    "ts_routed": pair(lambda t: T.routed(series(t), series(t).withColumn("value", F.lit(0.0)), START + 10 * DAY).select("ts", "value"), f"SELECT ts, CASE WHEN ts < {START + 10 * DAY} THEN 0.0 ELSE value END AS value FROM ({_SERIES}) s"),
    "htap_view": pair(lambda t: views.refreshed(_copied(t), _order_log(t), ["o_orderkey"]), f"SELECT * FROM {_AFTER} a"),
    "htap_aggregate_view": pair(
        lambda t: _r(views.counts_refreshed(_copied(t).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), _copied(t), _order_log(t), ["o_orderkey"], ["o_orderpriority"], "o_totalprice"), "total"),
        f"SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 4) AS total FROM {_AFTER} a GROUP BY o_orderpriority",
    ),
    "shape_subscription": pair(
        lambda t: continuous.shape_changes(_order_log(t), "o_totalprice > 100000", 3000).select("lsn", "op", "o_orderkey"),
        "SELECT o_orderkey * 3 AS lsn, CASE WHEN o_totalprice > 100000 THEN 'put' ELSE 'drop' END AS op, o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey * 3 > 3000 UNION ALL SELECT o_orderkey * 3 + 2, 'drop', o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey * 3 + 2 > 3000 UNION ALL SELECT o_orderkey * 3 + 1, CASE WHEN o_totalprice / 2 > 100000 THEN 'put' ELSE 'drop' END, o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey * 3 + 1 > 3000",
    ),
    "shape_watermark": pair(lambda t: continuous.shape_watermark(_order_log(t)), "SELECT max(greatest(CASE WHEN o_orderstatus <> 'F' THEN o_orderkey * 3 ELSE o_orderkey * 3 + 1 END, CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey * 3 + 2 ELSE 0 END)) AS watermark FROM orders"),
    "ca_percentile": pair(lambda t: T.bucketed(series(t), DAY, ["percentile(0.9)"]).select("bucket", F.col("`percentile(0.9)`").alias("p90")), f"SELECT ts - ts % {DAY} AS bucket, quantile_disc(value, 0.9) AS p90 FROM ({_SERIES}) s GROUP BY ALL"),
    "ca_topk": pair(lambda t: T.bucketed(series(t).withColumn("value", F.floor("value")), DAY, ["topk(20)"], ["event_type"]).select("event_type", "bucket", F.col("topk(20)").alias("tracked")), f"SELECT event_type, ts - ts % {DAY} AS bucket, CAST(least(count(DISTINCT floor(value)), 20) AS BIGINT) AS tracked FROM ({_SERIES}) s GROUP BY ALL"),
    "ts_export_csv": pair(_exported, f"SELECT ts, value, series_id FROM ({_SERIES}) s"),
    "describe_collection": pair(_described, "SELECT * FROM (VALUES ('n_nationkey', 'int', true), ('n_name', 'string', true)) v(\"column\", type, nullable)"),
    "stream_rollup": pair(_stream, f"SELECT ts - ts % {DAY} AS bucket, event_type, CAST(count(value) AS BIGINT) AS count, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max FROM ({_SERIES}) s GROUP BY ALL"),
}
