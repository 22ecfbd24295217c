"""Arrays, changes to tables, key-value tables, leaderboards and histories (inventory rows 153 to 204)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import Catalog
from tessera.functions.expressions import exact_total
from tessera.operators import dml as D
from tessera.operators import kv as K
from tessera.operators import ndarray as N
from tessera.operators import temporal as H
from tessera.plans.registry import pair
from tessera.plans.router import Router

DIMS = ["x", "y"]
_CELLS = "(SELECT l_orderkey % 50 AS x, CAST(l_linenumber AS BIGINT) AS y, l_quantity AS qty, l_orderkey * 10 + l_linenumber AS sys, CASE WHEN l_orderkey % 17 = 0 THEN 'tombstone' WHEN l_orderkey % 40 = 39 THEN 'erased' ELSE 'live' END AS tag, l_orderkey AS valid_from, CASE WHEN l_orderkey % 2 = 0 THEN l_orderkey + 300 END AS valid_until FROM lineitem)"


def cells(t):
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    return t.lineitem.select(
        (o % 50).alias("x"), n.cast("bigint").alias("y"), F.col("l_quantity").alias("qty"), (o * 10 + n).alias("sys"), F.when(o % 17 == 0, "tombstone").when(o % 40 == 39, "erased").otherwise("live").alias("tag"), o.alias("valid_from"), F.when(o % 2 == 0, o + 300).alias("valid_until"),
    )


def _live(where="1=1", final="1=1"):
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY sys DESC, qty DESC) AS rn FROM {_CELLS} c WHERE (x, y) NOT IN (SELECT (x, y) FROM {_CELLS} e WHERE tag = 'erased') AND {where}) WHERE rn = 1 AND tag = 'live' AND {final})"


def _unique_cells(t):
    """Versions of one cell have different times, so the newest is one row."""
    rest = ["qty", "tag", "valid_from", "valid_until"]
    return cells(t).groupBy("x", "y", "sys").agg(F.max(F.struct(*rest)).alias("v")).select("x", "y", F.col("v.qty").alias("qty"), "sys", F.col("v.tag").alias("tag"), F.col("v.valid_from").alias("valid_from"), F.col("v.valid_until").alias("valid_until"))


def _stock(t):
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("bigint").alias("qty"), F.col("p_brand").alias("name"))


def _delivery(t):
    return t.part.select((F.col("p_partkey") * 2).alias("id"), F.lit(7).cast("bigint").alias("qty"), F.lit("new").alias("name"))


_STOCK = "(SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS qty, p_brand AS name FROM part)"
_DELIVERY = "(SELECT p_partkey * 2 AS id, CAST(7 AS BIGINT) AS qty, 'new' AS name FROM part)"
_MERGED = f"SELECT coalesce(s.id, d.id) AS id, {{q}} AS qty, {{n}} AS name FROM {_STOCK} s FULL JOIN {_DELIVERY} d ON s.id = d.id"

NOW = 500_000
_KV = f"(SELECT 'user:' || CAST(c_custkey AS VARCHAR) AS key, '{{\"n\":' || CAST(c_nationkey AS VARCHAR) || ',\"seg\":\"' || c_mktsegment || '\"}}' AS value, CASE WHEN c_custkey % 4 = 0 THEN c_custkey * 1000 END AS expires_at FROM customer)"
_ALIVE = f"(expires_at IS NULL OR expires_at > {NOW})"


def kv(t):
    k = F.col("c_custkey")
    value = F.concat(F.lit('{"n":'), F.col("c_nationkey").cast("string"), F.lit(',"seg":"'), F.col("c_mktsegment"), F.lit('"}'))
    return t.customer.select(F.concat(F.lit("user:"), k.cast("string")).alias("key"), value.alias("value"), F.when(k % 4 == 0, k * 1000).alias("expires_at"))


def counters(t):
    return t.supplier.select(F.col("s_name").alias("key"), F.col("s_nationkey").cast("string").alias("value"), F.lit(None).cast("long").alias("expires_at"))


def _first_two(t):
    """The two least keys of the counters with their values."""
    return [(r.key, r.value) for r in counters(t).orderBy("key").limit(2).collect()]


_COUNTERS = "(SELECT s_name AS key, CAST(s_nationkey AS VARCHAR) AS value, CAST(NULL AS BIGINT) AS expires_at FROM supplier)"
_PLAYERS = "(SELECT user_id AS key, CAST(floor(sum(value)) AS BIGINT) AS score, max(ts) AS ts FROM events GROUP BY user_id)"
_BOARD = f"(SELECT *, CAST(row_number() OVER (ORDER BY score DESC, key) AS BIGINT) AS rank FROM {_PLAYERS} p)"


def players(t):
    return t.events.groupBy(F.col("user_id").alias("key")).agg(F.floor(exact_total(F.col("value"))).cast("bigint").alias("score"), F.max("ts").alias("ts"))


_HIST = "(SELECT o_custkey AS id, o_orderkey AS system_from, o_orderkey - 5 AS valid_from, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 2000 END AS valid_until, CASE WHEN o_orderkey % 11 = 0 THEN 'tombstone' ELSE 'live' END AS tag, o_orderstatus AS body FROM orders)"


def hist(t):
    o = F.col("o_orderkey")
    return t.orders.select(F.col("o_custkey").alias("id"), o.alias("system_from"), (o - 5).alias("valid_from"), F.when(o % 3 == 0, o + 2000).alias("valid_until"), F.when(o % 11 == 0, "tombstone").otherwise("live").alias("tag"), F.col("o_orderstatus").alias("body"))


def _asof(where: str, final: str) -> str:
    return f"SELECT id, system_from, body FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY system_from DESC) AS rn FROM {_HIST} h WHERE {where}) WHERE rn = 1 AND tag = 'live' AND {final}"


def _router(t):
    catalog = Catalog(t.spark)
    catalog.register("players_t", players(t), "kv", "key")
    catalog.register("grid_t", _unique_cells(t), "array", dims=DIMS)
    r = Router(catalog)
    r.sql("CREATE SORTED INDEX board_i ON players_t (score DESC) KEY key")
    return r


def _cols(df, *names):
    return df.select(*names)


QUERIES = {
    # arrays
    "array_slice": pair(lambda t: N.array_slice(_unique_cells(t), DIMS, {"x": (5, 20), "y": (1, 3)}).select("x", "y", "qty"), f"SELECT x, y, qty FROM {_live('x BETWEEN 5 AND 20 AND y BETWEEN 1 AND 3')} l"),
    "array_slice_as_of": pair(lambda t: N.array_slice(_unique_cells(t), DIMS, {"x": (0, 30)}, ["qty"], as_of=5000, valid_at=400).select("x", "y", "qty"), f"SELECT x, y, qty FROM {_live('x BETWEEN 0 AND 30 AND sys <= 5000', 'valid_from <= 400 AND (valid_until IS NULL OR valid_until > 400)')} l"),
    "array_project": pair(lambda t: N.array_project(_unique_cells(t), DIMS, ["qty"]).select("x", "y", "qty", "valid_from"), f"SELECT x, y, qty, valid_from FROM {_live()} l"),
    **{f"array_agg_{h}": pair(lambda t, h=h: N.array_aggregate(_unique_cells(t), DIMS, "qty", h).select(F.round(F.col("value").cast("double"), 4).alias("value")), f"SELECT round(CAST({f}(qty) AS DOUBLE), 4) AS value FROM {_live()} l") for h, f in (("sum", "sum"), ("count", "count"), ("min", "min"), ("max", "max"), ("mean", "avg"))},
    "array_agg_by_dim": pair(lambda t: N.array_aggregate(_unique_cells(t), DIMS, "qty", "sum", "y"), f"SELECT y AS key, sum(qty) AS value FROM {_live()} l GROUP BY y"),
    **{
        f"array_{op}": pair(
            lambda t, op=op: N.array_elementwise(_unique_cells(t).where("x < 30"), _unique_cells(t).where("x > 10"), DIMS, "qty", op).select("x", "y", F.round("value", 6).alias("value")),
            f"SELECT coalesce(a.x, b.x) AS x, coalesce(a.y, b.y) AS y, round(a.qty {s} b.qty, 6) AS value FROM (SELECT * FROM {_live()} l WHERE x < 30) a FULL JOIN (SELECT * FROM {_live()} l WHERE x > 10) b ON a.x = b.x AND a.y = b.y",
        )
        for op, s in (("add", "+"), ("sub", "-"), ("mul", "*"), ("div", "/"))
    },
    "array_put_delete": pair(
        lambda t: N.live(N.array_delete(N.array_put(_unique_cells(t), t.spark.createDataFrame([(1, 1, 99.0, 10**9, "live", 0, None)], _unique_cells(t).schema), DIMS, {"x": (0, 63)}, ["qty"]), t.spark.createDataFrame([(2, 1)], "x bigint, y bigint"), DIMS, 10**9), DIMS).select("x", "y", "qty"),
        f"SELECT x, y, qty FROM {_live()} l WHERE NOT (x IN (1, 2) AND y = 1) UNION ALL SELECT 1, 1, 99.0",
    ),
    "array_erase": pair(lambda t: N.live(N.array_delete(_unique_cells(t), t.spark.createDataFrame([(2, 1), (3, 2)], "x bigint, y bigint"), DIMS, 10**9, "erased"), DIMS, as_of=9000).select("x", "y", "qty"), f"SELECT x, y, qty FROM {_live('sys <= 9000')} l WHERE NOT (x = 2 AND y = 1) AND NOT (x = 3 AND y = 2)"),
    "array_compact": pair(lambda t: N.array_compacted(_unique_cells(t), DIMS).agg(F.count(F.lit(1)).alias("n")), f"SELECT CAST(count(DISTINCT (x, y)) AS BIGINT) AS n FROM {_CELLS} c"),
    "array_surrogates": pair(lambda t: N.surrogates(_unique_cells(t), DIMS, {"y": (2, 2)}, "qty"), f"SELECT DISTINCT qty FROM {_live('y = 2')} l"),
    "array_router": pair(lambda t: _router(t).sql("SELECT * FROM NDARRAY_SLICE(grid_t, 'x', 5, 9, 'y', NULL, 2)").select("x", "y", "qty"), f"SELECT x, y, qty FROM {_live('x BETWEEN 5 AND 9 AND y <= 2')} l"),
    # changes
    "dml_insert_nothing": pair(lambda t: D.insert(_stock(t), _delivery(t), ["id"], "nothing"), f"SELECT * FROM {_STOCK} s UNION ALL SELECT * FROM {_DELIVERY} d WHERE id NOT IN (SELECT id FROM {_STOCK} s)"),
    "dml_insert_update": pair(lambda t: D.insert(_stock(t), _delivery(t), ["id"], "update", {"qty": F.col("qty") + F.col("excluded_qty")}), _MERGED.format(q="CASE WHEN s.id IS NULL THEN d.qty WHEN d.id IS NULL THEN s.qty ELSE s.qty + d.qty END", n="coalesce(s.name, d.name)")),
    "dml_insert": pair(lambda t: D.insert(_stock(t), _delivery(t).withColumn("id", -F.col("id") - 1), ["id"]), f"SELECT * FROM {_STOCK} s UNION ALL SELECT -id - 1, qty, name FROM {_DELIVERY} d"),
    "dml_upsert": pair(lambda t: D.upsert(_stock(t), _delivery(t).select("id", "qty"), ["id"]), _MERGED.format(q="coalesce(d.qty, s.qty)", n="s.name")),
    "dml_update_swap": pair(lambda t: D.update(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), {"o_orderkey": F.col("o_custkey"), "o_custkey": F.col("o_orderkey"), "o_orderstatus": F.lower("o_orderstatus")}, F.col("o_orderkey") % 2 == 0), "SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE o_orderkey END AS o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE o_custkey END AS o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS o_orderstatus FROM orders"),
    "dml_delete": pair(lambda t: D.delete(t.events.select("event_id", "event_type"), F.nullif(F.col("event_type"), F.lit("view")) == "click"), "SELECT event_id, event_type FROM events WHERE NOT coalesce(nullif(event_type, 'view') = 'click', false)"),
    "dml_insert_select": pair(lambda t: D.insert_select(_stock(t), t.supplier, {"id": -F.col("s_suppkey") - 1, "qty": F.lit(1), "name": F.col("s_name")}), f"SELECT * FROM {_STOCK} s UNION ALL SELECT -s_suppkey - 1, 1, s_name FROM supplier"),
    "dml_update_from": pair(lambda t: D.update_from(_stock(t), _delivery(t), ["id"], {"qty": F.col("excluded_qty") * 2}), f"SELECT s.id, CASE WHEN d.id IS NOT NULL THEN d.qty * 2 ELSE s.qty END AS qty, s.name FROM {_STOCK} s LEFT JOIN {_DELIVERY} d ON s.id = d.id"),
    "dml_merge": pair(
        lambda t: D.merge(_stock(t), _delivery(t), ["id"], {"qty": F.col("qty") + F.col("excluded_qty")}, {"qty": F.col("excluded_qty"), "name": F.col("excluded_name")}, {"name": F.lit("old")}),
        _MERGED.format(q="CASE WHEN s.id IS NULL THEN d.qty WHEN d.id IS NULL THEN s.qty ELSE s.qty + d.qty END", n="CASE WHEN s.id IS NULL THEN d.name WHEN d.id IS NULL THEN 'old' ELSE s.name END"),
    ),
    "dml_merge_delete": pair(lambda t: D.merge(_stock(t), _delivery(t), ["id"], "delete", None, None), f"SELECT * FROM {_STOCK} s WHERE id NOT IN (SELECT id FROM {_DELIVERY} d)"),
    "dml_truncate": pair(lambda t: D.truncate(_stock(t)), f"SELECT * FROM {_STOCK} s WHERE false"),
    "dml_unique_check": pair(lambda t: D.unique_check(t.customer, ["c_mktsegment"], F.col("c_nationkey") < 5, True), "SELECT lower(c_mktsegment) AS c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM customer WHERE c_nationkey < 5 GROUP BY 1 HAVING count(*) > 1"),
    "dml_convert": pair(lambda t: D.to_typed(D.to_document(t.nation, "n_nationkey"), "n_nationkey int, n_name string").select(F.col("n_nationkey").cast("bigint").alias("k"), "n_name"), "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name FROM nation"),
    "dml_batch": pair(lambda t: D.apply_batch(_stock(t), [lambda s: D.update(s, {"qty": F.col("qty") + 1}), lambda s: D.delete(s, F.col("qty") > 30)]), f"SELECT id, qty + 1 AS qty, name FROM {_STOCK} s WHERE qty + 1 <= 30"),
    # key-value
    "kv_get": pair(lambda t: K.get(kv(t), ["user:1", "user:4", "user:1400"], NOW).select("key", "value"), f"SELECT key, value FROM {_KV} k WHERE key IN ('user:1', 'user:4', 'user:1400') AND {_ALIVE}"),
    "kv_field_get": pair(lambda t: K.field_get(kv(t), "user:7", ["n", "seg", "none"], NOW), f"SELECT key, json_extract_string(value, '$.n') AS n, json_extract_string(value, '$.seg') AS seg, json_extract_string(value, '$.none') AS none FROM {_KV} k WHERE key = 'user:7' AND {_ALIVE}"),
    "kv_ttl": pair(lambda t: K.ttl(kv(t), ["user:3", "user:8", "user:800"], NOW), f"SELECT key, CAST(coalesce(expires_at - {NOW}, -1) AS BIGINT) AS ttl_ms FROM {_KV} k WHERE key IN ('user:3', 'user:8', 'user:800') AND {_ALIVE}"),
    "kv_scan_glob": pair(lambda t: K.scan(kv(t), NOW, "user:1?5*", "user:12", 20).select("key"), f"SELECT key FROM {_KV} k WHERE {_ALIVE} AND regexp_full_match(key, 'user:1.5.*') AND key > 'user:12' ORDER BY key LIMIT 20"),
    "kv_range": pair(lambda t: K.key_range(kv(t), NOW, "user:2", "user:3", 50).select("key"), f"SELECT key FROM {_KV} k WHERE {_ALIVE} AND key >= 'user:2' AND key < 'user:3' ORDER BY key LIMIT 50"),
    "kv_rows": pair(lambda t: K.as_rows(kv(t), NOW, {"n": "bigint", "seg": "string", "gone": "string"}), f"SELECT key, CAST(NULL AS VARCHAR) AS gone, CAST(json_extract_string(value, '$.n') AS BIGINT) AS n, json_extract_string(value, '$.seg') AS seg FROM {_KV} k WHERE {_ALIVE}"),
    "kv_put_if_absent": pair(lambda t: K.put(counters(t), counters(t).withColumn("key", F.concat(F.col("key"), F.when(F.col("value").cast("int") < 10, "x").otherwise(""))).withColumn("value", F.lit("0")), True), f"SELECT * FROM {_COUNTERS} c UNION ALL SELECT key || 'x', '0', expires_at FROM {_COUNTERS} c WHERE CAST(value AS INT) < 10"),
    "kv_put": pair(lambda t: K.put(counters(t), counters(t).where("value = '3'").withColumn("value", F.lit("33"))), f"SELECT key, CASE WHEN value = '3' THEN '33' ELSE value END AS value, expires_at FROM {_COUNTERS} c"),
    "kv_delete_expire": pair(lambda t: K.compacted(K.expire(K.remove(kv(t), ["user:1", "user:2"]), ["user:3"], 1), NOW).agg(F.count(F.lit(1)).alias("n")), f"SELECT CAST(count(*) AS BIGINT) AS n FROM {_KV} k WHERE {_ALIVE} AND key NOT IN ('user:1', 'user:2', 'user:3')"),
    "kv_increment": pair(lambda t: K.increment(counters(t), counters(t).agg(F.min("key")).first()[0], 5, 0).select("key", "value"), f"SELECT key, CASE WHEN r = 1 THEN CAST(CAST(value AS BIGINT) + 5 AS VARCHAR) ELSE value END AS value FROM (SELECT *, row_number() OVER (ORDER BY key) AS r FROM {_COUNTERS} c)"),
    "kv_cas": pair(
        lambda t: K.compare_and_set(K.compare_and_set(counters(t), *_first_two(t)[0], "new", 0), _first_two(t)[1][0], "wrong", "lost", 0).select("key", "value"),
        f"SELECT key, CASE WHEN r = 1 THEN 'new' ELSE value END AS value FROM (SELECT *, row_number() OVER (ORDER BY key) AS r FROM {_COUNTERS} c)",
    ),
    "kv_get_set": pair(lambda t: K.get_and_set(counters(t), _first_two(t)[0][0], "new", 0)[0].select("key", "value"), f"SELECT key, CASE WHEN r = 1 THEN 'new' ELSE value END AS value FROM (SELECT *, row_number() OVER (ORDER BY key) AS r FROM {_COUNTERS} c)"),
    "kv_get_set_old": pair(lambda t: K.get_and_set(counters(t), _first_two(t)[0][0], "new", 0)[1], f"SELECT value FROM {_COUNTERS} c ORDER BY key LIMIT 1"),
    "kv_transfer": pair(
        lambda t: K.transfer(counters(t).withColumn("value", F.lit("10")), _first_two(t)[0][0], _first_two(t)[1][0], 4.0, 0).select("key", F.col("value").cast("double").alias("value")),
        f"SELECT key, CAST(CASE r WHEN 1 THEN 6 WHEN 2 THEN 14 ELSE 10 END AS DOUBLE) AS value FROM (SELECT *, row_number() OVER (ORDER BY key) AS r FROM {_COUNTERS} c)",
    ),
    "kv_transfer_item": pair(
        lambda t: K.transfer_item(kv(t), "user:5", "user:6", "seg", ["n", "seg"], NOW).select("key", F.get_json_object("value", "$.n").alias("n"), F.get_json_object("value", "$.seg").alias("seg")),
        f"SELECT key, json_extract_string(value, '$.n') AS n, CASE WHEN key = 'user:5' THEN NULL WHEN key = 'user:6' THEN (SELECT json_extract_string(value, '$.seg') FROM {_KV} o WHERE key = 'user:5') ELSE json_extract_string(value, '$.seg') END AS seg FROM {_KV} k WHERE {_ALIVE}",
    ),
    "kv_field_set": pair(
        lambda t: K.field_set(kv(t), "user:5", "seg", F.lit("Z"), ["n", "seg"], NOW).select("key", F.get_json_object("value", "$.seg").alias("seg")),
        f"SELECT key, CASE WHEN key = 'user:5' THEN 'Z' ELSE json_extract_string(value, '$.seg') END AS seg FROM {_KV} k WHERE {_ALIVE}",
    ),
    "kv_secondary_index": pair(
        lambda t: K.by_field(K.field_index(kv(t), "seg", NOW), kv(t), "BUILDING", NOW).select("key", "value"), f"SELECT key, value FROM {_KV} k WHERE {_ALIVE} AND json_extract_string(value, '$.seg') = 'BUILDING'"
    ),
    # leaderboards
    "board_rank": pair(lambda t: _router(t).sql("SELECT RANK(board_i, '17')"), f"SELECT max(rank) AS rank FROM {_BOARD} b WHERE key = 17"),
    "board_rank_absent": pair(lambda t: K.rank_of(K.leaderboard(players(t)), -1), f"SELECT max(rank) AS rank FROM {_BOARD} b WHERE key = -1"),
    "board_topk": pair(lambda t: _router(t).sql("SELECT TOPK(board_i, 10)"), f"SELECT rank, key FROM {_BOARD} b WHERE rank <= 10"),
    "board_range": pair(lambda t: _router(t).sql("SELECT RANGE(board_i, 2000, *)"), f"SELECT rank, key, score FROM {_BOARD} b WHERE score >= 2000"),
    "board_count": pair(lambda t: _router(t).sql("SELECT SORTED_COUNT(board_i)"), f"SELECT CAST(count(*) AS BIGINT) AS count FROM {_BOARD} b"),
    "board_score": pair(lambda t: _router(t).sql("SELECT SCORE(board_i, '5')"), f"SELECT score FROM {_BOARD} b WHERE key = 5"),
    "board_window": pair(lambda t: K.top(K.leaderboard(players(t), window="day", now="2024-01-30 12:00:00"), 5).select("rank", "key"), f"SELECT CAST(row_number() OVER (ORDER BY score DESC, key) AS BIGINT) AS rank, key FROM {_PLAYERS} p WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' QUALIFY rank <= 5"),
    # histories
    "temporal_as_of": pair(lambda t: _cols(H.as_of(hist(t), 5000), "id", "system_from", "body"), _asof("system_from <= 5000", "1=1")),
    "temporal_bitemporal": pair(lambda t: _cols(H.as_of(hist(t), 9000, 6000), "id", "system_from", "body"), _asof("system_from <= 9000", "valid_from <= 6000 AND (valid_until IS NULL OR valid_until > 6000)")),
    "temporal_current": pair(lambda t: _cols(H.current(hist(t)), "id", "system_from", "body"), _asof("1=1", "1=1")),
    "temporal_valid_time": pair(lambda t: _cols(H.valid_at(hist(t), 4000), "id", "system_from", "body"), f"SELECT id, system_from, body FROM {_HIST} h WHERE valid_from <= 4000 AND (valid_until IS NULL OR valid_until > 4000)"),
    "temporal_purge": pair(lambda t: _cols(H.purged(hist(t).withColumnRenamed("valid_until", "system_to"), 6000), "id", "system_from"), f"SELECT id, system_from FROM {_HIST} h WHERE valid_until IS NULL OR valid_until >= 6000"),
    "crdt_last_writer": pair(lambda t: _cols(H.last_writer(hist(t), ["id"], "system_from"), "id", "system_from", "body"), f"SELECT id, system_from, body FROM {_HIST} h QUALIFY row_number() OVER (PARTITION BY id ORDER BY system_from DESC) = 1"),
    "crdt_list_edit": pair(lambda t: H.list_move(H.list_delete(H.list_insert(t.nation.select("n_nationkey", F.array(F.lit("a"), F.lit("b"), F.col("n_name")).alias("l")), "l", 1, "z"), "l", 0), "l", 2, 0).select("n_nationkey", F.array_join("l", ",").alias("l")), "SELECT n_nationkey, n_name || ',z,b' AS l FROM nation"),
}
