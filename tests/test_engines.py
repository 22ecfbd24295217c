"""Time series, search, graph, spatial, array, key-value, history and statement tests on small fixtures."""

import pytest
from pyspark.sql import functions as F

from tessera.catalog import Catalog
from tessera.operators import graph, kv, ndarray, search, spatial, temporal, timeseries
from tessera.operators.ranking import ranked
from tessera.plans import catalogue
from tessera.plans.router import Router
from tessera.streaming import continuous


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def metrics(spark):
    return spark.createDataFrame([(1000, 10.0), (2000, 20.0), (4000, 40.0)], "ts long, value double")


def test_gap_filling(metrics):
    b = timeseries.bucketed(metrics, 1000, ["sum"])
    fill = lambda f: [r["sum"] for r in timeseries.gap_filled(b, 1000, 1000, 4000, f).orderBy("bucket").collect()]
    assert fill(None) == [10, 20, None, 40] and fill("prev") == [10, 20, 20, 40] and fill("7") == [10, 20, 7, 40]
    with pytest.raises(ValueError, match="not supported"):
        fill("linear")


def test_buckets_floor_below_zero(spark):
    assert rows(timeseries.bucketed(spark.createDataFrame([(-1, 1.0), (0, 1.0)], "ts long, value double"), 1000, ["count"])) == [(-1000, 1), (0, 1)]


def test_stream_rollup_takes_late_samples(spark, tmp_path):
    schema = "ts long, value double"
    spark.createDataFrame([(i * 1000, 50.0 + i) for i in range(120)] + [(5, 1.0)], schema).repartition(3).write.parquet(str(tmp_path / "s"))
    samples, table = spark.readStream.schema(schema).parquet(str(tmp_path / "s")), str(tmp_path / "rollup")
    got = continuous.run_rollup(spark, samples, 60_000, table)
    assert {r.bucket: r["count"] for r in got.collect()} == {0: 61, 60_000: 60}
    spark.createDataFrame([(7, 2.0)], schema).write.mode("append").parquet(str(tmp_path / "s"))  # a late sample reaches its old bucket, once
    again = continuous.run_rollup(spark, samples, 60_000, table)
    assert {r.bucket: (r["count"], r["min"]) for r in again.collect()} == {0: (62, 1.0), 60_000: (60, 110.0)}
    continuous.compact_rollup(spark, table, str(tmp_path / "compact"))
    assert rows(continuous.read_rollup(spark, str(tmp_path / "compact"))) == rows(again)


def test_triangle(spark):
    e = spark.createDataFrame([("A", "E", "B"), ("B", "E", "C"), ("C", "E", "A")], "src string, label string, dst string")
    assert {round(r["rank"], 6) for r in graph.pagerank(e).collect()} == {round(1 / 3, 6)}
    assert {r.component for r in graph.weak_components(e).collect()} == {"A"}
    assert {r.core for r in graph.k_core(e).collect()} == {2}
    assert {r.betweenness for r in graph.betweenness(e).collect()} == {0.5}
    assert graph.shortest_path(e, "A", "C").first().path == ["A", "B", "C"]
    assert rows(graph.match(e, [("a", "E", "b", "out"), ("b", "E", "c", "out")], where="a = 'A'")) == [("B", "A", "C")]
    assert graph.diameter(e).first() == (2, 2)


def test_search(spark):
    df = spark.createDataFrame([("both", [1.0, 0.0], "rust"), ("vector", [0.8, 0.2], "other"), ("text", [0.0, 1.0], "rust")], "id string, embedding array<double>, text string")
    got = search.hybrid(df, [1.0, 0.0], "rust", 3).collect()
    assert got[0].id == "both" and len(got) == 3
    sparse = spark.createDataFrame([("high", {1: 4.0, 9: 0.1}), ("mid", {1: 2.0}), ("low", {1: 0.5, 4: 3.0})], "id string, weights map<int,double>")
    assert [r.id for r in search.sparse_top_k(sparse, {1: 1.0}, 5).collect()] == ["high", "mid", "low"]
    assert search.phrase(df, "").count() == 0
    assert [r.id for r in search.bm25_top_k(df, "rusty", 5, fuzzy=1).collect()] == ["both", "text"]


def test_spatial(spark):
    places = spark.createDataFrame([("ayr", -4.63, 55.46), ("lima", -77.03, -12.05), ("perth", 115.86, -31.95), ("oslo", 10.75, 59.91)], "id string, lon double, lat double")
    assert [r.id for r in spatial.boxed(places, (-10, 35, 5, 60)).collect()] == ["ayr"]
    assert [r.id for r in spatial.contained(places, [(-8, 50), (1, 50), (1, 57), (-8, 57)]).collect()] == ["ayr"]
    assert [r.id for r in spatial.nearest(places, (0, 54), 2).collect()] == ["ayr", "oslo"]
    assert spatial.within_distance(places, (-4, 55), 100_000).count() == 1


def test_array_versions(spark):
    cells = spark.createDataFrame([(1, 5, 10, "live", 0, None), (1, 6, 20, "live", 0, None), (2, 7, 10, "live", 0, None), (2, None, 30, "tombstone", None, None), (3, 8, 10, "live", 0, None), (3, None, 40, "erased", None, None)], "x long, v long, sys long, tag string, valid_from long, valid_until long")
    assert rows(ndarray.array_slice(cells, ["x"], {"x": (0, 9)}).select("x", "v")) == [(1, 6)]
    assert rows(ndarray.array_slice(cells, ["x"], {}, as_of=15).select("x", "v")) == [(1, 5), (2, 7)]
    with pytest.raises(Exception, match="out of bounds"):
        ndarray.array_put(cells, cells.limit(1).withColumn("x", F.lit(99).cast("long")), ["x"], {"x": (0, 63)}).collect()


def test_leaderboard_and_statements(spark):
    catalog = Catalog(spark)
    catalog.register("players_test", spark.createDataFrame([("a", 10), ("b", 30), ("c", 20), ("d", -5), ("no score", None)], "key string, points long"), "kv", "key")
    r = Router(catalog)
    r.sql("CREATE SORTED INDEX i ON players_test (points DESC) KEY key")
    assert r.sql("SELECT RANK(i, 'c')").first()[0] == 2 and r.sql("SELECT RANK(i, 'no score')").first()[0] is None
    assert rows(r.sql("SELECT TOPK(i, 2)")) == [(1, "b"), (2, "c")]
    assert r.sql("SELECT RANGE(i, 0, NULL)").count() == 3 and r.sql("SELECT SORTED_COUNT(i)").first()[0] == 4
    with pytest.raises(ValueError, match="RETURNING"):
        r.sql("DELETE FROM players_test RETURNING *")
    assert r.sql("SELECT count(*) FROM players_test").first()[0] == 5
    r.sql("TRUNCATE players_test")
    assert r.sql("SELECT count(*) FROM players_test").first()[0] == 0


def test_ranks_over_buckets(spark):
    df = spark.createDataFrame([(i, (i * 37) % 50) for i in range(200)] + [(900, None)], "key long, score long")
    one, many = ranked(df, "score", "key"), ranked(df, "score", "key", per_bucket=20)
    assert rows(one.select("key", "rank")) == rows(many.select("key", "rank"))
    assert rows(ranked(df, "score", "key", False).select("key", "rank")) == rows(ranked(df, "score", "key", False, per_bucket=20).select("key", "rank"))


def test_key_values_and_histories(spark):
    held = spark.createDataFrame([("a", "1", None), ("b", "2", 50)], "key string, value string, expires_at long")
    assert kv.get(held, ["a", "b"], 60).count() == 1 and kv.increment(held, "a", 4, 60).where("key = 'a'").first().value == "5"
    assert kv.increment(held, "new", 2, 60).where("key = 'new'").first().value == "2"
    with pytest.raises(ValueError, match="not enough"):
        kv.transfer(held, "a", "b", 9, 0)
    h = spark.createDataFrame([(1, 1, 0, None, "live", "v1"), (1, 5, 0, None, "live", "v2"), (1, 9, 0, None, "tombstone", None)], "id long, system_from long, valid_from long, valid_until long, tag string, body string")
    assert temporal.as_of(h, 6).first().body == "v2" and temporal.current(h).count() == 0


def test_every_query_has_a_name_and_most_have_sql():
    queries, sql = catalogue.queries(), catalogue.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 200 and len(sql) > 200
