"""Text indexes, MATCH texts, writes to vectors, points, edges and labels, views, sequences and DDL on small fixtures."""

import pytest
from pyspark.sql import functions as F

from tessera.catalog import Catalog
from tessera.operators import graph, kv, search, spatial, textindex, timeseries, views
from tessera.plans.router import Router
from tessera.sources import readers
from tessera.streaming import continuous


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(1, "red fox and red hen", "fox"), (2, "a blue hen", "hen"), (3, None, ""), (4, "Fox, fox; FOX!", "other"), (5, "the quick dog", "fox")], "id long, body string, title string")


def test_text_index_scores_as_the_scan_does(spark, docs, tmp_path):
    index = textindex.build(docs, ["body"])
    for query in ("fox", "red hen", "nothing", "fox fox", ""):
        want = {i: round(s, 9) for i, s in search.bm25(docs, query, text_col="body").collect()}
        assert {i: round(s, 9) for i, s in index.search(query).collect()} == want
    assert rows(index.search("red hen", mode="and").select("id")) == [(1,)]
    assert rows(index.search("fux", fuzzy=1).select("id")) == [(1,), (4,)]
    stored = index.save(str(tmp_path / "i"), 2)
    assert rows(stored.search("fox")) == rows(index.search("fox"))


def test_text_index_fields_and_changes(spark, docs):
    index = textindex.build(docs, ["body", "title"])
    assert rows(index.search("fox", "title").select("id")) == [(1,), (5,)]
    assert rows(index.search("fox").select("id")) == [(1,), (4,), (5,)]
    with pytest.raises(ValueError, match="no text index"):
        index.search("fox", "author")
    assert textindex.build(docs, []).search("fox", "author").count() == 0
    changed = index.put(spark.createDataFrame([(1, "green", "green"), (6, "fox", "x")], docs.schema)).remove(spark.createDataFrame([(4,)], "id long"))
    assert rows(changed.search("fox", "body").select("id")) == [(6,)] and rows(changed.search("green", "title").select("id")) == [(1,)]
    rebuilt = textindex.build(spark.createDataFrame([(1, "green", "green"), (2, "a blue hen", "hen"), (3, None, ""), (5, "the quick dog", "fox"), (6, "fox", "x")], docs.schema), ["body", "title"])
    assert rows(changed.search("fox hen")) == rows(rebuilt.search("fox hen"))
    with pytest.raises(ValueError, match="NOT"):
        index.search("fox NOT hen")
    assert rows(textindex.build(docs, ["body"], analyzer="keyword").search("a blue hen").select("id")) == [(2,)]
    assert textindex.build(docs, ["body"], analyzer="stop").postings.where("term = 'and'").count() == 0


def test_collections_by_statements(spark, docs):
    r = Router(Catalog(spark))
    r.catalog.register("ddl_docs", docs, "document", "id")
    r.sql("CREATE SEARCH INDEX ON ddl_docs (body, title) ANALYZER 'simple' FUZZY 1")
    assert rows(r.sql("SELECT * FROM TEXT_SEARCH(ddl_docs, 'fix', FIELD 'body', LIMIT 5)").select("id")) == [(1,), (4,)]
    r.sql("DROP SEARCH INDEX ON ddl_docs")
    assert r.sql("SELECT * FROM TEXT_SEARCH(ddl_docs, 'fox')").count() == 0
    r.sql("CREATE TABLE ddl_people (id BIGINT PRIMARY KEY, name TEXT) WITH (bitemporal=true)")
    c = r.catalog.get("ddl_people")
    assert (c.kind, c.key) == ("strict", "id") and "valid_from" in c.df.columns
    with pytest.raises(ValueError, match="there already"):
        r.sql("CREATE TABLE ddl_people (id BIGINT)")
    r.sql("CREATE COLLECTION ddl_free")
    assert r.catalog.get("ddl_free").kind == "document"
    r.sql("CREATE COLLECTION ddl_series (ts BIGINT, value DOUBLE) ENGINE timeseries")
    assert r.catalog.get("ddl_series").kind == "timeseries"
    r.sql("ALTER COLLECTION ddl_series ADD COLUMN host TEXT DEFAULT 'none'")
    assert r.catalog.get("ddl_series").df.columns == ["ts", "value", "host"]
    r.sql("CREATE ARRAY ddl_grid DIMS (x INT64 [0..63], y INT64 [0..9]) ATTRS (v FLOAT64, tag_name TEXT) TILE_EXTENTS (8, 5)")
    assert r.catalog.get("ddl_grid").options["bounds"] == {"x": (0, 63), "y": (0, 9)} and r.sql("SELECT * FROM NDARRAY_SLICE(ddl_grid, 'x', 0, 5)").count() == 0
    r.sql("ALTER ARRAY ddl_grid SET (audit_retention = '30d')")
    assert r.catalog.get("ddl_grid").options["audit_retention"] == "30d"
    r.catalog.register("ddl_typed", spark.createDataFrame([(1, "x")], "id long, name string"), "strict", "id")
    r.sql("CONVERT COLLECTION ddl_typed TO document")
    assert r.catalog.get("ddl_typed").df.columns == ["id", "document"]
    r.sql("CONVERT COLLECTION ddl_typed TO strict (id BIGINT, name STRING)")
    assert rows(r.catalog.get("ddl_typed").df) == [(1, "x")]
    r.sql("DROP TABLE ddl_people")
    with pytest.raises(KeyError):
        r.sql("DESCRIBE ddl_people")


@pytest.fixture
def edges(spark):
    return spark.createDataFrame([(1, "next", 2), (2, "next", 3), (3, "next", 4), (2, "jump", 4), (4, "jump", 1)], "src long, label string, dst long")


def test_match_texts(spark, edges):
    labels = spark.createDataFrame([(1, "odd"), (2, "even"), (3, "odd"), (4, "even")], "node long, label string")
    say = lambda t: rows(graph.match_text(edges, t, labels))
    assert say("MATCH (a)-[:next]->(b)<-[:jump]-(c) RETURN a, b, c") == [(3, 4, 2)]
    assert say("MATCH (a:odd)-[:next*1..3]->(b) WHERE a = 1 RETURN b ORDER BY b LIMIT 2") == [(2,), (3,)]
    assert say("MATCH (a)-[:next]->(b) OPTIONAL MATCH (b)-[:jump]->(c) RETURN a, b, c") == [(1, 2, 4), (2, 3, None), (3, 4, 1)]
    assert say("MATCH (a)-[:next]->(b) WHERE NOT EXISTS { (b)-[:jump]->(c) } AND a > 1 RETURN DISTINCT a") == [(2,)]
    assert len(say("MATCH (a)--(b) RETURN a, b")) == 10
    for bad in ("MATCH (a RETURN a", "MATCH (a)-[:next*2..]->(b) RETURN a", "DELETE a"):
        with pytest.raises(ValueError, match="understood|bound"):
            graph.match_text(edges, bad)


def test_edges_and_labels_change(spark, edges):
    put = graph.put_edges(edges, spark.createDataFrame([(1, "next", 2), (9, "new", 1)], edges.schema))
    assert put.count() == 6 and graph.delete_edges(put, edges).count() == 1
    assert rows(graph.delete_nodes(edges, spark.createDataFrame([(4,)], "node long"))) == [(1, "next", 2), (2, "next", 3)]
    labels = graph.set_labels(spark.createDataFrame([(1, "a")], "node long, label string"), spark.createDataFrame([(1, "a"), (1, "b")], "node long, label string"))
    assert rows(labels) == [(1, "a"), (1, "b")]
    assert rows(graph.remove_labels(labels, spark.createDataFrame([(1, "a")], "node long, label string"))) == [(1, "b")]
    assert graph.compacted(edges.union(edges), 2).count() == 5


def test_triangles_against_brute_force(spark):
    import itertools
    import random

    rng = random.Random(3)
    arcs = {(rng.randrange(14), rng.randrange(14)) for _ in range(70)}
    near = {v: {b for a, b in arcs if a == v} | {a for a, b in arcs if b == v} for v in range(14)}
    want = {v: sum((a, b) in arcs for a, b in itertools.permutations(near[v] - {v}, 2)) for v in range(14) if near[v]}
    e = spark.createDataFrame([(a, "x", b) for a, b in arcs], "src long, label string, dst long")
    assert {r.node: r.triangles for r in graph.triangles(e).collect()} == {v: n // 2 for v, n in want.items()}
    k = {v: len(near[v] - {v}) for v in want}
    assert {r.node: round(r.lcc, 9) for r in graph.clustering(e).collect()} == {v: round(n / (k[v] * (k[v] - 1)), 9) if k[v] > 1 else 0.0 for v, n in want.items()}


def test_rag_ranks_all_it_finds(spark, edges):
    seeds = spark.createDataFrame([(1, 1)], "id long, rank long")
    assert [r.id for r in graph.rag(edges, seeds, 3, 10).collect()] == [1, 2, 3, 4]
    found = spark.createDataFrame([(i, [float(i), 0.0], f"word{i}") for i in (1, 2, 3, 4)], "id long, embedding array<double>, text string")
    got = graph.graph_rag(edges, found, [3.0, 0.0], 10, 1, "word3", seeds=1)
    assert [r.id for r in got.collect()] == [3, 4]
    only = graph.graph_rag(edges, found, [3.0, 0.0], 10, 2, seeds=1, allowed=spark.createDataFrame([(1,), (2,)], "node long"))
    assert [r.id for r in only.collect()] == [2]


def test_vectors_and_points_change(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<double>")
    put = search.vector_put(v, spark.createDataFrame([(2, [5.0, 5.0]), (3, [1.0, 1.0])], v.schema), 2)
    assert rows(put.select("id")) == [(1,), (2,), (3,)] and put.where("id = 2").first().embedding == [5.0, 5.0]
    assert search.vector_delete(put, spark.createDataFrame([(1,)], "id long")).count() == 2
    assert tuple(search.vector_stats(put).first()) == (3, 0, 2, 2)
    for bad in (lambda: search.vector_put(v, spark.createDataFrame([(4, [1.0])], v.schema), 2), lambda: search.vector_top_k(v, [1.0, 2.0, 3.0], 1)):
        with pytest.raises(Exception, match="dimension"):
            bad().collect()
    m = spark.createDataFrame([("a", {1: 1.0})], "id string, weights map<int,double>")
    assert search.sparse_put(m, spark.createDataFrame([("a", {2: 1.0})], m.schema)).first().weights == {2: 1.0}
    with pytest.raises(Exception, match="finite"):
        search.sparse_put(m, spark.createDataFrame([("b", {2: float("nan")})], m.schema)).collect()
    p = spark.createDataFrame([(1, 0.5, 0.5)], "id long, lon double, lat double")
    assert spatial.put_points(p, spark.createDataFrame([(1, 9.0, 9.0), (2, 1.0, 1.0)], p.schema)).count() == 2
    with pytest.raises(Exception, match="globe"):
        spatial.put_points(p, spark.createDataFrame([(3, 999.0, 0.0)], p.schema)).collect()
    line = p.select(F.round(spatial.distance_to_line(F.col("lon"), F.col("lat"), [(0.0, 0.0), (0.0, 1.0), (0.5, 3.0)]) / 1000, 1).alias("km"))
    assert line.first().km == 55.6


def test_views_follow_their_log(spark):
    t = spark.createDataFrame([(1, "a", 10), (2, "a", 20), (3, "b", 30)], "k long, g string, v long")
    log = spark.createDataFrame([(1, "update", 1, "b", 11), (2, "delete", 3, "b", 30), (3, "insert", 4, "c", 5), (4, "update", 4, "c", 6)], "lsn long, op string, k long, g string, v long")
    want = [(1, "b", 11), (2, "a", 20), (4, "c", 6)]
    once = views.refreshed(t, log, ["k"])
    assert rows(once) == want == rows(views.refreshed(once, log, ["k"]))
    sums = t.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))
    assert rows(views.counts_refreshed(sums, t, log, ["k"], ["g"], "v")) == [("a", 1, 20), ("b", 1, 11), ("c", 1, 6)]
    assert rows(continuous.shape_changes(log, "v > 5", 1).select("lsn", "op")) == [(2, "drop"), (3, "drop"), (4, "put")]
    assert continuous.shape_watermark(log).first()[0] == 4
    assert views.read_source(["a"], True, False) == "columnar" and views.read_source(["a"], False, True) == "rows"


def test_sequences_and_exports(spark, tmp_path):
    s = readers.Sequence(10, 5)
    with pytest.raises(ValueError, match="no value"):
        s.currval()
    df = spark.createDataFrame([("b",), ("a",)], "k string")
    assert rows(s.nextval(df, [F.col("k")])) == [("a", 10), ("b", 15)] and s.currval() == 15
    s.setval(100)
    assert rows(s.nextval(df, [F.col("k")])) == [("a", 105), ("b", 110)]
    s.setval(1, called=False)
    assert rows(s.nextval(df.limit(1), [F.col("k")]).select("nextval")) == [(1,)]
    readers.export_csv(spark.createDataFrame([(1, 2.5)], "ts long, value double"), str(tmp_path / "c"))
    assert rows(readers.csv(spark, str(tmp_path / "c"))) == [(1, 2.5)]


def test_key_values_swap_and_move(spark):
    held = spark.createDataFrame([("a", '{"x":"1","y":"2"}', None), ("b", '{"y":"3"}', None), ("c", "7", None)], "key string, value string, expires_at long")
    new, old = kv.get_and_set(held, "c", "8", 0)
    assert old.first().value == "7" and new.where("key = 'c'").first().value == "8" and new.count() == 3
    assert kv.get_and_set(held, "none", "1", 0)[1].first().value is None
    moved = {r.key: r.value for r in kv.transfer_item(held, "a", "b", "x", ["x", "y"], 0).collect()}
    assert moved == {"a": '{"y":"2"}', "b": '{"x":"1","y":"3"}', "c": "7"}
    with pytest.raises(ValueError, match="nothing"):
        kv.transfer_item(held, "b", "a", "x", ["x"], 0)
    assert kv.compare_and_set(held, "c", "7", "9", 0).where("key = 'c'").first().value == "9"
    assert rows(kv.by_field(kv.field_index(held, "y", 0), held, "3", 0).select("key")) == [("b",)]


def test_aggregates_with_an_argument(spark):
    df = spark.createDataFrame([(i, float(i % 10)) for i in range(100)], "ts long, value double")
    got = timeseries.bucketed(df, 1000, ["percentile(0.9)", "topk(3)", "unknown"]).first()
    assert (got["percentile(0.9)"], got["topk(3)"], got["unknown"]) == (8.0, 3, None)
