"""What a review found in the queries beside the corpus operators."""

import random
import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tessera.operators import breadth, graph, search, timeseries
from tessera.plans import state_queries


def test_average_of_a_bucket_does_not_depend_on_the_order_of_rows(spark):
    values, rng, rows = [83.11, 67.04, 15.09, 11.52, 62.1, 96.92, 20.8, 13.27], random.Random(1), []
    for series in range(60):
        rng.shuffle(values)
        rows += [(series, k, v) for k, v in enumerate(values)]
    rows += [(60, 0, None), (61, 0, float("nan")), (61, 1, 1.0), (62, 0, 1e300), (62, 1, 3e300), (63, 0, 0.1 + 0.2), (63, 1, None)]
    df = spark.createDataFrame(rows, "series_id int, ts long, value double").coalesce(1)
    got = {r.series_id: r for r in timeseries.bucketed(df, 1000, ["avg", "mean"], ["series_id"]).withColumn("rounded", F.round("avg", 4)).collect()}
    assert {(got[s].avg, got[s].mean, got[s].rounded) for s in range(60)} == {(46.23125, 46.23125, 46.2313)}
    assert got[60].avg is None and got[61].avg != got[61].avg and got[62].avg == 2e300 and got[63].avg == 0.1 + 0.2


def _searched(pairs, n):
    """Distances from each node by plain search."""
    out = {}
    for o in range(n):
        far, queue = {o: 0}, [o]
        for v in queue:
            for a, b in pairs:
                if a == v and b not in far:
                    far[b] = far[v] + 1
                    queue.append(b)
        out[o] = far
    return out


@pytest.fixture
def long_graph(spark, monkeypatch):
    """A chain of 90 nodes with some shortcuts and a loop; a search may not take a round of Spark for each step."""
    pairs = [(i, i + 1) for i in range(89)] + [(i, (i * i + 2) % 90) for i in range(40, 90, 9)] + [(89, 89)]
    monkeypatch.setattr(graph, "cut", lambda df: pytest.fail("a round of its own for each step"))
    return spark.createDataFrame([(a, "x", b) for a, b in [*pairs, *pairs[:5]]], "src long, label string, dst long"), _searched(pairs, 90)


def test_closeness_of_a_long_graph(long_graph):
    edges, far = long_graph
    assert dict(graph.closeness(edges).collect()) == {o: (len(d) - 1) / max(1, sum(d.values())) for o, d in far.items()}
    assert [r.node for r in graph.closeness(edges, sample=3).orderBy("node").collect()] == [0, 1, 2]


def test_closeness_in_batches_by_joins_and_of_odd_graphs(spark, monkeypatch):
    rng = random.Random(5)
    pairs = [(rng.randrange(150), rng.randrange(150)) for _ in range(260)]
    edges = spark.createDataFrame([(f"n{a}", "x", f"n{b}") for a, b in pairs], "src string, label string, dst string")
    monkeypatch.setattr(breadth, "MOST", 64)
    wide = {r.node: r for r in graph.profiles(edges).collect()}
    monkeypatch.setattr(graph, "MAX_ADJACENCY", 0)
    joined = {r.node: r for r in graph.profiles(edges).collect()}
    assert wide.keys() == joined.keys() and all((a.reached, a.total, a.farthest) == (joined[k].reached, joined[k].total, joined[k].farthest) and abs(a.inverse - joined[k].inverse) < 1e-9 for k, a in wide.items())
    monkeypatch.undo()
    none = edges.where("false")
    assert graph.closeness(none).collect() == []
    odd = spark.createDataFrame([(1, "x", 2), (2, "x", 3), (1, "x", None), (3, "x", None), (None, "x", 1)], "src long, label string, dst long")
    assert dict(graph.closeness(odd).collect()) == {1: 3 / 4, 2: 2 / 3, 3: 1.0, None: 0.0}  # a null is a node that is reached once and leads nowhere


def test_diameter_of_a_long_graph(long_graph):
    edges, far = long_graph
    most = [max(d.values()) for d in far.values()]
    assert graph.diameter(edges).first() == (max(most), min(m for m in most if m))


def test_harmonic_centrality_of_a_long_graph(long_graph):
    edges, far = long_graph
    assert dict(graph.harmonic(edges).collect()) == pytest.approx({o: sum(1 / x for x in d.values() if x) / 89 for o, d in far.items()}, abs=1e-12)


def test_score_of_a_player_does_not_depend_on_the_order_of_events(spark):
    values = [0.1] * 10 + [83.11, 16.89, 67.04, 32.96]  # 201 exactly; in some orders the doubles add up to less
    rng, events = random.Random(2), []
    for user in range(40):
        rng.shuffle(values)
        events += [(user, v) for v in values]
    events += [(40, None), (41, 2.5), (41, None)]
    df = spark.createDataFrame(events, "user_id long, value double").withColumn("ts", F.lit("2024-01-30").cast("timestamp_ntz")).coalesce(1)
    got = {r.key: r.score for r in state_queries.players(SimpleNamespace(events=df)).collect()}
    assert got == dict.fromkeys(range(40), 201) | {40: None, 41: 2}


def test_percentiles_of_many_different_values_are_exact(spark):
    df = spark.range(90_000).select("id", F.lit(5).alias("ts"), F.pmod(F.col("id") * 7919, F.lit(90_000)).cast("double").alias("value"), F.when(F.col("id") % 2 == 0, "even").alias("kind"))
    whole = timeseries.bucketed(df, 1000, ["percentile(0.9)", "count", "percentile"]).first()
    assert tuple(whole) == (0, 80_999.0, 90_000, 44_999.0)
    odd = df.where("id < 4").withColumn("value", F.when(F.col("id") != 2, F.col("id").cast("double"))).union(spark.createDataFrame([(9, 5, None, "none")], "id long, ts int, value double, kind string"))
    got = {r.kind: r.p for r in timeseries.bucketed(odd, 1000, ["percentile(0.9)"], ["kind"]).withColumnRenamed("percentile(0.9)", "p").collect()}
    assert got == {"even": 0.0, None: 3.0, "none": None}
    with pytest.raises(ValueError):
        timeseries.bucketed(df, 1000, ["percentile(90)"])


def test_phrases_and_counts_of_odd_texts(spark):
    texts = ["of the", "of of the the", "often of, THE; of the", "xof the ofthe of thex", None, "", "...", " of\tthe ", "d\u00e9j\u00e0 of\u2014the 42 of the", "the of", "of the of the of the"]
    docs = spark.createDataFrame([*enumerate(texts), (0, "of the end")], "id long, text string")
    words = [[w for w in re.split(r"[\W_]+", (t or "").lower()) if w] for t in [*texts, "of the end"]]
    at = [next((i for i, p in enumerate(zip(w, w[1:], strict=False)) if p == ("of", "the")), None) for w in words]
    want = sorted((i, p) for i, p in zip([*range(len(texts)), 0], at, strict=True) if p is not None)
    assert sorted((r.id, r.position) for r in search.phrase(docs, "of the").collect()) == want  # each row once, also where an id is there twice
    got = docs.select(search.spaced(F.col("text")).alias("w")).select(*search._tally("w", ["of", "the"])).collect()
    assert sorted((r.length, *r.tf) for r in got) == sorted((len(w), w.count("of"), w.count("the")) for w in words)
    scores = sorted(search.bm25(docs, "of the").collect())
    assert [r.id for r in scores] == sorted(i for i, w in zip([*range(len(texts)), 0], words, strict=True) if {"of", "the"} & {*w})
