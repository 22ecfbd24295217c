"""Graph queries read their whole tables."""

import pytest

from tessera.plans import catalogue

N = 100


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("suppliers"))
    spark.createDataFrame([(i,) for i in range(N)], "s_suppkey long").write.parquet(f"{path}/supplier.parquet")
    return path


def test_pagerank_of_all_suppliers(spark, folder):
    out = {s: [(s * 3 + 1) % N] + ([(s * s + 2) % (N * 3 // 4)] if s % 3 == 0 else []) for s in range(N)}
    rank = dict.fromkeys(range(N), 1 / N)
    for _ in range(15):
        new = dict.fromkeys(range(N), 0.15 / N)
        for s, targets in out.items():
            for d in targets:
                new[d] += 0.85 * rank[s] / len(targets)
        moved, rank = sum(abs(new[x] - rank[x]) for x in rank), new
        if moved < 1e-6:
            break
    got = dict(catalogue.queries()["graph_pagerank"](spark, folder).collect())
    assert got == pytest.approx(rank, abs=2e-6)


@pytest.mark.parametrize("name", ["graph_pagerank_personal", "graph_label_propagation", "graph_betweenness", "graph_k_core"])
def test_graph_queries_without_sql_see_all_suppliers(spark, folder, name):
    assert {r.node for r in catalogue.queries()[name](spark, folder).collect()} == set(range(N))
