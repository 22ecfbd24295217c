"""Graph traversal, algorithms and patterns (inventory rows 125 to 149)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators import search as S
from tessera.plans import search_queries as V
from tessera.plans.registry import pair

_N = "(SELECT coalesce(max(s_suppkey), 0) + 1 FROM supplier)"
_EDGES = f"(SELECT s_suppkey AS src, 'next' AS label, (s_suppkey * 3 + 1) % {_N} AS dst FROM supplier UNION ALL SELECT s_suppkey, 'jump', (s_suppkey * s_suppkey + 2) % greatest(1, {_N} * 3 // 4) FROM supplier WHERE s_suppkey % 3 = 0)"
_BOTH = f"(SELECT src AS a, dst AS b FROM {_EDGES} e1 UNION SELECT dst, src FROM {_EDGES} e2)"
_NODES = f"(SELECT src AS node FROM {_EDGES} e UNION SELECT dst FROM {_EDGES} e)"


def edges(t):
    """A graph of all suppliers: a `next` edge from each, and a `jump` edge from every third."""
    s, n = F.col("s_suppkey"), (t.supplier.agg(F.max("s_suppkey")).first()[0] or 0) + 1
    one = t.supplier.select(s.alias("src"), F.lit("next").alias("label"), ((s * 3 + 1) % n).alias("dst"))
    return one.union(t.supplier.where("s_suppkey % 3 = 0").select(s.alias("src"), F.lit("jump").alias("label"), ((s * s + 2) % max(1, n * 3 // 4)).alias("dst")))


def history(t):
    return edges(t).withColumn("valid_from", F.col("src") * 10).withColumn("valid_to", F.when(F.col("dst") % 4 != 0, F.col("src") * 10 + 200))


def _bfs(start: str, depth: int, steps: str = f"(SELECT DISTINCT src AS a, dst AS b FROM {_EDGES} e)") -> str:
    return f"WITH RECURSIVE st AS (SELECT * FROM {steps} x), r(node, depth) AS (SELECT CAST({start} AS BIGINT), 0 UNION SELECT b, depth + 1 FROM r JOIN st ON a = node WHERE depth < {depth})"


def _all_pairs() -> str:
    return f"WITH RECURSIVE st AS (SELECT DISTINCT src AS a, dst AS b FROM {_EDGES} e), r(origin, node, depth) AS (SELECT node, node, 0 FROM {_NODES} n UNION SELECT origin, b, depth + 1 FROM r JOIN st ON a = node WHERE depth < 60), d AS (SELECT origin, node, min(depth) AS depth FROM r GROUP BY ALL)"


_LINKS = f"""near AS (SELECT a, b FROM {_BOTH} x WHERE a <> b), arcs AS (SELECT DISTINCT src, dst FROM {_EDGES} e WHERE src <> dst), k AS (SELECT a AS node, count(*) AS k FROM near GROUP BY a),
l AS (SELECT n1.a AS node, count(*) AS links FROM near n1 JOIN arcs ON n1.b = src JOIN near n2 ON n2.a = n1.a AND n2.b = dst GROUP BY n1.a)"""


def _iterated(first: str, step: str, rounds: int, last: str, setup: str = "") -> str:
    """SQL of a fixed number of rounds: r0 is `first`, each round is `step` over {r}."""
    parts = [f"r0 AS MATERIALIZED ({first})", *(f"r{i} AS MATERIALIZED ({step.format(r=f'r{i - 1}')})" for i in range(1, rounds + 1))]
    return f"WITH {setup}{', '.join(parts)} {last.format(r=f'r{rounds}')}"


_RANKS = f"n AS MATERIALIZED (SELECT * FROM {_NODES} x), c AS (SELECT count(*) AS c FROM n), st AS MATERIALIZED (SELECT src, dst, count(*) OVER (PARTITION BY src) AS deg FROM {_EDGES} e), "
_PAGERANK = _iterated(
    "SELECT node, 1.0 / c AS rank FROM n, c", "SELECT n.node, 0.15 / c + 0.85 * coalesce(f.x, 0) AS rank FROM n JOIN c ON true LEFT JOIN (SELECT dst AS node, sum(rank / deg) AS x FROM {r} r JOIN st ON r.node = st.src GROUP BY dst) f USING (node)",
    15, "SELECT node, round(rank, 6) AS rank FROM {r} r", _RANKS,
)
_PERSONAL = _iterated(
    "SELECT node, t AS rank FROM h",
    "SELECT h.node, 0.15 * t + 0.85 * (coalesce(f.x, 0) + t * (1 - (SELECT coalesce(sum(rank / deg), 0) FROM {r} r JOIN st ON r.node = st.src))) AS rank FROM h LEFT JOIN (SELECT dst AS node, sum(rank / deg) AS x FROM {r} r JOIN st ON r.node = st.src GROUP BY dst) f USING (node)",
    10, "SELECT node, round(rank, 6) AS rank FROM {r} r", _RANKS + "h AS MATERIALIZED (SELECT node, CASE node WHEN 1 THEN 2.0 / 3 WHEN 5 THEN 1.0 / 3 ELSE 0.0 END AS t FROM n), ",
)
_TWO_WAYS = f"both_ways AS MATERIALIZED (SELECT src AS a, dst AS b FROM {_EDGES} e1 UNION ALL SELECT dst, src FROM {_EDGES} e2), "
_VOTE = "SELECT node, community FROM (SELECT b AS node, community, count(*) AS n FROM both_ways JOIN {r} r ON a = r.node GROUP BY ALL) v QUALIFY row_number() OVER (PARTITION BY node ORDER BY n DESC, community) = 1"
_COMMUNITIES = ("SELECT node, node AS community FROM " + _NODES + " x", _VOTE, 5)
_MODULARITY = (
    "SELECT round(sum(coalesce(inner_, 0) / m - pow(degree / (2 * m), 2)), 8) AS modularity FROM (SELECT community, count(*) AS degree FROM (SELECT src AS node FROM {e} a UNION ALL SELECT dst FROM {e} b) d JOIN {{r}} r USING (node) GROUP BY community) g "
    "LEFT JOIN (SELECT x.community, count(*) AS inner_ FROM {e} e JOIN {{r}} x ON x.node = src JOIN {{r}} y ON y.node = dst WHERE x.community = y.community GROUP BY x.community) i USING (community), (SELECT CAST(count(*) AS DOUBLE) AS m FROM {e} c) t"
).format(e=_EDGES)
_PATH = _bfs("3", 60) + ", lv AS (SELECT node, min(depth) AS d FROM r GROUP BY node), p(node, path) AS (SELECT CAST(3 AS BIGINT), [CAST(3 AS BIGINT)] UNION ALL SELECT st.b, list_append(path, st.b) FROM p JOIN st ON a = p.node JOIN lv x ON x.node = st.a JOIN lv y ON y.node = st.b WHERE y.d = x.d + 1) SELECT array_to_string(min(path), '>') AS path FROM p WHERE node = 34 HAVING count(*) > 0"
_BETWEEN = _all_pairs() + f""", w(origin, node) AS (SELECT node, node FROM {_NODES} n UNION ALL SELECT w.origin, st.b FROM w JOIN st ON a = w.node JOIN d x ON x.origin = w.origin AND x.node = st.a JOIN d y ON y.origin = w.origin AND y.node = st.b WHERE y.depth = x.depth + 1),
g AS (SELECT origin, node, count(*) AS paths, any_value(depth) AS depth FROM w JOIN d USING (origin, node) GROUP BY origin, node),
b AS (SELECT s.node, sum(s.paths * t.paths / CAST(e.paths AS DOUBLE)) AS b FROM g s JOIN g t ON t.origin = s.node JOIN g e ON e.origin = s.origin AND e.node = t.node WHERE s.depth + t.depth = e.depth AND s.depth > 0 AND t.depth > 0 GROUP BY s.node)
SELECT n.node, round(coalesce(b, 0) / greatest((c - 1) * (c - 2), 1), 8) AS betweenness FROM {_NODES} n LEFT JOIN b USING (node), (SELECT count(*) AS c FROM {_NODES} y) z"""


def _rag_sql(k: int = 10) -> str:
    """Seeds 1, 7 and 9 ranked by id, two steps along edges ranked by depth, both fused."""
    return f"""WITH RECURSIVE st AS (SELECT DISTINCT src AS a, dst AS b FROM {_EDGES} e), s(id, rank) AS (VALUES (1, 1), (7, 2), (9, 3)), r(node, depth) AS (SELECT CAST(id AS BIGINT), 0 FROM s UNION SELECT b, depth + 1 FROM r JOIN st ON a = node WHERE depth < 2),
x AS (SELECT node AS id, row_number() OVER (ORDER BY min(depth), node) AS rank FROM r GROUP BY node)
SELECT CAST(id AS BIGINT) AS id, round(sum(1.0 / (60 + rank)), 8) AS rrf_score FROM (SELECT * FROM s UNION ALL SELECT * FROM x) u GROUP BY id ORDER BY sum(1.0 / (60 + rank)) DESC, id LIMIT {k}"""


QUERIES = {
    "graph_hop": pair(lambda t: G.hop(edges(t), [1], 3).select("node", F.col("depth").cast("bigint").alias("depth")), _bfs("1", 3) + " SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY node"),
    "graph_hop_in_label": pair(lambda t: G.hop(edges(t), [4], 2, "in", ["next"]).select("node", F.col("depth").cast("bigint").alias("depth")), _bfs("4", 2, f"(SELECT DISTINCT dst AS a, src AS b FROM {_EDGES} e WHERE label = 'next')") + " SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY node"),
    "graph_neighbors": pair(lambda t: G.neighbors(edges(t), [3, 7, 12], "both"), f"SELECT DISTINCT * FROM (SELECT src AS node, label, dst AS neighbor FROM {_EDGES} e UNION SELECT dst, label, src FROM {_EDGES} e) WHERE node IN (3, 7, 12)"),
    "graph_path": pair(lambda t: G.shortest_path(edges(t), 3, 34).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path")), _PATH),
    "graph_path_length": pair(lambda t: G.shortest_path(edges(t), 3, 34).select((F.size("path") - 1).cast("bigint").alias("steps")), _bfs("3", 60) + " SELECT CAST(min(depth) AS BIGINT) AS steps FROM r WHERE node = 34 HAVING count(*) > 0"),
    "graph_subgraph": pair(lambda t: G.subgraph(edges(t), [1], 2), _bfs("1", 1) + f" SELECT DISTINCT src, label, dst FROM {_EDGES} e WHERE src IN (SELECT node FROM r)"),
    "graph_traverse_edges": pair(lambda t: G.traverse(edges(t), [1], 2, where=F.col("src") != F.col("dst"))[1], _bfs("1", 2, f"(SELECT DISTINCT src AS a, dst AS b FROM {_EDGES} e WHERE src <> dst)") + f" SELECT DISTINCT src, label, dst FROM {_EDGES} e WHERE src <> dst AND src IN (SELECT node FROM r) AND dst IN (SELECT node FROM r)"),
    "graph_stats": pair(lambda t: G.stats(edges(t)).select("node_count", "edge_count", F.round("avg_degree", 6).alias("avg_degree"), "max_degree", F.round("density", 8).alias("density")), f"WITH d AS (SELECT node, count(*) AS g FROM (SELECT src AS node FROM {_EDGES} e UNION ALL SELECT dst FROM {_EDGES} e) GROUP BY node) SELECT CAST(count(*) AS BIGINT) AS node_count, CAST(sum(g) / 2 AS BIGINT) AS edge_count, round(avg(g), 6) AS avg_degree, CAST(max(g) AS BIGINT) AS max_degree, round(sum(g) / 2 / (count(*) * (count(*) - 1)), 8) AS density FROM d"),
    "graph_pagerank": pair(lambda t: G.pagerank(edges(t), iterations=15).select("node", F.round("rank", 6).alias("rank")), _PAGERANK),
    "graph_pagerank_personal": pair(lambda t: G.pagerank(edges(t), iterations=10, teleport=t.spark.createDataFrame([(1, 2.0), (5, 1.0)], "node bigint, weight double"), keep_dangling=True).select("node", F.round("rank", 6).alias("rank")), _PERSONAL),
    "graph_wcc": pair(lambda t: G.weak_components(edges(t)), f"WITH RECURSIVE b AS (SELECT * FROM {_BOTH} x), r(node, reach) AS (SELECT node, node FROM {_NODES} n UNION SELECT r.node, b.b FROM r JOIN b ON r.reach = b.a) SELECT node, min(reach) AS component FROM r GROUP BY node"),
    "graph_label_propagation": pair(lambda t: G.label_propagation(edges(t), 5), _iterated(*_COMMUNITIES, "SELECT node, community FROM {r} r", _TWO_WAYS)),
    "graph_louvain_modularity": pair(lambda t: G.modularity(edges(t), G.label_propagation(edges(t), 5)).select(F.round("modularity", 8).alias("modularity")), _iterated(*_COMMUNITIES, _MODULARITY, _TWO_WAYS)),
    "graph_lcc": pair(lambda t: G.clustering(edges(t)).select("node", F.round("lcc", 8).alias("lcc")), f"WITH {_LINKS} SELECT node, round(CASE WHEN k > 1 THEN coalesce(links, 0) / (k * (k - 1)) ELSE 0.0 END, 8) AS lcc FROM {_NODES} n LEFT JOIN k USING (node) LEFT JOIN l USING (node)"),
    "graph_triangles": pair(lambda t: G.triangles(edges(t)), f"WITH {_LINKS} SELECT node, CAST(coalesce(links, 0) // 2 AS BIGINT) AS triangles FROM {_NODES} n LEFT JOIN l USING (node)"),
    "graph_sssp": pair(lambda t: G.sssp(edges(t), 2), _bfs("2", 60) + f" SELECT n.node, coalesce(CAST(min(depth) AS DOUBLE), CAST('inf' AS DOUBLE)) AS distance FROM {_NODES} n LEFT JOIN r USING (node) GROUP BY n.node"),
    "graph_closeness": pair(lambda t: G.closeness(edges(t)).select("node", F.round("closeness", 8).alias("closeness")), _all_pairs() + " SELECT origin AS node, round(CASE WHEN sum(depth) > 0 THEN (count(*) - 1) / sum(depth) ELSE 0.0 END, 8) AS closeness FROM d GROUP BY origin"),
    "graph_harmonic": pair(lambda t: G.harmonic(edges(t)).select("node", F.round("harmonic", 8).alias("harmonic")), _all_pairs() + f" SELECT origin AS node, round(sum(CASE WHEN depth > 0 THEN 1.0 / depth ELSE 0.0 END) / ((SELECT count(*) FROM {_NODES} n) - 1), 8) AS harmonic FROM d GROUP BY origin"),
    "graph_diameter": pair(lambda t: G.diameter(edges(t)), _all_pairs() + " SELECT CAST(max(e) AS BIGINT) AS diameter, CAST(min(e) AS BIGINT) AS radius FROM (SELECT max(depth) AS e FROM d GROUP BY origin) WHERE e > 0"),
    "graph_betweenness": pair(lambda t: G.betweenness(edges(t)).select("node", F.round("betweenness", 8).alias("betweenness")), _BETWEEN),
    "graph_degree_centrality": pair(lambda t: G.degree_centrality(edges(t)).select("node", "degree", F.round("centrality", 8).alias("centrality")), f"WITH d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM {_EDGES} e UNION ALL SELECT dst FROM {_EDGES} e) GROUP BY node) SELECT node, CAST(degree AS BIGINT) AS degree, round(degree / ((SELECT count(*) FROM d) - 1), 8) AS centrality FROM d"),
    "graph_k_core": pair(lambda t: G.k_core(edges(t)).select("node", F.col("core").cast("bigint").alias("core")), None),
    "graph_match_chain": pair(lambda t: G.match(edges(t), [("a", "jump", "b", "out"), ("b", "next", "c", "out")], where="a <> c", returns=["a", "b", "c"]), f"SELECT DISTINCT x.src AS a, x.dst AS b, y.dst AS c FROM {_EDGES} x JOIN {_EDGES} y ON x.dst = y.src WHERE x.label = 'jump' AND y.label = 'next' AND x.src <> y.dst"),
    "graph_match_var_length": pair(lambda t: G.match(edges(t), [("a", "next", "b", "out")], var_length={0: (1, 3)}, where="a = 1", returns=["a", "b"], distinct=True), _bfs("1", 3, f"(SELECT DISTINCT src AS a, dst AS b FROM {_EDGES} e WHERE label = 'next')") + " SELECT DISTINCT CAST(1 AS BIGINT) AS a, node AS b FROM r WHERE depth >= 1"),
    "graph_match_optional": pair(lambda t: G.match(edges(t), [("a", "next", "b", "out")], optional=[("b", "jump", "c", "out")], returns=["a", "b", "c"]), f"SELECT DISTINCT x.src AS a, x.dst AS b, y.dst AS c FROM {_EDGES} x LEFT JOIN (SELECT * FROM {_EDGES} z WHERE label = 'jump') y ON x.dst = y.src WHERE x.label = 'next'"),
    "graph_match_not_exists": pair(lambda t: G.match(edges(t), [("a", "next", "b", "out")], not_exists=[("b", "jump", "c", "out")], returns=["a", "b"], order=["a", "b"], limit=20), f"SELECT DISTINCT x.src AS a, x.dst AS b FROM {_EDGES} x WHERE x.label = 'next' AND NOT EXISTS (SELECT 1 FROM {_EDGES} y WHERE y.label = 'jump' AND y.src = x.dst) ORDER BY a, b LIMIT 20"),
    "graph_match_node_labels": pair(lambda t: G.match(edges(t), [("a", None, "b", "both")], labels=t.nation.select(F.col("n_nationkey").cast("bigint").alias("node"), F.when(F.col("n_nationkey") % 2 == 0, "even").otherwise("odd").alias("label")), node_labels={"a": "even", "b": "odd"}, returns=["a", "b"]), f"SELECT a, b FROM {_BOTH} x WHERE a % 2 = 0 AND b % 2 = 1 AND a < 25 AND b < 25"),
    "graph_temporal_neighbors": pair(lambda t: G.neighbors(G.as_of(history(t), 250), [10, 20, 24]), f"SELECT DISTINCT src AS node, label, dst AS neighbor FROM {_EDGES} e WHERE src * 10 <= 250 AND (dst % 4 = 0 OR src * 10 + 200 > 250) AND src IN (10, 20, 24)"),
    "graph_temporal_degree": pair(lambda t: G.degree_centrality(G.as_of(history(t), 250), "out").select("node", "degree"), f"WITH h AS (SELECT * FROM {_EDGES} e WHERE src * 10 <= 250 AND (dst % 4 = 0 OR src * 10 + 200 > 250)) SELECT n.node, CAST(count(h.src) AS BIGINT) AS degree FROM (SELECT src AS node FROM h UNION SELECT dst FROM h) n LEFT JOIN h ON h.src = n.node GROUP BY n.node"),
    "graph_rag": pair(lambda t: G.rag(edges(t), S.with_rank(t.spark.createDataFrame([(1,), (7,), (9,)], "id bigint"), F.col("id")), 2, 10).select("id", F.round("rrf_score", 8).alias("rrf_score")), _rag_sql()),
    "graph_match_text": pair(lambda t: G.match_text(edges(t), "MATCH (a)-[:jump]->(b)-[:next]->(c) WHERE a <> c AND NOT EXISTS { (c)-[:jump]->(d) } RETURN a, b, c"), f"SELECT DISTINCT x.src AS a, x.dst AS b, y.dst AS c FROM {_EDGES} x JOIN {_EDGES} y ON x.dst = y.src WHERE x.label = 'jump' AND y.label = 'next' AND x.src <> y.dst AND NOT EXISTS (SELECT 1 FROM {_EDGES} z WHERE z.label = 'jump' AND z.src = y.dst)"),
    "graph_put_delete_edges": pair(
        lambda t: G.delete_edges(G.put_edges(edges(t), t.customer.select(F.col("c_custkey").alias("src"), F.lit("buys").alias("label"), F.col("c_nationkey").cast("bigint").alias("dst"))), edges(t).where("label = 'jump'")),
        f"SELECT src, label, dst FROM {_EDGES} e WHERE label <> 'jump' UNION ALL SELECT c_custkey, 'buys', CAST(c_nationkey AS BIGINT) FROM customer",
    ),
    "graph_delete_nodes": pair(lambda t: G.delete_nodes(edges(t), t.nation.select(F.col("n_nationkey").cast("bigint").alias("node"))), f"SELECT src, label, dst FROM {_EDGES} e WHERE src NOT IN (SELECT n_nationkey FROM nation) AND dst NOT IN (SELECT n_nationkey FROM nation)"),
    "graph_node_labels": pair(
        lambda t: G.remove_labels(G.set_labels(t.supplier.select(F.col("s_suppkey").alias("node"), F.lit("supplier").alias("label")), t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("node"), F.lit("solvent").alias("label"))), t.supplier.where("s_nationkey = 3").select(F.col("s_suppkey").alias("node"), F.lit("supplier").alias("label"))),
        "SELECT s_suppkey AS node, 'supplier' AS label FROM supplier WHERE s_nationkey <> 3 UNION ALL SELECT s_suppkey, 'solvent' FROM supplier WHERE s_acctbal > 0",
    ),
    "graph_rag_search": pair(
        lambda t: G.graph_rag(edges(t), t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), V.Q, 10, 2, seeds=5, seed_ids=[3]).select("id", F.round("rrf_score", 8).alias("rrf_score")),
        f"""WITH RECURSIVE st AS (SELECT DISTINCT src AS a, dst AS b FROM {_EDGES} e), v AS (SELECT id, row_number() OVER (ORDER BY d, id) AS rank FROM (SELECT id, {V._METRIC['l2']} AS d FROM {V._E} e) x QUALIFY rank <= 5),
s AS (SELECT id, row_number() OVER (ORDER BY x DESC, id) AS rank FROM (SELECT id, sum(1.0 / (60 + rank)) AS x FROM (SELECT * FROM v UNION ALL SELECT 3, 1) u GROUP BY id) f), r(node, depth) AS (SELECT CAST(id AS BIGINT), 0 FROM s UNION SELECT b, depth + 1 FROM r JOIN st ON a = node WHERE depth < 2),
x AS (SELECT node AS id, row_number() OVER (ORDER BY min(depth), node) AS rank FROM r GROUP BY node)
SELECT CAST(id AS BIGINT) AS id, round(sum(1.0 / (60 + rank)), 8) AS rrf_score FROM (SELECT * FROM s UNION ALL SELECT * FROM x) u GROUP BY id ORDER BY sum(1.0 / (60 + rank)) DESC, id LIMIT 10""",
    ),
}
