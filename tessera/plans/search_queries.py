"""Vector, sparse, full-text and hybrid search, and spatial queries (inventory rows 100 to 124 and 150 to 152)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import Catalog
from tessera.functions import expressions as X
from tessera.operators import graph as GR
from tessera.operators import search as S
from tessera.operators import spatial as G
from tessera.operators import textindex as I
from tessera.plans.registry import pair
from tessera.plans.router import Router

Q = [round(((i * 37) % 64 - 32) / 64, 4) for i in range(64)]
_Q = "[" + ", ".join(f"CAST({x} AS DOUBLE)" for x in Q) + "]"
_E = f"(SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v, {_Q} AS q FROM embeddings)"
_Z = "list_zip(v, q)"
_SUM = "list_sum(list_transform(list_zip(v, q), lambda z: {}))"
_NORM = "sqrt(list_sum(list_transform({}, lambda x: x * x)))"
_CORR_N = "(list_sum(list_transform(list_zip(v, q), lambda z: z[1] * z[2])) - 64 * list_avg(v) * list_avg(q))"
_VAR = "(list_sum(list_transform({0}, lambda x: x * x)) - 64 * list_avg({0}) * list_avg({0}))"
_METRIC = {
    "l2": "sqrt(" + _SUM.format("(z[1] - z[2]) * (z[1] - z[2])") + ")",
    "cosine": "1 - " + _SUM.format("z[1] * z[2]") + f" / ({_NORM.format('v')} * {_NORM.format('q')})",
    "inner_product": "-" + _SUM.format("z[1] * z[2]"),
    "manhattan": _SUM.format("abs(z[1] - z[2])"),
    "chebyshev": "list_max(list_transform(list_zip(v, q), lambda z: abs(z[1] - z[2])))",
    "hamming": "CAST(" + _SUM.format("CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END") + " AS DOUBLE)",
    "jaccard": "1 - CAST(" + _SUM.format("CASE WHEN z[1] <> 0 AND z[2] <> 0 THEN 1 ELSE 0 END") + " AS DOUBLE) / " + _SUM.format("CASE WHEN z[1] <> 0 OR z[2] <> 0 THEN 1 ELSE 0 END"),
    "pearson": f"1 - {_CORR_N} / sqrt({_VAR.format('v')} * {_VAR.format('q')})",
}


def _emb(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), "embedding", "label")


def _top(metric):
    return pair(
        lambda t: S.vector_top_k(_emb(t), Q, 10, metric).select("id", F.round("distance", 5).alias("distance")),
        f"SELECT id, round(d, 5) AS distance FROM (SELECT id, {_METRIC[metric]} AS d FROM {_E} e) x ORDER BY d, id LIMIT 10",
    )


TEXT = "the of thene"
_TERMS = "(VALUES ('the'), ('of'), ('thene'))"
_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"


def _bm25(terms=_TERMS, having="", docs="documents", where="1=1"):
    return f"""WITH w AS (SELECT doc_id AS id, source, {_WORDS} AS ws FROM {docs}), st AS (SELECT count(*) AS n, avg(len(ws)) AS a FROM w),
q(term) AS (SELECT * FROM {terms} v), tf AS (SELECT id, source, len(ws) AS l, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT id, source, ws, unnest(ws) AS term FROM w) JOIN q USING (term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))) AS score FROM tf JOIN df USING (term), st WHERE {where} GROUP BY id {having})"""


def _docs(t):
    return t.documents.select(F.col("doc_id").alias("id"), "text", "source")


_SPARSE_SQL = "SELECT doc_id // 4 AS id, CAST(doc_id % 7 AS INT) AS dim, CAST((doc_id % 11) + 1 AS DOUBLE) / 4 AS w FROM documents"


def _sparse(t):
    flat = t.documents.select(F.floor(F.col("doc_id") / 4).alias("id"), (F.col("doc_id") % 7).cast("int").alias("dim"), (((F.col("doc_id") % 11) + 1).cast("double") / 4).alias("w"))
    one = flat.groupBy("id", "dim").agg(F.sum("w").alias("w"))
    return one.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("dim", "w"))).alias("weights"))


def _hybrid_frame(t):
    e = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    return e.join(t.documents.select(F.col("doc_id").alias("id"), "text"), "id")


_LINKS = "(SELECT vec_id, (vec_id * 2 + 1) % (SELECT max(vec_id) + 1 FROM embeddings) AS next FROM embeddings UNION ALL SELECT vec_id, (vec_id * vec_id + 3) % (SELECT max(vec_id) + 1 FROM embeddings) FROM embeddings WHERE label = 2)"


def _links(t):
    """A graph of all embeddings: an edge from each, and another from those of label 2."""
    v, n = F.col("vec_id"), (t.embeddings.agg(F.max("vec_id")).first()[0] or 0) + 1
    one = t.embeddings.select(v.alias("src"), F.lit("next").alias("label"), ((v * 2 + 1) % n).alias("dst"))
    return one.union(t.embeddings.where("label = 2").select(v.alias("src"), F.lit("far").alias("label"), ((v * v + 3) % n).alias("dst")))


def _indexed(t):
    """A search index made and asked by statements."""
    catalog = Catalog(t.spark)
    catalog.register("indexed_docs", _docs(t), "document", "id")
    r = Router(catalog)
    r.sql("CREATE SEARCH INDEX ON indexed_docs (text, source) ANALYZER 'standard' FUZZY 0")
    return r.sql(f"SELECT * FROM TEXT_SEARCH(indexed_docs, '{TEXT}', FIELD 'text', LIMIT 15)").select("id", F.round("score", 5).alias("score"))


_POINTS = "(SELECT c_custkey AS id, CAST((c_custkey * 7919) % 36000 AS DOUBLE) / 100 - 180 AS lon, CAST((c_custkey * 104729) % 17000 AS DOUBLE) / 100 - 85 AS lat FROM customer)"
RING = [(-10.0, 35.0), (30.0, 40.0), (25.0, 60.0), (5.0, 70.0), (-12.0, 55.0)]
_HAV = "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(48.85 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(48.85)) * pow(sin(radians(2.35 - lon) / 2), 2))))"


def _points(t):
    k = F.col("c_custkey")
    return t.customer.select(k.alias("id"), ((k * 7919 % 36000).cast("double") / 100 - 180).alias("lon"), ((k * 104729 % 17000).cast("double") / 100 - 85).alias("lat"))


def _ring_sql():
    parts = []
    for (x1, y1), (x2, y2) in zip(RING, [*RING[1:], RING[0]], strict=True):
        parts.append(f"(CASE WHEN lat >= {min(y1, y2)} AND lat < {max(y1, y2)} AND lon < (lat - {y1}) * {(x2 - x1) / (y2 - y1)} + {x1} THEN 1 ELSE 0 END)")
    return " + ".join(parts)


def _boxes(t):
    return _points(t).select("id", (F.col("lon") - 2).alias("west"), (F.col("lat") - 1).alias("south"), (F.col("lon") + 2).alias("east"), (F.col("lat") + 1).alias("north"))


QUERIES = {
    **{f"vector_{m}": _top(m) for m in X.METRICS},
    "vector_filtered": pair(lambda t: S.vector_top_k(_emb(t), Q, 7, where=F.col("label") == 1).select("id", F.round("distance", 5).alias("distance")), f"SELECT id, round({_METRIC['l2']}, 5) AS distance FROM {_E} e WHERE label = 1 ORDER BY {_METRIC['l2']}, id LIMIT 7"),
    "vector_allowed_ids": pair(lambda t: S.vector_top_k(_emb(t), Q, 7, allowed=t.embeddings.select(F.col("vec_id").alias("id")).where("id % 5 = 0")).select("id", F.round("distance", 5).alias("distance")), f"SELECT id, round({_METRIC['l2']}, 5) AS distance FROM {_E} e WHERE id % 5 = 0 ORDER BY {_METRIC['l2']}, id LIMIT 7"),
    "vector_query_dim": pair(lambda t: S.vector_top_k(_emb(t), Q, 7, query_dim=16).select("id", F.round("distance", 5).alias("distance")), f"SELECT id, round({_METRIC['l2']}, 5) AS distance FROM (SELECT id, v[1:16] AS v, q[1:16] AS q FROM {_E} x) e ORDER BY {_METRIC['l2']}, id LIMIT 7"),
    "vector_row_distance": pair(lambda t: _emb(t).select("id", F.round(X.vector_distance(F.col("embedding"), X.vector(Q), "cosine"), 5).alias("d")), f"SELECT id, round({_METRIC['cosine']}, 5) AS d FROM {_E} e"),
    "vector_array_prefilter": pair(lambda t: S.vector_top_k(_emb(t), Q, 5, allowed=t.lineitem.where("l_linenumber = 2 AND l_quantity > 25").select((F.col("l_partkey") % 500).alias("id"))).select("id", F.round("distance", 5).alias("distance")), f"SELECT id, round({_METRIC['l2']}, 5) AS distance FROM {_E} e WHERE id IN (SELECT l_partkey % 500 FROM lineitem WHERE l_linenumber = 2 AND l_quantity > 25) ORDER BY {_METRIC['l2']}, id LIMIT 5"),
    "sparse_search": pair(lambda t: S.sparse_top_k(_sparse(t), {1: 1.0, 3: 0.5, 99: 2.0}, 20), f"SELECT id, sum(w * CASE dim WHEN 1 THEN 1.0 ELSE 0.5 END) AS score FROM ({_SPARSE_SQL}) s WHERE dim IN (1, 3) GROUP BY id ORDER BY score DESC, id LIMIT 20"),
    "fts_bm25": pair(lambda t: S.bm25_top_k(_docs(t), TEXT, 20).select("id", F.round("score", 5).alias("score")), _bm25() + " SELECT id, round(score, 5) AS score FROM s ORDER BY s.score DESC, id LIMIT 20"),
    "fts_bm25_and": pair(lambda t: S.bm25_top_k(_docs(t), "the of and", 20, mode="and").select("id", F.round("score", 5).alias("score")), _bm25("(VALUES ('the'), ('of'), ('and'))", "HAVING count(*) = 3") + " SELECT id, round(score, 5) AS score FROM s ORDER BY s.score DESC, id LIMIT 20"),
    "fts_filter_before_rank": pair(lambda t: S.bm25_top_k(_docs(t), TEXT, 10, admitted=F.col("source") == "src3").select("id", F.round("score", 5).alias("score")), _bm25(where="source = 'src3'") + " SELECT id, round(score, 5) AS score FROM s ORDER BY s.score DESC, id LIMIT 10"),
    "fts_synonyms": pair(lambda t: S.bm25_top_k(_docs(t), "thene", 10, synonyms=[["thene", "the", "of"]]).select("id", F.round("score", 5).alias("score")), _bm25() + " SELECT id, round(score, 5) AS score FROM s ORDER BY s.score DESC, id LIMIT 10"),
    "fts_fuzzy": pair(
        lambda t: S.bm25_top_k(_docs(t), "thenr", 10, fuzzy=1).select("id", F.round("score", 5).alias("score")),
        f"""WITH w AS (SELECT doc_id AS id, {_WORDS} AS ws FROM documents), st AS (SELECT count(*) AS n, avg(len(ws)) AS a FROM w), tf AS (SELECT id, len(ws) AS l, CAST(len(list_filter(ws, lambda x: levenshtein(x, 'thenr') <= 1)) AS DOUBLE) AS tf FROM w), df AS (SELECT count(*) AS df FROM tf WHERE tf > 0)
SELECT id, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a)), 5) AS score FROM tf, df, st WHERE tf > 0 ORDER BY ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a)) DESC, id LIMIT 10""",
    ),
    "fts_score_scan": pair(lambda t: S.score_scan(_docs(t), TEXT).select("id", F.round("score", 5).alias("score")), _bm25() + " SELECT doc_id AS id, CASE WHEN text IS NOT NULL THEN round(coalesce(score, 0), 5) END AS score FROM documents LEFT JOIN s ON id = doc_id"),
    "fts_phrase": pair(
        lambda t: S.phrase(_docs(t), "of the").select("id", F.round("score", 5).alias("score"), F.col("position").cast("bigint").alias("position")),
        _bm25("(VALUES ('the'), ('of'))", "HAVING count(*) = 2") + ", p AS (SELECT id, min(i) - 1 AS position FROM (SELECT id, ws, unnest(generate_series(1, len(ws) - 1)) AS i FROM w) WHERE ws[i] = 'of' AND ws[i + 1] = 'the' GROUP BY id) SELECT id, round(score / (1 + 0.01 * position), 5) AS score, CAST(position AS BIGINT) AS position FROM s JOIN p USING (id)",
    ),
    "fts_phrase_empty": pair(lambda t: S.phrase(_docs(t), "!!").select("id"), "SELECT doc_id AS id FROM documents WHERE false"),
    "fts_score_distance": pair(lambda t: S.bm25(_docs(t), TEXT).select("id", F.round(S.score_to_distance(F.col("score")), 5).alias("d")), _bm25() + " SELECT id, round(1 - least(score / 20, 1), 5) AS d FROM s"),
    "hybrid_rrf": pair(
        lambda t: S.hybrid(_hybrid_frame(t), Q, TEXT, 10, 0.6).select("id", F.round("rrf_score", 6).alias("rrf_score")),
        _bm25(docs="(SELECT * FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)) hd") + f""", vl AS (SELECT id, row_number() OVER (ORDER BY d, id) AS r FROM (SELECT id, {_METRIC['l2']} AS d FROM {_E} e WHERE id IN (SELECT doc_id FROM documents)) x QUALIFY r <= 30),
tl AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM s QUALIFY r <= 30)
SELECT id, round(sum(x), 6) AS rrf_score FROM (SELECT id, 1.0 / (36.0 + r) AS x FROM vl UNION ALL SELECT id, 1.0 / (24.0 + r) FROM tl) GROUP BY id ORDER BY sum(x) DESC, id LIMIT 10""",
    ),
    "hybrid_triple": pair(
        lambda t: S.hybrid(_hybrid_frame(t), Q, TEXT, 10, graph=GR.bfs_leg(_links(t), 1, 3)).select("id", F.round("rrf_score", 6).alias("rrf_score")),
        _bm25(docs="(SELECT * FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)) hd").replace("WITH w", "WITH RECURSIVE w", 1) + f""", gs AS (SELECT DISTINCT vec_id AS a, next AS b FROM {_LINKS} l), gr(node, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT gs.b, depth + 1 FROM gr JOIN gs ON gs.a = node WHERE depth < 3),
vl AS (SELECT id, row_number() OVER (ORDER BY d, id) AS r FROM (SELECT id, {_METRIC['l2']} AS d FROM {_E} e WHERE id IN (SELECT doc_id FROM documents)) x QUALIFY r <= 30), tl AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM s QUALIFY r <= 30),
gl AS (SELECT node AS id, row_number() OVER (ORDER BY min(depth), node) AS r FROM gr GROUP BY node)
SELECT CAST(id AS BIGINT) AS id, round(sum(x), 6) AS rrf_score FROM (SELECT id, 1.0 / (30.0 + r) AS x FROM vl UNION ALL SELECT id, 1.0 / (30.0 + r) FROM tl UNION ALL SELECT id, 1.0 / (60.0 + r) FROM gl) GROUP BY id ORDER BY sum(x) DESC, id LIMIT 10""",
    ),
    "hybrid_legs": pair(
        lambda t: S.hybrid(_hybrid_frame(t), Q, TEXT, 10, vector_k=5, text_k=8, allowed=t.embeddings.where("label <> 1").select(F.col("vec_id").alias("id"))).select("id", F.round("rrf_score", 6).alias("rrf_score")),
        _bm25(docs="(SELECT * FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE label <> 1)) hd") + f""", vl AS (SELECT id, row_number() OVER (ORDER BY d, id) AS r FROM (SELECT id, {_METRIC['l2']} AS d FROM {_E} e WHERE label <> 1 AND id IN (SELECT doc_id FROM documents)) x QUALIFY r <= 5),
tl AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM s QUALIFY r <= 8)
SELECT id, round(sum(x), 6) AS rrf_score FROM (SELECT id, 1.0 / (30.0 + r) AS x FROM vl UNION ALL SELECT id, 1.0 / (30.0 + r) FROM tl) GROUP BY id ORDER BY sum(x) DESC, id LIMIT 10""",
    ),
    "fts_index_search": pair(lambda t: I.build(_docs(t), ["text"]).search(TEXT).orderBy(F.desc("score"), "id").limit(20).select("id", F.round("score", 5).alias("score")), _bm25() + " SELECT id, round(score, 5) AS score FROM s ORDER BY s.score DESC, id LIMIT 20"),
    "fts_index_field": pair(lambda t: I.build(_docs(t), ["text", "source"]).search(TEXT, "text", "and").select("id", F.round("score", 5).alias("score")), _bm25(having="HAVING count(*) = 3") + " SELECT id, round(score, 5) AS score FROM s"),
    "fts_index_changes": pair(
        lambda t: I.build(_docs(t).where("source <> 'src2'"), ["text"]).put(_docs(t).where("source IN ('src2', 'src3')")).remove(_docs(t).where("source = 'src1'")).search(TEXT).select("id", F.round("score", 5).alias("score")),
        _bm25(docs="(SELECT * FROM documents WHERE source <> 'src1') cd") + " SELECT id, round(score, 5) AS score FROM s",
    ),
    "fts_index_statements": pair(_indexed, _bm25() + " SELECT id, round(score, 5) AS score FROM s ORDER BY s.score DESC, id LIMIT 15"),
    "vector_put_delete": pair(
        lambda t: S.vector_delete(S.vector_put(_emb(t), _emb(t).where("label = 1").withColumn("label", F.lit(100)), 64), _emb(t).where("label = 2")).groupBy("label").agg(F.count("embedding").alias("n"), F.round(F.sum(F.get("embedding", F.lit(0)).cast("double")), 4).alias("s")),
        "SELECT CASE label WHEN 1 THEN 100 ELSE label END AS label, CAST(count(*) AS BIGINT) AS n, round(sum(CAST(embedding[1] AS DOUBLE)), 4) AS s FROM embeddings WHERE label <> 2 GROUP BY 1",
    ),
    "vector_stats": pair(lambda t: S.vector_stats(_emb(t)).select("vectors", "empty", F.col("least_dim").cast("bigint").alias("least_dim"), F.col("most_dim").cast("bigint").alias("most_dim")), "SELECT CAST(count(embedding) AS BIGINT) AS vectors, CAST(count(*) - count(embedding) AS BIGINT) AS empty, CAST(min(len(embedding)) AS BIGINT) AS least_dim, CAST(max(len(embedding)) AS BIGINT) AS most_dim FROM embeddings"),
    "sparse_put": pair(
        lambda t: S.sparse_top_k(S.sparse_put(_sparse(t), t.region.select(F.col("r_regionkey").cast("bigint").alias("id"), F.create_map(F.lit(1), F.lit(100.0)).alias("weights"))), {1: 1.0, 3: 0.5}, 20),
        f"SELECT id, sum(w * CASE dim WHEN 1 THEN 1.0 ELSE 0.5 END) AS score FROM (SELECT * FROM ({_SPARSE_SQL}) s WHERE id NOT IN (SELECT r_regionkey FROM region) UNION ALL SELECT CAST(r_regionkey AS BIGINT), 1, 100.0 FROM region) u WHERE dim IN (1, 3) GROUP BY id ORDER BY score DESC, id LIMIT 20",
    ),
    # spatial
    "spatial_dwithin": pair(lambda t: G.within_distance(_points(t), (2.35, 48.85), 1_500_000).select("id", F.round("distance", 2).alias("distance")), f"SELECT id, round(d, 2) AS distance FROM (SELECT id, {_HAV} AS d FROM {_POINTS} p) x WHERE d <= 1500000"),
    "spatial_contains": pair(lambda t: G.contained(_points(t), RING).select("id"), f"SELECT id FROM {_POINTS} p WHERE ({_ring_sql()}) % 2 = 1"),
    "spatial_bbox": pair(lambda t: G.boxed(_points(t), (170.0, -40.0, -170.0, 10.0)).select("id"), f"SELECT id FROM {_POINTS} p WHERE (lon >= 170 OR lon <= -170) AND lat BETWEEN -40 AND 10"),
    "spatial_intersects": pair(lambda t: G.boxes_intersect(_boxes(t), (0.0, 40.0, 20.0, 50.0)).select("id"), f"SELECT id FROM {_POINTS} p WHERE lon - 2 <= 20 AND lon + 2 >= 0 AND lat - 1 <= 50 AND lat + 1 >= 40"),
    "spatial_within": pair(lambda t: G.boxes_within(_boxes(t), (0.0, 40.0, 20.0, 50.0)).select("id"), f"SELECT id FROM {_POINTS} p WHERE lon - 2 >= 0 AND lon + 2 <= 20 AND lat - 1 >= 40 AND lat + 1 <= 50"),
    "spatial_nearest": pair(lambda t: G.nearest(_points(t), (2.35, 48.85), 10).select("id", F.round("distance", 2).alias("distance")), f"SELECT id, round(d, 2) AS distance FROM (SELECT id, {_HAV} AS d FROM {_POINTS} p) x ORDER BY d, id LIMIT 10"),
    "spatial_put_delete": pair(
        lambda t: G.delete_points(G.put_points(_points(t), t.supplier.select(F.col("s_suppkey").alias("id"), F.lit(1.5).alias("lon"), F.lit(2.5).alias("lat"))), t.nation.select(F.col("n_nationkey").cast("bigint").alias("id"))),
        f"SELECT * FROM (SELECT id, lon, lat FROM {_POINTS} p WHERE id NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, 1.5, 2.5 FROM supplier) u WHERE id NOT IN (SELECT n_nationkey FROM nation)",
    ),
    "spatial_polygon_hole": pair(lambda t: _points(t).where(G.in_polygon(F.col("lon"), F.col("lat"), [[(-100.0, -50.0), (100.0, -50.0), (100.0, 50.0), (-100.0, 50.0)], [(-40.0, -20.0), (40.0, -20.0), (40.0, 20.0), (-40.0, 20.0)]])).select("id"), f"SELECT id FROM {_POINTS} p WHERE lon >= -100 AND lon < 100 AND lat >= -50 AND lat < 50 AND NOT (lon >= -40 AND lon < 40 AND lat >= -20 AND lat < 20)"),
}
