"""Graphs as an edges table (src, label, dst): traversal, pattern matching and algorithms.

Traversals and algorithms are driver loops over distributed joins; each round is checkpointed. Nodes are those that have
an edge. Component, community and other labels are canonical: the least node.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import breadth
from tessera.session import cut

MAX_ADJACENCY = 5_000_000  # edges that may be broadcast


def directed(edges: DataFrame, direction: str = "out", labels: Sequence[str] | None = None) -> DataFrame:
    """(a, b, label): one row for each step that may be taken from a to b."""
    own = edges if not labels else edges.where(F.col("label").isin(list(labels)))
    out = own.select(F.col("src").alias("a"), F.col("dst").alias("b"), "label")
    back = own.select(F.col("dst").alias("a"), F.col("src").alias("b"), "label")
    return {"out": out, "in": back, "both": out.union(back)}[direction]


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def levels(steps: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """(origin, node, depth): the least number of steps (a, b) from every origin (starts: origin, node) to each node it reaches."""
    pairs = steps.select("a", "b").distinct()
    seen = front = cut(starts.select("origin", "node", F.lit(0).alias("depth")).distinct())
    n = 0
    while depth is None or n < depth:
        n += 1
        nxt = front.join(pairs, front.node == pairs.a).select("origin", F.col("b").alias("node")).distinct()
        front = cut(nxt.join(seen, ["origin", "node"], "left_anti").select("origin", "node", F.lit(n).alias("depth")))
        if front.isEmpty():
            break
        seen = cut(seen.union(front))
    return seen


def hop(edges: DataFrame, starts: Sequence[object], depth: int, direction: str = "out", labels: Sequence[str] | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(node, depth) of the nodes within `depth` steps of any start; allowed (node) bounds every step."""
    spark = edges.sparkSession
    steps = directed(edges, direction, labels)
    if allowed is not None:
        steps = steps.join(allowed.select(F.col("node").alias("b")).distinct(), "b", "left_semi")
    kind = edges.schema["src"].dataType.simpleString()
    first = spark.createDataFrame([(0, s) for s in starts], f"origin int, node {kind}")
    return levels(steps, first, depth).select("node", "depth")


def neighbors(edges: DataFrame, of: Sequence[object], direction: str = "out", labels: Sequence[str] | None = None) -> DataFrame:
    """(node, label, neighbor) of the given nodes."""
    return directed(edges, direction, labels).where(F.col("a").isin(list(of))).select(F.col("a").alias("node"), "label", F.col("b").alias("neighbor")).distinct()


def shortest_path(edges: DataFrame, src: object, dst: object, direction: str = "out", labels: Sequence[str] | None = None, max_depth: int = 100) -> DataFrame:
    """One row `path` of nodes from src to dst (the least by its nodes among the shortest), or none."""
    spark = edges.sparkSession
    steps = directed(edges, direction, labels).select("a", "b").distinct()
    kind = edges.schema["src"].dataType.simpleString()
    front = seen = cut(spark.createDataFrame([(src, [src])], f"node {kind}, path array<{kind}>"))
    for _ in range(max_depth):
        hit = front.where(F.col("node") == F.lit(dst)).select("path")
        if not hit.isEmpty():
            return hit
        grown = front.join(steps, front.node == steps.a).select(F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path"))
        front = cut(grown.join(seen.select("node"), "node", "left_anti").groupBy("node").agg(F.min("path").alias("path")))
        if front.isEmpty():
            break
        seen = cut(seen.union(front))
    return seen.where("false").select("path")


def subgraph(edges: DataFrame, starts: Sequence[object], depth: int) -> DataFrame:
    """The outgoing edges (src, label, dst) met on the way from the starts within `depth` steps."""
    inner = hop(edges, starts, depth - 1).select(F.col("node").alias("src")) if depth else hop(edges, [], 0).select(F.col("node").alias("src"))
    return edges.join(inner, "src", "left_semi").select("src", "label", "dst").distinct()


def traverse(edges: DataFrame, starts: Sequence[object], depth: int, direction: str = "out", labels: Sequence[str] | None = None, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes with depth, edges between them); `where` filters edges before any step."""
    own = edges if where is None else edges.where(where)
    found = hop(own, starts, depth, direction, labels)
    both = own if not labels else own.where(F.col("label").isin(list(labels)))
    inside = both.join(found.select(F.col("node").alias("src")), "src", "left_semi").join(found.select(F.col("node").alias("dst")), "dst", "left_semi")
    return found, inside.select("src", "label", "dst").distinct()


def stats(edges: DataFrame) -> DataFrame:
    """node_count, edge_count, avg_degree, max_degree (both directions), density = e / (n (n - 1))."""
    degrees = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    x = degrees.agg(F.count(F.lit(1)).alias("node_count"), (F.coalesce(F.sum("degree"), F.lit(0)) / 2).cast("long").alias("edge_count"), F.avg("degree").alias("avg_degree"), F.max("degree").alias("max_degree"))
    n = F.col("node_count")
    return x.withColumn("density", F.when(n > 1, F.col("edge_count") / (n * (n - 1))).otherwise(0.0))


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 20, tolerance: float = 1e-6, teleport: DataFrame | None = None, keep_dangling: bool = False) -> DataFrame:
    """(node, rank). teleport (node, weight): personalised, normalised; all zero means uniform. The mass of nodes without out-edges is dropped, or spread by the teleport weights."""
    every = cut(nodes(edges))
    n = every.count()
    if not n:
        return every.withColumn("rank", F.lit(0.0))
    home = every.withColumn("t", F.lit(1.0 / n))
    if teleport is not None:
        total = teleport.join(every, "node").agg(F.sum("weight")).first()[0] or 0.0
        if total:
            home = every.join(teleport, "node", "left").select("node", (F.coalesce("weight", F.lit(0.0)) / total).alias("t"))
    home = cut(home)
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    steps = cut(edges.join(out, "src").select("src", "dst", "deg"))
    rank = home.select("node", F.col("t").alias("rank"))
    for _ in range(iterations):
        flow = rank.join(steps, rank.node == steps.src).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("deg")).alias("in"))
        lost = 0.0
        if keep_dangling:
            lost = 1.0 - (flow.agg(F.sum("in")).first()[0] or 0.0)
        new = cut(home.join(flow, "node", "left").select("node", ((1 - damping) * F.col("t") + damping * (F.coalesce("in", F.lit(0.0)) + F.col("t") * lost)).alias("rank")))
        moved = new.join(rank.withColumnRenamed("rank", "old"), "node").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0
        rank = new
        if moved < tolerance:
            break
    return rank


def weak_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that can be reached in either direction. Labels spread along edges, and jump to their label's label."""
    both = cut(directed(edges, "both").select("a", "b").distinct())
    label = cut(nodes(edges).select("node", F.col("node").alias("component")))
    while True:
        best = both.join(label, both.a == label.node).groupBy(F.col("b").alias("node")).agg(F.min("component").alias("m"))
        near = label.join(best, "node", "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"), F.col("component").alias("old"))
        far = near.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = cut(near.join(far, "component", "left").select("node", F.least("component", F.coalesce("next", "component")).alias("component"), "old"))
        changed = new.where("component <> old").isEmpty()
        label = new.drop("old")
        if changed:
            return label


def label_propagation(edges: DataFrame, iterations: int = 10) -> DataFrame:
    """(node, community): each node takes the most frequent label of its neighbours in either direction, the least of several; all at once."""
    both = cut(directed(edges, "both").select("a", "b"))
    label = cut(nodes(edges).select("node", F.col("node").alias("community")))
    for _ in range(iterations):
        votes = both.join(label, both.a == label.node).groupBy(F.col("b").alias("node"), "community").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("node").agg(F.max(F.struct("n", (-F.col("community")).alias("minus"))).alias("x")).select("node", (-F.col("x.minus")).alias("community"))
        new = cut(label.select("node").join(best, "node"))
        same = new.join(label.withColumnRenamed("community", "old"), "node").where("community <> old").isEmpty()
        label = new
        if same:
            break
    return label


def modularity(edges: DataFrame, community: DataFrame) -> DataFrame:
    """One row `modularity` of a partition (node, community) of the undirected graph."""
    m = edges.count()
    inside = edges.join(community.select(F.col("node").alias("src"), F.col("community").alias("cs")), "src").join(community.select(F.col("node").alias("dst"), F.col("community").alias("cd")), "dst")
    own = inside.where("cs = cd").groupBy(F.col("cs").alias("community")).agg(F.count(F.lit(1)).alias("inner"))
    degree = edges.select(F.explode(F.array("src", "dst")).alias("node")).join(community, "node").groupBy("community").agg(F.count(F.lit(1)).alias("degree"))
    return degree.join(own, "community", "left").agg(F.sum(F.coalesce("inner", F.lit(0)) / m - F.pow(F.col("degree") / (2 * m), F.lit(2))).alias("modularity"))


def _neighbourhood(edges: DataFrame) -> DataFrame:
    return directed(edges, "both").where("a <> b").select("a", "b").distinct()


def _links_among(edges: DataFrame) -> DataFrame:
    """(node, k, links): neighbours of a node and the directed edges among them.

    Every pair of linked nodes is pointed at the one of higher degree, so that a node starts few wedges, however many neighbours it has;
    each triangle is found once, and an edge of it (or two, one each way) counts for the node on the other side.
    """
    near = _neighbourhood(edges)
    k = near.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("k"))
    arcs = edges.where("src <> dst").select("src", "dst").distinct()
    ways = arcs.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("ways"))
    ranked = ways.join(k.select(F.col("node").alias("a"), F.col("k").alias("ka")), "a").join(k.select(F.col("node").alias("b"), F.col("k").alias("kb")), "b")
    up = (F.col("ka") < F.col("kb")) | ((F.col("ka") == F.col("kb")) & (F.col("a") < F.col("b")))
    pointed = cut(ranked.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("low"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("high"), "ways"))
    one = pointed.select("low", F.col("high").alias("mid"), F.col("ways").alias("w1"))
    two = pointed.select("low", F.col("high").alias("top"), F.col("ways").alias("w2"))
    wedge = one.join(two, "low")
    ends = pointed.select(F.col("low").alias("mid"), F.col("high").alias("top"), F.col("ways").alias("w3"))
    corners = F.array(F.struct(F.col("low").alias("node"), F.col("w3").alias("n")), F.struct(F.col("mid").alias("node"), F.col("w2").alias("n")), F.struct(F.col("top").alias("node"), F.col("w1").alias("n")))
    links = wedge.join(ends, ["mid", "top"]).select(F.explode(corners).alias("c")).groupBy("c.node").agg(F.sum("c.n").alias("links"))
    return nodes(edges).join(k, "node", "left").join(links, "node", "left").fillna(0, ["k", "links"])


def clustering(edges: DataFrame) -> DataFrame:
    """(node, lcc): directed links among a node's neighbours over k (k - 1)."""
    k = F.col("k")
    return _links_among(edges).select("node", F.when(k > 1, F.col("links") / (k * (k - 1))).otherwise(0.0).alias("lcc"))


def triangles(edges: DataFrame) -> DataFrame:
    """(node, triangles): directed links among a node's neighbours, halved."""
    return _links_among(edges).select("node", F.floor(F.col("links") / 2).cast("long").alias("triangles"))


def sssp(edges: DataFrame, source: object) -> DataFrame:
    """(node, distance): steps from the source; infinite where it doesn't lead."""
    far = hop(edges, [source], 1 << 30)
    return nodes(edges).join(far, "node", "left").select("node", F.coalesce(F.col("depth").cast("double"), F.lit(float("inf"))).alias("distance"))


def distances(edges: DataFrame, sample: int | None = None) -> DataFrame:
    """(origin, node, depth) from every node, or from the `sample` least nodes, along outgoing edges."""
    origins = nodes(edges).orderBy("node")
    origins = origins if sample is None else origins.limit(sample)
    return levels(directed(edges), origins.select(F.col("node").alias("origin"), "node"))


def profiles(edges: DataFrame, sample: int | None = None) -> DataFrame:
    """(node, reached, total, inverse, farthest) of every node, or the `sample` least: how many others it reaches, the sum of their distances and of the inverse distances, the greatest distance.

    The adjacency is broadcast and origins are searched from in batches; beyond MAX_ADJACENCY edges, searches are joins that keep every pair.
    """
    arcs = edges.select("src", "dst").distinct()
    if arcs.limit(MAX_ADJACENCY + 1).count() > MAX_ADJACENCY:
        d, far = distances(edges, sample), F.col("depth")
        return d.groupBy(F.col("origin").alias("node")).agg((F.count(F.lit(1)) - 1).alias("reached"), F.sum("depth").alias("total"), F.sum(F.when(far > 0, 1.0 / F.nullif(far, F.lit(0))).otherwise(0.0)).alias("inverse"), F.max("depth").cast("long").alias("farthest"))
    spark = edges.sparkSession
    every = nodes(edges).orderBy("node").toArrow()["node"].combine_chunks()
    pairs = arcs.where("src IS NOT NULL").toArrow()
    src, dst = (pc.index_in(pairs[c].cast(every.type), value_set=every).to_numpy() for c in ("src", "dst"))
    held = spark.sparkContext.broadcast((every, breadth.adjacency(len(every), src, dst)))
    many = len(every) if sample is None else min(sample, len(every))
    size = breadth.batch_size(len(every), spark.sparkContext.defaultParallelism)

    def search(batches):
        every, graph = held.value
        for batch in batches:
            for lo in batch.column(0).to_pylist():
                hi = min(lo + size, many)
                found = breadth.profile(graph, lo, hi)
                yield pa.RecordBatch.from_arrays([every.slice(lo, hi - lo), *map(pa.array, found)], names=["node", "reached", "total", "inverse", "farthest"])

    kind = nodes(edges).schema["node"].dataType.simpleString()
    return spark.range(0, many, size, max(1, -(-many // size))).mapInArrow(search, f"node {kind}, reached long, total long, inverse double, farthest long")


def closeness(edges: DataFrame, sample: int | None = None) -> DataFrame:
    """(node, closeness): nodes reached over the sum of their distances."""
    return profiles(edges, sample).select("node", F.when(F.col("total") > 0, F.col("reached") / F.nullif(F.col("total"), F.lit(0))).otherwise(0.0).alias("closeness"))


def harmonic(edges: DataFrame, sample: int | None = None) -> DataFrame:
    """(node, harmonic): the sum of inverse distances over n - 1."""
    n = nodes(edges).count()
    return profiles(edges, sample).select("node", (F.col("inverse") / max(n - 1, 1)).alias("harmonic"))


def diameter(edges: DataFrame) -> DataFrame:
    """One row: the greatest and the least positive eccentricity (diameter, radius)."""
    ecc = profiles(edges).select(F.col("farthest").alias("e")).where("e > 0")
    return ecc.agg(F.coalesce(F.max("e"), F.lit(0)).cast("long").alias("diameter"), F.coalesce(F.min("e"), F.lit(0)).cast("long").alias("radius"))


def degree_centrality(edges: DataFrame, direction: str = "both") -> DataFrame:
    """(node, degree, centrality): degree over n - 1."""
    every = nodes(edges)
    n = every.count()
    d = directed(edges, direction).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    return every.join(d, "node", "left").fillna(0, ["degree"]).withColumn("centrality", F.col("degree") / max(n - 1, 1))


def betweenness(edges: DataFrame, sample: int | None = None) -> DataFrame:
    """(node, betweenness) by Brandes' accumulation from every node (or the `sample` least), over (n - 1) (n - 2).

    The adjacency is broadcast, so more than MAX_ADJACENCY edges are refused; origins are spread over tasks.
    """
    spark = edges.sparkSession
    arcs = edges.select("src", "dst").distinct()
    if arcs.limit(MAX_ADJACENCY + 1).count() > MAX_ADJACENCY:
        raise ValueError("too many edges for betweenness")
    adjacency: dict = {}
    for s, d in arcs.collect():
        adjacency.setdefault(s, []).append(d)
    held = spark.sparkContext.broadcast(adjacency)
    every = nodes(edges)
    n = every.count()
    origins = every.orderBy("node")
    origins = origins if sample is None else origins.limit(sample)
    kind = edges.schema["src"].dataType.simpleString()

    def accumulate(frames):
        out: dict = {}
        for frame in frames:
            for s in frame["node"]:
                order, before, paths, depth, queue = [], {}, {s: 1.0}, {s: 0}, [s]
                for v in queue:
                    order.append(v)
                    for w in held.value.get(v, ()):
                        if w not in depth:
                            depth[w] = depth[v] + 1
                            queue.append(w)
                        if depth[w] == depth[v] + 1:
                            paths[w] = paths.get(w, 0.0) + paths[v]
                            before.setdefault(w, []).append(v)
                share = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for v in before.get(w, ()):
                        share[v] += paths[v] / paths[w] * (1 + share[w])
                    if w != s:
                        out[w] = out.get(w, 0.0) + share[w]
        yield pd.DataFrame({"node": list(out), "b": list(out.values())})

    parts = origins.repartition(spark.sparkContext.defaultParallelism, "node").mapInPandas(accumulate, f"node {kind}, b double")
    total = parts.groupBy("node").agg(F.sum("b").alias("b"))
    scale = max((n - 1) * (n - 2), 1)
    return every.join(total, "node", "left").select("node", (F.coalesce("b", F.lit(0.0)) / scale).alias("betweenness"))


def k_core(edges: DataFrame) -> DataFrame:
    """(node, core): coreness by peeling on in- plus out-degree."""
    left = cut(edges.where("src <> dst").select("src", "dst"))
    rest = cut(nodes(edges))
    done, k = rest.where("false").withColumn("core", F.lit(0)), 0
    while not rest.isEmpty():
        degree = left.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("d"))
        own = cut(rest.join(degree, "node", "left").select("node", F.coalesce("d", F.lit(0)).alias("d")))
        low = own.agg(F.min("d")).first()[0]
        k = max(k, low)
        gone = own.where(F.col("d") <= k).select("node")
        done = cut(done.union(gone.withColumn("core", F.lit(k))))
        rest = cut(own.where(F.col("d") > k).select("node"))
        left = cut(left.join(rest.select(F.col("node").alias("src")), "src", "left_semi").join(rest.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"))
    return done


def match(edges: DataFrame, pattern: Sequence[tuple[str, str | None, str, str]], labels: DataFrame | None = None, node_labels: dict[str, str] | None = None, where: str | None = None, optional: Sequence[tuple[str, str | None, str, str]] = (), not_exists: Sequence[tuple[str, str | None, str, str]] = (), var_length: dict[int, tuple[int, int]] | None = None, returns: Sequence[str] | None = None, distinct: bool = False, order: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Rows of variable bindings for a pattern of triples (from, edge label or None, to, direction 'out' | 'in' | 'both').

    labels (node, label) with node_labels {variable: label} restrict nodes. var_length {place of a triple: (least, most
    steps)}. optional triples leave their new variable null; not_exists triples must have no match. `where` is SQL over
    the variables.
    """
    rows: DataFrame | None = None

    def steps(i: int | None, triple: tuple[str, str | None, str, str]) -> DataFrame:
        a, label, b, direction = triple
        one = directed(edges, direction, [label] if label else None).select("a", "b").distinct()
        least, most = (var_length or {}).get(i, (1, 1)) if i is not None else (1, 1)
        if (least, most) != (1, 1):
            walks, parts = one, [one] if least <= 1 else []
            for n in range(2, most + 1):
                nxt = one.select(F.col("a").alias("b"), F.col("b").alias("c"))
                walks = walks.join(nxt, "b").select("a", F.col("c").alias("b")).distinct()
                if n >= least:
                    parts.append(walks)
            one = parts[0]
            for p in parts[1:]:
                one = one.union(p)
            one = one.distinct()
        return one.where("a = b").select(F.col("a").alias(a)) if a == b else one.select(F.col("a").alias(a), F.col("b").alias(b))

    for i, triple in enumerate(pattern):
        own = steps(i, triple)
        shared = [] if rows is None else [c for c in own.columns if c in rows.columns]
        rows = own if rows is None else rows.join(own, shared) if shared else rows.crossJoin(own)
    for name, label in (node_labels or {}).items():
        rows = rows.join(labels.where(F.col("label") == label).select(F.col("node").alias(name)).distinct(), name, "left_semi")
    for triple in optional:
        own = steps(None, triple)
        rows = rows.join(own, [c for c in own.columns if c in rows.columns], "left")
    for triple in not_exists:
        own = steps(None, triple)
        rows = rows.join(own, [c for c in own.columns if c in rows.columns], "left_anti")
    if where:
        rows = rows.where(where)
    if returns:
        rows = rows.select(*returns)
    if distinct:
        rows = rows.distinct()
    if order:
        rows = rows.orderBy(*order)
    return rows if limit is None else rows.limit(limit)


def as_of(history: DataFrame, t: int, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """The edges of a history that were there at t: start <= t < end (null: open)."""
    return history.where((F.col(start) <= t) & (F.col(end).isNull() | (F.col(end) > t))).select("src", "label", "dst")


def rag(edges: DataFrame, seeds: DataFrame, depth: int, k: int, rrf_k: float = 60.0, allowed: DataFrame | None = None) -> DataFrame:
    """(id, rrf_score): seeds (id, rank) from a search, widened by `depth` steps; both rankings fused. Expansion ranks by depth, then node."""
    from tessera.operators.ranking import ranked
    from tessera.operators.search import fused

    if not (rrf_k >= 0 and rrf_k != float("inf")):
        raise ValueError("rrf_k must be finite and not negative")
    steps = directed(edges)
    if allowed is not None:
        steps = steps.join(allowed.select(F.col("node").alias("b")).distinct(), "b", "left_semi")
    found = levels(steps, seeds.select(F.lit(0).alias("origin"), F.col("id").alias("node")), depth)
    wide = ranked(found.select(F.col("node").alias("id"), "depth"), "depth", "id", descending=False)
    return fused([(seeds, rrf_k), (wide, rrf_k)], k)


def graph_rag(edges: DataFrame, docs: DataFrame, query_vector: list[float], k: int, depth: int = 2, query_text: str | None = None, seeds: int = 10, seed_ids: Sequence[object] = (), rrf_k: float = 60.0, allowed: DataFrame | None = None, metric: str = "l2", id_col: str = "id", vec_col: str = "embedding", text_col: str = "text") -> DataFrame:
    """(id, rrf_score): the nearest documents, those that a text search finds and the caller's own are seeds of an expansion; all rankings fused.

    The best `seeds` of each search are taken. allowed (node) bounds seeds and every step.
    """
    from tessera.operators.search import bm25_top_k, fused, vector_top_k, with_rank

    own = docs if allowed is None else docs.join(allowed.select(F.col("node").alias(id_col)).distinct(), id_col, "left_semi")
    legs = [with_rank(vector_top_k(own, query_vector, seeds, metric, id_col, vec_col), F.col("distance"), F.col("id")).select("id", "rank")]
    if query_text is not None:
        legs.append(with_rank(bm25_top_k(own, query_text, seeds, id_col=id_col, text_col=text_col), F.desc("score"), F.col("id")).select("id", "rank"))
    if seed_ids:
        given = own.where(F.col(id_col).isin(list(seed_ids))).select(F.col(id_col).alias("id"))
        legs.append(with_rank(given, F.col("id")).select("id", "rank"))
    every = cut(legs[0] if len(legs) == 1 else fused([(leg, rrf_k) for leg in legs], seeds * 2 + len(seed_ids)).withColumnRenamed("rrf_score", "score").transform(lambda d: with_rank(d, F.desc("score"), F.col("id")).select("id", "rank")))
    return rag(edges, every, depth, k, rrf_k, allowed)


def bfs_leg(edges: DataFrame, seed: object, depth: int) -> DataFrame:
    """(id, rank): nodes in the order in which a search from the seed along outgoing edges finds them (by steps, then node), the seed first."""
    from tessera.operators.ranking import ranked

    return ranked(hop(edges, [seed], depth).select(F.col("node").alias("id"), "depth"), "depth", "id", descending=False).select("id", "rank")


def put_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """edges with those of `new` (src, label, dst, more columns) added, or replaced where they are there."""
    key = ["src", "label", "dst"]
    return edges.join(new.select(*key).distinct(), key, "left_anti").select(*edges.columns).unionByName(new, allowMissingColumns=True)


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """edges without those of `gone` (src, label, dst)."""
    key = ["src", "label", "dst"]
    return edges.join(gone.select(*key).distinct(), key, "left_anti").select(*edges.columns)


def delete_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """edges without those at the nodes of `gone` (node)."""
    ids = gone.select("node").distinct()
    return edges.join(ids.withColumnRenamed("node", "src"), "src", "left_anti").join(ids.withColumnRenamed("node", "dst"), "dst", "left_anti").select(*edges.columns)


def set_labels(labels: DataFrame, new: DataFrame) -> DataFrame:
    """Node labels (node, label) with those of `new`; a node may have several."""
    return labels.select("node", "label").union(new.select("node", "label")).distinct()


def remove_labels(labels: DataFrame, gone: DataFrame) -> DataFrame:
    return labels.join(gone.select("node", "label").distinct(), ["node", "label"], "left_anti").select("node", "label")


def compacted(edges: DataFrame, files: int) -> DataFrame:
    """The edges, each once, in `files` partitions by source."""
    return edges.dropDuplicates(["src", "label", "dst"]).repartition(files, "src").sortWithinPartitions("src", "label", "dst")


def parse_match(text: str) -> dict:
    """A MATCH statement as the arguments of match(): chains of (a:Label)-[:TYPE*1..3]->(b), OPTIONAL MATCH, NOT EXISTS { }, WHERE, RETURN, ORDER BY, LIMIT."""
    flat = " ".join(text.split()).rstrip("; ")
    parts = re.fullmatch(r"MATCH (?P<match>.+?)(?P<optional>(?: OPTIONAL MATCH .+?)*)(?: WHERE (?P<where>.+?))? RETURN (?P<distinct>DISTINCT )?(?P<returns>.+?)(?: ORDER BY (?P<order>.+?))?(?: LIMIT (?P<limit>\d+))?", flat, re.I)
    if not parts:
        raise ValueError("not a MATCH statement that is understood")
    out: dict = {"node_labels": {}, "var_length": {}, "optional": [], "not_exists": []}
    fresh = iter(range(1 << 20))

    def chain(pattern: str, walks: bool) -> list[tuple[str, str | None, str, str]]:
        triples = []
        for path in re.split(r"\s*,\s*(?=\()", pattern.strip()):
            node = r"\(\s*(\w*)\s*(?::\s*(\w+))?\s*\)"
            edge = r"\s*(<?)-(?:\[\s*\w*\s*(?::\s*(\w+))?\s*(?:\*\s*(\d+)?\s*(?:\.\.\s*(\d+))?)?\s*\])?-(>?)\s*"
            if not re.fullmatch(node + f"(?:{edge}{node})*", path):
                raise ValueError(f"pattern {path!r} is not understood")
            names = []
            for name, label in re.findall(node, path):
                names.append(name or f"_n{next(fresh)}")
                if label:
                    out["node_labels"][names[-1]] = label
            for (back, kind, least, most, ahead), a, b in zip(re.findall(edge + r"(?=\()", path), names[:-1], names[1:], strict=True):
                direction = "both" if bool(back) == bool(ahead) else "in" if back else "out"
                if least or most:
                    if not walks or not most:
                        raise ValueError("walks need an upper bound and stand in the first MATCH")
                    out["var_length"][len(triples)] = (int(least or 1), int(most))
                triples.append((a, kind or None, b, direction))
        return triples

    out["pattern"] = chain(parts["match"], True)
    for o in re.findall(r"OPTIONAL MATCH (.+?)(?= OPTIONAL MATCH |$)", parts["optional"], re.I):
        out["optional"] += chain(o, False)
    where = parts["where"] or ""
    for negated in re.findall(r"NOT EXISTS \{ ?(?:MATCH )?(.+?) ?\}", where, re.I):
        out["not_exists"] += chain(negated, False)
    kept = [c for c in re.split(r"\s+AND\s+", where, flags=re.I) if c and not re.match(r"NOT EXISTS \{", c, re.I)]
    out["where"] = " AND ".join(kept) or None
    out["returns"] = [re.sub(r"(?i)^(\w+)$", r"\1", c.strip()) for c in parts["returns"].split(",")]
    out["distinct"] = bool(parts["distinct"])
    out["order"] = [c.strip() for c in parts["order"].split(",")] if parts["order"] else None
    out["limit"] = int(parts["limit"]) if parts["limit"] else None
    return out


def match_text(edges: DataFrame, text: str, labels: DataFrame | None = None) -> DataFrame:
    """The rows of a MATCH statement, see parse_match()."""
    asked = parse_match(text)
    if asked["node_labels"] and labels is None:
        raise ValueError("node labels are asked for, and there are none")
    return match(edges, asked.pop("pattern"), labels, **asked)
