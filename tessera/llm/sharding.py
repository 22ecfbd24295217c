"""Sharding by a k-d tree over document metadata, with distributed weighted medians.

A node of the tree that stands for several shards is split at a weighted quantile (the median, if its shards can be
halved) along the dimension in which its points spread widest, until every leaf is one shard of the target bytes.
The weight of a row is the size of its text and an overhead. Equal texts are one point, so that they share a shard.
Points heavier than LUMP of a shard (their number is bounded by shards / LUMP) are dealt out first, heaviest first to
the lightest shard, and the tree fills up what room each shard has left; a point heavier than a shard is cut by the
hash of its ids.

A quantile is found without sorting or gathering rows: each pass adds up weights by node and slice of the current
interval of keys, and narrows the interval to one slice. The driver sees at most SLICES sums for each node.

Dimensions: source and language (as numbers of their characters behind what all values begin with, so that equal values lie together and
similar ones near each other) and the length of the text (log scale), each from its least value, 0, to its greatest, 1. A hash of the
text only breaks ties, so any set of points can be split.

Nulls: a null text weighs the overhead only and is one group with empty texts; null sources and languages are values
of their own; a null id is kept. Repeated rows are rows. Empty tables give no rows.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import numbered, written

SHARDS, OVERHEAD = 40, 16
LUMP = 0.02  # of a shard
DIMENSIONS = ("source", "lang", "length")
_HALF = 18  # bits of a coordinate, and of the tie-breaker behind it
SLICES, PASSES = 4096, 3


def _unit(hash_: Column) -> Column:
    """A 64-bit hash as a number of 0 to 1."""
    return F.shiftrightunsigned(hash_, 12) / F.lit(float(1 << 52))


def _points(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str) -> DataFrame:
    """One row for each row of docs: id, size, crc, group and the plain metadata."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("grp"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("src"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lng"),
    )


def _number(name: Column, skip: int) -> Column:
    """Six bytes of a name, after `skip` of them, as a number."""
    return F.conv(F.rpad(F.hex(F.substring(name.cast("binary"), skip + 1, 6)), 12, "0"), 16, 10).cast("double")


def _scaled(value: Column, least: float | None, most: float | None) -> Column:
    return (value - least) / (most - least) if least is not None and most > least else F.lit(0.0)


def _key(coordinate: Column, tie: Column) -> Column:
    """A long: the coordinate in the upper half, the tie-breaker in the lower."""
    scale = 1 << _HALF
    whole = lambda x: F.floor(F.least(x, F.lit(0.99999999)) * scale).cast("long")
    return whole(coordinate) * scale + whole(tie)


def _leaf(splits: dict[int, tuple[int, int, int, int]], leaves: dict[int, int], node: int = 0) -> Column:
    """The node or shard of a row, as one nested expression over its keys."""
    if node not in splits:
        return F.lit(leaves[node])
    d, cut, left, right = splits[node]
    return F.when(F.col(f"k{d}") <= cut, _leaf(splits, leaves, left)).otherwise(_leaf(splits, leaves, right))


def tree(points: DataFrame, room: list[float]) -> Column:
    """The shard of each point: leaf i of the tree gets about room[i] of the weight w, by the keys k0, k1, ... of points."""
    splits: dict[int, tuple[int, int, int, int]] = {}
    spans = {0: (0, len(room))}  # a node's range of shards
    dims = range(len(DIMENSIONS))
    while True:
        wide = [n for n in spans if n not in splits and spans[n][1] - spans[n][0] > 1]
        if not wide:
            return _leaf(splits, {n: a for n, (a, b) in spans.items() if n not in splits})
        at = points.withColumn("node", _leaf(splits, {n: n for n in spans if n not in splits})).where(F.col("node").isin(wide))
        spread = at.groupBy("node").agg(F.sum("w").alias("w"), *[(F.shiftright(F.max(f"k{d}"), _HALF) - F.shiftright(F.min(f"k{d}"), _HALF)).alias(f"s{d}") for d in dims]).collect()
        goal, along = dict.fromkeys(wide, 0.0), dict.fromkeys(wide, 0)
        for r in spread:
            a, b = spans[r.node]
            widths = [r[f"s{d}"] for d in dims]
            along[r.node] = widths.index(max(widths))
            goal[r.node] = float(r.w) * sum(room[a : a + (b - a) // 2]) / max(sum(room[a:b]), 1e-9)
        low, before = dict.fromkeys(wide, 0), dict.fromkeys(wide, 0.0)
        for p in reversed(range(PASSES)):
            size = SLICES**p
            part = F.lit(None).cast("long")
            for n in wide:
                k = F.col(f"k{along[n]}")
                part = F.when((F.col("node") == n) & k.between(low[n], low[n] + size * SLICES - 1), F.floor((k - low[n]) / size)).otherwise(part)
            sums: dict[int, list[tuple[int, float]]] = {n: [] for n in wide}
            for r in at.withColumn("slice", part).where("slice is not null").groupBy("node", "slice").agg(F.sum("w").alias("w")).collect():
                sums[r.node].append((int(r.slice), float(r.w)))
            for n, parts in sums.items():
                for k, w in sorted(parts):
                    if before[n] + w >= goal[n] or k == max(parts)[0]:
                        low[n] += k * size
                        break
                    before[n] += w
                if p == 0 and parts and dict(parts).get(low[n] % SLICES, 0.0) > 2 * (goal[n] - before[n]):
                    low[n] -= 1  # the last slice goes to the side that it suits better
        for n in wide:
            a, b = spans[n]
            mid, left, right = a + (b - a) // 2, len(spans), len(spans) + 1
            splits[n] = (along[n], low[n], left, right)
            spans[left], spans[right] = (a, mid), (mid, b)


def sharded(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of docs; slots number a shard's rows from 0 in the order of hashes of ids."""
    rows = written(_points(docs, id_col, text_col, source_col, lang_col), "points")
    total, count = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    target = (total or 0) / shards
    groups = rows.groupBy("grp").agg(F.sum("size").alias("w"))
    heavy = groups.where(F.col("w") > LUMP * target).collect() if count else []  # at most shards / LUMP rows
    pieces = {r.grp: -(-int(r.w) // max(1, int(target))) for r in heavy}
    load = [0.0] * shards
    homes: list[tuple[int, int, int]] = []
    for w, grp, i in sorted(((r.w / pieces[r.grp], r.grp, i) for r in heavy for i in range(pieces[r.grp])), reverse=True):
        k = min(range(shards), key=load.__getitem__)
        load[k] += w
        homes.append((grp, i, k))
    room = [max(0.0, target - x) for x in load]
    lumps = rows.sparkSession.createDataFrame(homes, "grp long, piece long, home int")
    kinds = F.broadcast(lumps.groupBy("grp").agg(F.count(F.lit(1)).alias("pieces")))
    known = rows.join(kinds, "grp", "left").withColumn("piece", F.pmod(F.xxhash64("id", F.lit("piece")), F.col("pieces")))
    light = known.where("pieces is null")
    units = light.groupBy("grp").agg(F.sum("size").alias("w"), F.min("src").alias("src"), F.min("lng").alias("lng"), F.max("size").alias("long"))
    tie = _unit(F.xxhash64("grp", F.lit("tie")))
    ends = rows.agg(F.min("src"), F.max("src"), F.min("lng"), F.max("lng")).first()
    skip = [len(os.path.commonprefix([(a or "").encode(), (b or "").encode()])) for a, b in (ends[:2], ends[2:])]  # what least and greatest begin with, all do
    raw = [_number(F.col("src"), skip[0]), _number(F.col("lng"), skip[1]), F.log2("long")]
    span = units.agg(*[f(c) for c in raw for f in (F.min, F.max)]).first()
    coordinates = [_scaled(c, span[2 * d], span[2 * d + 1]) for d, c in enumerate(raw)]
    points = written(units.select("grp", "w", *[_key(c, tie).alias(f"k{d}") for d, c in enumerate(coordinates)]), "units")
    placed = points.select("grp", tree(points, room).alias("shard"))
    columns = ["id", "size", "crc", "shard"]
    spread = known.where("pieces is not null").join(F.broadcast(lumps), ["grp", "piece"]).withColumn("shard", F.col("home"))
    whole = light.join(placed, "grp").select(*columns).union(spread.select(*columns))
    return numbered(whole, ["shard"], ["id", "crc", "size"], "slot", count).select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int").alias("shard"), "slot")


def op1_sharding(docs: DataFrame) -> DataFrame:
    return sharded(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
