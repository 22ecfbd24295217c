"""Groups of documents whose word shingles are alike to a given degree: SimHash codes compared by bit slices, links verified on the shingles.

Two documents link if the exact Jaccard similarity of their sets of shingles is at least the given one; groups are what
links reach. A document's sketch has BANDS keys, each of ROWS minima of differently mixed shingle hashes; documents that share a
key are candidates. A pair at similarity j shares none with probability (1 - j ** ROWS) ** BANDS (0.2 % at 0.8),
whatever the number of documents, and whatever the shingles' counts.

A document's code has 64 * LANES bits: every lane is a SimHash of its shingle hashes, mixed anew. The codes of a bucket are compared
as bit planes (see bitslice), and links that span what is within the radius of the given similarity (its mean and one standard
error) are verified first; in buckets above FEW every document and the bucket's least, too. Then every two of a bucket
that aren't in one group yet are verified (so near copies in great numbers don't make all their pairs, and the radius
decides only what comes first: no link is lost by it). Buckets above MOST are spread over tasks. Shingles are taken anew from the texts of candidates only; the others are held back by a bitmap of SLOTS hashes (results don't depend
on it).

Nulls: a null text is empty. Texts without words are one group. Equal sets are one node however many rows have them.
Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.bitslice import spanning_links
from tessera.llm.common import forget, give_back, ship, tidy, written
from tessera.llm.components import components
from tessera.llm.simhash import _BITS, SEED, _slices, shingles

ROWS, BANDS, LANES = 5, 16, 4
FEW, MOST, SLOTS = 50, 20_000, 1 << 20
SLICE = 500  # texts whose shingles are held at once
_TIMES, _PLUS = np.random.default_rng(11).integers(0, 1 << 63, (2, ROWS * BANDS), np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def hashes(text: str | None, words: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    import xxhash

    parts, digest = shingles(text, words), xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(p, SEED) for p in parts), np.uint64, len(parts)))


def node(h: np.ndarray) -> int:
    """The number that stands for a set of hashes."""
    import xxhash

    return xxhash.xxh64_intdigest(h.tobytes(), SEED) - (1 << 63) if len(h) else 0


def keys(h: np.ndarray) -> np.ndarray:
    """The keys of a set of hashes, one for each band; of an empty set none."""
    if not len(h):
        return np.zeros(0, np.int64)
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(h), 4096):
        x = h[lo : lo + 4096] * _TIMES[:, None] + _PLUS[:, None]
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=1))
    out = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        out = (out ^ (out >> np.uint64(31))) * _MIX + row
    return (out ^ (out >> np.uint64(31))).view(np.int64)


def code(h: np.ndarray) -> np.ndarray:
    """The SimHash code of a set of hashes, LANES numbers; of an empty set zeros."""
    out = np.zeros(LANES, np.int64)
    for lane in range(LANES if len(h) else 0):
        x = h if lane == 0 else (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15 + 2 * lane * 0x1000193)
        x = x ^ (x >> np.uint64(32))
        grid = x.astype(">u8").view(np.uint8).reshape(-1, 8)
        seen = np.bincount((grid + np.arange(0, 2048, 256)).ravel(), minlength=2048).reshape(8, 256)
        out[lane] = np.packbits((seen @ _BITS).ravel() * 2 > len(h)).view(">i8")[0]
    return out


def radius(similarity: float) -> int:
    """The bits in which codes at a Jaccard similarity differ on average, and one standard error."""
    bits, share = 64 * LANES, math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return round(bits * share + math.sqrt(bits * share * (1 - share)))


def _near_codes(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Lists of (node, code), one for each bucket -> spanning links (a, b), a < b, of codes within `most` bits."""
    for batch in batches:
        lists = batch.column(0)
        sizes = np.diff(lists.offsets.to_numpy())
        for lo, hi in _slices(sizes, 1 << 16):
            rows = lists.slice(lo, hi - lo).flatten()
            nodes = rows.field("node").to_numpy()
            grid = rows.field("code").flatten().to_numpy().view(np.uint64).reshape(-1, LANES)
            a, b = (nodes[x] for x in spanning_links(grid, sizes[lo:hi], most))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def sketch(text: Column, words: int) -> Column:
    """struct<node, size, keys, code> of texts."""

    @F.arrow_udf("struct<node: long, size: int, keys: array<long>, code: array<long>>")
    def of(texts: pa.Array) -> pa.Array:
        parts = []
        for lo in range(0, max(1, len(texts)), SLICE):
            sets = [hashes(t.as_py(), words) for t in texts.slice(lo, SLICE)]
            parts.append(pa.StructArray.from_arrays([pa.array(map(node, sets), pa.int64()), pa.array(map(len, sets), pa.int32()), pa.array(map(keys, sets), pa.list_(pa.int64())), pa.array(map(code, sets), pa.list_(pa.int64()))], ["node", "size", "keys", "code"]))
        give_back()
        return pa.concat_arrays(parts)

    return of(text)


def shingle_sets(text: Column, words: int) -> Column:
    """struct<node, hashes> of texts."""

    @F.arrow_udf("struct<node: long, hashes: array<long>>")
    def of(texts: pa.Array) -> pa.Array:
        parts = []
        for lo in range(0, max(1, len(texts)), SLICE):
            sets = [hashes(t.as_py(), words) for t in texts.slice(lo, SLICE)]
            parts.append(pa.StructArray.from_arrays([pa.array(map(node, sets), pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "hashes"]))
        give_back()
        return pa.concat_arrays(parts)

    return of(text)


def _marked(slot: Column, marks: np.ndarray) -> Column:
    """True for marked slots; no Python worker's work, so that a task needs one for the shingles alone."""
    octet = F.substring(F.lit(np.packbits(marks, bitorder="little").tobytes()), F.shiftright(slot, 3) + 1, F.lit(1))
    return F.getbit(F.conv(F.hex(octet), 16, 10).cast("int"), slot.bitwiseAND(F.lit(7))) == 1


def _verified(pairs: DataFrame, source: DataFrame, kinds: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingles are as alike as asked."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    slot = F.pmod(F.xxhash64("id"), F.lit(SLOTS)).cast("int")
    masks = wanted.join(kinds, "node").select(F.pmod(F.xxhash64("least"), F.lit(SLOTS)).cast("int").alias("slot")).groupBy(F.shiftright("slot", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, slot & 31)")).alias("bits")).collect()
    marks = np.zeros(SLOTS, bool)
    for at, bits in masks:
        marks[at * 32 : at * 32 + 32] = bits >> np.arange(32) & 1
    near = source.where(_marked(slot, marks)).select(shingle_sets(F.col("text"), words).alias("s")).select("s.node", "s.hashes")
    sets = written(near.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    shared = both.select("a", "b", (F.size("x") + F.size("y")).alias("sum"), F.size(F.array_intersect("x", "y")).alias("shared"))
    out = written(shared.where(F.col("shared") / (F.col("sum") - F.col("shared")) >= similarity).select("a", "b"), "links")
    forget(sets)
    return out


def near_groups(docs: DataFrame, id_col: str, text_col: str, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component): component is the least id that links reach; one row per row of docs. Ids are longs, not null."""
    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    own = written(source.select("id", sketch(F.col("text"), words).alias("s")).select("id", "s.node", "s.size", "s.keys", "s.code"), "sketches")
    kinds = written(own.groupBy("node").agg(F.min("id").alias("least"), F.min("size").alias("size"), F.first("keys").alias("keys"), F.first("code").alias("code")), "kinds")
    keyed = kinds.select("node", "size", F.explode("keys").alias("key"))
    sized = F.least("size", "other_size") >= similarity * F.greatest("size", "other_size") - 1e-6  # others can't be that alike
    buckets = written(keyed.groupBy("key").agg(F.min(F.struct("node", "size")).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    hub = buckets.where(F.col("n") > FEW).select("key", F.col("hub.node").alias("other"), F.col("hub.size").alias("other_size"))
    ends = [F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")]
    shared = kinds.select("node", "code", F.explode("keys").alias("key")).join(buckets.select("key", F.ceil(F.col("n") / MOST).cast("int").alias("tiles")), "key")
    lists = shared.groupBy("key", F.pmod(F.xxhash64("node"), F.col("tiles")).alias("tile")).agg(F.collect_list(F.struct("node", "code")).alias("rows")).select("rows")
    most = radius(similarity)
    near = lists.mapInArrow(tidy(lambda batches: _near_codes(batches, most)), "a long, b long")
    stars = keyed.join(hub, "key").where(F.col("node") != F.col("other")).where(sized).select(*ends)
    tried = written(near.union(stars).distinct(), "pairs")
    links = _verified(tried, source, kinds, words, similarity)
    root = components(links)
    labelled = written(keyed.join(buckets.select("key"), "key", "left_semi").join(root, "node", "left").select("node", "size", "key", F.coalesce("root", "node").alias("label")), "labelled")
    apart = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.ceil(F.count(F.lit(1)) / MOST).cast("int").alias("tiles")).where("lo <> hi").select("key", "tiles")
    left = labelled.join(apart, "key").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).drop("tiles")
    right = labelled.join(apart, "key").select("key", F.col("node").alias("other"), F.col("size").alias("other_size"), F.col("label").alias("other_label"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    pairs = left.join(right, ["key", "tile"]).where("node < other AND label <> other_label").where(sized).select(*ends).distinct()
    rest = written(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
    if not rest.isEmpty():
        links = links.union(_verified(rest, source, kinds, words, similarity))
        root = components(links)
    inside = root.join(kinds.select("node", "least"), "node")
    component = inside.groupBy("root").agg(F.min("least").alias("component"))
    linked = inside.join(component, "root").select("node", "component")
    of = kinds.join(linked, "node", "left").select("node", F.coalesce("component", "least").alias("component"))
    return own.select("id", "node").join(of, "node").select("id", "component")
