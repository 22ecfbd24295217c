"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint has 64 bits for each seed: a bit is 1 if it is set in over half the XXH64 hashes of the text's word
shingles. Pairs within the radius must agree on whole blocks of the fingerprint (pigeonhole), so equal blocks bring
them into one bucket; a bucket's fingerprints are compared as bit planes (see bitslice).

Nulls: a null text counts as empty; a null id is kept, and never is a component's id. Empty texts have fingerprint
zero and link like any other. Texts are read whole. Equal fingerprints are one node however many rows have them.
Empty tables give empty results.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.bitslice import spanning_links
from tessera.llm.common import partitions_for, ship, written
from tessera.llm.components import components

SEED = 42
SPREAD = 20_000  # fingerprints of which one task makes bucket keys
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)  # of a byte, highest first


def shingles(text: str | None, words: int) -> list[bytes]:
    """The word shingles of a text, repeats included; of fewer words the whole sequence; of none nothing."""
    own = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if len(own) <= words:
        return [b" ".join(own)] if own else []
    joined = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [joined[s:e] for s, e in zip(starts[: len(own) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


def fingerprint(parts: list[bytes], seed: int = SEED) -> int:
    """The 64-bit fingerprint of shingles, as a signed number."""
    if not parts:
        return 0
    digest = xxhash.xxh64_digest
    grid = np.frombuffer(b"".join([digest(p, seed) for p in parts]), np.uint8).reshape(-1, 8)
    seen = np.bincount((grid + np.arange(0, 2048, 256)).ravel(), minlength=2048).reshape(8, 256)
    bits = (seen @ _BITS).ravel() * 2 > len(parts)
    return int(np.packbits(bits).view(">i8")[0])


def fingerprints(text: Column, words: int = 3, seeds: tuple[int, ...] = (SEED,)) -> Column:
    """array<long> of a text's fingerprints, one for each seed."""

    @F.arrow_udf("array<long>")
    def of(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            parts = shingles(t.as_py(), words)
            out.append([fingerprint(parts, s) for s in seeds])
        return pa.array(out, pa.list_(pa.int64()))

    return of(text)


def _link_buckets(batches, radius: int):
    for batch in batches:
        lists = batch.column(0)
        sizes = np.diff(lists.offsets.to_numpy())
        for lo, hi in _slices(sizes, 1 << 18):
            flat = lists.slice(lo, hi - lo).flatten()
            codes = flat.to_numpy().view(np.uint64)
            a, b = spanning_links(codes, sizes[lo:hi], radius)
            yield pa.RecordBatch.from_arrays([pa.array(codes[a].view(np.int64)), pa.array(codes[b].view(np.int64))], names=["a", "b"])


def _slices(sizes: np.ndarray, most: int):
    """Runs of buckets with at most `most` members together (or one bucket)."""
    lo, total = 0, 0
    for i, s in enumerate(sizes.tolist()):
        if total + s > most and i > lo:
            yield lo, i
            lo, total = i, 0
        total += s
    if lo < len(sizes):
        yield lo, len(sizes)


def fingerprint_links(codes: DataFrame, radius: int = 2) -> DataFrame:
    """Spanning links (a, b) among distinct 64-bit fingerprints (column `fp`) at most `radius` bits apart.

    The fingerprint is cut into radius + 6 blocks (eight bytes for radius 2); two that are within the radius agree
    on all blocks but `radius` of them, so each choice of those gives a bucket key. A bucket holds at most
    2 ** (bits of `radius` blocks) distinct fingerprints (65,536 for radius 2), which bounds a bucket's task however
    large or skewed the corpus is. Buckets of one fingerprint are dropped before any comparison.
    """
    blocks = radius + 6
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(blocks) if i not in gone) for gone in combinations(range(blocks), radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.explode(F.array(*[F.struct(F.lit(t).cast("byte").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(signed)]))
    buckets = codes.select("fp", keys.alias("k")).groupBy("k").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
    ship(codes.sparkSession)
    return buckets.mapInArrow(lambda it: _link_buckets(it, radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """(id, fingerprint long, component): one row per row of docs; component is the least id that links reach.

    Rows of one fingerprint are linked; fingerprints link at `radius` or fewer differing bits.
    """
    ship(docs.sparkSession)
    own = written(docs.select(F.col(id_col).alias("id"), fingerprints(F.col(text_col), words)[0].alias("fp")), "fp")
    codes = own.groupBy("fp").agg(F.min("id").alias("least"))
    spread = partitions_for(own.count(), SPREAD)  # a key for each choice of blocks is made of every code: not in a few large tasks
    links = fingerprint_links(codes.select("fp").repartition(spread, "fp"), radius)
    member = components(links)
    inside = member.join(codes, member.node == codes.fp).select("fp", "root", "least")
    component = inside.groupBy("root").agg(F.min("least").alias("component"))
    linked = inside.join(component, "root").select("fp", "component")
    of = codes.join(linked, "fp", "left").select("fp", F.coalesce("component", "least").alias("component"))
    return own.join(of, "fp").select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), F.col("component").alias("component_id"))


def op5_simhash(docs: DataFrame) -> DataFrame:
    """The contract's columns: fingerprint as 16 hex digits."""
    return near_duplicates(docs).withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))
