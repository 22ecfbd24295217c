"""Token ids in binary shard files, compressed by a Re-Pair grammar.

Each shard holds the documents of a range of ids. Rounds of Re-Pair replace pairs of neighbouring symbols: all pairs of
the shard are counted, the frequent ones become nonterminals, and their occurrences are replaced from left to right;
rounds go on until no pair occurs LEAST_COUNT times or symbols run out (they have 16 bits). Pairs never cross documents, so that a document is a run of symbols: with the rules and
their expansion lengths, any document or token is decoded without the rest.

File layout, little-endian: magic `TRP1`, then documents, rules, symbols (uint32 each), tokens (uint64); ids int64[documents];
tokens of each document uint32[documents]; symbols of each document uint32[documents]; rules (left, right) uint16[2 * rules];
expansion lengths uint32[rules]; symbols uint16[symbols]. Symbols below BASE are token ids; rule i is symbol BASE + i.

Nulls: a null text is empty (its end id only); a null id is written as the least long and comes first. Repeated rows are
written each. Empty tables give no files. Files are written under another name and renamed, so a task that runs twice
leaves the same file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import NO_ID, partitions_for, range_bounds, range_bucket, shared_dir, ship, written
from tessera.llm.tokenizing import BYTE, Cached, in_ranges

BASE = 50257  # ids of the vocabulary
MOST_RULES = (1 << 16) - BASE
LEAST_COUNT = 6  # of a pair that becomes a rule: a rule costs eight bytes and saves two for each occurrence
A_ROUND = 4096  # rules of one round at most: the most frequent pairs
_SLOTS = 16  # bits of a slot
SHARD_BYTES = 8 << 20  # of text
RANGE_BYTES = 8 << 20  # of text that is encoded at once: a piece is looked up once for each
PIECES = 600_000  # in a worker's table
HEAD = struct.Struct("<4sIIIQ")


def compress(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """uint16 symbols of documents that end at `ends` -> shorter symbols, their document ends, rules (n, 2).

    Ends when no pair is frequent or there is no symbol left for a rule. A round finds its pairs' places by a table of
    hashes; of pairs that share a slot the most frequent goes first, the others are left to the next round.
    """
    rules: list[np.ndarray] = []
    n_rules = 0
    while n_rules < MOST_RULES and len(symbols) > 1:
        codes = symbols[:-1].astype(np.uint32) << np.uint32(16) | symbols[1:]
        last = ends[(ends > 0) & (ends < len(symbols))] - 1  # no pair begins there
        ordered = np.sort(np.delete(codes, last))
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, int)
        times = np.diff(np.append(edge, len(ordered)))
        often = np.flatnonzero(times >= LEAST_COUNT)
        if not len(often):
            break
        often = often[np.argsort(-times[often], kind="stable")[: min(A_ROUND, MOST_RULES - n_rules)]]
        pairs = ordered[edge[often]]
        pairs = pairs[np.sort(np.unique(_slot(pairs), return_index=True)[1])]
        table, number = np.zeros(1 << _SLOTS, np.uint32), np.full(1 << _SLOTS, -1, np.int16)
        table[_slot(pairs)], number[_slot(pairs)] = pairs, np.arange(len(pairs))
        slot = _slot(codes)
        found = table[slot] == codes
        found[last] = False
        at = np.flatnonzero(found)
        rule = number[slot[at]]
        at, rule = at[rule >= 0], rule[rule >= 0]  # a free slot holds the code of the pair (0, 0)
        fresh = np.concatenate([[True], at[1:] != at[:-1] + 1]) if len(at) else np.zeros(0, bool)
        run = np.cumsum(fresh) - 1
        take = (at - at[fresh][run]) % 2 == 0  # of overlapping occurrences every other one, from the left
        at, rule = at[take], rule[take]
        used = np.flatnonzero(np.bincount(rule, minlength=len(pairs)))
        if not len(at):
            break
        rules.append(np.stack([pairs[used] >> np.uint32(16), pairs[used] & np.uint32(0xFFFF)], axis=1).astype(np.uint16))
        names = np.zeros(len(pairs), np.uint16)
        names[used] = (BASE + n_rules + np.arange(len(used))).astype(np.uint16)
        symbols = symbols.copy()
        symbols[at] = names[rule]
        ends = ends - np.searchsorted(at + 1, ends)
        symbols = np.delete(symbols, at + 1)
        n_rules += len(used)
    return symbols, ends, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint16)


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint32(2654435761)) >> np.uint32(32 - _SLOTS)


def expansions(rules: np.ndarray) -> list[np.ndarray]:
    """The token ids that each rule stands for."""
    out: list[np.ndarray] = []
    for a, b in rules.tolist():
        out.append(np.concatenate([out[s - BASE] if s >= BASE else np.array([s], np.uint32) for s in (a, b)]))
    return out


def expand(symbols: np.ndarray, rules: list[np.ndarray]) -> np.ndarray:
    """The token ids of symbols."""
    lengths = np.concatenate([np.ones(BASE, np.int64), np.array([len(r) for r in rules], np.int64)])
    firsts = np.concatenate([np.arange(BASE), BASE + np.cumsum(lengths[BASE:]) - lengths[BASE:]])
    flat = np.concatenate([np.arange(BASE, dtype=np.uint32), *rules])
    size = lengths[symbols]
    begin = np.cumsum(size) - size
    return flat[np.repeat(firsts[symbols] - begin, size) + np.arange(int(size.sum()))]


def to_file(ids: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> bytes:
    """The file of documents `ids`: their tokens in a row, and how many each has."""
    symbols, ends, rules = compress(tokens.astype(np.uint16), np.cumsum(sizes))
    lengths: list[int] = []
    for a, b in rules.tolist():
        lengths.append(sum(lengths[s - BASE] if s >= BASE else 1 for s in (a, b)))
    head = HEAD.pack(b"TRP1", len(ids), len(rules), len(symbols), int(sizes.sum()))
    parts = [ids.astype("<i8"), sizes.astype("<u4"), np.diff(ends, prepend=0).astype("<u4"), rules.astype("<u2"), np.array(lengths, "<u4"), symbols.astype("<u2")]
    return head + b"".join(p.tobytes() for p in parts)


class Shard:
    """A shard file's contents, decoded on demand."""

    def __init__(self, data: bytes):
        magic, docs, rules, symbols, self.n_tokens = HEAD.unpack_from(data)
        if magic != b"TRP1":
            raise ValueError("not a token shard")
        at = HEAD.size
        out = []
        for kind, n in (("<i8", docs), ("<u4", docs), ("<u4", docs), ("<u2", 2 * rules), ("<u4", rules), ("<u2", symbols)):
            out.append(np.frombuffer(data, kind, n, at))
            at += out[-1].nbytes
        self.ids, self.tokens, self.spans, flat, self.lengths, self.symbols = out
        self.rules = flat.reshape(-1, 2)
        self.ends = np.cumsum(self.spans, dtype=np.int64)
        self._rules: list[np.ndarray] | None = None

    def document(self, i: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Token ids start to stop of document i; only symbols that reach into that range are expanded."""
        own = self.symbols[self.ends[i] - self.spans[i] : self.ends[i]]
        sizes = np.where(own < BASE, 1, self.lengths[np.maximum(own.astype(np.int64) - BASE, 0)] if len(self.lengths) else 1)
        after = np.cumsum(sizes)
        stop = int(self.tokens[i]) if stop is None else min(stop, int(self.tokens[i]))
        lo, hi = int(np.searchsorted(after, start, side="right")), int(np.searchsorted(after, stop, side="left")) + 1
        begin = int(after[lo] - sizes[lo]) if lo < len(own) else start
        out: list[int] = []
        stack = own[lo:hi][::-1].tolist()
        while stack:
            s = stack.pop()
            if s < BASE:
                out.append(s)
            else:
                stack.extend(self.rules[s - BASE][::-1].tolist())
        return np.array(out[start - begin : max(start, stop) - begin], np.uint32)

    def all(self) -> np.ndarray:
        if self._rules is None:
            self._rules = expansions(self.rules)
        return expand(self.symbols, self._rules)


def _write(folder: str, shard: int, data: bytes) -> None:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    unready = f"{path}/.{shard:08d}-{uuid.uuid4().hex}"
    with system.open_output_stream(unready) as f:
        f.write(data)
    system.move(unready, f"{path}/shard-{shard:08d}.trp")


def prefix_sums(table: DataFrame, key: str, value: str, out: str, width: int = 4096) -> DataFrame:
    """table with `out`: the sum of `value` over the rows of a smaller `key` (a number from 0, without repeats); sums go by groups of `width` keys."""
    grouped = table.withColumn("_g", F.floor(F.col(key) / width))
    sums = grouped.groupBy("_g").agg(F.sum(value).alias("_s"))
    upto = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)  # one row for every `width` keys
    inside = Window.partitionBy("_g").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_g", F.coalesce(F.sum("_s").over(upto), F.lit(0)).alias("_b"))
    return grouped.join(before, "_g").withColumn(out, (F.col("_b") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long")).drop("_g", "_b")


def write_shards(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end: int = 0, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode docs and write shard files in ascending id order to `folder` (a URI); a table (shard, n_docs, n_tokens, n_bytes) of them."""
    spark = docs.sparkSession
    ship(spark)
    key: Column = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(key.alias("id"), text.alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = partitions_for(size, shard_bytes)
    bounds = range_bounds(own, "id", parts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Cached.of(tokenizer, BYTE, PIECES)
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        tokens: list[np.ndarray] = []
        shard = None
        for batch in batches:
            if batch.num_rows:
                shard = batch.column(0)[0].as_py()
            ids.append(batch.column(1).to_numpy())
            for lo, hi in in_ranges(batch.column(2), RANGE_BYTES):
                own, each = tool.encode(batch.column(2).slice(lo, hi - lo))
                if len(own) and int(own.max()) >= BASE:
                    raise ValueError(f"a token id of {int(own.max())}: files hold ids below {BASE}")
                tokens.append(np.insert(own.astype(np.uint16), np.cumsum(each), end))
                sizes.append(each + 1)
        if shard is not None:
            data = to_file(np.concatenate(ids), np.concatenate(tokens), np.concatenate(sizes))
            _write(folder, shard, data)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_docs": [sum(map(len, ids))], "n_tokens": [sum(map(len, tokens))], "n_bytes": [len(data)]})

    placed = own.withColumn("shard", range_bucket(F.col("id"), bounds).cast("int"))
    ordered = placed.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("id", F.crc32(F.col("text").cast("binary")))
    return written(ordered.select("shard", "id", "text").mapInArrow(encode, "shard int, n_docs long, n_tokens long, n_bytes long"), "shards")


def read_shards(spark, folder: str) -> DataFrame:
    """(shard, doc_id, local_start, n_tokens, ids_crc32) of every document in the shard files of `folder`, decoded."""
    ship(spark)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(bytes(data.as_buffer()))
                tokens = shard.all().astype("<u4")
                ends = np.cumsum(shard.tokens, dtype=np.int64)
                starts = ends - shard.tokens
                crc = [zlib.crc32(tokens[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                ids = pa.array(shard.ids, mask=shard.ids == NO_ID)
                number = np.full(len(ends), int(path.rpartition("shard-")[2].split(".")[0]), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(number), ids, pa.array(starts), pa.array(shard.tokens.astype(np.int64)), pa.array(crc, pa.int64())], names=["shard", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.trp").load(folder).select("path", "content")
    return files.mapInArrow(decode, "shard int, doc_id long, local_start long, n_tokens long, ids_crc32 long")


def op7_token_ids(docs: DataFrame, tokenizer: str) -> DataFrame:
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    shards = write_shards(docs, tokenizer, folder)
    if shards.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    offsets = prefix_sums(shards.select("shard", F.col("n_tokens").alias("size")), "shard", "size", "before").select("shard", "before")
    return read_shards(spark, folder).join(offsets, "shard").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
