"""Benchmark decontamination with a positional inverted index.

The index is split by document into blocks, each built and searched by one task. For every token of a block it stores
the ascending list of its places; places run on over the block's documents, and a table of the block holds where
each document begins. A window of test words is looked up from its rarest term: that term's places, moved back by
the term's offset, are intersected with the other terms' moved lists, rarest first.

Test items are taken in chunks of at most `MAX_WINDOWS` windows, so that what is broadcast has a fixed bound; every
chunk is matched against the whole index.

Nulls: a null text has no words; a null id is kept. Items without words match nothing. Repeated rows are documents
of their own. Empty tables give empty results (or documents without hits). Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ship, tidy, written

WINDOW = 8
BLOCK_BYTES = 6 << 20  # text of a block of the index
MAX_WINDOWS = 50_000  # of test items matched at once
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
HITS = "block long, doc int, items array<long>, span_starts array<int>, span_ends array<int>"
INDEX = "block long, term binary, n int, width int, places binary, ids array<long>, n_words array<int>"


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of letters, digits and all characters from U+0080."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _pack(places: np.ndarray) -> tuple[int, bytes]:
    """Ascending places as differences of 1, 2 or 4 bytes."""
    gaps = np.diff(places, prepend=0)
    width = 1 if gaps.max() < 256 else 2 if gaps.max() < 65536 else 4
    return width, gaps.astype(f"<u{width}").tobytes()


def _unpack(width: int, data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, f"<u{width}"), dtype=np.int64)


def _block(number: int, ids: list, texts: list[bytes]) -> pa.RecordBatch:
    """The index rows of one block: a row of its documents, and one for each term."""
    joined = np.frombuffer(b"\n".join(texts).translate(_FOLD), np.uint8)
    word = np.concatenate([[False], joined != 32, [False]])
    turn = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = turn[::2], turn[1::2]
    edges = np.cumsum([len(t) + 1 for t in texts])  # the separator of documents is not a word character
    n_words = np.diff(np.searchsorted(starts, edges), prepend=0).astype(np.int32)
    head = pa.array([None], pa.binary())
    columns = [head, [len(ids)], [0], head]
    if len(starts):
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        data = joined[word[1:-1]]
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        codes = coded.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        counts = np.bincount(codes, minlength=len(coded.dictionary))
        cut = np.concatenate([[0], np.cumsum(counts)])
        gaps = np.diff(order, prepend=0)
        gaps[cut[:-1]] = order[cut[:-1]]
        most = np.maximum.reduceat(gaps, cut[:-1])
        width = np.where(most < 256, 1, np.where(most < 65536, 2, 4))
        each = np.repeat(width, counts)
        at = np.cumsum(each) - each
        blob = np.zeros(int(each.sum()), np.uint8)
        for b in range(4):
            has = each > b
            blob[at[has] + b] = (gaps[has] >> (8 * b)) & 255
        bounds = np.concatenate([[0], np.cumsum(width * counts)]).astype(np.int32)
        blobs = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(bounds), pa.py_buffer(blob)])
        columns = [pa.concat_arrays([head, coded.dictionary]), np.concatenate([[len(ids)], counts]), np.concatenate([[0], width]), pa.concat_arrays([head, blobs])]
    rows = len(columns[0])
    lists = [pa.array([ids] + [None] * (rows - 1), pa.list_(pa.int64())), pa.array([n_words] + [None] * (rows - 1), pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(rows, number)), columns[0], pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), columns[3], *lists],
        names=["block", "term", "n", "width", "places", "ids", "n_words"],
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    ids: list = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for i, t in zip(batch.column(0), batch.column(1), strict=True):
            data = (t.as_py() or "").encode("utf-8", "surrogatepass")
            if texts and size + len(data) > BLOCK_BYTES:
                yield _block(number, ids, texts)
                number, ids, texts, size = number + 1, [], [], 0
            ids.append(i.as_py())
            texts.append(data)
            size += len(data) + 1
    if texts:
        yield _block(number, ids, texts)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index of docs, written to the shared folder.

    A row with a term: its `n` places in the block as differences of `width` bytes. A row without: the block's
    documents, their ids and numbers of words in order.
    """
    ship(docs.sparkSession)
    return written(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(tidy(_blocks), INDEX), "index")


def windows(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """Every run of `size` words; fewer words, but not none, are one window."""
    if len(words) <= size:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


def exact_places(lists: list[np.ndarray]) -> np.ndarray:
    """Where a phrase begins, from the places of each of its terms in order: moved lists, intersected rarest first."""
    order = sorted(range(len(lists)), key=lambda j: len(lists[j]))
    found = lists[order[0]] - order[0]
    for j in order[1:]:
        if not len(found):
            break
        at = np.searchsorted(lists[j], found + j)
        at[at == len(lists[j])] = 0
        found = found[lists[j][at] == found + j]
    return found


def near_places(lists: list[np.ndarray], span: int) -> list[tuple[int, int]]:
    """(begin, end) of the shortest stretches of at most `span` words around each place of the rarest term that hold every term, in any order.

    Terms are distinct. A stretch begins at one term's place and ends past another's.
    """
    out = set()
    rarest = min(range(len(lists)), key=lambda j: len(lists[j]))
    for p in lists[rarest].tolist():
        near = [x[np.searchsorted(x, p - span + 1) : np.searchsorted(x, p + span)].tolist() for x in lists]
        if not all(near):
            continue
        best = None
        for lo in sorted({q for x in near for q in x if q <= p}, reverse=True):
            nexts = [next((q for q in x if q >= lo), None) for x in near]
            if all(q is not None for q in nexts):
                hi = max(*nexts, p) + 1
                if hi - lo <= span and (best is None or hi - lo < best[1] - best[0]):
                    best = (lo, hi)
        if best:
            out.add(best)
    return sorted(out)


def _search(frame: pd.DataFrame, wanted: list[tuple[tuple[bytes, ...], list[int]]], slop: int) -> pd.DataFrame:
    """Hits of one block: block, place of the document in it, its items, merged spans of hit words."""
    empty = pd.DataFrame(columns=["block", "doc", "items", "span_starts", "span_ends"], dtype=object)
    head = frame[frame["term"].isna()]
    if head.empty:
        return empty
    block = int(head["block"].iloc[0])
    ends = np.cumsum(np.asarray(head["n_words"].iloc[0], np.int64))
    terms = frame[frame["term"].notna()]
    packed = dict(zip(map(bytes, terms["term"]), zip(terms["width"], terms["places"], strict=True), strict=True))
    opened: dict[bytes, np.ndarray] = {}

    def places(term: bytes) -> np.ndarray:
        if term not in opened:
            opened[term] = _unpack(*packed[term])
        return opened[term]

    found: dict[int, tuple[set, list]] = {}
    for words, items in wanted:
        if not all(w in packed for w in words):
            continue
        if slop:
            spans = near_places([places(w) for w in dict.fromkeys(words)], len(words) + slop)
        else:
            begin = exact_places([places(w) for w in words])
            spans = [(b, b + len(words)) for b in begin.tolist()]
        for b, e in spans:
            doc = int(np.searchsorted(ends, b, side="right"))
            if e <= ends[doc]:  # no match crosses documents
                own = found.setdefault(doc, (set(), []))
                own[0].update(items)
                first = int(ends[doc - 1]) if doc else 0
                own[1].append((b - first, e - first))
    rows = []
    for doc, (items, spans) in sorted(found.items()):
        merged: list[list[int]] = []
        for b, e in sorted(set(spans)):
            if merged and b <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([b, e])
        rows.append((block, doc, sorted(items), [m[0] for m in merged], [m[1] for m in merged]))
    return pd.DataFrame(rows, columns=empty.columns) if rows else empty


def _searcher(held, slop: int):
    def search(frame: pd.DataFrame) -> pd.DataFrame:
        return _search(frame, held.value, slop)

    return search


def _chunks(items: DataFrame, item_col: str, text_col: str, size: int) -> Iterator[dict[tuple[bytes, ...], list[int]]]:
    wanted: dict[tuple[bytes, ...], list[int]] = {}
    for row in items.select(item_col, text_col).where(F.col(item_col).isNotNull()).toLocalIterator():
        for w in windows(tokens(row[1]), size):
            wanted.setdefault(w, []).append(row[0])
        if len(wanted) >= MAX_WINDOWS:
            yield wanted
            wanted = {}
    if wanted:
        yield wanted


def search_index(index: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", size: int = WINDOW, slop: int = 0) -> DataFrame:
    """(block, doc, items, span_starts, span_ends) for each document of the index with a match.

    slop 0: exact phrases of `size` words. slop > 0: proximity, every word of a window within `size` + slop words in
    any order. `doc` is the place in the block; spans count words of the document, merged and ascending. One row per
    document and chunk of items. Items with a null id are ignored.
    """
    spark = index.sparkSession
    ship(spark)
    parts = []
    for chunk in _chunks(items, item_col, text_col, size):
        wanted = [(w, sorted(set(i))) for w, i in chunk.items()]
        terms = spark.createDataFrame([(bytearray(t),) for t in {t for w, _ in wanted for t in w}], "term binary")
        held = spark.sparkContext.broadcast(wanted)
        kept = index.where("term is not null").join(F.broadcast(terms), "term", "left_semi").select(index.columns)
        rows = kept.unionByName(index.where("term is null")).select("block", "term", "width", "places", "n_words")
        parts.append(rows.groupBy("block").applyInPandas(_searcher(held, slop), HITS))
    if not parts:
        return spark.createDataFrame([], HITS)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW, slop: int = 0) -> DataFrame:
    """One row per document: id, n_words, n_hit (words inside any match), items (ids of the items that match)."""
    index = build_index(docs, id_col, text_col)
    hits = search_index(index, items, item_col, item_text, size, slop)
    words = F.flatten(F.collect_list(F.flatten(F.transform(F.arrays_zip("span_starts", "span_ends"), lambda s: F.sequence(s["span_starts"], s["span_ends"] - 1)))))
    per = hits.groupBy("block", "doc").agg(F.size(F.array_distinct(words)).cast("long").alias("n_hit"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    own = index.where("term is null").select("block", F.posexplode(F.arrays_zip("ids", "n_words")).alias("doc", "own")).select("block", "doc", F.col("own.ids").alias("id"), F.col("own.n_words").cast("long").alias("n_words"))
    none = F.array().cast("array<long>")
    return own.join(per, ["block", "doc"], "left").select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"))


def op8_decontamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return contamination(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated")
    )


ORACLE = r"""
WITH d AS (SELECT rowid AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM (SELECT row_number() OVER () AS rowid, * FROM documents)),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[i : i + least(len(w), 8) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 7, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
