"""Removal of repeated passages with a sparse suffix array, sorted deep-shallow.

A byte goes if it lies in a LENGTH-byte string that also starts anywhere else, in any document. Only suffixes that
start at anchors are sorted. An anchor is the leftmost least hash of the GRAM-byte strings inside some LENGTH-byte
string of a document, so equal strings have their anchors at equal places, and an anchor whose hash is unique in the
corpus rules out every string it stands for. Around an anchor lie at most REACH bytes to its left and LENGTH bytes
from it on: its context.

1. Each task finds the anchors of its documents, with hashes of their grams and contexts. Of equal contexts in a task
   only one goes on, and all of them are known to be repeats (this also evens out grams that most documents share).
2. One shuffle brings a gram's contexts together, in order; they are read as a stream, so that a gram of any size
   needs no memory. Equal contexts are repeats as a whole and need no sorting. Grams of one context end here.
3. Other grams have different contexts. One context of each kind is taken from the texts, and the contexts of a gram
   are suffix-sorted twice, to the right and, reversed, to the left: multikey quicksort by eight-byte symbols to a
   shallow depth, then blind tries for the groups that still agree. Common-prefix classes of both orders give, for
   each offset, which strings are equal, byte by byte, without comparing pairs.
4. A gram with more than MAX_CONTEXTS different contexts isn't sorted in one task. Its contexts are grouped by longer
   strings around the gram first; a group that is still too large has its strings counted by their SHA-256 in
   a distributed aggregation instead. That is as complete, for any size.

Nulls: a null text is empty; a null id is kept. Repeated rows repeat each other's strings. Texts under LENGTH bytes
stay as they are. Texts are read whole. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import NO_ID, give_back, ship, tidy, written

LENGTH, GRAM = 200, 50
REACH = LENGTH - GRAM  # how far before an anchor a string that it stands for may start
HALF = REACH // 2
SHALLOW = 64
MAX_CONTEXTS = 1 << 15  # of a gram in one task: some 60 MB
SLOTS = 1 << 20
STRIDE = 1 << 17  # windows hashed at once
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    if not _POWERS:
        n = STRIDE + 2 * LENGTH + REACH
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(n + 1, b, np.uint64)
            steps[0] = 1
            _POWERS.append(np.cumprod(steps, dtype=np.uint64))
    return _POWERS[0], _POWERS[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents one after the other that end at `ends`: places of anchors, hashes of their grams and of their contexts."""
    power, inverse = _powers()
    n = len(data)
    starts = np.concatenate([[0], ends[:-1]])
    found = []
    for lo in range(0, max(0, n - LENGTH + 1), STRIDE):
        base, hi = max(0, lo - REACH), min(n - LENGTH + 1, lo + STRIDE)
        piece = data[base : min(n, hi + 2 * LENGTH)]
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_TABLE[piece] * power[: len(piece)], out=total[1:])
        first = lo - base
        grams = _mix((total[first + GRAM : hi - base + LENGTH] - total[first : hi - base + REACH]) * inverse[first : hi - base + REACH])
        keys = (grams & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(len(grams), dtype=np.uint64)  # ties go to the left
        width, least = 1, keys
        while 2 * width <= REACH + 1:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = REACH + 1 - width
        if rest:
            least = np.minimum(least[:-rest], least[rest:])
        least = least[: hi - lo]
        new = np.concatenate([[True], least[1:] != least[:-1]])
        # a document's strings must not cross its end
        doc = np.searchsorted(ends, lo, side="right")
        valid = np.zeros(hi - lo, bool)
        while doc < len(ends) and starts[doc] < hi:
            valid[max(starts[doc], lo) - lo : max(0, min(ends[doc] - LENGTH + 1, hi) - lo)] = True
            doc += 1
        new[1:] |= valid[1:] & ~valid[:-1]
        at = np.unique((least[new & valid] & np.uint64(0xFFFFF)).astype(np.int64))
        if not len(at):
            continue
        of = np.searchsorted(ends, lo + at, side="right")
        left, right = np.minimum(REACH, lo + at - starts[of]), np.minimum(LENGTH, ends[of] - lo - at)
        a = first + at
        context = _mix((total[a + right] - total[a - left]) * inverse[a - left] + (left * 1024 + right).astype(np.uint64))
        found.append((lo + at, grams[at], context))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    where, gram, context = (np.concatenate(x) for x in zip(*found, strict=True))
    where, one = np.unique(where, return_index=True)
    return where, gram[one], context[one]


ANCHOR, SPAN, ONE = 0, 1, 2  # kinds of rows: an anchor; a stretch of repeated bytes (pos to right); one context of a gram that has several
ROWS = "kind int, gram long, context long, id long, th long, pos int, right int, many boolean"
_NAMES = [c.split()[0] for c in ROWS.split(", ")]


def _combined(gram, context, ids, th, pos, right) -> pa.RecordBatch:
    """Rows of a task's anchors: one for each different context, and the merged stretches of those that occur again."""
    order = np.lexsort((context, gram))
    g, c = gram[order], context[order]
    first = np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])])
    group = np.cumsum(first) - 1
    size = np.bincount(group)
    again = np.sort(order[size[group] > 1])  # in the order of documents and places
    begin, end = pos[again] - np.minimum(pos[again], REACH), pos[again] + right[again]
    new = np.ones(len(again), bool)
    new[1:] = (ids[again][1:] != ids[again][:-1]) | (th[again][1:] != th[again][:-1]) | (begin[1:] > end[:-1]) | (begin[1:] < begin[:-1])
    start = np.flatnonzero(new)
    last = np.append(start[1:], len(again)) - 1 if len(again) else start
    lead, span = order[first], again[start]
    n, m = len(lead), len(span)
    both = lambda a, b: np.concatenate([a, b])
    spread = _mix(ids[span].astype(np.uint64) + begin[start].astype(np.uint64)).view(np.int64)  # stretches go anywhere
    columns = [
        np.repeat(np.array([ANCHOR, SPAN], np.int32), [n, m]), both(gram[lead].view(np.int64), spread), both(context[lead].view(np.int64), np.zeros(m, np.int64)), both(ids[lead], ids[span]),
        both(th[lead], th[span]), both(pos[lead], begin[start]).astype(np.int32), both(right[lead], end[last]).astype(np.int32), both(size > 1, np.ones(m, bool)),
    ]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=_NAMES)


def _anchor_rows(batches: Iterator[pa.RecordBatch], block: int = 4 << 20, most: int = 400_000) -> Iterator[pa.RecordBatch]:
    def found(ids: list, ths: list, texts: list[bytes]) -> tuple:
        ends = np.cumsum([len(t) for t in texts])
        where, gram, context = anchors(np.frombuffer(b"".join(texts), np.uint8), ends)
        of = np.searchsorted(ends, where, side="right")
        starts = np.concatenate([[0], ends[:-1]])
        return gram, context, np.array(ids, np.int64)[of], np.array(ths, np.int64)[of], where - starts[of], np.minimum(LENGTH, ends[of] - where)

    held: list[tuple] = []
    ids, ths, texts, size = [], [], [], 0
    for batch in batches:
        for i, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            data = t.as_buffer()
            if len(data) < LENGTH:
                continue
            ids.append(i)
            ths.append(h)
            texts.append(bytes(data))
            size += len(data)
            if size >= block:
                held.append(found(ids, ths, texts))
                ids, ths, texts, size = [], [], [], 0
                if sum(len(x[0]) for x in held) >= most:
                    yield _combined(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held = []
    if texts:
        held.append(found(ids, ths, texts))
    if sum(len(x[0]) for x in held):
        yield _combined(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _classified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors in order of gram and context -> stretches that are repeats, and one row for each context of a gram with several.

    Works batch by batch and holds one row back; of the running gram only its first context is remembered.
    """
    tail = lead = None  # the last row, not yet judged; the first context of the running gram, while it is the only one
    gram, context, inside = None, None, False  # of the last row judged; whether its gram has several contexts

    def judge(t: pa.Table, end: bool) -> Iterator[pa.Table]:
        nonlocal tail, lead, gram, context, inside
        n = t.num_rows - (not end)
        tail = None if end else t.slice(n)
        if n <= 0:
            return
        g, c = t.column("gram").to_numpy(), t.column("context").to_numpy()
        same_gram = np.concatenate([[gram is not None and g[0] == gram], g[1:] == g[:-1]])
        same = same_gram & np.concatenate([[context is not None and c[0] == context], c[1:] == c[:-1]])
        after = np.append(same[1:], False)
        many = t.column("many").to_numpy(zero_copy_only=False)
        g, c, same_gram, same, after, many = (x[:n] for x in (g, c, same_gram, same, after, many))
        repeat = np.flatnonzero((same | after) & ~many)
        if len(repeat):
            rows = t.take(pa.array(repeat))
            pos, right = rows.column("pos").to_numpy(), rows.column("right").to_numpy()
            rows = rows.set_column(0, "kind", pa.array(np.full(len(repeat), SPAN, np.int32)))
            rows = rows.set_column(5, "pos", pa.array((pos - np.minimum(pos, REACH)).astype(np.int32)))
            yield rows.set_column(6, "right", pa.array((pos + right).astype(np.int32)))
        starts = np.flatnonzero(~same)
        run = np.cumsum(~same_gram)  # 0: the gram that was running before
        contexts = np.bincount(run[starts], minlength=run[-1] + 1)
        if contexts[0] and not inside and lead is not None and same_gram[0]:
            yield lead.set_column(0, "kind", pa.array([ONE], pa.int32()))
            lead, inside = None, True
        several = contexts > 1
        several[0] = inside or contexts[0] > 0 if same_gram[0] else False
        out = starts[several[run[starts]]]
        if len(out):
            yield t.take(pa.array(out)).set_column(0, "kind", pa.array(np.full(len(out), ONE, np.int32)))
        if run[-1]:  # another gram runs now
            inside = bool(several[-1])
            lead = None if inside else t.slice(int(starts[run[starts] == run[-1]][0]), 1)
        gram, context = g[-1], c[-1]

    for batch in batches:
        if not batch.num_rows:
            continue
        kind = batch.column(0).to_numpy()
        passed = np.flatnonzero(kind == SPAN)
        if len(passed):
            yield batch.take(pa.array(passed))
            batch = batch.take(pa.array(np.flatnonzero(kind == ANCHOR)))
        if batch.num_rows:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([tail, t]).combine_chunks() if tail is not None else t
            for out in judge(t, False):
                yield from out.combine_chunks().to_batches()
    if tail is not None:
        for out in judge(tail, True):
            yield from out.combine_chunks().to_batches()


def blind_trie(strings: list[bytes]) -> list[int]:
    """The order of strings. Nodes keep only a depth and the bytes that branch there; the strings are compared once."""
    root: list = [0, {}]  # depth, children by byte (-1: the string ends): nodes, or lists of the numbers of equal strings
    for n, s in enumerate(strings):
        node, path = root, []
        while True:  # blindly down: skipped bytes aren't looked at
            path.append(node)
            kids = node[1]
            nxt = kids.get(s[node[0]] if node[0] < len(s) else -1)
            if nxt is None:
                nxt = next(iter(kids.values()), None)
            if nxt is None or isinstance(nxt[0], str):
                break
            node = nxt
        if nxt is None:
            root[1][s[0] if s else -1] = ["leaf", [n]]
            continue
        other = strings[nxt[1][0]]
        lcp = common_prefix(s, other)
        if lcp == len(s) == len(other):
            nxt[1].append(n)
            continue
        while path[-1][0] > lcp:
            path.pop()
        node = path[-1]
        mine, theirs = s[lcp] if lcp < len(s) else -1, other[lcp] if lcp < len(other) else -1
        if node[0] == lcp:
            node[1][mine] = ["leaf", [n]]
        else:
            edge = s[node[0]] if node[0] < len(s) else -1
            node[1][edge] = [lcp, {theirs: node[1][edge], mine: ["leaf", [n]]}]
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node[0], str):
            out.extend(node[1])
        else:
            stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
    return out


def common_prefix(a: bytes, b: bytes) -> int:
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def deep_shallow(grid: np.ndarray, lengths: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort zero-padded strings inside ascending groups: their order, and the common prefix of each with the one before (-1: first of its group).

    Multikey quicksort down to SHALLOW bytes, by symbols of eight bytes and over all groups at once; then a blind
    trie for each group of strings that agree so far.
    """
    n, wide = grid.shape
    order, cls = np.arange(n), group.astype(np.int64)
    for d in range(0, min(SHALLOW, wide), 8):
        symbol = np.zeros((n, 8), np.uint8)
        part = grid[:, d : d + 8]
        symbol[:, : part.shape[1]] = part
        key = symbol.view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((key, cls))
        c, k = cls[order], key[order]
        new = np.concatenate([[0], np.cumsum((c[1:] != c[:-1]) | (k[1:] != k[:-1]))])
        cls = np.empty(n, np.int64)
        cls[order] = new
    order = np.lexsort((np.arange(n), cls))
    sizes = np.bincount(cls) if n else np.zeros(0, int)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    for g in np.flatnonzero(sizes > 1):
        own = order[begins[g] : begins[g + 1]]
        order[begins[g] : begins[g + 1]] = own[blind_trie([grid[i, : lengths[i]].tobytes() for i in own])]
    lcp = np.full(n, -1, np.int64)
    if n > 1:
        a, b = order[1:], order[:-1]
        same = np.concatenate([grid[a] == grid[b], np.zeros((n - 1, 1), bool)], axis=1)
        shared = np.minimum(same.argmin(axis=1), np.minimum(lengths[a], lengths[b]))
        lcp[1:] = np.where(group[a] == group[b], shared, -1)
    return order, lcp


def repeated_offsets(contexts: list[bytes], left: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each context, the least and greatest offset r (0 to REACH) whose string, from r bytes before the anchor, occurs in another context of its group; (REACH + 1, -1) without any."""
    n = len(contexts)
    right = np.array([len(c) for c in contexts], np.int64) - left
    grid, back = np.zeros((n, LENGTH), np.uint8), np.zeros((n, REACH), np.uint8)
    for i, c in enumerate(contexts):
        raw = np.frombuffer(c, np.uint8)
        grid[i, : right[i]] = raw[left[i] :]
        back[i, : left[i]] = raw[: left[i]][::-1]
    r_order, r_lcp = deep_shallow(grid, right, group)
    l_order, l_lcp = deep_shallow(back, left, group)
    least, most = np.full(n, REACH + 1, np.int64), np.full(n, -1, np.int64)
    rc, lc = np.empty(n, np.int64), np.empty(n, np.int64)
    for r in range(REACH + 1):
        own = np.flatnonzero((left >= r) & (right >= LENGTH - r))
        if len(own) < 2:
            continue
        rc[r_order] = np.cumsum(r_lcp < LENGTH - r)
        lc[l_order] = np.cumsum(l_lcp < r)
        _, back_to, times = np.unique(rc[own] * (n + 1) + lc[own], return_inverse=True, return_counts=True)
        again = own[times[back_to] > 1]
        least[again] = np.minimum(least[again], r)
        most[again] = r
    return least, most


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"gram": [], "context": [], "id": [], "th": [], "pos": []}
        for i, h, t, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
            data = bytes(t.as_buffer())
            for w in wanted:
                p = w["pos"]
                out["gram"].append(w["gram"])
                out["context"].append(data[max(0, p - REACH) : p + LENGTH])
                out["id"].append(i)
                out["th"].append(h)
                out["pos"].append(p)
        yield pa.RecordBatch.from_arrays([pa.array(out["gram"], pa.int64()), pa.array(out["context"], pa.binary()), pa.array(out["id"], pa.int64()), pa.array(out["th"], pa.int64()), pa.array(out["pos"], pa.int32())], names=list(out))


CONTEXTS = "gram long, context binary, id long, th long, pos int"
SPANS = "id long, th long, begin int, end int"


def _sorted_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of repeated bytes; rows come in order of gram, and a gram may go on in the next batch."""

    def spans(t: pa.Table) -> pa.RecordBatch:
        gram = t.column("gram").to_numpy()
        pos = t.column("pos").to_numpy().astype(np.int64)
        group = np.concatenate([[0], np.cumsum(gram[1:] != gram[:-1])])
        least, most = repeated_offsets(t.column("context").to_pylist(), np.minimum(REACH, pos), group)
        hit = most >= 0
        return pa.RecordBatch.from_arrays(
            [pa.array(t.column("id").to_numpy()[hit]), pa.array(t.column("th").to_numpy()[hit]), pa.array((pos - most)[hit].astype(np.int32)), pa.array((pos - least)[hit].astype(np.int32) + np.int32(LENGTH))],
            names=["id", "th", "begin", "end"],
        )

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held).combine_chunks()
        gram = t.column("gram").to_numpy()
        cut = int(np.searchsorted(gram, gram[-1])) if len(gram) else 0
        if cut:
            yield spans(t.slice(0, cut))
        held = t.slice(cut).combine_chunks().to_batches()
    if held:
        yield spans(pa.Table.from_batches(held).combine_chunks())


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (null: NO_ID), crc of the text, the text's bytes (null: none)."""
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.crc32(data).alias("th"), data.alias("data"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, begin, end): stretches of bytes to remove, overlapping and in no order; th is the crc32 of the text."""
    ship(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col)
    found = written(keyed.mapInArrow(tidy(_anchor_rows), ROWS).repartition("gram").sortWithinPartitions("gram", "context").mapInArrow(tidy(_classified), ROWS), "repeats")
    spans = found.where(F.col("kind") == SPAN).select("id", "th", F.col("pos").alias("begin"), F.col("right").alias("end"))
    ones = found.where(F.col("kind") == ONE).select("gram", "id", "th", "pos")
    # texts without such a context needn't move: a semi-join with at most SLOTS hashes lets few of them through
    slot = F.pmod(F.xxhash64("id", "th"), F.lit(SLOTS)).alias("slot")
    likely = keyed.withColumn("slot", slot).join(F.broadcast(ones.select(slot).distinct()), "slot", "left_semi").drop("slot")
    contexts = written(_contexts(likely, ones), "contexts")
    crowded = contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MAX_CONTEXTS).select("gram")
    if not crowded.isEmpty():
        crowded = written(crowded, "crowded")
        finer, rest = _refined(contexts.join(crowded, "gram", "left_semi"))
        spans = spans.union(_sorted(finer))
        if rest is not None:
            spans = spans.union(_counted_spans(rest))
        contexts = contexts.join(crowded, "gram", "left_anti")
    return spans.union(_sorted(contexts))


def _sorted(contexts: DataFrame) -> DataFrame:
    return contexts.select(*[c.split()[0] for c in CONTEXTS.split(", ")]).repartition("gram").sortWithinPartitions("gram").mapInArrow(tidy(_sorted_spans), SPANS)


def _refined(contexts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Contexts of a crowded gram, in smaller groups: by the HALF bytes before the gram too, and by those after it.

    A string that the anchor stands for reaches at least HALF bytes to one side of the gram, so the strings that are equal
    have all of one side's bytes in common. Groups of one are dropped. Those that are still too large come second.
    """
    left = F.least("pos", F.lit(REACH))
    before = F.when(left >= HALF, F.struct(F.lit(0).alias("side"), F.substring(F.col("context"), left - HALF + 1, F.lit(HALF + GRAM)).alias("part")))
    after = F.when(F.octet_length("context") - left >= HALF + GRAM, F.struct(F.lit(1).alias("side"), F.substring(F.col("context"), left + 1, F.lit(HALF + GRAM)).alias("part")))
    split = contexts.select("gram", "context", "id", "th", "pos", F.explode(F.array_compact(F.array(before, after))).alias("p"))
    names = [c.split()[0] for c in CONTEXTS.split(", ")]
    split = split.withColumn("gram", F.xxhash64("gram", "p.side", "p.part")).select(*names)
    sizes = split.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    finer = split.join(sizes, "gram")
    large = sizes.where(F.col("n") > MAX_CONTEXTS).isEmpty()
    return finer.where(F.col("n") <= MAX_CONTEXTS).select(*names), None if large else finer.where(F.col("n") > MAX_CONTEXTS).select(*names)


def _contexts(keyed: DataFrame, ones: DataFrame) -> DataFrame:
    """The bytes of contexts, from the texts."""
    wanted = ones.groupBy("id", "th").agg(F.collect_list(F.struct("gram", "pos")).alias("wanted"))
    return keyed.join(wanted.hint("shuffle_hash"), ["id", "th"]).select("id", "th", "data", "wanted").mapInArrow(tidy(_context_rows), CONTEXTS)


def _counted_spans(contexts: DataFrame) -> DataFrame:
    """The same as sorting gives, for grams with too many contexts for one task.

    Strings are counted by their SHA-256 and the place of the anchor in them (a gram may occur twice in one string).
    """
    left = F.least("pos", F.lit(REACH))
    strings = contexts.select("gram", "id", "th", "pos", left.alias("left"), "context", F.explode(F.sequence(F.lit(0), F.octet_length("context") - LENGTH)).alias("o"))
    keyed = strings.select("gram", "id", "th", (F.col("pos") - F.col("left") + F.col("o")).alias("begin"), (F.col("left") - F.col("o")).alias("r"), F.sha2(F.substring(F.col("context"), F.col("o") + 1, F.lit(LENGTH)), 256).alias("string"))
    often = keyed.groupBy("gram", "r", "string").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram", "r", "string")
    return keyed.join(often, ["gram", "r", "string"], "left_semi").select("id", "th", "begin", (F.col("begin") + LENGTH).alias("end"))


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans, ascending."""
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((b, e))
    return out


def kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    if not spans:
        return data
    at, parts = 0, []
    for b, e in spans:
        parts.append(data[at:b])
        at = e
    return b"".join([*parts, data[at:]])


def _with_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spans = repeated_spans(docs, id_col, text_col).groupBy("id", "th").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    return _keyed(docs, id_col, text_col).join(spans.hint("shuffle_hash"), ["id", "th"], "left").select("id", "data", "spans")


def op10_suffix_dedup(docs: DataFrame) -> DataFrame:
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, t, s in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = t.as_buffer()
                runs = merge([(x["begin"], x["end"]) for x in s.as_py() or []])
                out.append((None if i == NO_ID else i, len(data), sum(e - b for b, e in runs), len(runs), hashlib.sha256(kept(bytes(data), runs) if runs else data).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_spans(docs, "doc_id", "text").mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def kept_text(data: Column, spans: Column) -> Column:
    """The text left of a document's bytes once spans are removed; a character that is cut in two goes as a whole."""

    @F.arrow_udf("string")
    def left(texts: pa.Array, removed: pa.Array) -> pa.Array:
        out = []
        for t, s in zip(texts, removed, strict=True):
            data = t.as_py()
            runs = merge([(x["begin"], x["end"]) for x in s.as_py() or []])
            out.append(kept(data, runs).decode("utf-8", "ignore") if runs else data.decode("utf-8", "ignore"))
        left_ = pa.array(out, pa.string())
        del out
        give_back()
        return left_

    return left(data, spans)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with `text_col` cut down to what isn't repeated; every other column and every row stay.

    A null text becomes an empty one. Rows are matched by id and text, so other columns may have any name.
    """
    spans = repeated_spans(docs, id_col, text_col).groupBy("id", "th").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    left = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.crc32(data).alias("th"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = left.join(spans.hint("shuffle_hash"), ["id", "th"], "left")
    text = kept_text(F.coalesce(F.col("row").getField(text_col), F.lit("")).cast("binary"), F.col("spans"))
    return joined.withColumn("_left", text).select(*[F.col("_left").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
