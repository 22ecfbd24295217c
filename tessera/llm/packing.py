"""Best-fit packing of token sequences by bin completion with branch and bound.

Only lengths matter for packing, and there are at most `capacity` of them, so the driver sees a table of lengths and
counts, however many documents there are. A step of the search completes a bin around the largest length left and applies the
completion as often as the counts allow, so there are few kinds of bins. The best-fit completion (least waste, larger items first)
is tried first; so the first packing is the first incumbent. If it doesn't meet the lower bound (the Martello-Toth bound L2 of the lengths),
the search goes back to where waste arose: every step has its undominated fillings as branches, a branch ends when its waste, or the bound
of what is left, can't beat the incumbent. It ends at the lower bound, when no branch is left, or after SEARCH more bins
(the fillings of a bin are listed by a walk of WALK steps); `bound` tells
how far from the lower bound the result can be at most.

A filling is dominated if another one's items could take its items' places: an item left over that fits into the free room with a
part of the filling smaller than itself taken out, or that is as large as several items of the filling together.

Nulls: a null text is empty and still has its end token; a null id is kept. Repeated rows are packed each. Empty tables
give no sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import numbered, ship, written
from tessera.llm.tokenizing import WORD, Cached, in_ranges

CAPACITY, END = 4096, 1
NODES = 4000  # of the search for one completion
SEARCH, WALK = 1000, 1000  # bins filled beyond the first packing; steps of the walk that lists a bin's fillings
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def complete(counts: np.ndarray, lengths: list[int], gap: int, nodes: int = NODES) -> list[int]:
    """Lengths (descending, within counts) that fill `gap` with the least waste found; the larger first among equals."""
    left = counts.copy()
    best: list[int] = []
    waste = gap
    budget = nodes
    small = lengths[0] if lengths else gap + 1
    import bisect

    def search(room: int, top: int, taken: list[int]) -> bool:
        """True once nothing is wasted."""
        nonlocal best, waste, budget
        if room < waste:
            best, waste = taken.copy(), room
        if room == 0:
            return True
        if room <= top and left[room] > 0:  # one item that fills the room dominates all other completions
            best, waste = [*taken, room], 0
            return True
        k = bisect.bisect_right(lengths, min(room, top)) - 1
        while k >= 0 and budget > 0:
            size = lengths[k]
            k -= 1
            if left[size] <= 0:
                continue
            for n in range(min(int(left[size]), room // size), 0, -1):
                budget -= 1
                rest = room - n * size
                if 0 < rest < small and rest >= waste:
                    continue  # whatever follows, that much is wasted
                left[size] -= n
                taken += [size] * n
                done = search(rest, size - 1, taken)
                del taken[-n:]
                left[size] += n
                if done:
                    return True
                if budget <= 0:
                    break
        return False

    search(gap, gap, [])
    return best


def lower_bound(left: np.ndarray, capacity: int) -> int:
    """Martello and Toth's L2 for left[x] items of length x: no packing has fewer bins."""
    if not left.any():
        return 0
    size = np.arange(capacity + 1)
    count, weight = np.concatenate([[0], np.cumsum(left)]), np.concatenate([[0], np.cumsum(left * size)])  # of lengths below x
    half = capacity // 2
    k = np.arange(half + 1)  # items below k are left out of account
    huge = count[-1] - count[capacity - k + 1]
    large, large_weight = count[capacity - k + 1] - count[half + 1], weight[capacity - k + 1] - weight[half + 1]
    medium = weight[half + 1] - weight[k]
    return int((huge + large + np.maximum(0, -(-(medium - (large * capacity - large_weight)) // capacity))).max())


def dominated(fill: list[int], slack: int, rest: int) -> bool:
    """Whether a filling with `slack` free room is dominated by one with an item of `rest` (bit x: length x is left over)."""
    every, several = 1, 0  # bits: sums of some items, and of two or more
    for x in fill:
        several |= (several | (every & ~1)) << x
        every |= every << x
    reach, width = every << 1, 1  # sums + 1 to sums + slack
    if slack == 0:
        reach = 0
    while width < slack:
        step = min(width, slack - width)
        reach |= reach << step
        width += step
    return bool((reach | several) & rest)


def fillings(left: np.ndarray, room: int, steps: int = WALK) -> list[list[int]]:
    """Undominated fillings of `room`, least waste first and then larger items first; the walk over them ends after `steps`."""
    lengths = [int(x) for x in np.flatnonzero(left[: room + 1])][::-1]
    counts = {x: int(left[x]) for x in lengths}
    present = sum(1 << x for x in lengths)
    out: list[tuple[int, list[int]]] = []
    budget = steps

    def walk(k: int, room: int, taken: list[int]) -> None:
        nonlocal budget
        if budget <= 0:
            return
        budget -= 1
        grew = False
        for j in range(k, len(lengths)):
            x = lengths[j]
            for n in range(min(counts[x], room // x), 0, -1):
                grew = True
                walk(j + 1, room - n * x, taken + [x] * n)
            if budget <= 0:
                return
        if not grew:
            rest = present
            for x in set(taken):
                if taken.count(x) == counts[x]:
                    rest &= ~(1 << x)
            if not dominated(taken, room, rest):
                out.append((room, taken.copy()))

    walk(0, room, [])
    out.sort(key=lambda f: (f[0], [-v for v in f[1]]))
    return [f for _, f in out]


@dataclass
class Plan:
    """kinds: (how many, [(length, how often in each)]); bins: how many together; bound: no packing has fewer."""

    kinds: list[tuple[int, list[tuple[int, int]]]]
    bins: int
    bound: int


def plan(counts: dict[int, int], capacity: int = CAPACITY, search: int = SEARCH) -> Plan:
    """Kinds of bins that hold `counts` items of each length (1 to capacity)."""
    left = np.zeros(capacity + 1, np.int64)
    for k, v in counts.items():
        left[k] = v
    bound, total = lower_bound(left, capacity), int((left * np.arange(capacity + 1)).sum())
    steps: list[tuple[int, list[tuple[int, int]], Iterator | None]] = []  # applied: times, filling, what else could be (None: not looked at)
    bins = waste = 0
    best: Plan | None = None

    def apply(times: int, fill: list[tuple[int, int]], others: Iterator | None) -> None:
        nonlocal bins, waste
        for x, n in fill:
            left[x] -= times * n
        bins += times
        waste += times * (capacity - sum(x * n for x, n in fill))
        steps.append((times, fill, others))

    def options(top: int, first: list[tuple[int, int]]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        left[top] -= 1
        every = [_tally([top, *f]) for f in fillings(left, capacity - top)]
        left[top] += 1
        for fill in [first, *(f for f in every if f != first)]:
            most = min(int(left[x]) // n for x, n in fill)
            yield from ((times, fill) for times in sorted({most, 1}, reverse=True) if fill != first or times < most)

    while True:
        while True:  # go on with best-fit completions
            have = [int(x) for x in np.flatnonzero(left)]
            if not have:
                if best is None or bins < best.bins:
                    best = Plan([(t, f) for t, f, _ in steps], bins, bound)
                break
            if best is not None and (waste > (best.bins - 1) * capacity - total or bins + lower_bound(left, capacity) >= best.bins):
                break
            if best is not None:
                search -= 1
                if search <= 0:
                    break
            top = have[-1]
            left[top] -= 1
            fill = _tally([top, *complete(left, have, capacity - top, NODES if best is None else NODES // 10)])
            left[top] += 1
            apply(min(int(left[x]) // n for x, n in fill), fill, None)
        going = False
        while steps and best.bins > bound and search > 0 and not going:  # back to the last step that has another filling
            times, fill, others = steps.pop()
            for x, n in fill:
                left[x] += times * n
            bins -= times
            waste -= times * (capacity - sum(x * n for x, n in fill))
            allowed = (best.bins - 1) * capacity - total
            if waste > allowed:
                continue
            if others is None:
                others = options(fill[0][0], fill)
            for times, fill in others:
                search -= 1
                if waste + times * (capacity - sum(x * n for x, n in fill)) <= allowed:
                    apply(times, fill, others)
                    going = True
                    break
        if not going:
            return best


def _tally(items: list[int]) -> list[tuple[int, int]]:
    out: dict[int, int] = {}
    for x in items:
        out[x] = out.get(x, 0) + 1
    return sorted(out.items(), reverse=True)


def places(kinds: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """For items numbered from 0 within their length: columns key (length << 40 | first number), each, sequence, offset; sorted by key."""
    rows, taken, sequence = [], {}, 0
    for times, fill in kinds:
        offset = 0
        for length, n in fill:
            first = taken.get(length, 0)
            rows.append((length << 40 | first, n, sequence, offset))
            taken[length] = first + times * n
            offset += length * n
        sequence += times
    grid = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {k: grid[:, i] for i, k in enumerate(("key", "each", "sequence", "offset"))}


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids and its end id, cut only beyond `capacity`."""
    ship(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Cached.of(tokenizer, WORD)
        for batch in batches:
            for lo, hi in in_ranges(batch.column(1)):
                ids, sizes = own.encode(batch.column(1).slice(lo, hi - lo))
                data = memoryview(np.insert(ids, np.cumsum(sizes), end).astype("<u4").tobytes())
                sizes = sizes + 1
                n = -(-sizes // capacity)  # pieces of each document
                piece = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(np.repeat(sizes, n) - start, capacity)
                first = np.repeat(np.cumsum(sizes) - sizes, n) + start
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
                docs_ = batch.column(0).slice(lo, hi - lo).take(pa.array(np.repeat(np.arange(hi - lo), n)))
                yield pa.RecordBatch.from_arrays([docs_, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(cut, PIECES)


def pack(parts: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """parts (with a column length of 1 to capacity) with sequence_id and offset; sequences are numbered from 0 and gapless.

    n_sequences is how many there are, least_sequences a lower bound of it.
    """
    counts = {r[0]: r[1] for r in parts.groupBy("length").agg(F.count(F.lit(1))).collect()}  # at most `capacity` rows
    packed = plan(counts, capacity)
    at = places(packed.kinds)
    held = parts.sparkSession.sparkContext.broadcast(at)

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def place(length: pa.Array, number: pa.Array) -> pa.Array:
        t, size, rank = held.value, length.to_numpy(), number.to_numpy()
        row = np.searchsorted(t["key"], size << 40 | rank, side="right") - 1
        rank = rank - (t["key"][row] & ((1 << 40) - 1))
        each = t["each"][row]
        return pa.StructArray.from_arrays([pa.array(t["sequence"][row] + rank // each), pa.array(t["offset"][row] + rank % each * size)], ["sequence_id", "offset"])

    ranked = numbered(parts, ["length"], list(order), "_rank", sum(counts.values()))
    return ranked.withColumn("_place", place("length", "_rank")).select(*parts.columns, F.col("_place.sequence_id").alias("sequence_id"), F.col("_place.offset").alias("offset"), F.lit(packed.bins).cast("long").alias("n_sequences"), F.lit(packed.bound).cast("long").alias("least_sequences"))


def op3_packing(docs: DataFrame, tokenizer: str) -> DataFrame:
    return pack(written(pieces(docs, tokenizer), "pieces"))
