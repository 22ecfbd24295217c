"""Breadth-first search from many origins at once, in numpy: every origin has a bit, and a step moves the bits of a node to its targets.

Only counts of nodes by distance leave a search, so that memory is the bits of one batch of origins, however many pairs there are.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

WORDS = 1 << 23  # 64-bit words of a batch at most: nodes times words for each node
MOST = 1024  # origins of a batch at most
FEW = 256  # rows whose bits are added one by one


class Adjacency(NamedTuple):
    """Edges between nodes 0 to n - 1. The targets of v are to[first[v]:first[v + 1]]; `by_target` has the sources sorted by target, those of targets[i] from starts[i]."""

    first: np.ndarray
    to: np.ndarray
    by_target: np.ndarray
    targets: np.ndarray
    starts: np.ndarray


def adjacency(n: int, src: np.ndarray, dst: np.ndarray) -> Adjacency:
    order = np.argsort(src, kind="stable")
    first = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(src, minlength=n), out=first[1:])
    back = np.argsort(dst, kind="stable")
    targets, starts = np.unique(dst[back], return_index=True)
    return Adjacency(first, dst[order], src[back], targets, starts)


def batch_size(n: int, tasks: int) -> int:
    """Origins of a batch, in whole words: four batches for each of `tasks`, within MOST and WORDS."""
    return 64 * max(1, min(MOST // 64, WORDS // max(n, 1), -(-n // (256 * tasks))))


def column_counts(rows: np.ndarray) -> np.ndarray:
    """(n, words) uint64: how many rows have each of the 64 * words bits. Carry-save adders make of three rows one of their weight and one of twice that."""
    counts, weight = np.zeros(64 * rows.shape[1], np.int64), 1
    while len(rows):
        carries = []
        while len(rows) > FEW:
            k = len(rows) // 3
            a, b, c = rows[:k], rows[k : 2 * k], rows[2 * k : 3 * k]
            x = a ^ b
            carries.append((a & b) | (x & c))
            rows = np.concatenate([x ^ c, rows[3 * k :]])
        bits = np.unpackbits(np.ascontiguousarray(rows.astype("<u8", copy=False)).view(np.uint8), axis=1, bitorder="little")
        counts += weight * bits.sum(axis=0, dtype=np.int64)
        weight *= 2
        rows = np.concatenate(carries) if carries else rows[:0]
    return counts


def _moved(graph: Adjacency, n: int, rows: np.ndarray, front: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes that the edges of `rows` (with the bits `front`) lead to, each once, and the bits that come there."""
    if 4 * len(rows) > n:
        full = np.zeros((n, front.shape[1]), np.uint64)
        full[rows] = front
        return graph.targets, np.bitwise_or.reduceat(full[graph.by_target], graph.starts, axis=0)
    degree = graph.first[rows + 1] - graph.first[rows]
    ends = np.cumsum(degree)
    to = graph.to[np.arange(ends[-1]) + np.repeat(graph.first[rows] - ends + degree, degree)]
    order = np.argsort(to, kind="stable")
    to = to[order]
    starts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])[: len(to)])
    bits = front[np.repeat(np.arange(len(rows)), degree)[order]]
    return to[starts], np.bitwise_or.reduceat(bits, starts, axis=0) if len(to) else bits


def profile(graph: Adjacency, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the origins lo to hi - 1: how many nodes each reaches (itself not among them), the sum of their distances, the sum of the inverse distances, the greatest."""
    n, many = len(graph.first) - 1, hi - lo
    seen = np.zeros((n, -(-many // 64)), np.uint64)
    rows, at = np.arange(lo, hi), np.arange(many)
    seen[rows, at // 64] = np.uint64(1) << (at % 64).astype(np.uint64)
    front = seen[rows]
    reached, total, inverse, farthest = np.zeros(many, np.int64), np.zeros(many, np.int64), np.zeros(many), np.zeros(many, np.int64)
    depth = 0
    while len(rows) and len(graph.to):
        depth += 1
        rows, front = _moved(graph, n, rows, front)
        front = front & ~seen[rows]
        new = front.any(axis=1)
        rows, front = rows[new], front[new]
        seen[rows] |= front
        count = column_counts(front)[:many]
        reached += count
        total += depth * count
        inverse += count / depth
        farthest[count > 0] = depth
    return reached, total, inverse, farthest
