"""Hamming distances by bit slices: planes of bits, carry-save counters, early abandoning of blocks.

Codes are numbers, so there are no nulls here; no codes, or one, give no links; equal codes link at any radius.
"""

from __future__ import annotations

import numpy as np

BLOCK = 256  # words of 64 pairs that are abandoned together


def planes(codes: np.ndarray) -> np.ndarray:
    """(n, words) uint64 codes as (64 * words, ceil(n / 64) + 1) uint64: row p holds bit p of every code, code i at bit i % 64."""
    n = len(codes)
    bits = np.unpackbits(np.ascontiguousarray(codes.astype("<u8")).view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    pad = np.zeros((bits.shape[1], (n // 64 + 2) * 64), np.uint8)
    pad[:, :n] = bits.T
    return np.packbits(pad, axis=1, bitorder="little").view("<u8")


def within(x: np.ndarray, radius: int, live: np.ndarray) -> np.ndarray:
    """Of 64-bit words of pairs: those whose set planes number at most radius, as bits.

    x: (planes, words), bit i of a word in plane p set if pair i differs in bit p. live: (words,) the pairs that count.
    Counters are bit-sliced: level j holds bit j of 64 counts. Planes are added eight at a time by a tree of carry-save adders
    (three bits of one level become one of it and one of the next), which leaves one carry of weight eight for the levels above;
    carries beyond the top level set `over`. After every eight planes the blocks in which every live pair is over the radius are given up.
    """
    levels = max(3, int(radius).bit_length())
    if x.shape[0] % 8:
        x = np.concatenate([x, np.zeros((-x.shape[0] % 8, x.shape[1]), np.uint64)])
    n = x.shape[1]
    out = np.zeros(n, np.uint64)
    for lo in range(0, n, BLOCK * 64):
        hi = min(n, lo + BLOCK * 64)
        size = -(-(hi - lo) // BLOCK) * BLOCK
        blocks = np.arange(size // BLOCK)
        xs = np.zeros((x.shape[0], size), np.uint64)
        xs[:, : hi - lo] = x[:, lo:hi]
        xs = xs.reshape(x.shape[0], -1, BLOCK)
        alive = np.zeros(size, np.uint64)
        alive[: hi - lo] = live[lo:hi]
        alive = alive.reshape(-1, BLOCK)
        count = [np.zeros_like(alive) for _ in range(levels)]
        over = ~alive
        for p in range(0, xs.shape[0], 8):
            a = [xs[q, blocks] if len(blocks) < xs.shape[1] else xs[q] for q in range(p, p + 8)]
            ones, twos, fours = count[:3]
            ones, t1 = _added(ones, a[0], a[1])
            ones, t2 = _added(ones, a[2], a[3])
            twos, f1 = _added(twos, t1, t2)
            ones, t1 = _added(ones, a[4], a[5])
            ones, t2 = _added(ones, a[6], a[7])
            twos, f2 = _added(twos, t1, t2)
            fours, carry = _added(fours, f1, f2)
            count[:3] = ones, twos, fours
            for j in range(3, levels):
                count[j], carry = count[j] ^ carry, count[j] & carry
            over = over | carry
            keep = (~(over | _greater(count, radius))).any(axis=1)
            if not keep.all():
                blocks, over, count = blocks[keep], over[keep], [c[keep] for c in count]
                if not len(blocks):
                    break
        if len(blocks):
            part = np.zeros((size // BLOCK, BLOCK), np.uint64)
            part[blocks] = ~(over | _greater(count, radius))
            out[lo:hi] = part.reshape(-1)[: hi - lo]
    return out


def _added(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A carry-save adder: the sum bits and the carries of three words."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _greater(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Bits of the counters whose value is more than radius."""
    more, same = np.zeros_like(count[0]), np.full_like(count[0], np.uint64(0xFFFFFFFFFFFFFFFF))
    for j in reversed(range(len(count))):
        if radius >> j & 1:
            same = same & count[j]
        else:
            more, same = more | (same & count[j]), same & ~count[j]
    return more


def _shifted(p: np.ndarray, s: int, words: int) -> np.ndarray:
    """The planes with code i + s in the place of code i."""
    q, r = divmod(s, 64)
    low = p[:, q : q + words] >> np.uint64(r)
    if r:
        high = p[:, q + 1 : q + words + 1]
        low[:, : high.shape[1]] |= high << np.uint64(64 - r)
    return low


def spanning_links(codes: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) by position that join the same codes of each bucket as all pairs within `radius` would.

    codes: (n,) or (n, words) uint64, bucket after bucket; sizes: their sizes. Every pair of a bucket is compared,
    but a spanning forest is all that is returned.
    """
    codes = codes.reshape(len(codes), -1)
    order = np.argsort(-sizes, kind="stable")
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    size = sizes[order]
    place = np.repeat(starts[order] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    codes, bucket = codes[place], np.repeat(np.arange(len(size)), size)
    ends = np.cumsum(size)
    p, label = planes(codes), np.arange(len(codes))
    for s in range(1, int(size[0]) if len(size) else 0):
        n = int(ends[np.searchsorted(-size, -s, side="left") - 1]) - s  # buckets are in descending size: only those of more than s codes
        if n <= 0:
            break
        words = -(-n // 64)
        same = np.zeros(words * 64, np.uint8)
        same[:n] = bucket[:n] == bucket[s : s + n]
        live = np.packbits(same, bitorder="little").view("<u8")
        hit = within(p[:, :words] ^ _shifted(p, s, words), radius, live)
        if hit.any():
            i = np.flatnonzero(np.unpackbits(hit.view(np.uint8), bitorder="little"))
            _join(label, i, i + s)
    while (label[label] != label).any():
        label = label[label]
    i = np.flatnonzero(label != np.arange(len(label)))
    return place[i], place[label[i]]


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of a and b, in place; a label never exceeds its place."""
    while True:
        x, y = label[a], label[b]
        while (label[x] != x).any():
            x = label[x]
        while (label[y] != y).any():
            y = label[y]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
