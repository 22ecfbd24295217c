"""Kernels without Spark, against brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import bitslice, contamination, packing, repair, suffixes, tokenizing, wordvectors

public_tokenizers = pytest.importorskip("public_tokenizers")


def _components(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 12])
@pytest.mark.parametrize("words", [1, 3])
def test_spanning_links_join_what_all_pairs_would(radius, words):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, (20, words), dtype=np.uint64)
    codes, sizes = [], []
    for _ in range(15):
        m = int(rng.integers(1, 150))
        c = base[rng.integers(0, 20, m)].copy()
        for _ in range(radius + 1):
            c[np.arange(m), rng.integers(0, words, m)] ^= np.uint64(1) << rng.integers(0, 64, m, dtype=np.uint64)
        codes.append(c)
        sizes.append(m)
    all_codes, starts = np.concatenate(codes), np.cumsum([0, *sizes])
    want = []
    for s, e in zip(starts[:-1], starts[1:], strict=True):
        for i in range(s, e):
            near = np.bitwise_count(all_codes[i] ^ all_codes[i + 1 : e]).sum(axis=1) <= radius
            want += [(i, i + 1 + int(j)) for j in np.flatnonzero(near)]
    a, b = bitslice.spanning_links(all_codes, np.array(sizes), radius)
    assert _components(len(all_codes), want) == _components(len(all_codes), zip(a.tolist(), b.tolist(), strict=True))
    assert len(a) < len(all_codes)


def test_blind_trie_sorts_with_ties_and_prefixes():
    rng = random.Random(3)
    for _ in range(200):
        strings = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 25))]
        order = suffixes.blind_trie(strings)
        assert sorted(order) == list(range(len(strings)))
        assert [strings[i] for i in order] == sorted(strings)


def test_deep_shallow_orders_groups_and_gives_common_prefixes():
    rng = random.Random(4)
    strings = [b"x" * 70 + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) if rng.random() < 0.5 else bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(120)]
    group = np.sort(np.array([rng.randint(0, 5) for _ in strings]))
    grid, lengths = np.zeros((120, suffixes.LENGTH), np.uint8), np.array([len(s) for s in strings])
    for i, s in enumerate(strings):
        grid[i, : len(s)] = np.frombuffer(s, np.uint8)
    order, lcp = suffixes.deep_shallow(grid, lengths, group)
    assert [group[i] for i in order] == sorted(group)
    for k in range(1, 120):
        a, b = order[k - 1], order[k]
        if group[a] != group[b]:
            assert lcp[k] == -1
        else:
            assert lcp[k] == suffixes.common_prefix(strings[a], strings[b])
            assert strings[a][: lcp[k]] == strings[b][: lcp[k]]


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_classification_is_the_same_for_any_batches(size):
    rng = random.Random(size)
    rows = sorted((rng.randint(0, 12), rng.randint(0, 3), i) for i in range(120))
    cols = {"kind": [0] * 120, "gram": [r[0] for r in rows], "context": [r[1] for r in rows], "id": [r[2] for r in rows], "th": [0] * 120, "pos": [500] * 120, "right": [200] * 120, "many": [rng.random() < 0.2 for _ in rows]}
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
    batch = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols.values(), kinds, strict=True)], names=list(cols))
    got = pa.Table.from_batches(list(suffixes._classified(iter([batch.slice(i, size) for i in range(0, 120, size)]))), batch.schema).to_pylist()
    times, contexts = {}, {}
    for g, c, _ in rows:
        times[g, c] = times.get((g, c), 0) + 1
        contexts.setdefault(g, set()).add(c)
    spans = {r["id"] for r in got if r["kind"] == suffixes.SPAN}
    assert spans == {i for (g, c, i), m in zip(rows, cols["many"], strict=True) if times[g, c] > 1 and not m}
    ones = [(r["gram"], r["context"]) for r in got if r["kind"] == suffixes.ONE]
    assert sorted(ones) == sorted((g, c) for g, cs in contexts.items() if len(cs) > 1 for c in cs)


@pytest.mark.parametrize(("kind", "name"), [(tokenizing.WORD, "word_bpe_49k.json"), (tokenizing.BYTE, "byte_bpe_50k.json")])
def test_cached_ids_are_the_librarys(kind, name):
    rng = random.Random(5)
    marks = [" ", "  ", "\n", "\t", "a", "é", "É", "é", "Σ", "1", "!", "'s", "<|", "<|endoftext|>", "\x1c", "\x85", "\xa0", " ", "　", "🙂", "ﬁ", "İ", "한", "word", "The", "...", "²"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 25))) for _ in range(1500)] + ["", "x" * 3000, "The end. The END!! the end"]
    own = tokenizing.Cached(public_tokenizers.path(name), kind, most=300)
    column = pa.array([*texts, None])
    want = [e.ids for e in own.tokenizer.encode_batch([*texts, ""], add_special_tokens=False)]
    for most in (3000, 1 << 22):
        got = []
        for lo, hi in tokenizing.in_ranges(column, most):
            ids, sizes = own.encode(column.slice(lo, hi - lo))
            got += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
        assert got == want
    assert list(tokenizing.in_ranges(pa.array([], pa.string()))) == [] and len(own.encode([])[0]) == 0


def _fewest(items, capacity):
    best = len(items)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[i] <= capacity and bins[j] not in bins[:j]:
                put(i + 1, [*bins[:j], bins[j] + items[i], *bins[j + 1 :]])
        put(i + 1, [*bins, items[i]])

    put(0, [])
    return best


def _checked(items, capacity):
    p = packing.plan(dict(Counter(items)), capacity)
    held = Counter()
    for m, fill in p.kinds:
        assert sum(x * k for x, k in fill) <= capacity
        held.update({x: m * k for x, k in fill})
    assert held == Counter(items) and p.bins == sum(m for m, _ in p.kinds) >= p.bound
    return p


def test_plan_is_optimal_on_small_sets():
    rng = random.Random(1)
    for _ in range(150):
        capacity = rng.choice([10, 30, 100])
        items = sorted((rng.randint(1, capacity) if rng.random() < 0.5 else rng.randint(max(1, capacity // 6), capacity // 2) for _ in range(rng.randint(1, 12))), reverse=True)
        p = _checked(items, capacity)
        assert p.bound <= p.bins == _fewest(items, capacity)
    assert _checked([44, 24, 24, 22, 21, 17, 8, 8, 6, 6, 10, 10], 100).bins == 2


def test_plan_packs_every_item_and_is_near_the_bound():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 40, 2000, 30000):
        p = _checked(np.clip(rng.lognormal(5.5, 1.1, n).astype(int), 1, 4096).tolist(), 4096)
        assert p.bins <= p.bound + 1
    assert _checked([4096] * 10**4 + [1] * 10**5, 4096).bins == 10025


def test_fillings_are_undominated():
    left = lambda items: np.bincount(items, minlength=11)
    assert packing.fillings(left([5, 3, 2]), 5) == [[5]]
    assert packing.fillings(left([5, 3, 2, 2, 1]), 9) == [[5, 3, 1], [5, 2, 2]]
    assert packing.fillings(left([7, 7]), 6) == [[]]
    assert packing.dominated([3, 2], 0, 1 << 5) and not packing.dominated([5], 0, 1 << 3 | 1 << 2) and packing.dominated([4], 1, 1 << 5)


def test_repair_round_trip_and_random_access():
    rng = np.random.default_rng(2)
    tokens = [rng.zipf(1.3, int(rng.integers(1, 2000))).clip(0, 50256).astype(np.uint16) for _ in range(30)] + [np.zeros(1, np.uint16)]
    sizes = np.array([len(t) for t in tokens])
    shard = repair.Shard(repair.to_file(np.arange(31), np.concatenate(tokens), sizes))
    assert len(shard.rules) and (shard.all() == np.concatenate(tokens)).all()
    for i, t in enumerate(tokens):
        a = int(rng.integers(0, len(t)))
        b = int(rng.integers(a, len(t) + 1))
        assert (shard.document(i) == t).all() and (shard.document(i, a, b) == t[a:b]).all()
    assert len(repair.Shard(repair.to_file(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int))).all()) == 0


def test_phrase_and_proximity_places():
    lists = [np.array([0, 5, 9]), np.array([1, 7, 10]), np.array([2, 6])]
    assert contamination.exact_places(lists).tolist() == [0]
    assert contamination.near_places(lists, 3) == [(0, 3), (5, 8)]


def test_classifier_learns_and_scores_any_text():
    rng = random.Random(1)
    good = [" ".join(rng.choice(["stone", "river", "cloud", "tree"]) for _ in range(30)) for _ in range(60)]
    bad = [" ".join(rng.choice(["BUY!!", "NOW!!", "win$$"]) for _ in range(30)) for _ in range(60)]
    model = wordvectors.train(good + bad, [1] * 60 + [0] * 60)
    scores = model.score([*good[:5], *bad[:5], "", "é" * 5000])
    assert min(scores[:5]) > 0.8 and max(scores[5:10]) < 0.2 and all(0 <= s <= 1 for s in scores)
    assert wordvectors.train([], []).score(["x"]) == [0.5]
    assert zlib.crc32(b"")  == 0
