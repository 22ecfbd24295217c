"""Operators on small tables, against brute force; nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tessera.llm import contamination, language, licenses, neargroups, packing, repair, sharding, simhash, suffixes, syncmers, wordvectors

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, gram long, size long"


def _rows(texts):
    return [(i, t, None if k % 7 == 3 else "en", f"s{k % 3}" if k % 5 else None, len(t or ""), -k, 1, 2) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    words = [("".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 7)))) for _ in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 160))) for _ in range(30)]
    out = list(enumerate(base))
    for i in range(30, 60):
        own = rng.choice(base).split()
        if rng.random() < 0.6:
            own[rng.randrange(len(own))] = "changed"
        out.append((i, " ".join(own)))
    out += [(60, None), (61, ""), (62, "  \n"), (63, "one"), (64, "one two"), (65, "Licensed under the Apache License, Version 2.0."), (66, "z" * 3000), (67, "word " * 4000)]
    return [*out, (5, base[5]), (7, "other text than the first of this id"), (None, "no id here")]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(_rows(texts), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _tuples(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def _simhash(t, k=3):
    own = [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    parts = [" ".join(own[i : i + k]) for i in range(len(own) - k + 1)] or ([" ".join(own)] if own else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(docs, none, texts):
    codes = [_simhash(t) for _, t in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if (codes[a] ^ codes[b]).bit_count() <= 2:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    ids = {g: min((i for (i, _), h in zip(texts, group, strict=True) if h == g and i is not None), default=None) for g in group}
    want = sorted(((i, f"{c:016x}", ids[g]) for (i, _), c, g in zip(texts, codes, group, strict=True)), key=str)
    assert _tuples(simhash.op5_simhash(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.op5_simhash(none).count() == 0


def test_near_groups_join_similar_texts(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    base = [[rng.choice(words) for _ in range(200)] for _ in range(25)]
    near = [b[:40] + ["new"] + b[41:] for b in base]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)] + [(100 + i, " ".join(b)) for i, b in enumerate(near)]
    got = dict(neargroups.near_groups(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect())
    assert sum(got[100 + i] == i for i in range(25)) >= 24
    assert all(got[i] == i for i in range(25))
    old, neargroups.MOST = neargroups.MOST, 4  # buckets in tiles give the same
    try:
        assert dict(neargroups.near_groups(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()) == got
    finally:
        neargroups.MOST = old


def _without_repeats(texts):
    data = [(t or "").encode() for _, t in texts]
    seen = Counter(d[p : p + 200] for d in data for p in range(len(d) - 199))
    out = []
    for (i, _), d in zip(texts, data, strict=True):
        mask = bytearray(len(d))
        for p in range(len(d) - 199):
            if seen[d[p : p + 200]] > 1:
                mask[p : p + 200] = b"\1" * 200
        left = bytes(c for c, m in zip(d, mask, strict=True) if not m)
        out.append((i, len(d), sum(mask), len([x for x in bytes(mask).split(b"\0") if x]), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [4096, 1])
def test_suffix_dedup(docs, none, texts, most, monkeypatch):
    monkeypatch.setattr(suffixes, "MAX_CONTEXTS", most)
    got = _tuples(suffixes.op10_suffix_dedup(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == _without_repeats(texts)
    if most > 1:
        assert suffixes.op10_suffix_dedup(none).count() == 0
        kept = suffixes.without_repeats(docs)
        assert kept.columns == docs.columns and kept.count() == len(texts)


def test_contamination(spark, docs, none, texts):
    items = [(1, texts[0][1]), (2, "one two"), (3, None), (4, "!?"), (10, " ".join(texts[1][1].split()[:9])), (10, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    fold = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    want = []
    for i, t in texts:
        own, hit, found = fold(t), set(), set()
        for item, u in items:
            w = fold(u)
            for win in [tuple(w[j : j + 8]) for j in range(max(1, len(w) - 7))] if w else []:
                for p in range(len(own) - len(win) + 1):
                    if tuple(own[p : p + len(win)]) == win:
                        hit.update(range(p, p + len(win)))
                        found.add(item)
        names = ",".join(sorted(map(str, found)))
        want.append((i, len(own), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), len(found) >= 2))
    got = _tuples(contamination.op8_decontamination(docs, bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(want, key=str)
    assert contamination.op8_decontamination(none, bench).count() == 0
    assert {r.n_items for r in contamination.op8_decontamination(docs, bench.limit(0)).collect()} == {0}
    near = contamination.contamination(docs, spark.createDataFrame([(1, "two x one")], "item_id long, text string"), slop=2)
    assert near.where("size(items) > 0").count() == 0


def test_packing(spark, none, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [*texts, (70, "w1 " * 9000), (70, "w1 " * 9000), (71, "a " * 4095), (72, "a " * 4096)]
    got = packing.op3_packing(spark.createDataFrame(_rows(rows), SCHEMA), path).collect()
    tool, want = Tokenizer.from_file(path), []
    for i, t in rows:
        ids = np.array([*tool.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 4096
    assert {(r.n_sequences, r.least_sequences) for r in got} == {(len(bins), -(-sum(r.length for r in got) // 4096))}
    assert packing.op3_packing(none, path).count() == 0


def test_token_files(docs, none, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tool = Tokenizer.from_file(path)
    start, want = 0, []
    order = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, zlib.crc32((x[1] or "").encode())))
    for i, t in order:
        ids = np.array([*tool.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert _tuples(repair.op7_token_ids(docs, path), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=str)
    assert repair.op7_token_ids(none, path).count() == 0


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(60)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = wordvectors.op2_quality(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0) for r in got)
    assert wordvectors.op2_quality(none, labels).count() == 0
    assert {r.score for r in wordvectors.op2_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_language(spark, none):
    en, de = "the house and the garden of the town", "das haus und der garten von der stadt"
    rows = [(i, (en if i % 2 else de) if i % 10 else None, "en" if i % 2 else "de") for i in range(80)] + [(200, "1234 !!", "en"), (202, "gartenhausen", None), (203, "", None)]
    got = {r.doc_id: r for r in language.op4_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") for i in range(80) if i % 10)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 200, 203)) and got[202].lang_pred == "de"
    assert language.op4_language(none).count() == 0


def test_sharding(docs, none, texts):
    got = sharding.op1_sharding(docs).collect()
    assert sorted(str((r.doc_id, r.size, r.text_crc32)) for r in got) == sorted(str((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))) for i, t in texts)
    for s in {r.shard for r in got}:
        assert 0 <= s < 40 and sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.op1_sharding(none).count() == 0


def test_shards_are_even_and_keep_equal_texts(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(50, 400) + str(i if i % 3 else i % 30), "en", f"s{i % 4}") for i in range(4000)]
    got = sharding.op1_sharding(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas()
    total = got.groupby("shard")["size"].sum()
    assert len(total) == 40 and total.max() < 1.05 * total.mean() and total.min() > 0.95 * total.mean()
    assert (got.groupby(["text_crc32", "size"]).shard.nunique() == 1).all()


def test_syncmers(spark, none, texts, monkeypatch):
    monkeypatch.setattr(syncmers, "BUCKET_BYTES", 2000)
    rows = [(i, t) for i, t in dict((i, t) for i, t in texts if i is not None).items()]
    got = {r.doc_id: r for r in syncmers.op9_syncmers(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    prints = {}
    for k, (i, t) in enumerate(order):
        cut = len(t) // 3
        edited = t[: len(t) - cut] + order[(k + 1) % len(order)][1][:cut]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(t, got[i].fingerprint) == got[i].fingerprint
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert syncmers.op9_syncmers(none).count() == 0
    assert syncmers.op9_syncmers(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).first().near_next == 1


def test_licenses(spark, none):
    rows = [(1, "Text.\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License."), (2, None), (3, "A licence of no kind."), (4, "Redistribution is fine. Released under the MIT License")]
    got = {r.doc_id: (r.n_known, r.licenses) for r in licenses.op6_license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (2, "MIT,Apache-2.0"), 2: (0, ""), 3: (0, ""), 4: (1, "MIT")}
    assert licenses.op6_license_scan(none).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    words = [("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    good = [text(120) for _ in range(40)]
    junk = [" ".join(w.upper() + "!!" for w in text(80).split()) for _ in range(20)]
    item, passage = text(20), text(60)
    rows = [*enumerate(good), *((100 + i, j) for i, j in enumerate(junk)), (200, good[0]), (201, good[1] + " extra"), (202, good[2] + " " + item), (203, text(50) + " " + passage), (204, text(50) + " " + passage), (205, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i, _ in rows if i < 130], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    kept = stage["quality"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and ids(kept) >= set(range(40)) and not ids(kept) & set(range(100, 120))
    left = stage["near_duplicates"](spark, docs, str(tmp_path))
    assert left.columns == docs.columns and not ids(left) & {200, 201} and ids(left) >= {*range(40), 203, 204}
    cut = {r.doc_id: r for r in stage["repeats"](spark, left, str(tmp_path)).collect()}
    assert passage not in cut[203].text and cut[203].n_chars == len(cut[203].text) and cut[5].text == good[5]
    clean = ids(stage["decontaminate"](spark, docs, str(tmp_path)))
    assert 202 not in clean and clean >= set(range(40))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} >= set(range(3, 40)) - {2} and not {r.doc_id for r in out} & {*range(100, 120), 200, 201}
