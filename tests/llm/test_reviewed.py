"""What a review found in the corpus operators."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import common, licenses, neargroups, tokenizing


def test_near_groups_need_one_python_worker_for_a_task(spark):
    slots = np.arange(neargroups.SLOTS)
    marks = np.random.default_rng(3).random(neargroups.SLOTS) < 0.3
    marked = spark.range(neargroups.SLOTS).where(neargroups._marked(F.col("id").cast("int"), marks))
    assert "ArrowEvalPython" not in marked._jdf.queryExecution().toString()
    assert sorted(r.id for r in marked.collect()) == slots[marks].tolist()


def test_workers_give_back_what_they_hold(monkeypatch):
    assert any(held is tokenizing._OWN for held in common.HELD)
    table = {"piece": 1}
    monkeypatch.setattr(common, "HELD", [table])
    assert list(common.tidy(iter)([1, 2])) == [1, 2] and not table


def test_every_known_licence_sentence_is_found_alone(spark):
    sentences = list(licenses.SENTENCES.items())
    got = licenses.op6_license_scan(spark.createDataFrame([(i, s) for i, (s, _) in enumerate(sentences)], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_known, r.identifiers) for r in got} == {i: (1, name) for i, (_, name) in enumerate(sentences)}
    assert {r.licenses for r in got if r.identifiers == "unlicense-grant"} == {"Unlicense"}


def _variants(rng, count, places):
    """Texts of 300 words and, for each, one with as many words changed as `places` says."""
    rows = []
    for i in range(count):
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        near = list(base)
        for at in range(places(i)):
            near[10 + at * 9] = f"new{i}x{at}"
        rows += [(i, " ".join(base)), (1000 + i, " ".join(near))]
    return rows


def test_simhash_codes_of_a_bucket_are_compared_by_bit_slices():
    rows = _variants(random.Random(7), 20, lambda i: 3)
    codes = [neargroups.code(neargroups.hashes(t, 5)) for _, t in rows]
    differ = lambda a, b: sum((int(x) ^ int(y)).bit_count() if (x < 0) == (y < 0) else 64 - (int(x) ^ ~int(y)).bit_count() for x, y in zip(a, b, strict=True))
    most = neargroups.radius(0.8)
    want = {(2 * i, 2 * i + 1) for i in range(20) if differ(codes[2 * i], codes[2 * i + 1]) <= most}
    assert len(want) >= 19 and all(differ(codes[a], codes[b]) > most for a in range(40) for b in range(a) if a // 2 != b // 2)
    bucket = [{"node": k, "code": c.tolist()} for k, c in enumerate(codes)]
    kind = pa.list_(pa.struct([("node", pa.int64()), ("code", pa.list_(pa.int64()))]))
    batch = pa.RecordBatch.from_arrays([pa.array([bucket[:10], bucket[10:], bucket[:1]], kind)], names=["rows"])
    got = [x for out in neargroups._near_codes(iter([batch]), most) for x in zip(*(c.to_pylist() for c in out.columns), strict=True)]
    assert set(got) == want and not len(neargroups.code(np.zeros(0, np.uint64)).nonzero()[0])


def test_the_radius_of_codes_loses_no_link(spark, monkeypatch):
    rows = _variants(random.Random(9), 60, lambda i: i % 12)
    docs = spark.createDataFrame([*rows, (5000, rows[0][1]), (5001, None), (5002, ""), (5003, "one")], "id long, text string")
    groups = dict(neargroups.near_groups(docs, "id", "text").collect())
    assert len(groups) == 124 and groups[5000] == 0 and groups[5002] == 5001 and groups[5003] == 5003
    monkeypatch.setattr(neargroups, "radius", lambda similarity: 0)
    assert dict(neargroups.near_groups(docs, "id", "text").collect()) == groups


def test_white_space_at_a_texts_end_is_one_piece():
    own = tokenizing.Cached(public_tokenizers.path("byte_bpe_50k.json"), tokenizing.BYTE)
    texts = ["a\n\n", "\n\n", "a  ", "a \n", "a\n\nb", "don't. Ünß,\n\"Oh\"\n\n", "", "a….b", "a<|b\n\n", "ä\n\n\nö"]
    ids, sizes = own.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert own.encode(["a\n\n"])[0].tolist() == [64, 628]


def test_a_full_table_keeps_the_words_that_come_again(monkeypatch):
    own, asked = tokenizing.Cached(public_tokenizers.path("byte_bpe_50k.json"), tokenizing.BYTE, most=300), []
    encode = own._words
    monkeypatch.setattr(own, "_words", lambda words: asked.append(set(words)) or encode(words))
    letters = str.maketrans("0123456789", "abcdefghij")
    common = [f" common{i}".translate(letters) for i in range(100)]
    for k in range(12):
        text = "".join(c + mark for c, mark in zip(common, ".,;!" * 25, strict=True)) + "".join(f" rare{k}x{i}".translate(letters) for i in range(100))
        ids, _ = own.encode([text])
        assert ids.tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(own.place) <= 600 and sum(len(a & set(common)) for a in asked) == 100
