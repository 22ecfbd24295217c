"""Corpus operators do their whole job: near-duplicates at the threshold, wrapped licence texts, short and unspaced texts."""

import bisect
import hashlib
import random
import re
import struct

import xxhash

from tessera.llm import language, licenses, neargroups, syncmers


def _alike(a, b, k=5):
    x, y = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_near_groups_are_those_of_exact_similarity(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    rows, want = [], {}
    for i in range(240):  # similarities of 0.70 to 0.90, half of them within 0.02 of 0.8
        base = [rng.choice(words) for _ in range(300)]
        n = rng.choice([3, 4, 5, 6, 6, 7, 7, 7, 8, 9, 10])
        near = list(base)
        for at in range(n):
            near[10 + at * 28] = f"new{i}x{at}"
        rows += [(i, " ".join(base)), (1000 + i, " ".join(near))]
        want[i] = _alike(*(t for _, t in rows[-2:])) >= 0.8
    assert 60 < sum(want.values()) < 200
    got = dict(neargroups.near_groups(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect())
    assert all(got[i] == i and got[1000 + i] == (i if want[i] else 1000 + i) for i in want if not want[i])
    assert sum(got[1000 + i] == i for i in want if want[i]) >= 0.98 * sum(want.values())


def test_near_groups_compare_all_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(neargroups, "FEW", 2)
    rng = random.Random(6)
    base = [f"w{rng.randrange(9000)}" for _ in range(200)]
    rows = []
    for i in range(30):  # a chain: each is like the next, few are like the least
        base[(i * 37) % 190] = f"new{i}"
        rows.append((i, " ".join(base)))
    alike = {(a, b) for a, t in rows for b, u in rows if a < b and _alike(t, u) >= 0.8}
    assert {(i, i + 1) for i in range(29)} <= alike and (0, 29) not in alike
    got = dict(neargroups.near_groups(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect())
    assert set(got.values()) == {0}


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE FOR ANY CLAIM."""
BSD = """Redistribution and use in source and binary forms are permitted provided that:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
NAMES = """

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""
GPL = """This program is free software{}you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{}either version {} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""


def test_wrapped_licences(spark):
    texts = {MIT: "MIT", BSD: "BSD-2-Clause", BSD + NAMES: "BSD-3-Clause", APACHE: "Apache-2.0", GPL.format("; ", "; ", 2): "GPL-2.0-or-later", GPL.format(": ", ", ", 3): "GPL-3.0-or-later"}
    commented = {"#!/bin/sh\n" + "\n".join(("# " + x).rstrip() for x in t.split("\n")) + "\nrun()": n for t, n in texts.items()}
    windows = {"/*\r\n" + "\r\n".join((" * " + x).rstrip() for x in t.split("\n")) + "\r\n */": n for t, n in texts.items()}
    lines = {"A title\nReleased under the MIT License\nand more words": "MIT", "permission\n\nis hereby granted": "", "released under\n\nthe MIT license": ""}
    rows = list((texts | commented | windows | lines).items())
    got = {r.doc_id: r.licenses for r in licenses.op6_license_scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == [n for _, n in rows]


LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details."""
AGPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE."""
KERNEL = """This program is free software; you can redistribute it and/or modify it
under the terms of the GNU General Public License version 2 as published by
the Free Software Foundation."""


def test_more_licences_and_spdx_lines(spark):
    texts = {
        LGPL: "LGPL-2.1-or-later", AGPL: "AGPL-3.0-or-later", MPL: "MPL-2.0", ISC: "ISC", KERNEL: "GPL-2.0-only", "// SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause", "# SPDX-License-Identifier: MIT OR Apache-2.0\ncode()": "MIT OR Apache-2.0",
        "This project is licensed under the Mozilla Public License 2.0.": "MPL-2.0", "Distributed under the GPLv3.": "GPL-3.0-only", "licensed under the licence of nobody": "", None: "", "": "", "x. " * 20000 + "\nReleased under the ISC License\n" + "y " * 20000: "ISC",
        "Released under the MIT License. Released under the MIT License. Released under the ISC License.": "MIT,ISC",
    }
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, LGPL, "clash"), (None, LGPL, "clash")]
    got = licenses.op6_license_scan(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()
    assert sorted(((r.doc_id, r.licenses) for r in got), key=str) == sorted([(i, n) for i, n in enumerate(texts.values())] + [(None, "LGPL-2.1-or-later")] * 2, key=str)


def _signed(x):
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _long_hash(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", _signed(v)), seed)
    return seed


def _fingerprint(t):
    """Closed syncmers of tokens by brute force: hash -> first place, the least 64."""
    tokens = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[^ \t\n\x0b\x0c\r]{1,8}", t)]
    inner = [_signed(_long_hash(a, b)) for a, b in zip(tokens, tokens[1:], strict=False)]
    own = {}
    for i in range(len(inner) - 2):
        if min(inner[i : i + 3]) in (inner[i], inner[i + 2]):
            own.setdefault(_long_hash(inner[i], inner[i + 2]) >> 25, i)
    if not own and tokens:
        own = {xxhash.xxh64_intdigest(" ".join(re.findall(r"[^ \t\n\x0b\x0c\r]+", t)).encode(), 42) >> 25: 0}
    return dict(sorted(own.items())[:64])


def _likeness(a, b):
    least = sorted(a.keys() | b.keys())[:64]
    places = [q for _, q in sorted((a[h], b[h]) for h in least if h in a and h in b)]
    ends = []
    for q in places:
        at = bisect.bisect_left(ends, q)
        ends[at : at + 1] = [q]
    return len(ends) / len(least) if least else 1.0


def _hex(f):
    return "".join(f"{h << 24 | i:016x}" for h, i in f.items())


def test_syncmers_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "BUCKET_BYTES", 4000)
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeé😀") for _ in range(rng.randint(1, 8))) for _ in range(200)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    texts += ["", "", "a", "one two", "z" * 400, "漢字" * 300, texts[0], "ab" * 7, texts[1] + texts[2], texts[2] + texts[1], "tok a b c", "x" * 13, "x" * 14, "😀" * 20]
    rows = [(i * 3, t, i) for i, t in enumerate(texts)] + [(None, None, 0), (None, "text of no id and of some length", 0), (9, texts[5], 0), (9, texts[5], 0)]
    order = sorted(((i if i is not None else -(1 << 63), _signed(xxhash.xxh64_intdigest((t or "").encode(), 42)), t or "") for i, t, _ in rows), key=lambda r: (-r[0], r[1]))
    want = []
    for k, (i, _, t) in enumerate(order):
        after = order[(k + 1) % len(order)][2]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        own, other = _fingerprint(t), _fingerprint(edited)
        want.append((i if i >= 0 else None, len(t), hashlib.sha256(edited.encode()).hexdigest(), _hex(own), _hex(other), _likeness(own, other), _likeness(own, _fingerprint(after))))
    got = syncmers.op9_syncmers(spark.createDataFrame(rows, "doc_id long, text string, sketch long")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_syncmers_tell_edited_texts_from_others(spark):
    rng = random.Random(8)
    rows = [(i, " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(150, 400)))) for i in range(40)]
    got = syncmers.op9_syncmers(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(0.25 < r.near_edited < 0.75 and r.near_next < 0.05 for r in got)
    moved = spark.createDataFrame([(1, rows[0][1]), (0, "a new beginning " * 3 + rows[0][1])], "doc_id long, text string")
    assert min(r.near_next for r in syncmers.op9_syncmers(moved).collect()) > 0.7


def test_short_texts_have_fingerprints(spark):
    rows = [(i, f"tok{i} b{i} c{i} d{i}") for i in range(30)]
    got = syncmers.op9_syncmers(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.fingerprint for r in got) and len({r.fingerprint for r in got}) == 30
    assert all(r.near_next < 1 for r in got)


def test_language_of_text_without_spaces(spark):
    rng = random.Random(4)
    rows = [(i, "a" * 60 + "".join(rng.choice("efg" if i % 2 else "bcd") for _ in range(100)), "y" if i % 2 else "x") for i in range(80)]
    got = language.op4_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r.lang_pred == ("y" if r.doc_id % 2 else "x") for r in got)


def test_language_of_held_out_texts_of_unseen_and_mixed_words(spark):
    rng = random.Random(11)
    parts = {"x": ["ka", "lo", "mi", "tu", "ne"], "y": ["ka", "lor", "sch", "tun", "ei"], "z": ["ca", "lo", "mi", "oux", "ne"]}  # syllables overlap
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randint(2, 5)))
    rows = []
    for i in range(400):
        lang = "xyz"[i % 3]
        own = [word(lang) for _ in range(rng.randint(5, 40))]
        rows.append((i, " ".join(own if i % 4 else [*own, *(word(rng.choice("xyz")) for _ in range(len(own) // 3))]), lang, "clash"))
    rows += [(9000, None, "x", ""), (9001, "", "y", ""), (9002, "kalo " * 50000, "x", ""), (None, "sch", "y", ""), (None, "sch", "y", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, h string")
    got = {r.doc_id: r for r in language.op4_language(docs).collect() if r.doc_id is not None and r.doc_id < 400}
    held = [i for i in got if got[i].held_out]
    assert len(held) > 60 and sum(got[i].lang_pred == rows[i][2] for i in held) >= 0.95 * len(held)
    assert language.op4_language(docs).count() == len(rows)


def test_a_language_is_learned_from_a_bounded_number_of_texts(spark):
    rows = [("en", f"word{i % 500} the text") for i in range(2000)] + [("de", f"das wort{i}") for i in range(3)]
    got = language.sample(spark.createDataFrame(rows, "lang string, text string"), "text", "lang", 100).groupBy("lang").count().collect()
    assert dict(got) == {"en": 100, "de": 3}
    model = language.learn(spark.createDataFrame(rows, "lang string, text string"))
    assert {"the", "das", "text"} <= model["known"][0].keys() and model["langs"] == ["de", "en"]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
