"""Licence scan by sentence rules, with DataFrame functions only.

A text is cut at sentence ends and blank lines, and within these into pieces at line ends, semicolons and colons. Pieces are
normalised (lower case, runs of anything but letters, digits and inner dots as one space, so comment marks go). One piece or
several in a row that make a known licence sentence have its identifier (the longest sentence counts). So
notices may be wrapped anywhere. The SQL of oracle() looks at single pieces, which is the same where nothing is wrapped. The identifiers of a text, in order, are
matched against rules in their order: a rule is a sequence of identifiers that must follow each other (other
sentences may stand between), and what it matched is used up. Identifiers that no rule used are reported as such.

Only texts with a cue that every known sentence contains are cut up; no sentence is lost by that. There is no shuffle.
Nulls: a null text has no sentences; a null id is kept. Texts are read whole. Repeated rows are rows. Empty tables give
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GPL_HEAD = "this {what} is free software you can redistribute it and or modify it under the terms of the gnu {name} as published by the free software foundation either version {version} of the license or at your option any later version"
_GPL_ONLY = "this {what} is free software you can redistribute it and or modify it under the terms of the gnu {name} version {version} as published by the free software foundation"
_GPL_WARRANTY = "this {what} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"
_DISCLAIMED = "including but not limited to the"
_BSD_HOLDER = "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
_BSD_BINARY = "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"

#: normalised sentence -> identifier
SENTENCES = {
    "licensed under the apache license version 2.0": "apache2-ref",
    "licensed under the apache license version 2.0 the license": "apache2-head",
    "you may not use this file except in compliance with the license": "apache2-comply",
    "you may obtain a copy of the license at": "apache2-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-asis",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-limits",
    "this work is licensed under the gnu general public license version 3": "gpl3-ref",
    "this work is licensed under the gnu general public license version 2": "gpl2-ref",
    "see the gnu general public license for more details": "gpl-details",
    "see the gnu lesser general public license for more details": "lgpl-details",
    "see the gnu affero general public license for more details": "agpl-details",
    "you should have received a copy of the gnu general public license along with this program": "gpl-received",
    "you should have received a copy of the gnu lesser general public license along with this library": "lgpl-received",
    "you should have received a copy of the gnu affero general public license along with this program": "agpl-received",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so": "mit0-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    f"the software is provided as is without warranty of any kind express or implied {_DISCLAIMED} warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    _BSD_HOLDER: "bsd-source",
    _BSD_BINARY: "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "neither the name of the copyright holders nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    f"this software is provided by the copyright holders and contributors as is and any express or implied warranties {_DISCLAIMED} implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2-head",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0": "mpl2-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0": "mpl2-copy",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0": "epl2-head",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1.0": "epl1-head",
    "the contents of this file are subject to the terms of the common development and distribution license the license": "cddl-head",
    "boost software license version 1.0": "bsl1-name",
    "distributed under the boost software license version 1.0": "bsl1-ref",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl1-grant",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "this notice may not be removed or altered from any source distribution": "zlib-notice",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed": "wtfpl-terms",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-grant",
    "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1.3 or any later version published by the free software foundation": "gfdl13-head",
    "use of this source code is governed by a bsd style license that can be found in the license file": "bsd-style-ref",
    "use of this source code is governed by an mit style license that can be found in the license file": "mit-style-ref",
}
_GNU = (("gpl", "general public license", (2, 3)), ("lgpl", "lesser general public license", ("2.1", 3)), ("agpl", "affero general public license", (3,)))
for _short, _name, _versions in _GNU:
    for _what in ("program", "library", "software", "file"):
        SENTENCES[_GPL_WARRANTY.format(what=_what)] = "gpl-warranty"
        for _v in _versions:
            SENTENCES[_GPL_HEAD.format(what=_what, name=_name, version=_v)] = f"{_short}{_v}plus-head"
            SENTENCES[_GPL_ONLY.format(what=_what, name=_name, version=_v)] = f"{_short}{_v}-head"
#: names of licences as a reference has them -> identifier of the reference (the licence itself is in REFERENCES)
REFERENCES = {
    "mit": ("MIT", ("mit license",)),
    "apache2": ("Apache-2.0", ("apache license 2.0", "apache 2.0 license", "apache license version 2.0")),
    "bsd2": ("BSD-2-Clause", ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license")),
    "bsd3": ("BSD-3-Clause", ("bsd 3 clause license", "3 clause bsd license", "new bsd license")),
    "isc": ("ISC", ("isc license",)),
    "mpl2": ("MPL-2.0", ("mozilla public license 2.0", "mozilla public license version 2.0")),
    "gpl2": ("GPL-2.0-only", ("gnu general public license version 2", "gnu gpl v2", "gpl v2", "gplv2")),
    "gpl3": ("GPL-3.0-only", ("gnu general public license version 3", "gnu gpl v3", "gpl v3", "gplv3")),
    "lgpl21": ("LGPL-2.1-only", ("gnu lesser general public license version 2.1", "lgpl v2.1", "lgplv2.1")),
    "lgpl3": ("LGPL-3.0-only", ("gnu lesser general public license version 3", "lgpl v3", "lgplv3")),
    "agpl3": ("AGPL-3.0-only", ("gnu affero general public license version 3", "agpl v3", "agplv3")),
    "epl2": ("EPL-2.0", ("eclipse public license 2.0",)),
    "bsl1": ("BSL-1.0", ("boost software license 1.0",)),
    "zlib": ("Zlib", ("zlib license",)),
    "unlicense": ("Unlicense", ("unlicense",)),
    "cc0": ("CC0-1.0", ("cc0 1.0 license", "creative commons zero v1.0 universal license")),
    "ccby4": ("CC-BY-4.0", ("creative commons attribution 4.0 international license", "cc by 4.0 license")),
    "ccbysa4": ("CC-BY-SA-4.0", ("creative commons attribution sharealike 4.0 international license", "cc by sa 4.0 license")),
    "ccbync4": ("CC-BY-NC-4.0", ("creative commons attribution noncommercial 4.0 international license", "cc by nc 4.0 license")),
    "ccbynd4": ("CC-BY-ND-4.0", ("creative commons attribution noderivatives 4.0 international license", "cc by nd 4.0 license")),
    "ccbyncsa4": ("CC-BY-NC-SA-4.0", ("creative commons attribution noncommercial sharealike 4.0 international license", "cc by nc sa 4.0 license")),
}
for _short, (_, _names) in REFERENCES.items():
    for _name in _names:
        for _by in ("released under the", "licensed under the", "distributed under the", "available under the", "this work is licensed under the", "this work is licensed under a", "this project is licensed under the", "this software is licensed under the", "this software is released under the"):
            SENTENCES.setdefault(f"{_by} {_name}", f"{_short}-ref")
for _short, _name in (("ccby4", "cc by 4.0"), ("ccbysa4", "cc by sa 4.0"), ("ccbync4", "cc by nc 4.0"), ("ccbynd4", "cc by nd 4.0"), ("ccbyncsa4", "cc by nc sa 4.0"), ("cc0", "cc0 1.0")):
    SENTENCES[f"licensed under {_name}"] = f"{_short}-ref"
#: licences that a machine-readable line may name, alone or two of them with OR or AND
SPDX = (
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "MIT-0", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only",
    "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "EPL-2.0", "BSL-1.0", "Zlib", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
)
_DUAL = ("MIT", "Apache-2.0", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "MPL-2.0")
for _one in SPDX:
    _plain = _one.lower().replace("-", " ")
    SENTENCES[f"spdx license identifier {_plain}"] = f"spdx-{_one.lower()}"
    for _two in _DUAL:
        for _word in ("or", "and"):
            if _one in _DUAL and _one != _two:
                SENTENCES[f"spdx license identifier {_plain} {_word} {_two.lower().replace('-', ' ')}"] = f"spdx-{_one.lower()}-{_word}-{_two.lower()}"
#: (licence, identifiers in a row), in the order in which they are tried
RULES = (
    ("BSD-3-Clause", ("bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-source", "bsd-binary")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT-0", ("mit0-grant", "mit-warranty")),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("0BSD", ("0bsd-grant", "isc-warranty")),
    ("Apache-2.0", ("apache2-head", "apache2-comply", "apache2-copy", "apache2-asis", "apache2-limits")),
    ("Apache-2.0", ("apache2-head", "apache2-comply", "apache2-copy")),
    ("Apache-2.0", ("apache2-head", "apache2-comply")),
    ("MPL-2.0", ("mpl2-head", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-head",)),
    *((f"{short.upper()}-{v if '.' in str(v) else f'{v}.0'}-{kind}", (f"{short}{v}{head}", *rest)) for short, _, versions in _GNU for v in versions for head, kind in (("plus-head", "or-later"), ("-head", "only"))
      for rest in (("gpl-warranty", f"{short}-details", f"{short}-received"), ("gpl-warranty", f"{short}-details"), ())),
    ("BSL-1.0", ("bsl1-name", "bsl1-grant")),
    ("BSL-1.0", ("bsl1-grant",)),
    ("Zlib", ("zlib-grant", "zlib-notice")),
    ("Unlicense", ("unlicense-grant",)),
    ("WTFPL", ("wtfpl-terms",)),
    ("EPL-2.0", ("epl2-head",)),
    ("EPL-1.0", ("epl1-head",)),
    ("CDDL-1.0", ("cddl-head",)),
    ("GFDL-1.3-or-later", ("gfdl13-head",)),
    *((licence, (f"{short}-ref",)) for short, (licence, _) in REFERENCES.items()),
    *((one, (f"spdx-{one.lower()}",)) for one in SPDX),
    *((f"{one} {word.upper()} {two}", (f"spdx-{one.lower()}-{word}-{two.lower()}",)) for one in _DUAL for two in _DUAL for word in ("or", "and") if one != two),
)
CUES = r"(?i)licen|permi(?:ssion|tted)|redistribution|warrant|gpl|mpl|notice|liable|compiled"  # each known sentence has one, whole in a word
_END, _PIECE = "\u0001", "\u0002"  # between sentences, and between pieces of one


def _cut(text: Column) -> Column:
    """The normalised text, with marks at the ends of sentences and of pieces."""
    steps = (
        (f"[{_END}{_PIECE}]", " "), (r"\r\n?", "\n"), (r"\n(?:[^\p{L}\p{N}\n]*\n)+", _END), (r"[.!?][ \t\n]+", _END), (r"[;:][ \t\n]+|\n", _PIECE), (f"[^a-z0-9.{_END}{_PIECE}]+", " "),
        (rf"\.+(?=[ {_END}{_PIECE}]|$)", ""), (f"[ {_PIECE}]*{_END}[ {_END}{_PIECE}]*", _END), (f" *{_PIECE}[ {_PIECE}]*", _PIECE), (" +", " "),
    )
    out = F.lower(text)
    for pattern, by in steps:
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def _known(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in order."""
    table = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    either = "|".join(s.replace(".", r"\.").replace(" ", f"[ {_PIECE}]") for s in sorted(SENTENCES, key=len, reverse=True))
    found = F.regexp_extract_all(_cut(text), F.lit(f"(?<![^{_END}{_PIECE}])(?:{either})(?![^{_END}{_PIECE}])"), F.lit(0))
    return F.transform(found, lambda s: F.element_at(table, F.translate(s, _PIECE, " ")))


def _pattern(identifiers: tuple[str, ...]) -> str:
    return "".join(f"<{i}>" for i in identifiers)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_known, identifiers, licenses, unresolved): identifiers in order; licences in order of rules, each once; identifiers no rule used."""
    own = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    known = own.select(id_col, F.when(F.col("_text").rlike(CUES), _known(F.col("_text"))).otherwise(F.array().cast("array<string>")).alias("ids"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(_pattern(i)).alias("pattern")) for name, i in RULES])
    start = F.struct(F.concat(F.lit(""), F.array_join(F.transform("ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")).alias("rest"), F.array().cast("array<string>").alias("names"))
    match = F.aggregate(
        rules, start,
        lambda acc, r: F.struct(
            F.replace(acc["rest"], r["pattern"], F.lit("|")).alias("rest"), F.when(F.contains(acc["rest"], r["pattern"]), F.array_append(acc["names"], r["name"])).otherwise(acc["names"]).alias("names")
        ),
    )
    matched = known.select(id_col, "ids", F.when(F.size("ids") > 0, match).alias("m"))
    return matched.select(
        F.col(id_col), F.size("ids").cast("long").alias("n_known"), F.array_join("ids", ",").alias("identifiers"), F.coalesce(F.array_join(F.array_distinct("m.names"), ","), F.lit("")).alias("licenses"),
        F.coalesce(F.array_join(F.filter(F.split(F.translate("m.rest", "<", ""), r"[>|]+"), lambda x: x != ""), ","), F.lit("")).alias("unresolved"),
    )


def op6_license_scan(docs: DataFrame) -> DataFrame:
    return scan(docs)


def oracle() -> str:
    """The same in SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    table = ", ".join(f"({quote(s)}, {quote(i)})" for s, i in SENTENCES.items())
    steps, last = [], "seq"
    for n, (name, ids) in enumerate(RULES):
        steps.append(f"r{n} AS (SELECT doc_id, rid, ids, replace(rest, {quote(_pattern(ids))}, '|') AS rest, CASE WHEN contains(rest, {quote(_pattern(ids))}) AND NOT list_contains(names, {quote(name)}) THEN list_append(names, {quote(name)}) ELSE names END AS names FROM {last})")
        last = f"r{n}"
    return rf"""
WITH known(sentence, ident) AS (VALUES {table}),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT rid, doc_id, regexp_split_to_array(regexp_replace(text, '([.;:!?])[ \t\r\n]+', '\1' || chr(10), 'g'), '[\r\n]+') AS parts FROM d),
s AS (SELECT rid, generate_subscripts(parts, 1) AS i, unnest(parts) AS part FROM p),
n AS (SELECT rid, i, trim(regexp_replace(regexp_replace(lower(part), '[^a-z0-9.]+', ' ', 'g'), '\.+( |$)', '\1', 'g')) AS sentence FROM s),
k AS (SELECT rid, list(ident ORDER BY i) AS ids FROM n JOIN known USING (sentence) GROUP BY rid),
seq AS (SELECT doc_id, d.rid, ids, coalesce('<' || array_to_string(ids, '><') || '>', '') AS rest, CAST([] AS VARCHAR[]) AS names FROM d LEFT JOIN k ON d.rid = k.rid),
{', '.join(steps)}
SELECT doc_id, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_known, coalesce(array_to_string(ids, ','), '') AS identifiers, array_to_string(names, ',') AS licenses,
       array_to_string(list_filter(regexp_split_to_array(replace(rest, '<', ''), '[>|]+'), lambda x: x <> ''), ',') AS unresolved
FROM {last}
"""
