"""License scans by sentence rules.

A text is cut into pieces, at line ends and after . ! ? : ; before white space, and
each piece is normalised: comment marks at its start go, A-Z is lower-cased, and
every run of other characters than a-z and 0-9 is one blank. A sentence is a piece
or several in a row, as lines are wrapped; pieces without words don't count. A
hash table maps sentences to identifiers. Names of holders and the like are taken
for placeholders by patterns; references to a licence are made by rule, of a
phrase, a name and an ending. What remains of a text is the sequence of its
identifiers, and ordered rules, the most specific first, match runs of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.sources.workspace import shipped

#: Pieces that one sentence may be wrapped over.
WRAPPED = 24

# Normalised sentences of public licences, with the identifiers that they stand for.
_FREE = "free software you can redistribute it and or modify it under the terms of the gnu %s as published by the free software foundation either version %s of the license or at your option any later version"
_ONLY = "free software you can redistribute it and or modify it under the terms of the gnu %s version %s as published by the free software foundation"
_GNU = [("general public license", "2", "gpl2"), ("general public license", "3", "gpl3"), ("library general public license", "2", "lgpl2"), ("lesser general public license", "2", "lgpl2"), ("lesser general public license", "2 1", "lgpl21"), ("lesser general public license", "3", "lgpl3"), ("affero general public license", "3", "agpl3")]
_PROVIDED = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BINARY = "in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_ENDORSE = "be used to endorse or promote products derived from this software without specific prior written permission"
SENTENCES: dict[str, str] = {
    # MIT and relatives
    "mit license": "mit-title", "the mit license": "mit-title", "the mit license mit": "mit-title", "mit license mit": "mit-title", "expat license": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so": "mit0-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    # Apache
    "apache license version 2 0 january 2004": "apache2-title", "apache license version 2 0": "apache2-title", "apache license 2 0": "apache2-title",
    "terms and conditions for use reproduction and distribution": "apache2-terms", "licensed under the apache license version 2 0 the license": "apache2-ref",
    "you may not use this file except in compliance with the license": "apache2-use", "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache2-copy",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "apache2-copy", "you may obtain a copy of the license at": "apache2-copy-at", "http www apache org licenses license 2 0": "apache2-url", "https www apache org licenses license 2 0": "apache2-url",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-warranty",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-see",
    # GNU
    **{f"gnu {name} version {v} {day}": f"{i}-title" for (name, v, i), day in zip(_GNU, ("june 1991", "29 june 2007", "june 1991", "", "february 1999", "29 june 2007", "19 november 2007"), strict=True) if day},
    **{f"gnu {name} version {v}": f"{i}-title" for name, v, i in _GNU},
    "this work is licensed under the gnu general public license version 3": "gpl3-ref",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gnu-warranty",
    "you should have received a copy of the gnu general public license along with this program": "gnu-copy", "you should have received a copy of the gnu lesser general public license along with this library": "gnu-copy", "you should have received a copy of the gnu affero general public license along with this program": "gnu-copy",
    "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed": "gnu-verbatim",
    # BSD
    **{f"bsd {n} clause license": f"bsd{n}-title" for n in "234"}, "the bsd license": "bsd-title", "bsd license": "bsd-title", "bsd zero clause license": "0bsd-title",
    _PROVIDED: "bsd-grant", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source", f"redistributions {_BINARY}": "bsd-binary",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advertising",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "bsd-liability",
    # ISC, zlib, Boost, public domain and others
    "isc license": "isc-title", "the isc license": "isc-title",
    **{f"permission to use copy modify {x} distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant" for x in ("and", "and or")},
    **{f"permission to use copy modify {x} distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant" for x in ("and", "and or")},
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "zlib license": "zlib-title", "the zlib license": "zlib-title", "this software is provided as is without any express or implied warranty": "zlib-warranty", "in no event will the authors be held liable for any damages arising from the use of this software": "zlib-liability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "boost software license version 1 0 august 17th 2003": "boost-title", "boost software license version 1 0": "boost-title", "distributed under the boost software license version 1 0": "boost-ref",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "boost-grant",
    "this is free and unencumbered software released into the public domain": "unlicense-grant", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-anyone",
    "do what the fuck you want to public license": "wtfpl-title", "you just do what the fuck you want to": "wtfpl-grant",
    "mozilla public license version 2 0": "mpl2-title", "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-ref",
    **{f"if a copy of the mpl was not distributed with this file you can obtain one at {x} mozilla org mpl 2 0": "mpl2-copy" for x in ("http", "https")},
    "eclipse public license v 2 0": "epl2-title", "eclipse public license v 1 0": "epl1-title", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0": "epl2-ref",
    "cc0 1 0 universal": "cc0-title", "creative commons legal code": "cc-title", "all rights reserved": "reserved",
    # more than one licence
    **{f"{x} under either of apache license version 2 0 or mit license at your option": "apache2-ref,mit-ref" for x in ("licensed", "dual licensed")}, **{f"dual licensed under {x}": "apache2-ref,mit-ref" for x in ("apache 2 0 and mit", "mit and apache 2 0", "the mit and apache 2 0 licenses", "the apache 2 0 and mit licenses", "mit or apache 2 0", "apache 2 0 or mit")},
}
#: Sentences with placeholders, as patterns over a whole normalised sentence (of both engines), with their identifiers.
PATTERNS: list[tuple[str, str]] = [
    *((f"(?:.+ )?(?:is|are) {_FREE % (name, v)}", f"{i}-grant") for name, v, i in _GNU),
    *((f"(?:.+ )?(?:is|are) {_ONLY % (name, v)}", f"{i}-only") for name, v, i in _GNU),
    (f"(?:[0-9a-z] )?neither the names? of .+ nor the names of .+ may {_ENDORSE}", "bsd-name"), (f"(?:[0-9a-z] )?(?:the )?names? of .+ may not {_ENDORSE}", "bsd-name"),
    ("(?:[0-9a-z] )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd-source"), (f"(?:[0-9a-z] )?redistributions {_BINARY}", "bsd-binary"),
    ("(?:[0-9a-z] )?all advertising materials mentioning features or use of this software must display the following acknowledgement .+", "bsd-advertising"),
    ("this software is provided by .+ as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", "bsd-warranty"),
]
#: A notice of one piece.
COPYRIGHT = "(?:c )?copyright (?:c |[0-9]{4}).*"
#: References by rule: a phrase, a name with its identifier, and an ending make a sentence.
PHRASES = [f"{x}{y} under {z}" for x in ("", "this project is ", "this software is ", "this work is ", "this code is ") for y in ("licensed", "released", "distributed", "available") for z in ("", "the ", "a ", "the terms of the ")]
ENDINGS = ["", " see license", " see the license file", " see license file for details", " see the license file for details", " see license for details", " see license txt", " which can be found in the license file"]
_CC = [("attribution", "by"), ("attribution sharealike", "by-sa"), ("attribution share alike", "by-sa"), ("attribution noderivatives", "by-nd"), ("attribution noncommercial", "by-nc"), ("attribution noncommercial sharealike", "by-nc-sa"), ("attribution noncommercial noderivatives", "by-nc-nd")]
NAMES: dict[str, str] = {
    "mit license": "mit", "apache license version 2 0": "apache2", "apache license 2 0": "apache2", "apache 2 0 license": "apache2", "apache software license version 2 0": "apache2",
    **{f"{a} {b}": f"{i}" for n, i in (("general public license", "gpl"), ("lesser general public license", "lgpl"), ("affero general public license", "agpl")) for v, s in (("2", "2"), ("2 1", "21"), ("3", "3"), ("3 0", "3"), ("2 0", "2")) for a in (f"gnu {n}",) for b, i in ((f"version {v}", f"{i}{s}"), (f"v{v}", f"{i}{s}"))},
    "gplv3": "gpl3", "gplv2": "gpl2", "gpl v3": "gpl3", "gpl v2": "gpl2", "gpl 3 0": "gpl3", "gpl 2 0": "gpl2", "lgplv3": "lgpl3", "lgplv2 1": "lgpl21", "agplv3": "agpl3", "agpl v3": "agpl3",
    "bsd license": "bsd3", "bsd 2 clause license": "bsd2", "bsd 3 clause license": "bsd3", "2 clause bsd license": "bsd2", "3 clause bsd license": "bsd3", "new bsd license": "bsd3", "simplified bsd license": "bsd2", "isc license": "isc", "zlib license": "zlib",
    "boost software license version 1 0": "boost", "mozilla public license 2 0": "mpl2", "mozilla public license version 2 0": "mpl2", "mpl 2 0": "mpl2", "eclipse public license 2 0": "epl2", "eclipse public license v 2 0": "epl2", "unlicense": "unlicense", "cc0 1 0 universal license": "cc0", "cc0": "cc0", "cc0 1 0": "cc0", "wtfpl": "wtfpl",
    **{f"cc {i.replace('-', ' ')} {v} 0": f"cc-{i}-{v}" for i in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd") for v in "34"},
    **{f"creative commons {n} {v} 0 {p}license": f"cc-{i}-{v}" for n, i in _CC for v, p in (("4", "international "), ("4", ""), ("3", "unported "), ("3", ""))},
}
#: What the identifiers of references and titles stand for.
LICENSES: dict[str, str] = {
    "mit": "MIT", "apache2": "Apache-2.0", "gpl2": "GPL-2.0", "gpl3": "GPL-3.0", "lgpl2": "LGPL-2.0", "lgpl21": "LGPL-2.1", "lgpl3": "LGPL-3.0", "agpl3": "AGPL-3.0", "bsd2": "BSD-2-Clause", "bsd3": "BSD-3-Clause", "bsd4": "BSD-4-Clause", "bsd": "BSD-3-Clause", "0bsd": "0BSD", "isc": "ISC", "zlib": "Zlib",
    "boost": "BSL-1.0", "mpl2": "MPL-2.0", "epl1": "EPL-1.0", "epl2": "EPL-2.0", "unlicense": "Unlicense", "cc0": "CC0-1.0", "wtfpl": "WTFPL", **{f"cc-{i}-{v}": f"CC-{i.upper()}-{v}.0" for i in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd") for v in "34"},
}
#: SPDX names by their normalised form ("GPL-2.0+" and "GPL-2.0" have the same), and exceptions.
SPDX: dict[str, str] = {
    re.sub("[^a-z0-9]+", " ", x.lower()): x
    for x in ("MIT", "MIT-0", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "ISC", "Zlib", "Unlicense", "0BSD", "BSL-1.0", "MPL-1.1", "MPL-2.0", "EPL-1.0", "EPL-2.0", "CDDL-1.0", "EUPL-1.2", "WTFPL", "CC0-1.0", *(f"CC-{i}-{v}.0" for i in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND") for v in (3, 4)), *(f"{x}{y}" for x in ("GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for y in ("", "-only", "-or-later")))
}
EXCEPTIONS = ["linux syscall note", "classpath exception 2 0", "gcc exception 3 1", "gcc exception 2 0", "llvm exception", "autoconf exception 3 0", "bison exception 2 2", "font exception 2 0", "openjdk assembly exception 1 0"]
_SPDX_NAMES = "|".join(sorted(SPDX, key=lambda x: (-len(x), x)))
SPDX_LINE = f"(?:.* )?spdx license identifier ((?:{_SPDX_NAMES})(?: (?:or|and) (?:{_SPDX_NAMES})| with (?:{'|'.join(EXCEPTIONS)}))*)"
SPDX_NAME = f"(?:{_SPDX_NAMES})"
_BSD = ("bsd-grant", "bsd-source", "bsd-binary")
#: Rules in order: licence, and the run of identifiers that stands for it. The line "All rights reserved" above a BSD text belongs to it.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("MIT", ("mit-grant", "mit-notice")), ("MIT-0", ("mit0-grant", "mit-warranty")), ("MIT", ("mit-title", "copyright", "mit-warranty")), ("MIT", ("mit-warranty", "mit-liability")),
    *((name, (*before, *run)) for name, run in (("BSD-4-Clause", (*_BSD, "bsd-advertising", "bsd-name")), ("BSD-3-Clause", (*_BSD, "bsd-name")), ("BSD-2-Clause", _BSD)) for before in (("reserved",), ())),
    ("Apache-2.0", ("apache2-ref", "apache2-use", "apache2-copy")), ("Apache-2.0", ("apache2-ref", "apache2-use", "apache2-copy-at", "apache2-url")), ("Apache-2.0", ("apache2-title", "apache2-url")),
    *((f"{LICENSES[i]}-or-later", (f"{i}-grant",)) for i in ("agpl3", "lgpl3", "lgpl21", "lgpl2", "gpl3", "gpl2")), *((f"{LICENSES[i]}-only", (f"{i}-only",)) for i in ("agpl3", "lgpl3", "lgpl21", "lgpl2", "gpl3", "gpl2")),
    ("ISC", ("isc-grant",)), ("0BSD", ("0bsd-grant",)), ("Zlib", ("zlib-warranty", "zlib-liability", "zlib-grant")), ("Zlib", ("zlib-grant",)), ("BSL-1.0", ("boost-grant",)), ("Unlicense", ("unlicense-grant",)), ("WTFPL", ("wtfpl-grant",)), ("MPL-2.0", ("mpl2-ref", "mpl2-copy")),
    *((name, (f"{i}-ref",)) for i, name in LICENSES.items()), *((name, (f"{i}-title",)) for i, name in LICENSES.items()),
    *((name, (f"spdx-{x.replace(' ', '-')}",)) for x, name in SPDX.items()),
    ("proprietary", ("reserved",)),
]


#: One of these is in every known sentence.
ANCHORS = ("licens", "copyright", " under", "reserved", "permi", "redistribut", "liable", "warrant", "advertising", "endorse", "gnu", "software", "spdx", "copy", "universal", "commons", "fuck", "conditions")
#: Sentences with placeholders have one of these in their first two pieces.
START = "(?:is|are) free software you|neither the name|names? of|redistributions|all advertising|this software is provided by|spdx license"


@lru_cache(maxsize=1)
def table() -> dict[str, str]:
    """All sentences without placeholders: those of SENTENCES, and references by rule."""
    return {f"{p}{n}{e}": f"{i}-ref" for n, i in NAMES.items() for p in PHRASES for e in ENDINGS} | SENTENCES


_MARK = re.compile(r"(?m)^[ \t]*+(?:C|REM|rem|dnl|@c)(?=[ \t]|$)")
_CUT = re.compile(r"\n|(?<=[.!?:;])[ \t\r]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORDS = re.compile(r"[a-z0-9]+")
_START, _COPYRIGHT, _SPDX_LINE, _SPDX_NAME = map(re.compile, (START, COPYRIGHT, SPDX_LINE, SPDX_NAME))


@lru_cache(maxsize=1)
def _known() -> tuple[dict[str, str], frozenset[str], int, list[tuple[re.Pattern, str]]]:
    """The table, its first words, its longest sentence in characters, and the compiled patterns."""
    known = table()
    if unfound := [x for x in known if not any(a in x for a in ANCHORS)]:
        raise ValueError(f"no anchor in {unfound[:3]}")
    return known, frozenset(x.split(" ", 1)[0] for x in known), max(map(len, known)), [(re.compile(p), i) for p, i in PATTERNS]


def ids_of(sentence: str, pieces: int, placeholders: bool) -> str | None:
    """The identifiers, between commas, of a normalised sentence of some pieces."""
    known, _, _, patterns = _known()
    if (found := known.get(sentence)) is not None:
        return found
    if pieces == 1 and _COPYRIGHT.fullmatch(sentence):
        return "copyright"
    if placeholders:
        for pattern, i in patterns:
            if pattern.fullmatch(sentence):
                return i
        if m := _SPDX_LINE.fullmatch(sentence):
            return ",".join(f"spdx-{x.replace(' ', '-')}" for x in _SPDX_NAME.findall(m[1]))
    return None


def sentence_ids(text: str | None) -> list[str]:
    """Identifiers of the known sentences of a text, in order. Of those that start at one piece the longest counts; they do not overlap."""
    low = (text or "").lower()
    if not any(x in low for x in ANCHORS):
        return []
    pieces = [" ".join(w) for x in _CUT.split(_MARK.sub("", text).translate(_LOWER)) if (w := _WORDS.findall(x))]
    _, heads, longest, _ = _known()
    out, at = [], 0
    while at < len(pieces):
        placeholders = bool(_START.search(" ".join(pieces[at : at + 2])))
        best, end, joined = None, at + 1, ""
        if placeholders or pieces[at].split(" ", 1)[0] in heads or "copyright" in pieces[at]:
            for n, piece in enumerate(pieces[at : at + WRAPPED], 1):
                joined = f"{joined} {piece}" if joined else piece
                if not placeholders and n > 1 and len(joined) > longest:
                    break
                if (found := ids_of(joined, n, placeholders)) is not None:
                    best, end = found, at + n
        if best:
            out += best.split(",")
        at = end
    return out


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sentence_ids(x) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.string()))], ["doc_id", "sentence_ids"])


def license_scan(docs: DataFrame, rules: list[tuple[str, tuple[str, ...]]] | None = None) -> DataFrame:
    """The licences of each whole text.

    docs: ``doc_id`` bigint, ``text``; other columns are ignored. Returns
    doc_id, n_sentences (known ones), sentence_ids (array, in order) and
    licenses (array of names in the order of the rules, each once). A rule
    matches a run of neighbouring known sentences; what a rule matched is
    taken out for later rules. Null and empty texts have none; every row has
    its result, repeated rows too; an empty table gives no rows. A very long text
    is read piece by piece, and of it only the pieces are held.
    """
    rows = shipped(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scanned, "doc_id long, sentence_ids array<string>")
    # ids between bars; a taken run leaves a gap that no later run crosses
    left = F.concat(F.lit("|"), F.array_join("sentence_ids", "||"), F.lit("|"))
    found = []
    for name, run in RULES if rules is None else rules:
        mark = "|" + "||".join(run) + "|"
        found.append(F.when(F.contains(left, F.lit(mark)), F.lit(name)))
        left = F.replace(left, F.lit(mark), F.lit("-"))
    names = F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull()))
    none = F.array().cast("array<string>")
    return rows.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), "sentence_ids", F.when(F.size("sentence_ids") > 0, names).otherwise(none).alias("licenses"))
