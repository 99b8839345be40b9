"""The ten operators against brute force, public libraries and exact round trips, and on rows that go wrong."""

from __future__ import annotations

import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwood.llm import chat_format, html_extract, line_dedup, near_dedup, sentence_pieces, token_counts, url_filters
from driftwood.llm.decontaminate import contamination, decontaminated, winnow
from driftwood.llm.license_scan import license_scan
from driftwood.llm.quality_rules import quality, quality_filtered

FOLDER = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (4, "a"), (None, "x y z"), (5, "word " * 30_000), (6, "Ünï 漢字 😀\r\n\n\nend")]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*x, "s", 7, 8, True) for x in ODD], "doc_id long, text string, source string, n_words int, n_lines int, kept boolean")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "a"), (2, None), (3, ""), (None, "x y z")], "item_id long, text string")


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 4))) for _ in range(60)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared, out = say(14), []
    for i in range(150):
        text = say(rng.choice((0, 2, 5, 9, 10, 30, 80)))
        if i % 3 == 0 and out:
            text = list(out[rng.randrange(len(out))])
            for _ in range(rng.randint(0, 3)):
                if text:
                    text[rng.randrange(len(text))] = rng.choice(vocabulary).upper()
        if i % 7 == 0:
            at = rng.randint(0, len(text))
            text[at:at] = shared[rng.randint(0, 4) :]
        out.append(text)
    return spark.createDataFrame([(i, rng.choice((" ", ", ", "\n")).join(x)) for i, x in enumerate(out)], "doc_id long, text string"), shared


def shingles(text, k=5):
    w = words(text)
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()


def test_near_duplicates_are_the_components_of_all_pairs(corpus):
    docs = {r.doc_id: shingles(r.text) for r in corpus[0].collect()}
    parent = {i: i for i in docs}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in docs:
        for b in docs:
            if a < b and docs[a] and docs[b]:
                both = sum((docs[a] & docs[b]).values())
                if both >= 0.8 * (docs[a].total() + docs[b].total() - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    want = {i: find(i) for i in docs}
    got = near_dedup.near_duplicates(corpus[0]).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    assert {r.doc_id for r in got if r.first} == set(want.values())
    assert {r.doc_id for r in near_dedup.near_deduplicated(corpus[0]).collect()} == set(want.values())


def test_bag_minhash_is_unbiased():
    rng, m = np.random.default_rng(1), 4000
    h = rng.integers(1, 2**63, 40).astype(np.uint64)
    for _ in range(3):
        a, b = rng.integers(1, 40, 40), rng.integers(1, 40, 40)
        sig = near_dedup.bag_minhash(np.repeat([0, 1], 40), np.concatenate([h, h]), np.concatenate([a, b]), 2, m)
        assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_contamination_is_brute_force(spark, corpus):
    docs, shared = corpus
    bench = [(1, " ".join(shared)), (2, " ".join(shared[4:8])), (10, " ".join(shared[3:]).upper()), (3, "never here"), (4, shared[5])]
    items = spark.createDataFrame(bench, "item_id long, text string")
    want = {}
    for r in docs.collect():
        w, hit, ids = words(r.text), set(), set()
        for item, text in bench:
            v = words(text)
            n = min(10, len(v))
            windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    ids.add(item)
        want[r.doc_id] = (len(w), len(hit), sorted(ids, key=str))
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in contamination(docs, items).collect()}
    assert got == want and any(x[1] for x in want.values())
    assert {r.doc_id for r in decontaminated(docs, items).collect()} == {i for i, x in want.items() if not x[1]}


def test_winnowing_guarantee():
    rng = np.random.default_rng(5)
    a, b = (rng.integers(0, 50, 300).astype(np.uint64) for _ in range(2))
    b[100:110] = a[40:50]
    prints = [set(winnow(x, np.array([0, 300]), 10, 5)[1].tolist()) for x in (a, b)]
    assert prints[0] & prints[1]


@pytest.mark.parametrize("limit", [1_000_000, -1])
@pytest.mark.parametrize("keep", ["first", "none"])
def test_line_dedup(spark, limit, keep):
    rng = random.Random(4)
    rows = [(i, None if i == 7 else "\n".join(rng.choice(("  Foo bar\t", "foo BAR", "baz", "", f"own {i}", "two", "é" if i % 2 else "É")) for _ in range(rng.randint(1, 8)))) for i in range(40)]
    key = lambda x: x.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    seen: dict[str, set[int]] = {}
    for i, text in rows:
        for x in (text or "").split("\n"):
            seen.setdefault(key(x), set()).add(i)
    many = {k: min(v) for k, v in seen.items() if k and len(v) >= 10}
    want = {}
    for i, text in rows:
        kept, spared, n = [], set(), 0
        for x in (text or "").split("\n"):
            k = key(x)
            if k in many and not (keep == "first" and many[k] == i and k not in spared):
                n += 1
            else:
                kept.append(x)
                spared.add(k)
        want[i] = ("\n".join(kept), len((text or "").split("\n")), n)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.line_dedup(docs, 10, 1, keep, limit).collect()}
    assert got == want


@pytest.mark.parametrize("keep", ["first", "none"])
def test_line_dedup_joins_all_digests(spark, keep):
    keys = [f"line {i}" for i in range(4000)]
    assert sum(hashlib.md5(k.encode()).digest()[-1] == 0 for k in keys) > 5
    rows = [(i, "\n".join([*keys[i % 4 * 1000 : i % 4 * 1000 + 1000], f"own {i}"])) for i in range(12)]
    want = {i: text if keep == "first" and i < 4 else f"own {i}" for i, text in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for limit in (1_000_000, -1):
        got = line_dedup.line_dedup(docs, 2, 1, keep, limit).collect()
        assert {r.doc_id: r.text for r in got} == want
        assert sum(r.n_dropped for r in got) == (8000 if keep == "first" else 12000)


def test_pieces_are_those_of_the_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    rng = random.Random(6)
    texts = ["", "a", " ", "   lead and tail   ", "The  quick\tbrown 漢字 😀 fox\n\nnext é" * 3, "theringofthe" * 300, "😀ab𝕏é" * 60, " " * 3000 + "x"]
    texts += ["".join(rng.choice("ab \n the 漢é0.,") for _ in range(rng.randint(1, 200))) for _ in range(300)]
    for text in texts:
        ids = sentence_pieces.encode_text(sentence_pieces.MODEL, text).tolist()
        assert ids == (library.encode(text) if text else [])
        assert sentence_pieces.decode_ids(sentence_pieces.MODEL, ids) == text


def test_search_holds_a_window_and_finds_the_best_unigram_path():
    p = sentence_pieces._memory(sentence_pieces.MODEL).pieces
    search = sentence_pieces.Search(p)
    search.feed("thering" * 5000)
    assert search.held < 100 and len(search.text) < 100

    class Uni:
        bpe, byte, unknown, longest, worst = False, {}, 0, 3, -20.0
        ids = {"a": 1, "b": 2, "ab": 3, "ba": 4, "aba": 5}
        score = [0.0, -2.0, -2.1, -3.0, -2.5, -5.2]
        piece = ["", *ids]
        of_char = sentence_pieces.Pieces.of_char

    rng = random.Random(7)
    for _ in range(50):
        text = "".join(rng.choice("aabbx") for _ in range(rng.randint(1, 60)))
        best = [(0.0, [])]
        for i in range(1, len(text) + 1):
            options = [(best[i - n][0] + (Uni.score[Uni.ids[text[i - n : i]]] if text[i - n : i] in Uni.ids else -20.0), best[i - n][1] + [Uni.ids.get(text[i - n : i], 0)]) for n in range(1, min(3, i) + 1) if n == 1 or text[i - n : i] in Uni.ids]
            best.append(max(options, key=lambda x: x[0]))
        s = sentence_pieces.Search(Uni())
        s.feed(text)
        score = lambda ids: sum(-20.0 if x == 0 else Uni.score[x] for x in ids)
        assert abs(score(s.finish()) - best[-1][0]) < 1e-9


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_tokens_of_sections(spark, rule):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    library.encode_special_tokens = True
    texts = ["one two\n\n\n  three 漢字\nx", "a\n \n\n b", None, "", "\n", "😀é\n<|endoftext|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.section): r for r in token_counts.section_tokens(docs, rule=rule).collect()}
    for d, text in enumerate(texts):
        lines = (text or "").split("\n")
        starts = np.cumsum([0, *(len(x) + 1 for x in lines[:-1])])
        section = lambda c, starts=starts: int(np.searchsorted(starts, c, "right")) - 1
        want = Counter()
        for a, b in library.encode(text or "", add_special_tokens=False).offsets:
            held = Counter(section(c) for c in range(a, max(b, a + 1)))
            want[{"first": section(a), "last": section(max(b, a + 1) - 1), "most": min(held, key=lambda x: (-held[x], x))}[rule]] += 1
        for i, x in enumerate(lines):
            r = got.pop((d, i))
            assert (r.start, r.end, r.n_tokens) == (starts[i], starts[i] + len(x), want[i])
    assert not got


def test_chat(spark):
    odd_text = "\\<|end|>\n\\\\<|turn|> [INST] \\"
    rows = [(1, 2, "assistant", odd_text, 0), (1, 1, "user", "hi", 0), (2, 1, "assistant", None, 0), (2, 2, None, "x", 0), (2, 2, None, "x", 0), (None, 1, "us<|says|>er", "\n", 0), (3, None, "system", "", 0)]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seg int")
    segments = chat_format.chat_segments(talks)
    t = chat_format.Template()
    for r in segments.where("seg = 2").collect():
        assert not any(x in r.text for x in t.controls)
    want = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] or 0, r[2] or "", r[3] or ""))
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        want[conv] = (len(own), digest("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)), len(loss), digest(loss), conv in (1, 3))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.valid) for r in chat_format.chat_digests(segments).collect()}
    assert got == want
    assert chat_format.chat_digests(chat_format.chat_segments(talks.where("false"))).count() == 0


def test_url_filters(spark):
    entries = spark.createDataFrame(
        [("bad.com", "2024-01-10", "add"), ("bad.com", "2024-02-01", "remove"), ("bad.com", "2024-03-01", "add"), ("bad.com", "2024-03-01", "remove"), ("x.org/a", "2024-01-01", "add"), (None, "2024-01-01", "add"), ("y.org", None, "add"), ("bad.com", "2024-01-12", "other")],
        "key string, day string, action string",
    ).withColumn("day", F.to_date("day"))
    pages = [(1, "http://www.BAD.com:80/p?q", "2024-01-09", 0), (2, "http://www.BAD.com:80/p?q", "2024-01-10", 0), (3, "http://bad.com", "2024-02-01", 0), (4, "https://u@x.org/a/b#f", "2024-05-01", 0), (5, "https://x.org/ab", "2024-05-01", 1), (6, None, "2024-05-01", 0), (7, "nonsense", "2024-05-01", 0), (8, "http://notbad.com/", "2024-01-15", 0), (9, "http://bad.com/", None, 0), (2, "http://www.BAD.com:80/p?q", "2024-01-10", 0)]
    captures = spark.createDataFrame(pages, "page_id long, url string, fetched string, n_active int").withColumn("fetched", F.to_date("fetched"))
    got = url_filters.url_filtered(captures, entries).collect()
    assert sorted(r.page_id for r in got) == sorted(p[0] for p in pages)
    assert {r.page_id: r.entry for r in got if r.blocked} == {2: "bad.com", 4: "x.org/a"}


def test_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rows = [(1, mit), (2, mit.split("\n")[1]), (3, "Text. Released under the MIT License. More.\nlicensed under CC BY-NC 4.0"), (4, None), (5, ""), (6, "the MIT License")]
    got = {r.doc_id: r.licenses for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["MIT"], 2: [], 3: ["MIT", "CC-BY-NC-4.0"], 4: [], 5: [], 6: ["MIT"]}


COMMON = [
    ("MIT License\n\nCopyright (c) 2024 A. Body, Inc.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.", ["MIT"]),
    ("This is free and unencumbered software released into the public domain.", ["Unlicense"]),
    ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007", ["GPL-3.0"]),
    ("This software is provided 'as-is', without any express or implied\nwarranty.  In no event will the authors be held liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:", ["Zlib"]),
    ("Apache License\nVersion 2.0, January 2004", ["Apache-2.0"]), ("Boost Software License - Version 1.0 - August 17th, 2003", ["BSL-1.0"]),
    ("Released under the MIT license, see LICENSE", ["MIT"]), ("Text.\nlicensed under the MIT License - see the LICENSE file\nMore", ["MIT"]),
    ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", ["MIT", "Apache-2.0"]), ("// SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note", ["GPL-2.0-only"]),
    ("/* SPDX-License-Identifier: (MIT OR GPL-2.0-only) */", ["MIT", "GPL-2.0-only"]), ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]),
    ("Neither the name of " + "the Long Institute of Many Words and Names " * 20 + "nor the names of its\ncontributors may be used to endorse or promote products derived from this software\nwithout specific prior written permission.", []),
    ("Permission to use the room is granted. The software is late, under review; copyright law applies. See the license office.", []),
]


def test_common_license_texts(spark):
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame([(i, x) for i, (x, _) in enumerate(COMMON)], "doc_id long, text string")).collect()}
    assert {i: sorted(r.licenses) for i, r in got.items()} == {i: sorted(names) for i, (_, names) in enumerate(COMMON)}
    assert got[12].sentence_ids == ["bsd-name"] and got[13].sentence_ids == []


def test_search_in_parts_and_from_shared_characters():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    pieces = sentence_pieces.Pieces(sentence_pieces.MODEL)
    rng = random.Random(8)
    words = {sentence_pieces.MARK + "".join(rng.choice("etaoinshrdlu漢é0.") for _ in range(n - 1)) for n in [*range(60, 69), *range(2, 40)] * 8}
    memory = sentence_pieces._Memory(pieces)
    memory.learn(words)
    for word in words:
        search = sentence_pieces.Search(pieces)
        for part in re.findall("(?s).{1,7}", word):
            search.feed(part)
        want = library.encode(word[1:])
        assert search.finish() == want and np.frombuffer(memory[word], np.int32).tolist() == want


MIT = """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS"."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
BSD = """Copyright (c) 2020, Acme Inc. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of Acme Inc. nor the names of its contributors may be
   used to endorse or promote products derived from this software without
   specific prior written permission."""
ISC = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."
MPL = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."
LGPL = GPL.replace("This program", "Libfoo").replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1")


@pytest.mark.parametrize("mark", ["", "// ", " * ", "# ", "REM ", "C     ", "\r"])
def test_licenses_over_lines(spark, mark):
    if mark == "\r":
        prefixed = lambda x: x.replace("\n", "\r\n")
    else:
        prefixed = lambda x: "\n".join((mark + y).rstrip(" ") for y in x.split("\n"))
    want = [
        (MIT, "mit-grant,mit-notice", "MIT"), (APACHE, "apache2-ref,apache2-use,apache2-copy", "Apache-2.0"), (GPL, "gpl3-grant", "GPL-3.0-or-later"), (LGPL, "lgpl21-grant", "LGPL-2.1-or-later"),
        (BSD, "reserved,bsd-grant,bsd-source,bsd-binary,bsd-name", "BSD-3-Clause"), (BSD[: BSD.index("3. ")], "reserved,bsd-grant,bsd-source,bsd-binary", "BSD-2-Clause"), (ISC, "isc-grant", "ISC"), (MPL, "mpl2-ref,mpl2-copy", "MPL-2.0"),
        ("SPDX-License-Identifier: GPL-2.0-only\nint x;", "spdx-gpl-2-0-only", "GPL-2.0-only"), ("All rights\nreserved seats.", "", ""), ("Not all rights reserved.", "", ""), (f"{MIT}\n\n{MIT}", "mit-grant,mit-notice,mit-grant,mit-notice", "MIT"),
    ]
    docs = spark.createDataFrame([(i, prefixed(x)) for i, (x, *_) in enumerate(want)] + [(100 + i, " ".join(x.split())) for i, x in ((0, MIT[MIT.index("Permission") :]), (2, GPL))], "doc_id long, text string")
    got = {r.doc_id: (",".join(r.sentence_ids), ",".join(r.licenses), r.n_sentences) for r in license_scan(docs).collect()}
    bare = lambda x: ",".join(i for i in x.split(",") if i != "copyright" and not i.endswith("-title"))
    for i, (_, ids, names) in enumerate(want):
        assert (bare(got[i][0]), got[i][1]) == (ids, names) and got[i][2] == (len(got[i][0].split(",")) if got[i][0] else 0)
        if i in (0, 2):
            assert (bare(got[100 + i][0]), got[100 + i][1]) == (ids, names)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{FOLDER}/pages.parquet")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_html(spark, pages):
    rng = random.Random(99)
    composed = []
    for i in range(60):
        source = html_extract.compose([f"w{rng.randint(0, 400)}" for _ in range(300)], rng)
        page = html_extract.Page(source)
        composed.append((i, source, page.text(html_extract.labels(page) > 0)))
    odd_pages = [(1000, None), (1001, ""), (1002, "<"), (1003, "<p>a<p"), (1004, "<script>x"), (1005, "plain &amp text &#x41;\n\n b")]
    rows = [(i, "u", x) for i, x, *_ in [*composed, *odd_pages]]
    got = {r.page_id: r for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), pages).collect()}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got.values())
    right = sum(got[i].text == want for i, _, want in composed)
    assert right >= 48, right
    assert got[1000].text == got[1001].text == got[1004].text == ""


def test_tree_choice_is_never_contradictory():
    page = html_extract.Page("<body><div><p>a</p><p>b</p></div><nav><p>c</p></nav></body>")
    rng = np.random.default_rng(2)
    for _ in range(50):
        kept = page.decode(rng.random(len(page.tag)))
        assert all(kept[page.parent[i]] for i in range(1, len(kept)) if kept[i])


def test_quality_on_odd_rows(odd, spark):
    got = quality(odd).collect()
    assert len(got) == len(ODD)
    by = {(r.doc_id, r.n_words): r for r in got}
    assert by[1, 0].base_failed and not by[1, 0].kept
    long = by[5, 30_000]
    assert (long.n_repeat_words, long.word_chars, long.kept) == (30_000, 120_000, False)
    assert quality_filtered(odd).columns == odd.columns
    assert quality(odd.where("false")).count() == 0


def test_others_on_odd_rows(odd, items, spark):
    empty = odd.where("false")
    assert contamination(odd, items).count() == len(ODD) and contamination(empty, items).count() == 0
    assert contamination(odd, items.where("false")).where("n_hit > 0").count() == 0
    assert {(r.doc_id, r.n_hit, len(r.item_ids)) for r in contamination(odd, items).collect()} >= {(4, 1, 1), (None, 3, 0), (1, 0, 0)}
    out = line_dedup.line_dedup(odd, 2, 1, "none")
    assert out.columns == ["doc_id", "text", "source", "n_words", "kept", "n_lines", "n_dropped"] and out.count() == len(ODD)
    assert {r.text for r in out.where("doc_id = 4").collect()} == {""}
    assert line_dedup.line_dedup(empty).count() == 0
    classes = near_dedup.near_duplicates(odd).collect()
    assert len(classes) == len(ODD) and sorted(r.class_id for r in classes if r.doc_id == 4) == [4, 4]
    assert near_dedup.near_duplicates(empty).count() == 0
    assert sentence_pieces.encoded(odd).where("round_trip").count() == len(ODD)
    assert token_counts.section_tokens(odd).where("doc_id = 6").count() == 4
    assert license_scan(odd).count() == len(ODD)
    back = sentence_pieces.decoded(sentence_pieces.encoded(odd.where("doc_id = 6"))).first()
    assert back.text == ODD[-1][1]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    bench = {tuple(w[i : i + 10]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect() for w in [words(r.text)] for i in range(max(1, len(w) - 9))}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, FOLDER).cache()
        n = docs.count()
        if name == "quality rules":
            assert 0 < n < before.count()
        if name == "line dedup":
            assert n == before.count()
        if name == "benchmark decontamination":
            assert not any(tuple(w[i : i + 10]) in bench for r in docs.collect() for w in [words(r.text)] for i in range(max(1, len(w) - 9)))
        if not name.startswith("SentencePiece"):
            assert docs.columns == before.columns
    assert docs.columns == ["doc_id", "n_ids", "ids", "round_trip"] and docs.where("not round_trip").count() == 0
