"""Operators 11 to 13 against brute force, and on rows that go wrong."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from driftwood.llm import conversation_repair, ngram_join, token_align

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def classes(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def family(r, words, copies, edits):
    """Copies of a text, each with its own edits."""
    base = [f"w{r.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(copies):
        own = list(base)
        for _ in range(r.randrange(edits + 1)):
            own[r.randrange(words)] = f"e{r.randrange(10**6)}"
        out.append(r.choice([" ", "\n", "\t "]).join(own))
    return out


@pytest.mark.parametrize("blocks", [None, 3])
def test_jaccard_components_are_those_of_all_pairs(spark, rows, monkeypatch, blocks):
    r = random.Random(blocks)
    texts = [None, "", " \n", "one two", "One  TWO", "one two three four five", "one two three four five six", "\xa0 a b"]
    for words, copies, edits in ((60, 40, 2), (120, 30, 4), (30, 30, 1), (400, 8, 12)):
        texts += family(r, words, copies, edits)
    shared = " ".join(f"s{i}" for i in range(40))
    texts += [shared + " " + " ".join(f"x{r.randrange(10**6)}" for _ in range(9 + i % 3)) for i in range(40)]  # near the threshold, all on the same shingles
    if blocks:
        monkeypatch.setattr(ngram_join, "BLOCK_ROWS", blocks)
        monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 900)
    r.shuffle(texts)
    data = list(enumerate(texts))
    got = ngram_join.jaccard_components(spark.createDataFrame(data, "doc_id long, text string"))
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got.collect()) == classes(data)


def test_groups_that_meet_make_no_rows_for_their_pairs(spark, monkeypatch):
    made, real = {}, ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, name: made.setdefault(name, []).append(real(df, name)) or made[name][-1])
    words = lambda name, n: " ".join(f"{name}w{i}" for i in range(n))
    # a passage and five of 55 pieces: two texts share one piece at most, which 11 texts have, and are just not linked
    texts = [" ".join([words("p", 370), *(words(f"{j}v{(a * j + b) % 11}", 12) for j in range(5))]) for a in range(11) for b in range(11)]
    texts += [" ".join([words("p", 370), *(words(f"{j}v{j % 11}", 12) for j in range(4)), words("z", 11)])]
    got = ngram_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got.collect()) == classes(list(enumerate(texts)))
    members, met, closer = (made[x][-1].count() for x in ("members", "meeting", "closer"))
    assert 100 < closer <= met <= members


def test_filters_never_drop_a_link():
    r = np.random.default_rng(5)
    for _ in range(400):
        n, edits = int(r.integers(1, 300)), int(r.integers(0, 40))
        a = np.unique(r.integers(0, 1 << 62, n)).astype(np.uint64)
        b = np.unique(np.concatenate([a[r.permutation(len(a))[: max(1, len(a) - edits)]], r.integers(0, 1 << 62, edits).astype(np.uint64)]))
        common = np.intersect1d(a, b)
        if len(common) and 100 * len(common) >= 80 * (len(a) + len(b) - len(common)):
            i, j = np.searchsorted(a, common[0]), np.searchsorted(b, common[0])
            parts = [np.minimum(np.bincount((x & np.uint64(63)).astype(int), minlength=64), 255).astype(np.uint8) for x in (a, b)]
            assert ngram_join.may_link(np.array([len(a)]), np.array([len(b)]), np.array([i]), np.array([j]), parts[0][None], parts[1][None], 80).all()
            assert i <= len(a) - -(-80 * len(a) // 100) and j <= len(b) - -(-80 * len(b) // 100)


def test_join_on_odd_rows(spark, rows):
    odd = [(1, None), (None, "x y z"), (2, "X y\nz"), (4, "a"), (4, "a"), (5, "long " * 300_000), (6, "Ünï 漢字 😀\r\n\n\nend"), (None, None)]
    docs = spark.createDataFrame([(*x, 1, "s") for x in odd], "doc_id long, text string, n int, node string")
    got = rows(ngram_join.jaccard_components(docs).select("doc_id", "n_shingles", "component_id"))
    assert got == sorted([(1, 0, 1), (None, 1, 2), (2, 1, 2), (4, 1, 4), (4, 1, 4), (5, 1, 5), (6, 1, 6), (None, 0, None)], key=str)
    empty = ngram_join.jaccard_components(docs.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "text_hash", "n_shingles", "component_id"]


def brute_alignment(texts):
    """Whole texts by the two libraries, links by all pairs of byte ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(token_align.BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=token_align.PIECES)
    byte = token_align.byte_level()
    out, holds, linked = [], Counter(), []
    for text in texts:
        x = a.encode(" " + (text or ""), add_special_tokens=False).ids
        y = b.encode(text or "")
        xb = [bytes(byte[c] for c in a.id_to_token(i)) for i in x]
        yb = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) and b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in y)]
        raw = (" " + (text or "")).encode()
        if not text or b"".join(xb) != raw or b"".join(yb) != raw:
            out.append([0, 0, 0, 0, ""])
            linked.append(Counter())
            continue
        xe, ye = np.cumsum([len(t) for t in xb]), np.cumsum([len(t) for t in yb])
        both = np.intersect1d(xe, ye)
        groups, links, at = [], Counter(), 0
        for end in both:
            groups.append(",".join(str(i) for i, e in zip(x, xe) if at < e <= end) + "|" + ",".join(str(i) for i, e in zip(y, ye) if at < e <= end))
            at = end
        for i, e, t in zip(x, xe, xb):
            for j, f, u in zip(y, ye, yb):
                if max(e - len(t), f - len(u)) < min(e, f):
                    links[i, j] += 1
        out.append([len(x), len(y), len(both), sum(links.values()), hashlib.sha256(";".join(groups).encode()).hexdigest()])
        linked.append(links)
        holds.update(links.keys())
    best = {}
    for (i, _), n in holds.items():
        best[i] = max(best.get(i, 0), n)
    return [(*o, sum(c for p, c in links.items() if holds[p] == best[p[0]]), sum(c * holds[p] for p, c in links.items())) for o, links in zip(out, linked)]


def odd_texts(n):
    r = random.Random(n)
    parts = ["the", "Ein", "l'été", "don't", "x1y22", "漢字かな", "😀👍🏽", "<|endoftext|>", "<s>", "</s>", "<0x41>", " ", "  ", "\n", "\n\n ", "\t", "\r\n", "\xa0", "　", " ", "\u0085", "\x1c", "\x00", "!", "...", "_", "'s", "é", "▁", "ﬁ", "​", "i18n", "ANTIDIS", "ab"]
    return ["".join(r.choice(parts) + r.choice(["", " ", " ", "  "]) for _ in range(r.randrange(1, 30))) for _ in range(n)]


@pytest.mark.parametrize("limit", [token_align.BROADCAST_PAIRS, 0])
def test_alignment_is_brute_force(spark, limit):
    texts = [None, "", " ", "  ", "\n", "a", "a", "▁", "<|endoftext|>", "word " * 40, *odd_texts(150)]
    docs = spark.createDataFrame([(i // 2, t, 3, "x") for i, t in enumerate(texts)], "doc_id long, text string, pairs int, n string").repartition(3)
    got = token_align.token_alignment(docs, broadcast_pairs=limit).drop("text_hash").collect()
    want = [(i // 2, *x) for i, x in enumerate(brute_alignment(texts))]
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(x[1] > 0 for x in want) > 100


def test_stretches_that_come_again_are_aligned_once(monkeypatch):
    monkeypatch.setattr(token_align, "REMEMBERED", 60)
    memory, whole = (token_align.Memory(token_align.BYTE_BPE, token_align.PIECES) for _ in range(2))
    learned, real = Counter(), memory.learn
    memory.learn = lambda stretches: (learned.update(stretches), real(stretches))
    for i in range(15):
        texts = ["common words of all texts " + " ".join(f"w{i}x{j}" for j in range(20)), "y" * 100 + f" common {i}", None]
        texts += odd_texts(40) if i == 9 else []  # more that come again than are kept
        whole.forget()
        for got, want in zip(memory.aligned(texts), whole.aligned(texts), strict=True):
            assert np.array_equal(got, want)
        assert i == 9 or len(memory.groups) <= 90
        if i == 8:
            assert learned[" common"] == learned[" texts"] == 1 and learned[" w0x0"] == 1


def test_alignment_of_long_texts(spark, rows):
    texts = [" " * 300_000 + "x", "\n" * 300_000 + "x", "a" * 300_000, "漢" * 50_000, "ab " * 300_000]
    got = token_align.token_alignment(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    own = token_align.Encoders(token_align.BYTE_BPE, token_align.PIECES)
    for x in got:
        (a, b), = own.both([" " + texts[x["doc_id"]]])
        assert (x["n_a"], x["n_b"], x["n_links"]) == (len(a), len(b), len(a) + len(b) - x["n_groups"])
    empty = token_align.token_alignment(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0


SPACE = " \t\n\x0b\x0c\r"


def brute_repair(rows):
    """rows: (conv_id, turn, role, text), by the contract; strings of whole audits are compared."""
    by_conv = {}
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else x
        role, text = show(role), show(text)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        own = by_conv.setdefault(conv, [])
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, own in by_conv.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.rstrip(SPACE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        # any string of edits: states are what has been written, as an automaton by hand
        step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
        way = {x: (0, "", ()) if x in ("", "a") else (10**9, "", ()) for x in ("", "s", "u", "a")}

        def insert(way):
            for _ in range(4):
                for x in way:
                    for i, name in (("u", "user"), ("a", "assistant")):
                        if (x, i) in step:
                            c, e, t = way[step[x, i]]
                            way[x] = min(way[x], (c + 3, "I" + e, (f"{name}:", *t)))
            return way

        way = insert(way)
        for (_, role, text), fault in zip(reversed(own), reversed(faults)):
            now = {}
            for x in way:
                c, e, t = way[x]
                ways = [(c + 4, "D" + e, t)]
                if fault not in ("blank", "duplicate"):
                    more = 3 if fault == "truncated" else 0
                    for cost, letter, name in ((0, "K", role), (3, "R", "user"), (3, "R", "assistant")):
                        if (x, name[:1]) in step:
                            c, e, t = way[step[x, name[:1]]]
                            ways.append((c + cost + more, letter + e, (f"{name}:{text}", *t)))
                now[x] = min(ways)
            way = insert(now)
        cost, audit, lines = way[""]
        count = Counter(faults)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def odd_conversations(n):
    r, out = random.Random(n), []
    for conv in range(n):
        for turn in range(r.randrange(1, 25)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "ü"])
            text = r.choice([f"Hello {r.randrange(4)}.", "Yes!", "no", "", None, " \t", f"q{turn}?", "end. \n", "\xa0", "a" + " " * 50])
            out.append((r.choice([conv, conv, None]), r.choice([turn, turn * 3, 4, None]), role, text))
    return out


def test_repair_is_brute_force(spark, rows):
    data = odd_conversations(60)
    table = spark.createDataFrame([(*x, 1, "y") for x in data], "conv_id long, turn long, role string, text string, copy int, cost string").repartition(3)
    assert rows(conversation_repair.repaired(table)) == brute_repair(data)


def test_blocks_of_rows_give_the_same_path():
    """Ranks block by block, as of a long conversation, against one block."""
    r = random.Random(2)
    for _ in range(60):
        rows = [{"turn": i, "role": x, "text": "t.", "copy": 1, "initial": x[:1], "fault": r.choice([0, 0, 0, 1, 2, 3])} for i, x in enumerate(r.choice(["user", "assistant", "system", "tool"]) for _ in range(r.randrange(40)))]
        togo = conversation_repair.END
        for row in reversed(rows):
            row["togo"] = togo
            arcs = conversation_repair.row_costs(row["initial"], row["fault"])
            togo = conversation_repair.through_inserts([min(c + togo[to] for _, c, to in a) for a in arcs])
        found = []
        for size in (1, 4, 1000):
            repair = conversation_repair._Repair()
            conversation_repair.BLOCK, kept = size, conversation_repair.BLOCK
            for row in rows:
                repair.feed(row)
            conversation_repair.BLOCK = kept
            found.append(repair.row(1))
        assert found[0] == found[1] == found[2]


def test_least_path_needs_ranks_beyond_the_first():
    """Two arcs of one initial out of the start: only longer audits tell them apart."""
    node = np.array([0, 0, 1, 2, 3, 4])
    edit = np.array([ord(x) for x in "KKRRKD"])
    after = np.array([1, 2, 3, 4, 5, 5])
    assert conversation_repair.least_path(node, edit, after, 6, 0).tolist() == [1, 3, 5]


def test_repair_on_odd_rows(spark, rows):
    schema = "conv_id long, turn long, role string, text string"
    empty = conversation_repair.repaired(spark.createDataFrame([], schema))
    assert empty.count() == 0 and empty.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    nothing = hashlib.sha256(b"").hexdigest()
    assert rows(conversation_repair.repaired(spark.createDataFrame([(lost, 0, "user", "Hi.")], schema))) == [(lost, 0, 0, 0, 0, 0, 0, "", nothing)]
    long = [(7, i, ("user", "assistant")[i % 2], f"{i} " * 200 + ".") for i in range(20_000)]
    assert rows(conversation_repair.repaired(spark.createDataFrame(long, schema))) == brute_linear(long)


def brute_linear(rows):
    """brute_repair with audits joined at the end, for long conversations without ties."""
    conv = conversation_repair
    own = []
    for c, turn, role, text in rows:
        kind = zlib.crc32(f"{c}:{turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    seen, faults = set(), []
    for _, role, text in own:
        bare = text.rstrip(SPACE)
        faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    togo, costs = conv.END, [conv.END]
    for (_, role, _), fault in zip(reversed(own), reversed(faults)):
        togo = conv.through_inserts([min(c + togo[to] for _, c, to in a) for a in conv.row_costs(role[:1], fault)])
        costs.append(togo)
    costs.reverse()
    state, at, audit, lines = conv.START, 0, [], []
    while True:
        options = []
        if at < len(own):
            options = [(e, at + 1, to) for e, c, to in conv.row_costs(own[at][1][:1], faults[at])[state] if c + costs[at + 1][to] == costs[at][state]]
        to = conv.STEP[state, conv.WANTED[state]]
        if conv.INSERT + costs[at][to] == costs[at][state]:
            options.append(("I", at, to))
        if not options:
            break
        edit, after, to = min(options)
        audit.append(edit)
        if edit != "D":
            lines.append(f"{own[at][1] if edit == 'K' else conv.ROLE[conv.WANTED[state]]}:{own[at][2] if edit != 'I' else ''}")
        at, state = after, to
    turns = [t for t, _, _ in own]
    initials = [r[:1] for _, r, _ in own]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    count = Counter(faults)
    return [(7, max(turns) - min(turns) + 1 - len(set(turns)), count[1], count[2], count[3], illegal, costs[0][0], "".join(audit), hashlib.sha256("\n".join(lines).encode()).hexdigest())]
