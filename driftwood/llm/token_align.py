"""Alignment of the tokens of two tokenizers by the places where both end a token.

Both encode a space and the text. The cumulative byte ends of either's tokens
are the keys of a dictionary from end to index; the intersection of the two key
sets, sorted, cuts both id lists into groups, and within each group's slices all
overlapping pairs of tokens are linked. How many documents hold a pair of ids
linked is counted over all documents, and weighs the links of each.

At some places both are known to end a token: before a single space that a word
follows, around a single line end, and between a letter and a mark that no piece
joins to it. Text between two such places is aligned once, and a worker remembers
it, within a bound, for when it comes again.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.llm import bytes_
from driftwood.llm.rows import text_hash
from driftwood.sources.workspace import written

BYTE_BPE, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Stretches that a worker remembers, and the longest of them (some 120 MB in every Python worker).
REMEMBERED, LONGEST = 200_000, 64
#: Pairs of ids whose counts may be broadcast (16 bytes each).
BROADCAST_PAIRS = 2_000_000
#: Latin letters, and marks that may follow them.
LETTER, MARKS = "[A-Za-zÀ-ÖØ-öø-ɏ]", ".,;:!?"


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: printable Latin-1 is itself, other bytes follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoders:
    """The two tokenizers and the bytes of their tokens."""

    def __init__(self, a: str, b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        import sentencepiece
        import tokenizers

        self._a = tokenizers.Tokenizer.from_file(a)
        self._a.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_file=b)
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size()) if not self._b.is_byte(i)]
        if any(MARK in x.lstrip(MARK) or "\n" in x for x in pieces):
            raise ValueError("the piece model has pieces that go on into a space or over a line end")
        marks = "".join(c for c in MARKS if not any(re.search(LETTER + re.escape(c), x) for x in pieces))
        self.cut = re.compile(rf"(?<! )(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?={LETTER})|(?<={LETTER})(?=[{re.escape(marks)}\n])")
        byte = byte_level()
        vocabulary = self._a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in ((i, self._b.id_to_piece(i)) for i in range(self._b.get_piece_size()))]

    def both(self, stretches: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """The ids of stretches. The second tokenizer adds a space; to those without one a line end is put, and both are taken off again."""
        first = self._a.encode_batch_fast(stretches, add_special_tokens=False)
        second = self._b.encode([x[1:] if x[0] == " " else "\n" + x for x in stretches], num_threads=1)
        return ((x.ids, y if s[0] == " " else y[2:]) for s, x, y in zip(stretches, first, second, strict=True))


def end_index(ids: list[int], size: list[int]) -> dict[int, int]:
    """Where each token ends, in bytes, and how many tokens have ended there."""
    return dict(zip(accumulate(map(size.__getitem__, ids)), range(1, len(ids) + 1), strict=True))


def align(a: list[int], b: list[int], a_size: list[int], b_size: list[int]) -> tuple[list[tuple[list[int], list[int]]], list[tuple[int, int]]]:
    """The groups (slices of both id lists) and the links (pairs of ids, one for each overlapping pair of tokens) of tokens that tile the same bytes."""
    if len(a) == 1 or len(b) == 1:
        return [(a, b)], [(x, y) for x in a for y in b]
    a_ends, b_ends = end_index(a, a_size), end_index(b, b_size)
    groups, links, i, j = [], [], 0, 0
    for end in sorted(a_ends.keys() & b_ends.keys()):
        x, y = a[i : a_ends[end]], b[j : b_ends[end]]
        i, j = a_ends[end], b_ends[end]
        groups.append((x, y))
        if len(x) == 1 or len(y) == 1:
            links += [(p, q) for p in x for q in y]
            continue
        p, q = 0, 0
        left, right = a_size[x[0]], b_size[y[0]]  # where the tokens at p and q end; inside a group never both at once
        while True:
            links.append((x[p], y[q]))
            if left < right:
                p += 1
                left += a_size[x[p]]
            elif right < left:
                q += 1
                right += b_size[y[q]]
            else:
                break
    return groups, links


class Memory:
    """Aligned stretches by number: counts, groups as text, and links in a flat array."""

    def __init__(self, a: str, b: str) -> None:
        self.encoders = own = Encoders(a, b)
        self.a_size, self.b_size = ([len(x) for x in y] for y in (own.a_bytes, own.b_bytes))
        self.shown = [str(i) for i in range(max(len(own.a_bytes), len(own.b_bytes)))]
        self.radix = len(own.b_bytes)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts = array("q")  # of each stretch: tokens of both, groups, 1 if its bytes are not its tokens'
        self.links = array("q")  # of all stretches
        self.ends = array("q")  # where each one's links end
        self.uses = np.zeros(0, np.int64)  # how often each one came

    def keep_repeated(self) -> None:
        """Forgets the stretches that came once, or all if those that came again fill half of the bound."""
        at = np.flatnonzero(self.uses > 1)
        if len(at) > REMEMBERED // 2:
            self.forget()
            return
        names, groups = list(self.number), self.groups
        size, ends, links = (np.array(x, np.int64) for x in (self.counts, self.ends, self.links))
        many = np.diff(ends, prepend=0)[at]
        links = links[np.repeat(ends[at] - np.cumsum(many), many) + np.arange(many.sum())]
        self.forget()
        self.number = {names[i]: n for n, i in enumerate(at.tolist())}
        self.groups = [groups[i] for i in at.tolist()]
        self.counts, self.links, self.ends = (array("q", x.tobytes()) for x in (size.reshape(-1, 4)[at], links, np.cumsum(many)))
        self.uses = np.zeros(len(at), np.int64)

    def learn(self, stretches: list[str]) -> None:
        own, shown, radix = self.encoders, self.shown.__getitem__, self.radix
        a_bytes, b_bytes = own.a_bytes.__getitem__, own.b_bytes.__getitem__
        for at in range(0, len(stretches), 10_000):
            some = stretches[at : at + 10_000]
            for stretch, (a, b) in zip(some, own.both(some), strict=True):
                raw = stretch.encode()
                same = b"".join(map(a_bytes, a)) == raw and b"".join(map(b_bytes, b)) == raw
                groups, links = align(a, b, self.a_size, self.b_size) if same else ([], [])
                self.number[stretch] = len(self.groups)
                self.groups.append(";".join([f"{shown(x[0])}|{shown(y[0])}" if len(x) == len(y) == 1 else ",".join(map(shown, x)) + "|" + ",".join(map(shown, y)) for x, y in groups]))
                self.counts.extend((len(a), len(b), len(groups), not same))
                self.links.extend([x * radix + y for x, y in links])
                self.ends.append(len(self.links))

    def aligned(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of some texts: (tokens of both, groups, links) of each, their groups as text, and (text, pair, times) of their links."""
        cut = self.encoders.cut
        split = [[x for x in cut.split(" " + text) if x] if text and MARK not in text else [] for text in texts]
        new = {x: None for stretches in split for x in stretches if x not in self.number}
        self.learn([x for x in new if len(x) <= LONGEST])
        kept, kept_links = len(self.groups), len(self.links)
        self.learn([x for x in new if len(x) > LONGEST])
        size, ends, links = (np.array(x, np.int64) for x in (self.counts, self.ends, self.links))
        size, begins = size.reshape(-1, 4), np.append(0, ends)[:-1]

        doc = np.repeat(np.arange(len(texts)), [len(x) for x in split])
        places = [[self.number[x] for x in stretches] for stretches in split]
        at = np.fromiter(chain.from_iterable(places), np.int64, len(doc))
        self.uses = np.pad(self.uses, (0, kept - len(self.uses))) + np.bincount(at, minlength=len(self.groups))[:kept]
        total = np.zeros((len(texts), 4), np.int64)
        for i in range(4):
            total[:, i] = np.bincount(doc, size[at, i], len(texts))
        sound = total[:, 3] == 0
        doc, at = doc[sound[doc]], at[sound[doc]]
        total[~sound] = 0
        groups = [";".join(map(self.groups.__getitem__, own)) if ok else "" for own, ok in zip(places, sound.tolist(), strict=True)]

        many = ends[at] - begins[at]
        pair = links[np.repeat(begins[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        span = len(self.encoders.a_bytes) * self.radix
        key, times = np.unique(np.repeat(doc, many) * span + pair, return_counts=True)
        total[:, 3] = np.bincount(np.repeat(doc, many), minlength=len(texts))

        for x in new:
            if len(x) > LONGEST:
                del self.number[x]
        del self.groups[kept:], self.counts[4 * kept :], self.ends[kept:], self.links[kept_links:]
        if kept > REMEMBERED:
            self.keep_repeated()
        return total, groups, key // span, key % span, times


@lru_cache(maxsize=1)
def _memory(a: str, b: str) -> Memory:
    return Memory(a, b)


def _aligned(a: str, b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _memory(a, b)
        for batch, _, _ in bytes_.slices(batches):
            total, groups, doc, pair, times = memory.aligned(batch.column("text").to_pylist())
            digests = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in groups]
            bounds = pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int64())) for x in (pair, times)]
            columns = [*(pa.array(total[:, i]) for i in range(4)), pa.array(digests), pa.array(np.full(batch.num_rows, memory.radix))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *columns, *lists], ["doc_id", "text_hash", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "radix", "pairs", "times"])

    return run


def _weighed(counts: Broadcast, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = counts.value
        for batch in batches:
            pairs, times = (batch.column(x).flatten().to_numpy() for x in ("pairs", "times"))
            size = np.diff(batch.column("pairs").offsets.to_numpy())
            owner, at = np.repeat(np.arange(batch.num_rows), size), np.searchsorted(known, pairs)
            totals = []
            for x in (times * best[at], times * count[at]) if len(known) else (times, times):
                sums = np.zeros(batch.num_rows, np.int64)
                np.add.at(sums, owner, x)
                totals.append(pa.array(sums))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), *totals], [*names, "n_best", "count_sum"])

    return run


def token_alignment(docs: DataFrame, a: str = BYTE_BPE, b: str = PIECES, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """How the tokens of two tokenizers lie over each other in every whole text.

    docs: ``doc_id`` bigint, ``text``; other columns are ignored. ``a`` is a
    byte-level BPE vocabulary and ``b`` a piece model, paths that every executor
    can open. Returns a row per row: doc_id, text_hash, n_a and n_b (tokens),
    n_groups, n_links, groups_sha256 (hex, of ``a1,a2|b1;a3|b2,b3``: ids of the
    groups in order), n_best (links whose pair is in as many documents as any
    pair of its first id; ties count) and count_sum (documents that hold a
    link's pair, over all links).

    Texts that are null or empty, or whose joined token bytes differ from space
    and text for either tokenizer (so with U+2581, which the second one reads as
    a space), have no tokens: zeros and ''. They count for no pair. Repeated
    rows are documents of their own. An empty table gives an empty table. A very
    long text is one row; it is encoded in stretches between spaces, and a
    stretch without them as a whole.
    """
    docs = docs.select(F.col("doc_id").cast("long"), text_hash().alias("text_hash"), F.col("text").cast("string"))
    names = ["doc_id", "text_hash", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = "doc_id long, text_hash long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    aligned = written(docs.mapInArrow(_aligned(a, b), schema + ", radix long, pairs array<long>, times array<long>"), "aligned")

    pairs = aligned.select("radix", F.explode("pairs").alias("pair")).groupBy("pair", "radix").agg(F.count("*").alias("n")).withColumn("first", F.expr("pair div radix"))
    pairs = written(pairs.select("pair", "first", "n"), "pair-counts")
    most = pairs.groupBy("first").agg(F.max("n").alias("most"))
    counts = pairs.join(most, "first").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    if pairs.count() <= broadcast_pairs:
        rows = counts.toArrow()
        pair, n, best = (rows[x].to_numpy() for x in ("pair", "n", "best"))
        order = np.argsort(pair)
        sent = docs.sparkSession.sparkContext.broadcast((pair[order], n[order], best[order].astype(np.int8)))
        return aligned.select(*names, "pairs", "times").mapInArrow(_weighed(sent, names), schema + ", n_best long, count_sum long")

    each = aligned.dropDuplicates(["doc_id", "text_hash"]).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), F.inline(F.arrays_zip("pairs", "times")))
    sums = each.join(counts, each["pairs"] == counts["pair"]).groupBy("id", "hash").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long")).alias(x)
    return aligned.select(names).join(sums, same, "left").select(*names, zero("n_best"), zero("count_sum"))
