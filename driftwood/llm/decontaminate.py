"""Benchmark decontamination by winnowing.

Of every window of w consecutive k-gram hashes the minimum is kept, in items and
in texts alike. Two texts that share n = k + w - 1 words share the window and so
its minimum: every shared span of n words has a common fingerprint. Text
fingerprints are tested against a bounded Bloom filter of the item fingerprints;
those that pass are extended to all windows of n words around them, and the
digests of these windows join the item windows, which decides exactly.

Items of fewer than n words are one window; its hash over all its words serves
as fingerprint, and texts are tested at every place for the lengths that occur.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.llm import bloom, bytes_
from driftwood.llm.rows import small, text_hash, without
from driftwood.sources.workspace import written


def _sliding(x: np.ndarray, w: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over w neighbours from each place on."""
    done = 1
    while done < w:
        step = min(done, w - done)
        x = best(x[: len(x) - step], x[step:])
        done += step
    return x


def winnow(word: np.ndarray, first: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (first words) and hashes of the selected k-grams of texts given as word hashes; ties are all kept."""
    w, h = n - k + 1, bytes_.grams(word, k)
    if len(word) < n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = np.maximum(h, np.uint64(1))
    least = _sliding(h, w, np.minimum)
    doc = bytes_.owners(first)
    least[doc[: len(least)] != doc[n - 1 :]] = 0  # a window that leaves its text selects nothing
    edge = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(h == _sliding(np.concatenate([edge, least, edge]), w, np.maximum))
    return at, h[at]


def _window_digest(spans: bytes_.Spans, at: int, n: int) -> bytes:
    return hashlib.md5(b" ".join(spans.lowered(i) for i in range(at, at + n))).digest()


def _item_windows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in bytes_.slices(batches):
            spans, rows = bytes_.words(data, off), []
            for item, a, b in zip(batch.column("item_id").to_pylist(), spans.first[:-1].tolist(), spans.first[1:].tolist(), strict=True):
                size = min(n, b - a)
                rows += [(_window_digest(spans, i, size), item) for i in range(a, b - size + 1) if size]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())], ["digest", "item_id"])

    return run


def _item_fingerprints(n: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, off in bytes_.slices(batches):
            spans = bytes_.words(data, off)
            word = spans.hashes()
            _, h = winnow(word, spans.first, n, k)
            long_ones = [pa.array(h.view(np.int64)), pa.array(np.full(len(h), n, np.int32))]
            short = [(i, c) for i, c in zip(spans.first[:-1].tolist(), spans.counts.tolist(), strict=True) if 0 < c < n]
            short_h = np.array([bytes_.grams(word[i : i + c], c)[0] for i, c in short], np.uint64)
            short_ones = [pa.array(short_h.view(np.int64)), pa.array([c for _, c in short], pa.int32())]
            for x in (long_ones, short_ones):
                yield pa.RecordBatch.from_arrays(x, ["h", "n"])

    return run


def _doc_candidates(n: int, k: int, short: list[int], known: Broadcast, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in bytes_.slices(batches):
            spans = bytes_.words(data, off)
            word, first, doc = spans.hashes(), spans.first, bytes_.owners(spans.first)
            at, h = winnow(word, first, n, k)
            at = at[bloom.held(known.value, h, bits)]
            starts = np.unique((at[:, None] - np.arange(n - k + 1)).ravel())
            starts = starts[(starts >= 0) & (starts + n <= len(doc))]
            starts = starts[doc[starts] == doc[starts + n - 1]]
            found = [(starts, n)]
            for c in short:
                at = np.flatnonzero(bloom.held(known.value, bytes_.grams(word, c), bits))
                found.append((at[doc[at] == doc[at + c - 1]], c))
            windows = [(int(doc[i]), i - int(first[doc[i]]), c, _window_digest(spans, i, c)) for at, c in found for i in at.tolist()]
            windows.sort(key=lambda x: x[0])
            bounds = pa.array(np.searchsorted([x[0] for x in windows], np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, pa.array([x[i] for x in windows], t)) for i, t in ((1, pa.int32()), (2, pa.int32()), (3, pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(spans.counts), *lists], ["doc_id", "text_hash", "n_words", "at", "n", "digest"])

    return run


def contamination(docs: DataFrame, items: DataFrame, n: int = 10, k: int = 5) -> DataFrame:
    """Which words of which texts stand in windows of ``n`` words of benchmark items.

    docs: ``doc_id`` bigint, ``text``; items: ``item_id`` bigint, ``text``;
    other columns are ignored. Words are runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]
    after A-Z became a-z. An item's windows are its runs of n words; an item of
    fewer words is one window, one without words has none.

    Returns, for each row of docs: doc_id, text_hash, n_words, n_hit (words
    inside any occurrence of a window), item_ids (array of bigint, those with
    an occurring window, sorted as strings) and hits (array of start and n: the
    windows, by word). Null and empty texts have no words. Null item ids take
    part in n_hit but are not listed. Repeated rows are each returned. An empty
    table of docs gives none, an empty table of items no hits; windows that
    several items share count for each of them. A very long text is one row,
    hashed slice by slice.
    """
    if not 1 <= k <= n:
        raise ValueError("k lies between 1 and n")
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    prints = written(items.mapInArrow(_item_fingerprints(n, k), "h long, n int"), "item-fingerprints")
    windows = written(items.mapInArrow(_item_windows(n), "digest binary, item_id long").distinct(), "item-windows")
    digests = written(windows.select("digest").distinct(), "item-digests")
    short = sorted(r["n"] for r in prints.where(F.col("n") < n).select("n").distinct().collect())  # n - 1 values at most
    known, bits = bloom.shared_filter(prints, "h", prints.count())

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_hash().alias("text_hash"))
    found = written(docs.mapInArrow(_doc_candidates(n, k, short, known, bits), "doc_id long, text_hash long, n_words long, at array<int>, n array<int>, digest array<binary>"), "contamination-candidates")
    key = [F.col("doc_id").eqNullSafe(F.col("hit_id")), F.col("text_hash") == F.col("hit_hash")]
    places = (
        found.where(F.size("at") > 0)
        .select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), F.explode(F.arrays_zip("at", "n", "digest")).alias("x"))
        .select("hit_id", "hit_hash", F.struct(F.col("x.at").alias("start"), F.col("x.n").alias("n")).alias("hit"), F.col("x.digest").alias("digest"))
    )
    places = written(places.join(small(digests, digests.count()), "digest"), "item-hits")
    # which items: their ids join the few digests that occur, never as arrays in a broadcast
    ids = places.select("hit_id", "hit_hash", "digest").distinct().join(small(windows, windows.count()), "digest").where("item_id is not null")
    ids = ids.groupBy("hit_id", "hit_hash").agg(F.collect_set("item_id").alias("ids"))
    ids = ids.withColumnsRenamed({"hit_id": "id_id", "hit_hash": "id_hash"})
    hits = places.groupBy("hit_id", "hit_hash").agg(F.array_sort(F.collect_set("hit")).alias("hits"))
    hits = hits.join(ids, F.col("hit_id").eqNullSafe(F.col("id_id")) & (F.col("hit_hash") == F.col("id_hash")), "left").drop("id_id", "id_hash")
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("words")),
        lambda a, x: F.struct(
            F.greatest(a["end"], x["start"] + x["n"]).alias("end"),
            (a["words"] + F.greatest(F.lit(0), x["start"] + x["n"] - F.greatest(a["end"], x["start"]))).alias("words"),
        ),
        lambda a: a["words"],
    )
    ids = F.transform(F.array_sort(F.transform("ids", lambda x: x.cast("string"))), lambda x: x.cast("long"))
    none = F.array().cast("array<struct<start:int,n:int>>")
    return found.select("doc_id", "text_hash", "n_words").join(hits, key[0] & key[1], "left").select(
        "doc_id", "text_hash", "n_words",
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(ids, F.array().cast("array<bigint>")).alias("item_ids"),
        F.coalesce("hits", none).alias("hits"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, n: int = 10, k: int = 5) -> DataFrame:
    """The rows of docs, all columns, in which no window of an item occurs (see ``contamination``)."""
    gone = written(contamination(docs, items, n, k).where("n_hit > 0").select("doc_id", "text_hash").distinct(), "contaminated")
    return without(docs, gone, gone.count())
