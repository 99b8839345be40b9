"""Line deduplication with two Bloom filters.

1. Tasks hash the lines of whole texts. Only 8-byte hashes go to the shard that
   holds their once-seen filter; a hash that finds itself there is suspected.
2. The suspects make the twice-seen filter, of bounded size, which all tasks get.
3. Lines that pass it, and only those, shuffle with their text. Counting them by
   text confirms repeats exactly and chooses the first occurrence.
4. Texts are rewritten: against the confirmed digests if these fit a broadcast,
   else by a join of each text with its own confirmed digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwood.llm import bloom, bytes_
from driftwood.llm.rows import unused
from driftwood.sources.workspace import written

#: Bits of a shard's first once-seen filter (2 MB), and the most that those of one shard may have together (256 MB).
SHARD_BITS, SHARD_MOST = 24, 31
#: Confirmed keys that may be broadcast (16-byte digest and 8-byte first id each).
BROADCAST_KEYS = 1_000_000


def _keys(data: np.ndarray, off: np.ndarray, min_chars: int) -> tuple[bytes_.Spans, bytes_.Spans, np.ndarray]:
    """Lines, their keys, and which keys are long enough."""
    all_lines = bytes_.lines(data, off)
    keys = bytes_.stripped(all_lines)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return all_lines, keys, points[keys.ends] - points[keys.starts] >= max(1, min_chars)


def _line_hashes(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, off in bytes_.slices(batches):
            _, keys, long_enough = _keys(data, off, min_chars)
            h, doc = keys.hashes()[long_enough], bytes_.owners(keys.first)[long_enough]
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new_h = np.ones(len(h), bool)
            new_h[1:] = h[1:] != h[:-1]
            new = new_h.copy()
            new[1:] |= doc[1:] != doc[:-1]
            at = np.flatnonzero(new_h)
            docs = np.add.reduceat(new.astype(np.int64), at) if len(at) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(docs > 1)], ["h", "many"])

    return run


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes found before. When a filter is full a larger one is added, so that what a shard holds follows its lines.

    Beyond the last filter's size more hashes are suspected by chance, and confirmed or not like all others.
    """
    filters, keys = [np.zeros(1 << (SHARD_BITS - 6), np.uint64)], 0
    bits = SHARD_BITS
    for batch in batches:
        h, many = batch.column("h").to_numpy(), batch.column("many").to_numpy(zero_copy_only=False)
        h, at, n = np.unique(h, return_inverse=True, return_counts=True)
        twice = n > 1
        twice[at[many]] = True
        for i, once in enumerate(filters):
            twice |= bloom.held(once, h, SHARD_BITS + i)
        bloom.put(filters[-1], h, bits)
        keys += len(h)
        if keys * bloom.BITS_PER_KEY > 1 << bits and bits < SHARD_MOST - 1:
            bits, keys = bits + 1, 0
            filters.append(np.zeros(1 << (bits - 6), np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(h[twice])], ["h"])


def _suspected(data: np.ndarray, off: np.ndarray, min_chars: int, twice: Broadcast, bits: int):
    """Lines, keys, and the indices of the lines that pass the twice-seen filter."""
    all_lines, keys, long_enough = _keys(data, off, min_chars)
    passed = bloom.held(twice.value, keys.hashes(), bits) & long_enough
    return all_lines, keys, np.flatnonzero(passed)


def _candidates(min_chars: int, twice: Broadcast, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in bytes_.slices(batches):
            _, keys, passed = _suspected(data, off, min_chars, twice, bits)
            doc, seen = bytes_.owners(keys.first), {}
            for i in passed.tolist():
                seen[doc[i], keys.lowered(i)] = None
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for _, k in seen], pa.binary()).cast(pa.string()), batch.column("doc_id").take(pa.array([int(d) for d, _ in seen], pa.int64()))],
                ["key", "doc_id"],
            )

    return run


def _rewrite(min_chars: int, twice: Broadcast, bits: int, confirmed: Broadcast | str, keep_first: bool, names: list[str]):
    """Drops confirmed lines. Without a broadcast, each row brings its own digests and first ids in the column ``confirmed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in bytes_.slices(batches):
            all_lines, keys, passed = _suspected(data, off, min_chars, twice, bits)
            doc, ids = bytes_.owners(keys.first), batch.column("doc_id").to_pylist()
            found = [hashlib.md5(keys.lowered(i)).digest() for i in passed.tolist()]
            if not isinstance(confirmed, str):
                known, first = confirmed.value
                digests = np.array(found, "S16")
                at = np.searchsorted(known, digests)
                hit = np.zeros(len(digests), bool)
                ok = at < len(known)
                hit[ok] = known[at[ok]] == digests[ok]
                firsts = first[at[hit]].tolist() if keep_first else []
                hits = list(zip(passed[hit].tolist(), digests[hit].tolist(), firsts or [None] * int(hit.sum()), strict=True))
            else:
                # plain bytes on both sides: numpy's strip trailing NULs
                own = [{x["digest"]: x["first"] for x in row or ()} for row in batch.column(confirmed).to_pylist()]
                hits = [(i, d, own[doc[i]][d]) for i, d in zip(passed.tolist(), found, strict=True) if d in own[doc[i]]]
            dropped, spared = np.zeros(len(doc), bool), set()
            for i, digest, first_id in hits:
                if keep_first and first_id == ids[doc[i]] and (doc[i], digest) not in spared:
                    spared.add((doc[i], digest))
                else:
                    dropped[i] = True
            n_dropped = np.bincount(doc[dropped], minlength=batch.num_rows)
            raw, kept = data.tobytes(), []
            for d in range(batch.num_rows):
                if n_dropped[d]:
                    rows = range(all_lines.first[d], all_lines.first[d + 1])
                    kept.append(b"\n".join(raw[all_lines.starts[i] : all_lines.ends[i]] for i in rows if not dropped[i]))
                else:
                    kept.append(raw[off[d] : off[d + 1]])
            new = {"text": pa.array(kept, pa.binary()).cast(pa.string()), "n_lines": pa.array(keys.counts), "n_dropped": pa.array(n_dropped)}
            yield pa.RecordBatch.from_arrays([new[x] if x in new else batch.column(x) for x in names], names)

    return run


def line_dedup(docs: DataFrame, min_docs: int = 2, min_chars: int = 1, keep: str = "first", broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Drops lines whose key is found in at least ``min_docs`` rows of ``docs``.

    docs: ``doc_id`` bigint, ``text`` string and any other columns, which pass
    through; ``n_lines`` and ``n_dropped`` are added and replace columns of
    these names. A key is a line without white space at both ends, with A-Z
    lower-cased; keys of fewer than ``min_chars`` code points (1 at least) stay.

    keep="none": all lines of such a key go. keep="first": the first such line
    in the row with the smallest doc_id stays (in each of them, if rows repeat
    a doc_id; rows with a null doc_id are never first unless all are null, and
    then each keeps its first). Columns may have any names.

    Every row counts as a document, repeated rows too. A null or empty text has
    one empty line and comes back as ''. An empty table gives an empty table.
    """
    if keep not in ("first", "none"):
        raise ValueError("keep is 'first' or 'none'")
    docs = docs.drop("n_lines", "n_dropped").withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    bare = docs.select("doc_id", "text")

    hashes = bare.select("text").mapInArrow(_line_hashes(min_chars), "h long, many boolean")
    suspects = written(hashes.repartition("h").mapInArrow(_suspects, "h long"), "line-suspects")
    twice, bits = bloom.shared_filter(suspects, "h", suspects.count())

    found = bare.mapInArrow(_candidates(min_chars, twice, bits), "key string, doc_id long").groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    confirmed = written(found.where(F.col("n") >= min_docs).select(F.unhex(F.md5("key")).alias("digest"), "first"), "line-repeats")

    names = [*docs.columns, "n_lines", "n_dropped"]
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    if confirmed.count() <= broadcast_keys:
        rows = confirmed.toArrow()
        digests, first = np.array(rows["digest"].to_pylist(), "S16"), np.array(rows["first"].to_pylist(), object)
        order = np.argsort(digests)
        sent = docs.sparkSession.sparkContext.broadcast((digests[order], first[order]))
        return docs.mapInArrow(_rewrite(min_chars, twice, bits, sent, keep == "first", names), schema)

    own, key = unused("confirmed", docs), unused("text_digest", docs)
    keyed = docs.withColumn(key, F.md5(F.coalesce("text", F.lit(""))))
    seen = keyed.select(F.col(key).alias("doc_id"), "text").mapInArrow(_candidates(min_chars, twice, bits), "key string, doc_id string")
    each = (
        seen.select(F.unhex(F.md5("key")).alias("digest"), F.col("doc_id").alias(key)).distinct().join(confirmed, "digest")
        .groupBy(key).agg(F.collect_list(F.struct("digest", "first")).alias(own))
    )
    return keyed.join(each, key, "left").drop(key).mapInArrow(_rewrite(min_chars, twice, bits, own, keep == "first", names), schema)
