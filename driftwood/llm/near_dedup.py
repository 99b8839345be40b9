"""MinHash near-deduplication with BagMinHash signatures.

Similarity is the weighted Jaccard of the multisets of five-word shingles: the
sum of the smaller counts over the sum of the larger. Each (shingle, unit of
weight) is a Poisson process in time; every point falls on one of m components,
and a component's signature value is the earliest time on it. Texts agree in a
component with a probability of exactly their weighted Jaccard.

Weights are discretised at the integers, so nothing is rounded. The processes
of a shingle are grouped in dyadic shells [0,1), [1,2), [2,4), [4,8) ..., one
process of the shell's width each, whose points are thinned by the weight; a
count of w costs log w processes. Times are generated in order and only up to a
limit of about m ln m / weight, beyond which no component is open (else the
limit is doubled), so a text costs m ln m points beside one look at each shingle.

Texts with the same words are one node. Nodes that agree in a band are compared
with the band's first node, which joins large groups of copies. Then the nodes
of a band outside of its largest group are compared with all of it, in blocks
of bounded size within tasks, so that no link is lost and no table of pairs is
made. A sketch of four bits of each component travels with the nodes; pairs whose
sketches differ more than texts at the threshold do (by five standard deviations)
are left out. All others are verified by their exact multiset overlap. Groups
are the connected components of the verified links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.llm import bytes_
from driftwood.llm.rows import small, text_hash, without
from driftwood.sources.workspace import written

SHINGLE, THRESHOLD = 5, 0.8
#: A pair at the threshold of 0.8 shares no band with a probability of (1 - 0.8**5)**36 = 6e-7.
BANDS, ROWS = 36, 5
#: Components in one 64-bit word of a sketch.
NIBBLES = 16
#: Rows with sketches, and bytes of text, in a block of nodes that one task compares with another block.
BLOCK_ROWS, BLOCK_BYTES = 4096, 4 << 20
#: What names a pair of blocks: the band key, a block of its rows, and a block of those outside of its largest group.
CELL = ["key", "block", "outer"]


def shingle_counts(spans: bytes_.Spans, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the distinct shingles of each text, by text and hash; fewer than k words are one shingle."""
    word, first = spans.hashes(), spans.first
    doc, n = bytes_.owners(first), spans.counts
    h = bytes_.grams(word, k)
    inside = doc[: len(h)] == doc[k - 1 :]
    h, doc = h[inside], doc[: len(inside)][inside]
    short = np.flatnonzero((n > 0) & (n < k))
    h = np.concatenate([h, np.array([bytes_.grams(word[first[d] : first[d + 1]], n[d])[0] for d in short.tolist()], np.uint64)])
    doc = np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def _points(sig: np.ndarray, doc: np.ndarray, h: np.ndarray, count: np.ndarray, limit: np.ndarray) -> None:
    """Lowers sig (texts x components) to the earliest points of all processes up to each text's limit."""
    m, flat, shell, low, width = sig.shape[1], sig.reshape(-1), 0, 0, 1
    while True:
        in_shell = count > low
        if not in_shell.any():
            return
        seed = bytes_.mix(h[in_shell] + np.uint64(0x632BE59BD9B4E019 * (shell + 1) & (1 << 64) - 1))
        own, weight, until = doc[in_shell], count[in_shell], limit[doc[in_shell]]
        t, k = np.zeros(len(seed)), 0
        while len(seed):
            k += 1
            r = bytes_.mix(seed + np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1))
            t = t - np.log(((r >> np.uint64(11)) + np.uint64(1)) * 2.0**-53) / width
            live = np.flatnonzero(t <= until)
            seed, own, weight, until, t, r = seed[live], own[live], weight[live], until[live], t[live], r[live]
            r = bytes_.mix(r)
            place = own * m + (((r >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
            if width == 1:
                np.minimum.at(flat, place, t)
            else:
                covered = low + (r & np.uint64(0xFFFFFFFF)) * (2.0**-32 * width) < weight
                np.minimum.at(flat, place[covered], t[covered])
        low, width, shell = (1, 1, 1) if shell == 0 else (low + width, low + width, shell + 1)


def bag_minhash(doc: np.ndarray, h: np.ndarray, count: np.ndarray, texts: int, m: int) -> np.ndarray:
    """Signatures (texts x m times) of multisets; a text without shingles keeps infinity."""
    sig = np.full((texts, m), np.inf)
    weight = np.bincount(doc, count, texts)
    limit = m * (math.log(m) + 4) / np.maximum(weight, 1)
    open_ = weight > 0
    while open_.any():
        mine = open_[doc]
        _points(sig, doc[mine], h[mine], count[mine], limit)
        open_ = open_ & np.isinf(sig).any(axis=1)
        limit = limit * 2
    return sig


def _signed(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in bytes_.slices(batches):
            spans, n = bytes_.words(data, off), batch.num_rows
            sig = bag_minhash(*shingle_counts(spans, k), n, bands * rows).view(np.uint64).reshape(n, bands, rows)
            key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
            for i in range(rows):
                key = bytes_.mix(key ^ sig[:, :, i])
            low = np.zeros((n, -(-bands * rows // NIBBLES) * NIBBLES), np.uint64)
            low[:, : bands * rows] = bytes_.mix(sig.reshape(n, -1)) & np.uint64(15)
            low = low.reshape(n, -1, NIBBLES) << (np.arange(NIBBLES, dtype=np.uint64) * np.uint64(4))
            sketch = np.bitwise_or.reduce(low, axis=2).view(np.int64)
            some = spans.counts > 0
            bounds = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))])
            nodes = _digests(spans, off)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(nodes, pa.binary()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(key[some].ravel().view(np.int64))), pa.array(list(sketch), pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "node", "bands", "sketch"],
            )

    return run


def _digests(spans: bytes_.Spans, off: np.ndarray) -> list[bytes | None]:
    """A digest of each text's words, in order; none without words."""
    inside = bytes_.WORD[spans.data]
    kept = inside.copy()
    kept[1:] |= inside[:-1]  # one separator after a word
    plain = np.where(inside, bytes_.LOWER[spans.data], np.uint8(32))[kept].tobytes()
    bounds = np.concatenate([[0], np.cumsum(kept)])[off].tolist()
    # a separator that opens a text after a word of the text before is blank, and stripped
    return [hashlib.md5(x).digest() if (x := plain[a:b].strip()) else None for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _verify(k: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [bytes_.texts(batch.column(x)) for x in ("text_a", "text_b")]
            size, at = sides[0][1] + sides[1][1], 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(size, size[at] + 2 * bytes_.SLICE, "right")) - 1)
                shingles = [shingle_counts(bytes_.words(data[off[at] : off[to]], off[at : to + 1] - off[at]), k) for data, off in sides]
                doc, h, count = (np.concatenate([x[i] for x in shingles]) for i in range(3))
                total = np.bincount(doc, count, to - at)
                order = np.lexsort((h, doc))
                doc, h, count = doc[order], h[order], count[order]
                both = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1]))
                shared = np.bincount(doc[both], np.minimum(count[both], count[both + 1]), to - at)
                links = np.flatnonzero((shared >= threshold * (total - shared) - 1e-9) & (shared > 0))
                yield batch.slice(at, to - at).select(["a", "b"]).take(pa.array(links))
                at = to

    return run


def _most_apart(components: int, threshold: float) -> int:
    """Components in which sketches of two texts at the threshold differ at most, but for one pair in millions."""
    expected = (1 - threshold) * 15 / 16
    return math.ceil(components * expected + 5 * math.sqrt(components * expected * (1 - expected)))


def _alike(a: str, b: str, components: int, threshold: float):
    words, most = -(-components // NIBBLES), _most_apart(components, threshold)
    nibbles = "bit_count(({x} | shiftrightunsigned({x}, 1) | shiftrightunsigned({x}, 2) | shiftrightunsigned({x}, 3)) & 1229782938247303441L)"
    return F.expr(" + ".join(nibbles.format(x=f"({a}[{i}] ^ {b}[{i}])") for i in range(words)) + f" <= {most}")


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(x).to_numpy(zero_copy_only=False) for x in keys]
        new = np.zeros(batch.num_rows, bool)
        for x in cols:
            new[1:] |= x[1:] != x[:-1]
        new[0] = last is not None and last != tuple(x[0] for x in cols)
        at = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(at[:-1], at[1:], strict=True):
            if new[a] and held:
                yield pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
        last = tuple(x[-1] for x in cols)
    if held:
        yield pa.Table.from_batches(held)


def _codes(run: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The group of each row as a number, the rows to be compared, and those that they are compared with."""
    probe = run.column("probe").to_numpy()
    return run.column("root").combine_chunks().dictionary_encode().indices.to_numpy(), np.flatnonzero(probe), np.flatnonzero(~probe)


def _with_alike(components: int, threshold: float):
    """(key, node) of rows that have an alike row of another group in their key."""
    most = _most_apart(components, threshold)
    one = np.uint64(0x1111111111111111)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes = [], []
        for rows in _runs(batches, CELL):
            group, probes, base = _codes(rows)
            sketch = rows.column("sketch").combine_chunks()
            sketch = sketch.values.to_numpy()[sketch.offsets[0].as_py() :].view(np.uint64).reshape(rows.num_rows, -1)
            good, others, other_group = np.zeros(rows.num_rows, bool), sketch[base], group[base]
            for x in probes.tolist():
                d = others ^ sketch[x]
                d = (d | (d >> np.uint64(1)) | (d >> np.uint64(2)) | (d >> np.uint64(3))) & one
                alike = (np.bitwise_count(d).sum(axis=1) <= most) & (other_group != group[x])
                if alike.any():
                    good[base[alike]] = True
                    good[x] = True
            if good.any():
                keys.append(rows.column("key").to_numpy()[good])
                nodes += rows.column("node").take(pa.array(np.flatnonzero(good))).to_pylist()
            if len(nodes) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(nodes, pa.binary())], ["key", "node"])
                keys, nodes = [], []
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(nodes, pa.binary())], ["key", "node"])

    return run


def _linked(k: int, threshold: float):
    """Links between rows of different groups in their key, as many as join these groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, CELL):
            n = rows.num_rows
            group, probes, base = _codes(rows)
            data, off = bytes_.texts(rows.column("text").combine_chunks())
            doc, h, count = shingle_counts(bytes_.words(data, off), k)
            # one element for each shingle and occurrence: the overlap of multisets is that of these sets
            first = np.cumsum(count) - count
            nth = np.arange(count.sum()) - np.repeat(first, count)
            doc = np.repeat(doc, count)
            _, element = np.unique(bytes_.mix(np.repeat(h, count) + nth.astype(np.uint64)), return_inverse=True)
            size, own = np.bincount(doc, minlength=n), np.searchsorted(doc, np.arange(n + 1))
            among = np.isin(doc, base)
            held = element[among]
            holders = doc[among][np.argsort(held, kind="stable")]
            many = np.bincount(held, minlength=int(element.max(initial=-1)) + 1)
            start = np.cumsum(many) - many
            node, links = rows.column("node").to_pylist(), []
            for x in probes.tolist():
                e = element[own[x] : own[x + 1]]
                at = np.repeat(start[e] - (np.cumsum(many[e]) - many[e]), many[e]) + np.arange(many[e].sum())
                shared = np.bincount(holders[at], minlength=n)
                for y in np.flatnonzero((shared >= threshold * (size + size[x] - shared) - 1e-9) & (shared > 0) & (group != group[x])).tolist():
                    if group[y] != group[x]:
                        links.append((min(node[x], node[y]), max(node[x], node[y])))
                        group = np.where(group == group[y], group[x], group)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([v[i] for v in links], pa.binary()) for i in (0, 1)], ["a", "b"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the connected components of links (a, b), a <> b; root is the smallest node, and no row is its own.

    Alternates large-star and small-star steps until the edges stay as they are; an edge table is written each time.
    """
    edges = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).where("node <> root").distinct()
    state = None
    while True:
        both = edges.unionAll(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.min("root").alias("least"))
        large = both.where("root > node").join(least.select("node", F.least("node", "least").alias("least")), "node").select(F.col("root").alias("node"), F.col("least").alias("root")).distinct()
        least = large.groupBy("node").agg(F.min("root").alias("least"))
        stars = large.join(least, "node").where("root <> least").select(F.col("root").alias("node"), F.col("least").alias("root"))
        edges = written(stars.unionAll(least.select("node", F.col("least").alias("root"))).distinct(), "components")
        now = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(node, root))").alias("x"), F.count_distinct("node").alias("nodes")).first()
        if now == state and now["n"] == now["nodes"]:
            return edges
        state = now


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The class of each row of docs: rows linked, directly or over others, by a similarity of ``threshold`` or more.

    docs: ``doc_id`` bigint, ``text``; other columns are ignored. Words are as
    in ``decontaminate``; a text of fewer than k words is one shingle. Returns
    doc_id, text_hash, class_id (smallest doc_id of the class), class_docs (its
    rows) and first (boolean: this row is the class's smallest by doc_id, then
    text_hash; rows repeating both are the same document and all first).
    Texts without words (null, empty) are each a class of their own. A null
    doc_id counts as larger than all others. Ties: of equal band members the
    smallest node leads, and of equal groups the one with the largest root is
    the key's main one; neither changes the classes. An empty table gives an
    empty table; a very long text is one row, hashed slice by slice.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_hash().alias("text_hash"))
    signed = written(docs.mapInArrow(_signed(k, bands, rows), "doc_id long, text_hash long, node binary, bands array<long>, sketch array<long>"), "signatures")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    nodes = written(signed.where("node is not null").groupBy("node").agg(F.min(row).alias("row"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "nodes")
    alike = lambda a, b: _alike(a, b, bands * rows, threshold)

    def texts_of(some: DataFrame) -> DataFrame:
        ends = written(some.join(nodes.select("node", "row"), "node").select("node", F.col("row.doc_id").alias("id"), F.col("row.text_hash").alias("hash")), "pair-nodes")
        same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
        return written(docs.join(small(ends, ends.count()), same).select("node", "text").dropDuplicates(["node"]), "pair-texts")

    def verified(pairs: DataFrame) -> DataFrame:
        sketch = lambda x: nodes.select(F.col("node").alias(x), F.col("sketch").alias(f"sketch_{x}"))
        close = pairs.distinct().join(sketch("a"), "a").join(sketch("b"), "b").where(alike("sketch_a", "sketch_b"))
        pairs = written(close.select("a", "b"), "pairs")
        texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
        return written(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_verify(k, threshold), "a binary, b binary"), "links")

    def blocks(some: DataFrame, inner, outer, value: str) -> DataFrame:
        """Rows of a key in ``inner`` blocks, each with every one of the ``outer`` blocks of rows outside of its largest group.

        Rows of that group are linked with each other, so only outsiders are
        compared: n rows with o outsiders make n * outer + o * inner rows.
        """
        own = some.withColumns({"inner": F.greatest(inner, F.lit(1)).cast("int"), "outers": F.greatest(outer, F.lit(1)).cast("int"), "place": F.hash("node")})
        cell = lambda block, outer, probe: F.struct(block.cast("int").alias("block"), outer.cast("int").alias("outer"), F.lit(probe).alias("probe"))
        base = F.transform(F.sequence(F.lit(0), F.col("outers") - 1), lambda y: cell(F.pmod("place", "inner"), y, False))
        probes = F.transform(F.sequence(F.lit(0), F.col("inner") - 1), lambda x: cell(x, F.pmod("place", "outers"), True))
        dealt = own.select("key", "node", "root", value, F.explode(F.when(F.col("root") == F.col("main"), base).otherwise(F.concat(base, probes))).alias("cell"))
        return dealt.select("key", "cell.*", "node", "root", value).repartition(*CELL).sortWithinPartitions(*CELL)

    def apart(members: DataFrame, roots: DataFrame, name: str) -> DataFrame:
        """Members, but for first nodes, of keys whose nodes are in several groups, with the key's largest group, its rows and those outside of that group."""
        grouped = members.where("n > 2").join(roots, "node", "left").select("key", "node", "leader", F.coalesce("root", "node").alias("root"))
        sizes = grouped.groupBy("key", "root").agg(F.count("*").alias("size"))
        main = sizes.groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.count("*").alias("groups"), F.sum("size").alias("n"), (F.sum("size") - F.max("size")).alias("outside")).where("groups > 1")
        return written(grouped.join(main, "key").where("node <> leader").join(nodes.select("node", "sketch"), "node"), name)

    keys = nodes.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1")
    members = written(keys.join(shared, "key"), "members")
    links = verified(members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")))
    roots = components(links)

    mixed = apart(members, roots, "mixed")
    nearer = written(blocks(mixed, F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("outside") / BLOCK_ROWS), "sketch").mapInArrow(_with_alike(bands * rows, threshold), "key long, node binary").distinct(), "nearer")
    texts = texts_of(nearer.select("node").distinct())
    close = mixed.join(nearer, ["key", "node"]).join(texts, "node")
    size = F.octet_length("text")
    sizes = close.groupBy("key").agg(F.sum(size).alias("bytes"), F.sum(F.when(F.col("root") != F.col("main"), size).otherwise(0)).alias("outer_bytes"))
    close = written(close.join(sizes, "key"), "close") if not nearer.isEmpty() else None
    if close is not None:
        more = written(blocks(close, F.ceil(F.col("bytes") / BLOCK_BYTES), F.ceil(F.col("outer_bytes") / BLOCK_BYTES), "text").mapInArrow(_linked(k, threshold), "a binary, b binary").distinct(), "links")
        roots = components(links.unionAll(more))

    rooted = signed.select("doc_id", "text_hash", "node").join(roots, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))
    sized = signed.where("node is not null").groupBy("node").agg(F.min(row).alias("row"), F.count("*").alias("n"))
    classes = sized.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("row").alias("row"), F.sum("n").alias("class_docs"))
    first = F.col("row").isNull() | (F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("row.text_hash") == F.col("text_hash")))
    return rooted.join(classes, "root", "left").select(
        "doc_id", "text_hash",
        F.when(F.col("row").isNull(), F.col("doc_id")).otherwise(F.col("row.doc_id")).alias("class_id"),
        F.coalesce("class_docs", F.lit(1).cast("long")).alias("class_docs"),
        first.alias("first"),
    )


def near_deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that are first in their class (see ``near_duplicates``)."""
    gone = written(near_duplicates(docs, threshold).where(~F.col("first")).select("doc_id", "text_hash").distinct(), "near-copies")
    return without(docs, gone, gone.count())
