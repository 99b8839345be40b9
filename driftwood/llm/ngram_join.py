"""N-gram Jaccard self-join by rare-first prefix filtering.

A text's set holds its distinct five-word shingles. All sets are put in one
order, rare shingles first, so that two sets as similar as asked for share a
shingle of their prefixes (the first n - ceil(t * n) + 1 of n). How rare a
shingle is comes from a table of counts over all texts, in cells by hash. Any
fixed order gives the same result; a cell that several shingles share makes them
look more frequent and costs candidates, never links.

Equal sets are one node. Nodes meet on prefix shingles that several nodes have.
Three filters keep pairs from being verified:

* length: the smaller set has at least t times the shingles of the larger one;
* position: with the first common shingle at places i and j, no more than
  1 + min(n - i - 1, m - j - 1) shingles are common (at a later common shingle
  the pair may be dropped, as it also meets at the first);
* suffix: both sets are cut by the same pivots of the hash range; the differences
  of the parts' sizes add up to no more than the shingles that are not common. The
  cut is coarse where many rows meet, and fine before texts are read.

First each node is verified against at most two likely partners, the first nodes
of its rarest and its most frequent shared prefix shingle, which joins large groups
of near copies. Then the groups that still meet on a shingle are compared with each
other, within tasks and in blocks of bounded size, by the filters and at last by
their texts. What passes from one comparison to the next are a shingle's nodes with
any partner in another group, and what comes out are as many links as join the
groups. So no table of all pairs of nodes or groups is made and no link between
groups is lost.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.llm import bloom, bytes_
from driftwood.llm.near_dedup import CELL, _runs, components, shingle_counts
from driftwood.llm.rows import small, text_hash
from driftwood.sources.workspace import discard, written

SHINGLE, PERCENT = 5, 80
#: Cells of the table of counts (4 MB while it is summed, 1 MB as broadcast), whatever the input, and cells in a row of it.
CELL_BITS, BLOCK_CELLS = 20, 4096
#: Parts that the suffix filter's pivots cut a set into.
PARTS = 64
#: Most parts of a set that two groups are compared by before their texts are read; a set has about half as many as shingles.
FINE_PARTS = 1 << 16
#: Rows of a shingle, and their bytes of parts or text, in a block that one task compares with another block.
BLOCK_ROWS, BLOCK_BYTES = 4096, 4 << 20


def space_words(data: np.ndarray, off: np.ndarray) -> bytes_.Spans:
    """The words [^\\x20\\x09-\\x0D]+ of each text."""
    inside = ~bytes_.SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    borders = off[(off > 0) & (off < len(data))]  # words of neighbouring texts may touch
    begins[borders] = inside[borders]
    ends[borders - 1] = inside[borders - 1]
    starts = np.flatnonzero(begins)
    return bytes_.Spans(data, starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, off))


def least_common(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The fewest common shingles of linked sets of n and m: 100 * common >= percent * (n + m - common)."""
    return -(-percent * (n + m) // (100 + percent))


def may_link(n, m, i, j, n_parts: np.ndarray, m_parts: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs pass the filters of length, position and suffix. Parts: sizes (uint8, the largest stands for all above it)."""
    need = least_common(n, m, percent)
    passed = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (np.minimum(n - i, m - j) >= need)
    at = np.flatnonzero(passed)
    own = n_parts if n_parts.ndim == 1 else n_parts[at]  # one set against many, or pairs
    apart = np.abs(own.astype(np.int16) - m_parts[at]).sum(axis=1)
    passed[at] = apart <= ((n + m) - 2 * need)[at]
    return passed


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _counted(k: int):
    """Texts by cell of their shingles, in rows of BLOCK_CELLS cells, once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << CELL_BITS, np.uint32), 0
        for batch, data, off in bytes_.slices(batches):
            n += batch.num_rows
            total += np.bincount(_cells(shingle_counts(space_words(data, off), k)[1]), minlength=len(total)).astype(np.uint32)
        if n:
            rows = total.astype(np.int64).reshape(-1, BLOCK_CELLS)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows), dtype=np.int32)), pa.array([zlib.compress(x.tobytes(), 1) for x in rows], pa.binary())], ["block", "counts"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
            own = np.frombuffer(zlib.decompress(counts.as_buffer()), np.int64)
            total[block] = total[block] + own if block in total else own.copy()
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], ["block", "counts"])


def frequencies(docs: DataFrame, k: int) -> Broadcast:
    """How many texts hold the shingles of each cell, as a broadcast byte: exact up to 128, then eight steps for each doubling."""
    rows = docs.mapInArrow(_counted(k), "block int, counts binary").repartition("block").mapInArrow(_summed, "block int, counts binary").toArrow()
    total = np.zeros((1 << CELL_BITS) // BLOCK_CELLS * BLOCK_CELLS, np.int64).reshape(-1, BLOCK_CELLS)
    for block, counts in zip(rows["block"].to_pylist(), rows["counts"].to_pylist(), strict=True):
        total[block] += np.frombuffer(zlib.decompress(counts), np.int64)
    steps = 128 + 8 * (np.log2(np.maximum(total, 128)) - 7)
    return docs.sparkSession.sparkContext.broadcast(np.minimum(np.where(total <= 128, total, steps), 255).astype(np.uint8).ravel())


def _fine(h: np.ndarray) -> bytes:
    """Sizes of as many parts as a power of two near half the set, at least PARTS."""
    parts = min(FINE_PARTS, max(PARTS, 1 << max(0, len(h) // 2 - 1).bit_length()))
    return np.minimum(np.bincount((h & np.uint64(parts - 1)).astype(np.int64), minlength=parts), 255).astype(np.uint8).tobytes()


def _folded(sizes: np.ndarray, parts: int) -> np.ndarray:
    """Rows of part sizes as those of fewer parts."""
    return np.minimum(sizes.reshape(len(sizes), -1, parts).sum(axis=1, dtype=np.int32), 255)


def _signed(k: int, percent: int, rare: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in bytes_.slices(batches):
            doc, h, _ = shingle_counts(space_words(data, off), k)
            texts = batch.num_rows
            n = np.bincount(doc, minlength=texts)
            first = np.concatenate([[0], np.cumsum(n)])
            raw = h.tobytes()
            nodes = [hashlib.md5(raw[8 * a : 8 * b]).digest() if b > a else None for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            parts = np.bincount(doc * PARTS + (h & np.uint64(PARTS - 1)).astype(np.int64), minlength=texts * PARTS).reshape(texts, PARTS)
            order = np.argsort(doc << 8 | rare.value[_cells(h)], kind="stable")  # then by hash, as before
            size = np.where(n > 0, n - -(-percent * n // 100) + 1, 0)
            bounds = np.concatenate([[0], np.cumsum(size)])
            place = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - first[:-1], size)
            fine = [_fine(h[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text_hash"), pa.array(nodes, pa.binary()), pa.array(n), pa.array(fine, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(h[order[place]].view(np.int64))),
                    pa.array([x.tobytes() for x in np.minimum(parts, 255).astype(np.uint8)], pa.binary()),
                ],
                ["doc_id", "text_hash", "node", "n", "fine", "prefix", "parts"],
            )

    return run


def _members(repeated: Broadcast, bits: int):
    """(key, node, n, pos) of prefix shingles that the filter of repeated ones holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("prefix")
            keys, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(batch.num_rows), size)
            pos = np.arange(len(keys)) - np.repeat(np.cumsum(size) - size, size)
            at = np.flatnonzero(bloom.held(repeated.value, keys, bits))
            own = pa.array(owner[at])
            yield pa.RecordBatch.from_arrays([pa.array(keys[at]), batch.column("node").take(own), batch.column("n").take(own), pa.array(pos[at])], ["key", "node", "n", "pos"])

    return run


def _parts(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), PARTS)


def _passing(percent: int):
    """Pairs (a, b) that pass the filters of length and suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(x).to_numpy() for x in ("n_a", "n_b"))
            passed = may_link(n, m, 0, 0, _parts(batch.column("parts_a")), _parts(batch.column("parts_b")), percent)
            yield batch.select(["a", "b"]).take(pa.array(np.flatnonzero(passed)))

    return run


def _overlaps(texts: list[pa.Array], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, element) of the sets of some columns of texts, one after the other, and the sets' sizes."""
    rows, hashes, at = [], [], 0
    for column in texts:
        data, off = bytes_.texts(column)
        doc, h, _ = shingle_counts(space_words(data, off), k)
        rows.append(doc + at)
        hashes.append(h)
        at += len(column)
    row, h = np.concatenate(rows), np.concatenate(hashes)
    return row, np.unique(h, return_inverse=True)[1], np.bincount(row, minlength=at)


def _verified(k: int, percent: int):
    """Pairs (a, b) of text_a and text_b that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = sum(bytes_.texts(batch.column(x))[1] for x in ("text_a", "text_b"))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(size, size[at] + 2 * bytes_.SLICE, "right")) - 1)
                some = batch.slice(at, to - at)
                row, element, n = _overlaps([some.column("text_a"), some.column("text_b")], k)
                pair = row % len(some)
                order = np.lexsort((element, pair))
                pair, element = pair[order], element[order]
                both = (pair[1:] == pair[:-1]) & (element[1:] == element[:-1])
                common = np.bincount(pair[1:][both], minlength=len(some))
                links = np.flatnonzero((common > 0) & (100 * common >= percent * (n[: len(some)] + n[len(some) :] - common)))
                yield some.select(["a", "b"]).take(pa.array(links))
                at = to

    return run


def _comparisons(rows: pa.Table) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray]:
    """Rows that others are compared with, (row, with how many of them it is compared), and the group of each row as a number.

    Of two rows that are on both sides, only the later is compared with the earlier.
    """
    probe, base = (rows.column(x).to_numpy() for x in ("probe", "base"))
    only, both = np.flatnonzero(base & ~probe), np.flatnonzero(base & probe)
    others = np.concatenate([only, both])
    pairs = [*zip(both.tolist(), range(len(only), len(others)), strict=True), *((x, len(others)) for x in np.flatnonzero(probe & ~base).tolist())]
    return others, pairs, rows.column("root").combine_chunks().dictionary_encode().indices.to_numpy().copy()


def _kept(close):
    """(key, node) of the rows of a cell that ``close`` marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, CELL):
            at = np.flatnonzero(close(rows))
            if len(at):
                yield pa.RecordBatch.from_arrays([rows.column(x).combine_chunks().take(pa.array(at)) for x in ("key", "node")], ["key", "node"])

    return run


def _meeting(percent: int):
    """Marks the rows that pass the filters with a row of another group."""

    def close(rows: pa.Table) -> np.ndarray:
        others, pairs, group = _comparisons(rows)
        n, pos = rows.column("n").to_numpy(), rows.column("pos").to_numpy()
        parts, marked = _parts(rows.column("parts").combine_chunks()), np.zeros(len(n), bool)
        m, j, m_parts, their = n[others], pos[others], parts[others], group[others]
        for x, k in pairs:
            hit = others[:k][may_link(n[x], m[:k], pos[x], j[:k], parts[x], m_parts[:k], percent) & (their[:k] != group[x])]
            marked[hit] = True
            marked[x] |= len(hit) > 0
        return marked

    return _kept(close)


def _closer(percent: int):
    """Marks the rows that pass the suffix filter with fine parts with a row of another group."""

    def close(rows: pa.Table) -> np.ndarray:
        others, pairs, group = _comparisons(rows)
        n, fine = rows.column("n").to_numpy(), rows.column("fine").to_pylist()
        size, marked = np.array([len(x) for x in fine]), np.zeros(len(n), bool)
        places = {p: np.flatnonzero(size[others] == p) for p in np.unique(size[others]).tolist()}
        tables = {p: np.frombuffer(b"".join(fine[i] for i in others[at].tolist()), np.uint8).reshape(len(at), p) for p, at in places.items()}
        for x, k in pairs:
            own = np.frombuffer(fine[x], np.uint8)[None]
            for p, at in places.items():
                y = others[at]
                alike = np.flatnonzero((at < k) & (group[y] != group[x]) & (100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x])))
                if len(alike):
                    some, parts = y[alike], min(p, len(fine[x]))
                    apart = np.abs(_folded(tables[p][alike], parts) - _folded(own, parts)).sum(axis=1)
                    hit = some[apart <= n[some] + n[x] - 2 * least_common(n[some], n[x], percent)]
                    marked[hit] = True
                    marked[x] |= len(hit) > 0
        return marked

    return _kept(close)


def _joined(k: int, percent: int):
    """Links between rows of different groups in their cell, as many as join these groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, CELL):
            others, pairs, group = _comparisons(rows)
            row, element, n = _overlaps([rows.column("text").combine_chunks()], k)
            inner = np.isin(row, others)
            holders = row[inner][np.argsort(element[inner], kind="stable")]
            many = np.bincount(element[inner], minlength=int(element.max(initial=-1)) + 1)
            start, own = np.cumsum(many) - many, np.searchsorted(row, np.arange(len(n) + 1))
            node, links = rows.column("node").to_pylist(), []
            for x, upto in pairs:
                y = others[:upto][group[others[:upto]] != group[x]]
                if not len(y):
                    continue
                e = element[own[x] : own[x + 1]]
                at = np.repeat(start[e] - (np.cumsum(many[e]) - many[e]), many[e]) + np.arange(many[e].sum())
                common = np.bincount(holders[at], minlength=len(n))[y]
                for z in y[(common > 0) & (100 * common >= percent * (n[y] + n[x] - common))].tolist():
                    if group[z] != group[x]:
                        links.append(sorted((node[x], node[z])))
                        group[group == group[z]] = group[x]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([v[i] for v in links], pa.binary()) for i in (0, 1)], ["a", "b"])

    return run


def jaccard_components(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """Components of texts linked by a Jaccard similarity of ``percent`` hundredths or more of their sets of k-word shingles.

    docs: ``doc_id`` bigint, ``text``; other columns are ignored. Words are
    [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a text of fewer than k words has
    one shingle. Returns a row per row: doc_id, text_hash, n_shingles,
    component_id (the smallest doc_id that links reach, its own included; null
    counts as the largest).

    Texts without words (null, empty, white space) have no shingles and are
    linked with nothing. Repeated rows are rows of the same set, and so of the
    same component. Shingles of equal rarity are in the order of their hashes,
    and of a shingle's nodes the smallest is first; neither changes the result.
    An empty table gives an empty table. A very long text is one row, whose
    words are hashed slice by slice.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_hash().alias("text_hash"))
    rare = frequencies(docs.select("text"), k)
    signed = docs.mapInArrow(_signed(k, percent, rare), "doc_id long, text_hash long, node binary, n long, fine binary, prefix array<long>, parts binary")
    sets = written(signed.withColumn("nth", F.monotonically_increasing_id()), "sets")  # nth tells equal rows apart
    firsts = sets.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "nth")).alias("row"))
    firsts = written(firsts.select("row.nth"), "firsts")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    nodes = written(sets.join(small(firsts, firsts.count()), "nth").select("node", row.alias("row"), "n", "fine", "prefix", "parts"), "nodes")
    signed = written(sets.select("doc_id", "text_hash", "node", "n"), "rows")
    discard(sets)

    repeated = written(nodes.select(F.explode("prefix").alias("key")).groupBy("key").count().where("count > 1").select("key"), "repeated")
    held, bits = bloom.shared_filter(repeated, "key", repeated.count())
    members = written(nodes.select("node", "n", "prefix").mapInArrow(_members(held, bits), "key long, node binary, n long, pos long"), "members")
    # the shingles of a passage are on the same nodes: only the first of them is needed, as it is where any two of these meet first
    same = [F.expr(f"bit_xor(xxhash64(node, {i}))").alias(f"on_{i}") for i in (1, 2)]
    shared = members.groupBy("key").agg(F.min(F.struct("node", "n", "pos")).alias("leader"), F.count("*").alias("rows"), *same).where("rows > 1")
    shared = shared.groupBy("rows", "on_1", "on_2").agg(F.min_by(F.struct("key", "leader"), "leader.pos").alias("first")).select("first.*")
    candidates, members = members, written(members.join(shared, "key"), "members")
    discard(candidates)

    def texts_of(some: DataFrame) -> DataFrame:
        ends = written(some.join(nodes.select("node", "row"), "node").select("node", F.col("row.doc_id").alias("id"), F.col("row.text_hash").alias("hash")), "pair-nodes")
        same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
        n = ends.count()
        texts = written(docs.join(small(ends, n), same).select("node", "text"), "pair-texts")
        return texts if texts.count() == n else written(texts.dropDuplicates(["node"]), "pair-texts")  # rows that repeat both id and text

    def verified(met: DataFrame) -> DataFrame:
        parts = lambda x: nodes.select(F.col("node").alias(x), F.col("parts").alias(f"parts_{x}"))
        passing = met.join(parts("a"), "a").join(parts("b"), "b").mapInArrow(_passing(percent), "a binary, b binary")
        pairs = written(passing, "pairs")
        texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
        return written(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_verified(k, percent), "a binary, b binary"), "links")

    # two likely partners of each node: the first nodes of its rarest and of its most frequent shared prefix shingle
    leaders = members.where("node <> leader.node").groupBy("node", "n").agg(F.min_by("leader", "pos").alias("rare"), F.max_by("leader", "pos").alias("frequent"))
    likely = leaders.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.explode(F.array("rare", "frequent")).alias("a")).distinct().where(f"100 * least(n_b, a.n) >= {percent} * greatest(n_b, a.n)")
    links = verified(likely.select(F.col("a.node").alias("a"), "b", F.col("a.n").alias("n_a"), "n_b"))
    roots = components(links)
    roots = small(roots, roots.count())

    def in_cells(some: DataFrame, size, most: int, *values: str) -> DataFrame:
        """Rows (key, node, values) of keys with several groups, in blocks of bounded size, each with every block of rows outside of the key's largest group.

        Rows of that group are linked with each other. A row outside of it is on both sides where its own blocks meet.
        """
        grouped = some.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        sizes = grouped.groupBy("key", "root").agg(F.sum(size).alias("size"))
        main = sizes.groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.count("*").alias("groups"), F.sum("size").alias("all"), (F.sum("size") - F.max("size")).alias("outside")).where("groups > 1")
        main = written(main.select("key", "main", *(F.ceil(F.col(x) / most).cast("int").alias(y) for x, y in (("all", "inners"), ("outside", "outers")))), "main")
        own, outer, outside = F.pmod(F.hash("node"), "inners"), F.pmod(F.hash("node"), "outers"), F.col("root") != F.col("main")
        cell = lambda x, y, probe, base: F.struct(x.alias("block"), y.alias("outer"), probe.alias("probe"), F.lit(base).alias("base"))
        bases = F.transform(F.sequence(F.lit(0), F.col("outers") - 1), lambda y: cell(own, y, outside & (y == outer), True))
        probes = F.transform(F.filter(F.sequence(F.lit(0), F.col("inners") - 1), lambda x: outside & (x != own)), lambda x: cell(x, outer, F.lit(True), False))
        dealt = grouped.join(small(main, main.count()), "key").select("key", "node", "root", *values, F.explode(F.concat(bases, probes)).alias("cell"))
        return dealt.select("key", "cell.*", "node", "root", *values)

    def by_cell(dealt: DataFrame) -> DataFrame:
        return dealt.repartition(*CELL).sortWithinPartitions(*CELL)

    def passing(cells: DataFrame, marked, name: str) -> DataFrame:
        """(key, node) of the rows that pass; of keys with the same nodes, all pairs of which are compared next, the first is enough."""
        met = written(by_cell(cells).mapInArrow(marked, "key long, node binary").distinct(), name)
        first = met.groupBy("key").agg(F.count("*").alias("rows"), *same).groupBy("rows", "on_1", "on_2").agg(F.min("key").alias("key"))
        return met.join(first.select("key"), "key")

    met = in_cells(members.select("key", "node", "n", "pos"), F.lit(1), BLOCK_ROWS, "n", "pos")
    meeting = written(passing(met.join(nodes.select("node", "parts"), "node"), _meeting(percent), "meeting"), "meeting-once")
    if not meeting.isEmpty():
        fine = meeting.join(nodes.select("node", "n", "fine"), "node")
        closer = written(passing(in_cells(fine, F.octet_length("fine"), BLOCK_BYTES, "n", "fine"), _closer(percent), "closer"), "closer-once")
        texts = texts_of(closer.select("node").distinct())
        close = by_cell(in_cells(closer.join(texts, "node"), F.octet_length("text"), BLOCK_BYTES, "text"))
        more = written(close.mapInArrow(_joined(k, percent), "a binary, b binary"), "links")
        roots = components(links.unionAll(more))

    rooted = signed.select("doc_id", "text_hash", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = nodes.select("node", "row").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("row").alias("least"))
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id"))
    return rooted.join(least, "root", "left").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), component.alias("component_id"))
