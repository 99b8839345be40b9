"""References, occurrences and the spans they touch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from driftwood.sources.workspace import written


def resolve_references(refs: DataFrame, targets: DataFrame, candidates: list[Column]) -> DataFrame:
    """(src, ref, dst, rank): each reference resolved to its first candidate that is a target. refs: (src, ref); targets: (path)."""
    form = F.posexplode(F.array(*candidates)).alias("rank", "dst")
    hit = refs.select("src", "ref", form).where("dst is not null").join(targets.select(F.col("path").alias("dst")).distinct(), "dst", "left_semi")
    return hit.where("src <> dst").groupBy("src", "ref").agg(F.min(F.struct("rank", "dst")).alias("m")).select("src", "ref", "m.dst", "m.rank")


#: Bytes of needles of which one automaton is made, which every worker holds (some 50 times as many bytes).
AUTOMATON_BYTES = 2 << 20
#: Runs of this many words, or of characters for needles of one or two words, bring needles and texts together beyond that.
HEAD_WORDS, HEAD_CHARS = 3, 3
#: Rows of two numbers, and bytes of needles, that may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20


class Automaton:
    """All needles at once: the goto and failure links of Aho and Corasick, made by a library; a text is read once whatever it holds."""

    def __init__(self, needles: list[tuple[object, str]]) -> None:
        import ahocorasick

        ids: dict[str, list] = {}
        for item, needle in needles:
            ids.setdefault(needle, []).append(item)
        self.links = ahocorasick.Automaton()
        for needle, items in ids.items():
            self.links.add_word(needle, (len(needle), needle.count("\n"), items))
        self.links.make_automaton()

    def places(self, text: str) -> Iterator[tuple[object, int, int, int]]:
        """(item, place from 1, first line, last line) of every occurrence."""
        line, counted = 1, 0
        for end, (size, more, items) in self.links.iter(text):
            # lines are counted up to where the hit ends, which only grows
            line += text.count("\n", counted, end + 1)
            counted = end + 1
            for item in items:
                yield item, end + 2 - size, line - more, line


def _by_all(sent: Broadcast, kind: pa.DataType):
    """Texts (doc_id, text) against the broadcast needles."""
    made: list[Automaton] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Automaton(sent.value))
        for batch in batches:
            yield from _hits(batch, ((made[0].places(text) if text else ()) for text in batch.column("text").to_pylist()), kind)

    return run


def _by_own(kind: pa.DataType):
    """Texts (doc_id, text, needles) against their own needles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            needles = [[(x["item_id"], x["needle"]) for x in own] for own in batch.column("needles").to_pylist()]
            yield from _hits(batch, (Automaton(own).places(text) for own, text in zip(needles, batch.column("text").to_pylist(), strict=True)), kind)

    return run


def _hits(batch: pa.RecordBatch, found: Iterator, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for row, places in enumerate(found):
        for x in places:
            out.append((row, *x))
            if len(out) >= 100_000:
                yield _hit_rows(batch, out, kind)
                out = []
    yield _hit_rows(batch, out, kind)


def _hit_rows(batch: pa.RecordBatch, out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    rows, items, *places = ([x[i] for x in out] for i in range(5))
    return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(items, kind), *(pa.array(x, pa.int64()) for x in places)], ["doc_id", "item_id", "at", "line_start", "line_end"])


def _grams(items: Column, k: int) -> Column:
    """Hashes of all runs of k items; they only nominate, every candidate is searched in full."""
    starts = F.sequence(F.lit(1), F.size(items) - k + 1)
    return F.when(F.size(items) >= k, F.transform(starts, lambda i: F.xxhash64(F.slice(items, i, k)))).otherwise(F.array().cast("array<bigint>"))


def _with_candidates(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """(doc_id, text, needles): texts with the needles that they may hold, each text once.

    The inner words of a needle are whole words of a text that holds it, so
    needles of three words and more meet texts by an equi-join on the hash of
    their first inner words; shorter ones by that of their first characters.
    """
    words = lambda x: F.array_remove(F.split(x, r"\s+"), "")
    chars = lambda x: F.split(x, "")
    n = needles.select("item_id", "needle", words("needle").alias("w"), F.length("needle").alias("n"))
    n = n.withColumns({"k": F.least(F.lit(HEAD_WORDS), F.greatest(F.size("w") - 2, F.lit(0))), "c": F.least(F.lit(HEAD_CHARS), F.col("n"))})
    head = F.when(F.col("k") > 0, F.slice("w", 2, F.col("k"))).otherwise(F.slice(chars("needle"), 1, F.col("c")))
    known = written(n.select("item_id", "needle", F.when(F.col("k") > 0, F.col("k")).otherwise(-F.col("c")).alias("kind"), F.xxhash64(head).alias("gram")), "needles")
    size = known.agg(F.count("*"), F.sum(F.octet_length("needle")), F.collect_set("kind")).first()  # HEAD_WORDS + HEAD_CHARS kinds at most
    t = written(texts.withColumn("nth", F.monotonically_increasing_id()), "texts")  # tells rows of one doc_id apart
    w = t.select("nth", words("text").alias("w"), *([chars("text").alias("c")] if min(size[2]) < 0 else []))
    kinds = [F.struct(F.lit(k).alias("kind"), F.array_distinct(_grams(F.col("w" if k > 0 else "c"), abs(k))).alias("grams")) for k in sorted(size[2])]
    grams = w.select("nth", F.explode(F.array(*kinds)).alias("x")).select("nth", "x.kind", F.explode("x.grams").alias("gram"))
    heads = known.select("kind", "gram", "item_id", "needle")
    small = size[0] <= BROADCAST_ROWS and size[1] <= BROADCAST_BYTES
    pairs = grams.join(F.broadcast(heads) if small else heads, ["kind", "gram"]).groupBy("nth").agg(F.collect_set(F.struct("item_id", "needle")).alias("needles"))
    return t.join(pairs, "nth").select("doc_id", "text", "needles")


def occurrence_scan(texts: DataFrame, needles: DataFrame, budget: int = AUTOMATON_BYTES) -> DataFrame:
    """(doc_id, item_id, at, line_start, line_end): every occurrence of needles, overlapping ones too; at and lines count from 1.

    texts: (doc_id, text); needles: (item_id, text); null and empty ones match
    nothing; repeated texts each count, repeated needles once. Needles of up to ``budget`` bytes together
    are one automaton, which every task sends its texts through, without a
    shuffle. Beyond that each text first meets the needles that it may hold and
    goes through an automaton of these. Either way a text is read once.
    """
    known = written(needles.where("text <> ''").select("item_id", F.col("text").alias("needle")).distinct(), "needles")
    t = texts.where("text <> ''").select("doc_id", "text")
    fields = [t.schema["doc_id"], known.schema["item_id"], *(T.StructField(x, T.LongType()) for x in ("at", "line_start", "line_end"))]
    schema = T.StructType([T.StructField(x.name, x.dataType) for x in fields])
    kind = to_arrow_type(known.schema["item_id"].dataType)
    size = known.agg(F.coalesce(F.sum(F.octet_length("needle") + 8), F.lit(0))).first()[0]
    if size <= budget:
        sent = t.sparkSession.sparkContext.broadcast([tuple(x) for x in known.collect()])  # within the budget
        return t.mapInArrow(_by_all(sent, kind), schema)
    return _with_candidates(t, known).mapInArrow(_by_own(kind), schema)


def span_targets(spans: DataFrame, nodes: DataFrame, bucket: int | None = None) -> DataFrame:
    """(span columns, node_id): nodes (file, node_id, line_start, line_end) whose lines overlap a span (file, line_start, line_end).

    ``bucket``: lines to a bucket; overlapping pairs then meet by file and bucket, for files with many nodes.
    """
    a, b = spans.withColumnsRenamed({"line_start": "s0", "line_end": "s1"}), nodes.select("file", "node_id", F.col("line_start").alias("n0"), F.col("line_end").alias("n1"))
    keys = ["file"]
    if bucket:
        each = lambda x, y: F.explode(F.sequence(F.floor(F.col(x) / bucket), F.floor(F.col(y) / bucket)))
        a, b, keys = a.withColumn("bucket", each("s0", "s1")), b.withColumn("bucket", each("n0", "n1")), ["file", "bucket"]
    out = a.join(b, keys).where("s0 <= n1 and n0 <= s1")
    if bucket:  # a pair is taken in the first bucket that both have
        out = out.where(F.col("bucket") == F.floor(F.greatest("s0", "n0") / bucket)).drop("bucket")
    return out.drop("n0", "n1").withColumnsRenamed({"s0": "line_start", "s1": "line_end"})


def path_prefix_map(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, root, relative): the longest root (a path without a final slash) that a path lies in."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    hit = paths.select("path").distinct().select("path", F.explode(prefixes).alias("root")).join(roots.select("root").distinct(), "root")
    best = hit.groupBy("path").agg(F.max(F.struct(F.length("root").alias("n"), "root")).alias("m")).select("path", "m.root")
    return best.withColumn("relative", F.expr("substring(path, length(root) + 2)"))
