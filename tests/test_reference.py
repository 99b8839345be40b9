"""Operators on the tiny tables of FIXTURES.md."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from driftwood.operators import contracts, corpus, drift, graph, leases, spans
from driftwood.operators import tables as t
from driftwood.streaming import streams

NODES = [("a::1", "a", None, "benign", 1, 1, "h1"), ("a::f", "a", "f", "structural", 3, 6, "h2"), ("a::g", "a", "g", "structural", 8, 20, "h3"), ("b::p", "b", "p", "external", 1, 4, "h4"), ("c::q", "c", "q", "structural", 1, 2, "h5")]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(NODES, "node_id string, file string, name string, kind string, line_start int, line_end int, content_hash string")


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "a"), ("c", "b")], "src string, dst string")


@pytest.mark.parametrize(
    ("start", "depth", "way", "want"),
    [("a", 1, "forward", "a0 b1"), ("a", 2, "forward", "a0 b1 c2"), ("a", 9, "forward", "a0 b1 c2"), ("b", 1, "reverse", "b0 a1 c1"), ("b", 2, "reverse", "b0 a1 c1 d2"), ("a", 1, "both", "a0 b1 d1")],
)
def test_bfs(spark, edges, start, depth, way, want):
    got = graph.bounded_bfs(edges, spark.createDataFrame([(start,)], "node string"), depth, way)
    assert {f"{r.node}{r.hop}" for r in got.collect()} == set(want.split())


def test_ttl_and_spans(spark, nodes, rows):
    ask = spark.createDataFrame([("a::f",), ("a::g",), ("zz",)], "node_id string")
    assert rows(leases.lease_ttl(ask, nodes)) == [("a::f", 36), ("a::g", 54), ("zz", 30)]
    for bucket in (None, 4):
        hit = lambda a, b, bucket=bucket: {r.node_id for r in spans.span_targets(spark.createDataFrame([("a", a, b)], "file string, line_start int, line_end int"), nodes, bucket).collect()}
        assert hit(6, 8) == {"a::f", "a::g"} and hit(7, 7) == set()


def test_occurrences(spark, rows):
    texts = spark.createDataFrame([(1, "aaa"), (2, "x\none two three\nfour five"), (3, None), (4, "")], "doc_id long, text string")
    needles = spark.createDataFrame([(7, "aa"), (8, "wo three\nfour fi"), (9, ""), (10, None)], "item_id long, text string")
    assert rows(spans.occurrence_scan(texts, needles)) == [(1, 7, 1, 1, 1), (1, 7, 2, 1, 1), (2, 8, 8, 2, 3)]


@pytest.mark.parametrize("budget", [spans.AUTOMATON_BYTES, 0])
def test_occurrences_are_brute_force_and_linear(spark, budget):
    import random
    import time

    rng = random.Random(1)
    say = lambda n: "".join(rng.choice("ab \n\té") for _ in range(n))
    texts = [(i, say(rng.randint(0, 120))) for i in range(60)] + [(99, "aab ab " * 50)]
    needles = [(i, say(rng.choice((1, 2, 3, 5, 9)))) for i in range(40)] + [(50, "ab aab ab aab"), (51, "b aab ab a"), (52, " "), (53, "b aab")]
    want = set()
    for d, text in texts:
        for n, needle in needles:
            for at in range(len(text) - len(needle) + 1):
                if needle and text.startswith(needle, at):
                    start = text.count("\n", 0, at) + 1
                    want.add((d, n, at + 1, start, start + needle.count("\n")))
    found = spans.occurrence_scan(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), spark.createDataFrame(needles + needles[:3], "item_id long, text string"), budget)
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    assert not any(x in found._jdf.queryExecution().toString() for x in ("CartesianProduct", "BroadcastNestedLoopJoin"))
    long = spark.createDataFrame([(1, "one two three four\n" + "word and more text " * 2 + "\n") for _ in range(1)], "doc_id long, text string").withColumn("text", F.repeat("text", 20_000))
    began = time.time()
    out = spans.occurrence_scan(long, spark.createDataFrame([(1, "two three four")], "item_id long, text string"), budget).agg(F.count("*"), F.max("line_start")).first()
    assert tuple(out) == (20_000, 39_999) and time.time() - began < 20
    text = "word and more text " * 40_000  # 760 kB, and needles of all lengths that are found again and again
    needles = spark.createDataFrame([(str(i), text[i % 19 : i % 19 + i]) for i in range(1, 400)], "item_id string, text string")
    out = spans.occurrence_scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), needles, budget).groupBy("item_id").count().orderBy(F.col("item_id").cast("int")).collect()
    assert len(out) == 399 and out[-1]["count"] == len([i for i in range(len(text) - 398) if (i - 399 % 19) % 19 == 0])


def test_components(spark, rows):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 6), (6, 7), (8, 8), (0, 1), (9, 10), (10, 9), (7, 9)]
    got = graph.cycle_components(spark.createDataFrame(edges, "src long, dst long"))
    assert rows(got) == [(1, 1), (10, 9), (2, 1), (3, 1), (4, 4), (5, 4), (8, 8), (9, 9)]
    assert graph.cycle_components(spark.createDataFrame(edges[3:4], "src long, dst long")).isEmpty()
    assert {r.node for r in graph.wait_cycles(spark.createDataFrame(edges, "src long, dst long"), 2).collect()} == {4, 5, 8, 9, 10}


def test_session_end(spark):
    log = spark.createDataFrame([("s", 1, 0, 0, 5, "acquire"), ("s", 2, 1, 1, 6, "acquire"), ("t", 3, 1, 2, 7, "acquire"), ("s", None, 2, 3, 5, "end"), ("t", 1, 3, 4, 7, "acquire")], "session string, resource long, sec long, event_id long, agent long, op string")
    got = {(r.resource, r.event_id, r.outcome) for r in leases.lease_replay(leases.session_release_fanout(log), 30).collect()}
    assert got == {(1, 0, "grant"), (2, 1, "grant"), (3, 2, "grant"), (1, 3, "release"), (2, 3, "release"), (1, 4, "grant")}


def test_impact(spark, nodes, edges, rows):
    changed = spark.createDataFrame([("b", "me")], "file string, agent string")
    held = spark.createDataFrame([("a::g", "other")], "node_id string, holder string")
    assert rows(graph.impact_set(changed, edges, nodes, held, 2)) == [("a::f", "a", 1), ("c::q", "c", 1)]


@pytest.mark.parametrize(
    ("held", "asked", "members"),
    [("n2B", "An2", ""), ("n1A n2B", "An2 Bn1", "AB"), ("n1A n2B n3C", "An2 Bn3 Cn1", "ABC"), ("n1A n2B n3C", "An2 Bn3", ""), ("n1A", "An1", "")],
)
def test_wait_cycles(spark, held, asked, members):
    holders = spark.createDataFrame([(x[:2], x[2]) for x in held.split()], "node_id string, holder string")
    intents = spark.createDataFrame([(x[0], x[1:]) for x in asked.split()], "agent string, node_id string")
    assert {r.node for r in graph.wait_cycles(leases.wait_for_edges(intents, holders)).collect()} == set(members)


def test_victim_and_queue(spark, rows):
    m = spark.createDataFrame([(1, "A", 100), (1, "B", 0), (2, "A", 0), (2, "B", 0)], "cycle long, agent string, priority int")
    assert rows(leases.cycle_victim(m)) == [(1, "B"), (2, "A")]
    q = spark.createDataFrame([(1, "n", "low", 0), (2, "n", "high", 100), (3, "n", "late", 0)], "id long, node string, agent string, priority int")
    p = leases.queue_position(q)
    assert {r.agent: r.position for r in p.collect()} == {"high": 0, "low": 1, "late": 2}
    ask = spark.createDataFrame([("absent", "n"), ("late", "n")], "agent string, node string")
    assert rows(leases.best_position(ask, p)) == [("absent", 0), ("late", 2)]


LOG = [(0, "A", "acquire"), (10, "B", "acquire"), (12, "A", "acquire"), (42, "B", "acquire"), (43, "B", "acquire"), (50, "A", "release"), (51, "B", "release"), (52, "A", "acquire"), (90, "A", "release")]
OUT = ["grant", "block", "reenter", "block", "grant_after_expiry", "noop", "release", "grant"]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame([(r, s, i, {"A": 1, "B": 2}[a], op) for r in (1, 2) for i, (s, a, op) in enumerate(LOG)], "resource long, sec long, event_id long, agent long, op string")


@pytest.mark.parametrize(("evict", "last"), [("eager", "noop"), ("lazy", "release")])
def test_replay(log, evict, last):
    got = leases.lease_replay(log, 30, evict).where("resource = 1").orderBy("event_id").collect()
    assert [r.outcome for r in got] == [*OUT, last]


OPS = "resource long, sec long, event_id long, agent long, op string"


@pytest.mark.parametrize("order", [[0, 1, 2], [0, 2, 1], [2, 0, 1]])
def test_stream_equals_replay(spark, order):
    """Three micro-batches in wrong order, within the watermark's delay, then a tick; all leases end in a release or expire."""
    day = 86400
    log = [(r, s + 100, i, {"A": 1, "B": 2}[a], op) for r in (1, 2) for i, (s, a, op) in enumerate(LOG)] + [(3, 5, 50, None, "acquire"), (4, 20, 51, 7, "acquire"), (None, 6, 52, 8, "acquire"), (None, 7, 53, 9, "acquire")]
    parts = [spark.createDataFrame([x for j, x in enumerate(log) if j % 3 == i], OPS) for i in order]
    tick = spark.createDataFrame([(-1, 9 * day, -1, -1, "tick")], OPS)
    got = streams.drained(streams.lease_stream(streams.staged([*parts, tick], 1), 30)).collect()
    replay = {(r.resource, r.event_id): r.outcome.replace("_after_expiry", "") for r in leases.lease_replay(spark.createDataFrame(log, OPS), 30).collect()}
    assert {(r.resource, r.event_id): r.outcome for r in got if r.op != "expired"} == replay and replay[None, 53] == "block"
    assert sorted(((r.resource, r.sec, r.agent) for r in got if r.op == "expired"), key=str) == [(1, 142, 1), (1, 182, 1), (2, 142, 1), (2, 182, 1), (4, 50, 7), (None, 36, 8)]


def test_late_events_and_forgotten_visits(spark):
    parts = [[(1, 1000, 1, 5, "acquire")], [(1, 900_000, 2, 6, "acquire")], [(1, 10, 3, 7, "acquire")], [(-1, 2_000_000, -1, -1, "tick")]]
    live = streams.staged([spark.createDataFrame(x, OPS) for x in parts], 1)
    got = streams.drained(streams.lease_stream(live, 30)).where("op <> 'expired'").collect()
    assert {(r.event_id, r.outcome) for r in got} == {(1, "grant"), (2, "grant"), (3, "late")}
    visits = [spark.createDataFrame(x, "agent string, node string, at timestamp") for x in spark_days()]
    out = streams.drained(streams.traversal_dedupe(streams.staged(visits, 1), ["agent", "node"], "at", "1 day"))
    assert sorted(r.at.day for r in out.collect()) == [1, 20, 25]


def spark_days():
    import datetime

    day = lambda n: datetime.datetime(2024, 1, n)
    return [[("a", "x", day(1))], [("a", "y", day(20))], [("a", "x", day(25))], [("a", "x", day(25))]]


def test_index_stream(spark, rows, tmp_path):
    schema = "file string, seq long, event string, text string"
    parts = [
        [("f", 1, "change", "a"), ("f", 2, "change", "b\ng"), ("g", 3, "change", "x"), ("h", 4, "change", "g"), ("k", 5, "change", "f"), ("m", 6, "unlink", None)],
        [("f", 7, "change", "b\ng"), ("g", 8, "unlink", None), ("k", 9, "change", "f\nh")],
    ]
    index = streams.Index(spark, str(tmp_path / "index"), buckets=3)
    segment = lambda x: corpus.segment_lines(x, "file").withColumn("kind", F.lit("benign"))
    links = lambda x: x.select(F.col("file").alias("src"), F.explode(F.split("text", "\n")).alias("dst")).where("length(dst) = 1 and dst between 'f' and 'm'")
    streams.index_stream(streams.staged([spark.createDataFrame(x, schema) for x in parts], 1), index, segment, links, str(tmp_path / "state")).awaitTermination()
    assert rows(index.read("nodes").select("node_id")) == [("f::1",), ("f::2",), ("h::1",), ("k::1",), ("k::2",)]
    assert rows(index.read("edges").select("src", "dst")) == [("k", "f"), ("k", "h")]  # those to g went with it
    assert rows(index.read("refresh").select("batch", "file")) == [(1, "f"), (1, "h")]


def test_drift_monitor_reports_missing_nodes(spark, rows, tmp_path):
    spark.createDataFrame([("f", {"f::1": "h1", "f::2": "H"}), ("g", {})], "file string, nodes map<string,string>").coalesce(1).write.parquet(str(tmp_path / "c"))
    live = spark.readStream.schema("file string, nodes map<string,string>").parquet(str(tmp_path / "c"))
    base = spark.createDataFrame([("f", "f::1", "h1"), ("f", "f::2", "h2"), ("f", "f::3", "h3"), ("g", "g::1", "h4"), ("z", "z::1", "h5")], "file string, node_id string, baseline_hash string")
    got = streams.drained(streams.drift_monitor(live, base))
    assert rows(got.select("node_id", "content_hash")) == [("f::2", "H"), ("f::3", None), ("g::1", None)]


def test_routed(spark, rows, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, t string").write.parquet(str(tmp_path / "e"))
    live = spark.readStream.schema("id long, t string").parquet(str(tmp_path / "e"))
    streams.routed(live, [(F.col("t") == "a", "x"), (F.col("t") < "c", "y")], "z", str(tmp_path / "o"), str(tmp_path / "s")).awaitTermination()
    assert sorted(x.name for x in (tmp_path / "o").iterdir() if x.name.startswith("mode")) == ["mode=x", "mode=y", "mode=z"]
    assert rows(spark.read.parquet(str(tmp_path / "o" / "mode=y")).select("id")) == [(2,)]


@pytest.mark.parametrize(
    ("now", "own", "want"),
    [("x1 y2 z9", "", ""), ("x1 yH", "", "y"), ("x1", "", "y"), ("x1 yH", "y", ""), ("xH y2", "x", "x")],
)
def test_drift(spark, now, own, want):
    base = spark.createDataFrame([("A", "x", "x", "h1"), ("A", "x", "y", "h2")], "agent string, lease_node string, node_id string, content_hash string")
    current = spark.createDataFrame([(x[0], "h" + x[1]) for x in now.split()], "node_id string, content_hash string")
    seen = spark.createDataFrame([("A", x) for x in own.split()], "agent string, node_id string")
    assert {r.node_id for r in drift.snapshot_drift(base, current, seen).collect()} == set(want.split())


def test_whole_file_marks_are_no_nodes(spark):
    base = spark.createDataFrame([("A", "f::__file__", "f::__file__", "h1"), ("A", "f::__file__", "f::1", "h2")], "agent string, lease_node string, node_id string, content_hash string")
    now = spark.createDataFrame([("f::1", "h2")], "node_id string, content_hash string")
    assert drift.snapshot_drift(base, now, now.where("false").selectExpr("'A' as agent", "node_id")).isEmpty()


def test_null_groups(spark, rows):
    nodes = spark.createDataFrame([(None, "a", 1, "h1"), (None, "b", 1, "h2"), (None, "b", 2, "h3"), ("g", "c", 1, "h4")], "g string, file string, line_no int, content_hash string")
    sha = lambda *h: hashlib.sha256("".join(h).encode()).hexdigest()
    want = [("g", sha(sha("h4"))), (None, sha(sha("h1"), sha("h2", "h3")))]
    assert sorted(rows(drift.merkle_root(nodes, ["g"])), key=str) == sorted(want, key=str)
    assert drift.view_digest(nodes.withColumn("d", F.when(F.col("g").isNull(), float("nan"))), ["g", "d"], "file", "content_hash").count() == 2
    log = spark.createDataFrame([(None, 1, 1, 5, "acquire"), (None, 2, 2, 6, "acquire"), (None, 3, 3, None, "release"), (None, 4, 4, 5, "release")], OPS)
    assert [r.outcome for r in leases.lease_replay(log, 30).orderBy("event_id").collect()] == ["grant", "block", "noop", "release"]
    placed = drift.places_in_order(nodes.repartition(3), ["g"], "file", "line_no")
    assert rows(placed.select("g", "file", "line_no", "place")) == [("g", "c", 1, 1), (None, "a", 1, 1), (None, "b", 1, 2), (None, "b", 2, 3)]


def test_merkle(spark, nodes, rows):
    leaf = lambda *h: hashlib.sha256("".join(h).encode()).hexdigest()
    root = leaf(leaf("h1", "h2", "h3"), leaf("h4"), leaf("h5"))
    n = nodes.withColumn("all", F.lit(1))
    assert rows(drift.merkle_root(n, ["all"], order="line_start")) == [(1, root)]
    assert rows(drift.merkle_root(n.where("false"), ["all"], order="line_start")) == []
    ids = spark.createDataFrame([("b::p",), ("nope",)], "node_id string")
    assert rows(drift.merkle_of_nodes(n, ids, ["all"], order="line_start")) == [(1, leaf(leaf("h4")))]


@pytest.mark.parametrize(
    ("required", "actual", "ok"),
    [("x:int", "x:int y:str", True), ("x:int y:str", "x:int", False), ("$:int", "$:float", False), ("$:bool", "$:int", False), ("$:ARRAY $[]:UNKNOWN", "$:ARRAY $[]:int", True), ("$:ARRAY $[]:int", "$:ARRAY $[]:UNKNOWN", False), ("x:NULL", "x:int", False), ("x:NULL", "x:NULL", True)],
)
def test_superset(spark, required, actual, ok):
    frame = lambda x: spark.createDataFrame([("e", *y.split(":")) for y in x.split()], "entity string, path string, type string")
    assert contracts.superset_check(frame(required), frame(actual)).first().satisfied is ok


def test_structure(spark, rows):
    got = contracts.infer_structure(spark.createDataFrame([("e", '{"a": [1, "x"], "b": {"c": true}, "n": null, "l": [], "f": 1.0, "g": 12345678901234567890}'), ("e", "not json"), ("f", None)], "e string, j string"), "e", "j")
    want = [("$", "OBJECT"), ("$.a", "ARRAY"), ("$.a[]", "BIGINT"), ("$.b", "OBJECT"), ("$.b.c", "BOOLEAN"), ("$.f", "DOUBLE"), ("$.g", "BIGINT"), ("$.l", "ARRAY"), ("$.l[]", "UNKNOWN"), ("$.n", "NULL")]
    assert rows(got) == [("e", *x, 1) for x in want]


def test_records_that_lack_a_path(spark):
    shape = lambda *x: contracts.infer_structure(spark.createDataFrame([("e", y) for y in x], "e string, j string"), "e", "j")
    required = contracts.required_paths(shape('{"a": 1, "o": 1}', '{"a": null}'))
    assert {(r.path, r.type) for r in required.collect()} == {("$", "OBJECT"), ("$.a", "BIGINT"), ("$.a", "NULL")}
    check = lambda *x: contracts.superset_check(required, shape(*x)).first()
    assert check('{"a": 1}', '{"b": 2}')[1:] == (2, 1, 0, False)
    assert check('{"a": 1}', '{"a": "x", "b": 1}', '{"a": null}')[1:] == (3, 0, 1, False)
    assert check('{"a": 1, "c": []}')[1:] == (1, 0, 0, True)


def test_keys_are_compared_level_by_level(spark):
    shape = lambda x: contracts.infer_structure(spark.createDataFrame([("e", x)], "e string, j string"), "e", "j")
    pairs = ['{"a.b": 1}', '{"a": {"b": 1}}', '{"a": {"[]": 1}}', '{"a": [1]}', r'{"a\"][\"b": 1}', '{"a[]": 1}', '{"": 1}', '{"\\n": 1}']
    for x in pairs:
        required = contracts.required_paths(shape(x))
        assert [contracts.superset_check(required, shape(y)).first().satisfied for y in pairs] == [x == y for y in pairs], x


def test_structure_beyond_one_pass(spark):
    deep = '{"a": ' * 20 + "[[1]]" + "}" * 20
    shape = lambda depth: {(r.path, r.type): r.n_records for r in contracts.infer_structure(spark.createDataFrame([("e", deep), ("e", '{"a": 1}')], "e string, j string"), "e", "j", depth).collect()}
    whole = shape(None)
    assert len(whole) == 24 and whole["$", "OBJECT"] == 2 and whole["$" + ".a" * 20 + "[][]", "BIGINT"] == 1 and whole["$.a", "BIGINT"] == 1
    assert shape(9) == {k: n for k, n in whole.items() if k[0].count(".") <= 9} and shape(0) == {("$", "OBJECT"): 2}


def test_structure_has_no_last_level(spark):
    def shape(x):
        return contracts.infer_structure(spark.createDataFrame([("e", x), ("f", '{"k": 1}')], "e string, j string"), "e", "j")

    deep = '{"a": {"b": {"c": {"d": [[{"x": %s}]]}}}}'
    got = {(r.entity, r.path): r.type for r in shape(deep % "1").collect()}
    assert got["e", "$.a.b.c.d[][].x"] == "BIGINT" and got["f", "$.k"] == "BIGINT" and len(got) == 10
    checks = [contracts.superset_check(shape(deep % "1"), shape(x)).where("entity = 'e'").first() for x in (deep % "1", deep % '"1"', deep.replace("x", "y") % "1")]
    assert [(c.n_missing, c.n_mismatched, c.satisfied) for c in checks] == [(0, 0, True), (0, 1, False), (1, 0, False)]


FILES = [
    ("pkg/net.py", "import requests\n\ndef get(u):\n    return requests.get(u)\n"),
    ("pkg/alias.py", "import subprocess as sp\n\ndef run(c):\n    return sp.run(c)\n\ndef twice(c):\n    run(c)\n    return run(c)\n"),
    ("pkg/cls.py", "import socket\n\nclass K:\n    def open(self):\n        return socket.create_connection(1)\n    def use(self):\n        return self.open()\n    @property\n    def v(self):\n        return 1\n    @v.setter\n    def v(self, x):\n        pass\n"),
    ("pkg/user.py", "from .net import get as fetch\n\ndef page(u):\n    return fetch('x', 3)\n\ndef pure(a):\n    return a + 1\n"),
    ("pkg/pure.py", "def f(a):\n    return g(1, b='z')\n\ndef g(a, b):\n    return a\n"),
    ("pkg/bad.py", "def f(:\n"),
    ("pkg/empty.py", "# nothing\n"),
]


def test_code(spark, rows):
    files = spark.createDataFrame(FILES, "path string, source string")
    records = corpus.parsed(files).cache()
    assert {r.path: r.name for r in records.where("record = 'status'").collect()} == {p: "syntax_error" if "bad" in p else "ok" for p, _ in FILES}
    ids = {r.node_id for r in corpus.code_nodes(records).collect()}
    assert {"pkg/cls.py::K.v", "pkg/cls.py::K.v#2"} <= ids and not any("empty" in x or "bad" in x for x in ids)
    assert ("pkg/alias.py", "sp", "subprocess") in rows(corpus.import_aliases(records))
    assert rows(corpus.bound_symbols(records, files)) == [("pkg/user.py", "fetch", "pkg/net.py", "get")]
    inside = {"pkg/net.py::get", "pkg/alias.py::run", "pkg/alias.py::twice", "pkg/cls.py::K.open", "pkg/cls.py::K.use"}
    assert {r.node_id for r in corpus.external_functions(records).collect()} == inside
    assert {r.node_id for r in corpus.external_functions(records, files).collect()} == inside | {"pkg/user.py::page"}
    asked = spark.createDataFrame([("g",), ("run",)], "name string")
    assert rows(corpus.call_site_args(asked, records)) == [("g", "pkg/pure.py", "([1], {'b': 'z'})")]


def test_scan(spark, rows, tmp_path):
    for path, source in [*FILES[:1], ("venv/x.py", "1"), ("pkg/note.txt", "n")]:
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(source)
    assert rows(t.corpus_scan(spark, str(tmp_path))) == [FILES[0]]


def test_tables(spark, rows):
    r = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (2, 5, "c")], "k long, seq long, v string")
    assert rows(t.upsert_last_wins(r, ["k"], ["seq"])) == [(1, 2, None), (2, 5, "c")]
    assert rows(t.append_first_wins(r, ["k"], ["seq"])) == [(1, 1, "a"), (2, 5, "c")]
    names = spark.createDataFrame([("K_.f",), ("kx.g",), ("top",)], "name string")
    ask = spark.createDataFrame([("K_",), ("top",), ("k%",)], "prefix string")
    assert rows(t.prefix_exists(names, ask)) == [("K_",)]
    assert rows(t.prefix_exists(names.where("name <> 'K_.f'"), ask, like_compat=True)) == [("K_",)]


def test_stop_fans_out(spark):
    log = spark.createDataFrame([(1, 0, 0, 5, "acquire"), (2, 1, 1, 5, "acquire"), (9, 2, 2, 5, "stop"), (1, 3, 3, 6, "acquire")], "resource long, sec long, event_id long, agent long, op string")
    got = leases.lease_replay(leases.agent_release_fanout(log), 30)
    assert {(r.resource, r.event_id, r.outcome) for r in got.collect()} == {(1, 0, "grant"), (2, 1, "grant"), (1, 2, "release"), (2, 2, "release"), (1, 3, "grant")}


def test_default_lists(spark):
    modules = "requests httpx aiohttp urllib urllib3 socket smtplib ftplib psycopg2 asyncpg pymysql sqlalchemy pymongo redis elasticsearch boto3 botocore openai anthropic subprocess".split()
    assert sorted(corpus.EXTERNAL) == sorted(modules)
    source = "import sqlite3\n" + "".join(f"import {m}\n" for m in modules) + "def own():\n    return sqlite3.connect(1)\n" + "".join(f"def f_{m}():\n    return {m}.call(1)\n" for m in modules)
    records = corpus.parsed(spark.createDataFrame([("a.py", source)], "path string, source string"))
    assert {r.node_id for r in corpus.external_functions(records).collect()} == {f"a.py::f_{m}" for m in modules}
    folders = ".venv venv .env env site-packages __pycache__ .git node_modules .tox build dist".split()
    files = spark.createDataFrame([(f"{x}/a.py",) for x in [*folders, "kept"]], "path string")
    assert [r.path for r in t.corpus_scan_df(files).collect()] == ["kept/a.py"]
