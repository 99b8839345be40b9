"""Jobs whose cost grew faster than their input and result."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from driftwood.operators import contracts, leases
from driftwood.streaming import streams


@pytest.mark.parametrize(("seed", "evict", "block"), [(1, "eager", 1024), (2, "lazy", 2)])
def test_releases_of_a_session_are_not_replayed(spark, rows, monkeypatch, seed, evict, block):
    monkeypatch.setattr(leases, "END_BLOCK", block)
    rng = random.Random(seed)
    log, agents = [], [1, 2, 3, 4, 5, None]
    for i in range(400):
        op, agent = rng.choice(["acquire"] * 4 + ["release", "failure", "end", "intent"]), rng.choice(agents)
        session = rng.choice(["s", "t", None]) if agent in (5, None) else "st"[agent % 2]  # agent 5 is in several sessions
        log.append((session, rng.choice([10, 11, 12, None]), rng.choice([i * 5, i * 5, i * 5, i * 5, None]), i, agent, op))
    log += [("s", 10, 7, None, 2, "acquire"), ("t", None, 1900, None, None, "end"), ("s", None, 400, 777, None, "end"), ("s", None, 400, 777, None, "end")]
    table = spark.createDataFrame(log, "session string, resource long, sec long, event_id long, agent long, op string")
    want = leases.lease_replay(leases.session_release_fanout(table), 40, evict)
    got = leases.lease_replay_fanout(table, 40, "end", evict)
    assert rows(got) == rows(want)
    assert got.where("op = 'release' and outcome = 'release'").count() > 10
    assert "MapInArrow" not in got._jdf.queryExecution().toString()  # no release that does nothing goes through the replay
    assert rows(leases.lease_replay_fanout(table.where(F.col("op") != "end"), 40, "end", evict)) == rows(leases.lease_replay(table.drop("session").where("op <> 'end'"), 40, evict))


def test_shuffled_ends(spark, rows, monkeypatch):
    monkeypatch.setattr(leases, "BROADCAST_ENDS", 0)
    log = spark.createDataFrame([(i % 7, i % 3, i, i, i % 7, "stop" if i % 5 == 0 else "acquire") for i in range(200)], "session long, resource long, sec long, event_id long, agent long, op string")
    assert rows(leases.lease_replay_fanout(log, 30, "stop")) == rows(leases.lease_replay(leases.agent_release_fanout(log.drop("session")), 30).select("resource", "sec", "event_id", "agent", "op", "outcome"))


def shuffled(df):
    """Rows that the shuffles of a collected DataFrame wrote."""

    def walk(node):
        kind = node.getClass().getSimpleName()
        inner = node.children()
        below = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [inner.apply(i) for i in range(inner.size())]
        return (node.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0) + sum(map(walk, below))

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize(("broadcast", "evict", "pieces"), [(200_000, "eager", 4), (200_000, "lazy", 1000), (0, "eager", 4), (0, "lazy", 1000)])
def test_a_product_of_leases_and_ends_is_not_shuffled(spark, rows, monkeypatch, broadcast, evict, pieces):
    for name, value in {"END_BLOCK": 4, "BROADCAST_ENDS": broadcast, "RELEASES": 500, "AGENTS": pieces, "SPREAD": 8, "END_SLICE": 200}.items():
        monkeypatch.setattr(leases, name, value, raising=False)
    rng = random.Random(8)
    log = [("st"[i % 2], rng.choice([10, 11, None]), 10 * i + rng.randint(0, 9), i, rng.choice([i % 2 + 2 * k for k in range(20)]), "acquire") for i in range(600)]
    log += [("st"[i % 3 == 0], None, 10 * i + 3, 1000 + i, None, "end") for i in range(600)] + [("s", 10, 7, 3000, None, "acquire"), ("u", None, 9, 3001, None, "end"), ("w", 10, 9, 3002, 77, "acquire")]
    table = spark.createDataFrame(log, "session string, resource long, sec long, event_id long, agent long, op string")
    want = leases.lease_replay(leases.session_release_fanout(table), 25, evict)
    got = leases.lease_replay_fanout(table, 25, "end", evict)
    assert rows(got) == rows(want) and got.where("op = 'release' and outcome = 'release'").count() > 100
    assert got.count() > 30_000 and len(got.where("outcome = 'noop'").select("agent").distinct().collect()) == 41
    assert shuffled(got) < 3_000  # some 120 leases and 600 ends, in slices of 200 beyond the broadcast


def test_live_drift_meets_changes_of_the_time_only(spark, rows):
    rng = random.Random(3)
    hour = 3600
    at = lambda n: [rng.choice([rng.randint(-50 * hour, 50 * hour), hour * rng.randint(-50, 50)]) for _ in range(n)]
    old = [(i, rng.choice("ab"), "1", x) for i, x in enumerate([*at(300), None])]
    new = [(i, rng.choice("ab"), rng.choice(["1", "2", None]), x) for i, x in enumerate([*at(300), None])]
    time = lambda df, x: df.withColumn(x, F.timestamp_seconds(x))
    captures = time(spark.createDataFrame(old, "i long, node_id string, baseline_hash string, captured_at long"), "captured_at")
    changes = time(spark.createDataFrame(new, "j long, node_id string, content_hash string, changed_at long"), "changed_at")
    got = streams.live_drift(captures, changes, "3 hours")
    pairs = {(a[0], b[0]) for a in old for b in new if a[1] == b[1] and a[3] is not None and b[3] is not None and a[3] <= b[3] <= a[3] + 3 * hour}
    quiet = {(a[0], None) for a in old} - {(i, None) for i, _ in pairs}
    assert rows(got.select("i", "j")) == sorted(pairs | quiet, key=str) and len(pairs) > 300
    assert {r.i for r in got.where("status = 'quiet'").collect()} == {i for i, _ in quiet}
    keys = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x]
    assert len(keys) == 1 and "piece" in keys[0].split("[")[1]  # the join has the time among its keys
    for within in ("1 month", "1 day", "0 seconds"):
        want = captures.alias("c").join(changes.alias("x"), F.expr(f"c.node_id = x.node_id and changed_at >= captured_at and changed_at <= captured_at + interval {within}")).select("i", "j")
        assert rows(streams.live_drift(captures, changes, within).where("j is not null").select("i", "j")) == rows(want)


def test_alike_values_are_opened_once(spark, rows, monkeypatch):
    rng = random.Random(4)
    text = lambda: "".join(rng.choice('a1:,"\\\\[]{}.e-\\n true false é') for _ in range(rng.randint(0, 6)))
    odd = lambda: rng.choice(["1", "-0", "0", "1.0", "-1.25", "1e5", "1E-5", "2.5e+3", "123456789012345678", "9223372036854775807", "12345678901234567890", "1" * 39, "1" * 60, "12345678901234567890.0", "0." + "1" * 40, "true", "false", "null"])

    def value(depth):
        kind = rng.random()
        if depth and kind < 0.35:
            return "{" + ", ".join(f"{x}: {value(depth - 1)}" for x in {json.dumps(text()) for _ in range(rng.randint(0, 3))}) + "}"
        if depth and kind < 0.6:
            return "[" + rng.choice([",", " , "]).join(value(depth - 1) for _ in range(rng.randint(0, 3))) + "]"
        return json.dumps(text(), ensure_ascii=rng.random() < 0.5) if kind < 0.8 else odd()

    table = [("e", value(3)) for _ in range(1500)] + [("e", x) for x in ("{", '{"a": }', "01", "[1, 2", "", None, '{"a": "x"', ' {"k" : "v" , "w":[ "a" , 1 ]} ', '"', "\x04")]
    table = spark.createDataFrame(table, "e string, j string")
    got = rows(contracts.infer_structure(table, "e", "j"))
    repeated = spark.createDataFrame([("e", f'{{"a{i % 2}": {i}, "b": "{i}", "c": {i}.5, "d": [{i}, {i}]}}') for i in range(500)], "e string, j string")
    assert repeated.select(contracts.alike(F.col("j"))).distinct().count() == 2  # 500 values, two of them opened
    monkeypatch.setattr(contracts, "alike", lambda x: x)
    assert got == rows(contracts.infer_structure(table, "e", "j")) and len(got) > 500


def test_a_batch_without_repeats_writes_no_texts(spark, rows, tmp_path, monkeypatch):
    names, write = [], streams.written
    monkeypatch.setattr(streams, "written", lambda df, name: (names.append((name, tuple(df.columns))), write(df, name))[1])
    segment = lambda x: x.select("file", F.concat("file", F.lit("::1")).alias("node_id"), F.sha2("text", 256).alias("content_hash"), F.lit("benign").alias("kind"))
    links = lambda x: x.where("text like '-> %'").select(F.col("file").alias("src"), F.substring("text", 4, 9).alias("dst"))
    parts = [[("a", 1, "change", "x"), ("b", 1, "change", "-> a"), ("c", 1, "change", "-> b")], [("a", 2, "unlink", None), ("c", 3, "change", "z"), ("c", 2, "change", "-> a")], [("b", 4, "change", "-> a")]]
    index = streams.Index(spark, str(tmp_path / "index"), 2)
    live = streams.staged([spark.createDataFrame(x, "file string, seq long, event string, text string") for x in parts], 1)
    streams.index_stream(live, index, segment, links, str(tmp_path / "state")).awaitTermination()
    assert rows(index.read("nodes").select("file")) == [("b",), ("c",)] and index.read("nodes").where("file = 'c'").first().content_hash == rows(spark.sql("select sha2('z', 256)"))[0][0]
    assert rows(index.read("edges").select("src", "dst")) == [] and rows(index.read("refresh").select("file", "batch")) == [("b", 1)]
    assert [i for i, (_, cols) in enumerate(names) if "text" in cols] == [next(i for i, x in enumerate(names) if x[0] == "changes" and "text" in x[1])]  # only the batch that repeats a file
    assert sum(x[0] == "states" for x in names) == 2  # the first batch meets no known file; later ones are compared once each
