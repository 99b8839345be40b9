"""Inputs that ended a job or gave wrong rows before."""

from __future__ import annotations

import ast
import subprocess
import sys
import time

from pyspark.sql import functions as F

from driftwood.operators import corpus, drift
from driftwood.streaming import streams


def test_odd_source_gives_a_status(spark):
    odd = ["g({[]: 1})", "x = " + "-" * 20_000 + "1", "x" + "()" * 20_000, "f(" * 500 + ")" * 500, "def f():\n    g({[]: 1}, [1] * 2)\n", "\x00", "s = '\ud800'", "f(1)\r\nif x:\r  y = 'é'\n\x0cz = 1\n", None, ""]
    rows = corpus.parsed(spark.createDataFrame([(str(i), x) for i, x in enumerate(odd) if x is None or "\ud800" not in x], "path string, source string")).where("record = 'status'").collect()
    assert {r.path: r.name for r in rows if r.name != "ok"}.keys() <= {"1", "2", "3", "5"} and len(rows) == len(odd) - 1
    source = odd[7]
    got = [r for r in corpus._records("p", source) if r[1] == "node"]
    import hashlib

    assert [r[9] for r in got] == [hashlib.sha256(ast.get_source_segment(source, x).encode()).hexdigest() for x in ast.parse(source).body]


def test_parsing_takes_linear_time():
    def took(n):
        began = time.process_time()
        assert sum(1 for _ in corpus._records("p", "".join(f"v{i} = {i}\n" for i in range(n)))) == n + 1
        return time.process_time() - began

    took(500)
    assert took(16_000) < 8 * max(took(4_000), 0.05)


def test_repeated_baseline_rows(spark):
    changes = streams.staged([spark.createDataFrame([("f", {"a": "1", "b": "2"})], "file string, nodes map<string,string>")])
    baseline = spark.createDataFrame([("f", "a", "0"), ("f", "a", "0"), ("f", "a", "1"), ("f", "c", "9")], "file string, node_id string, baseline_hash string")
    got = streams.drained(streams.drift_monitor(changes, baseline)).collect()
    assert sorted((r.node_id, r.baseline_hash, r.content_hash) for r in got) == sorted([("a", "0", "1"), ("a", "0", "1"), ("c", "9", None)], key=str)


def test_stale_nodes_of_a_null_group(spark, rows):
    old = spark.createDataFrame([(None, "a", "1"), ("s", "b", "1"), ("s", "c", "1"), ("t", "d", "1"), (None, None, "1")], "source string, node_id string, content_hash string")
    new = old.withColumn("content_hash", F.when(F.col("node_id").isin("a", "b") | F.col("node_id").isNull(), "2").otherwise(F.col("content_hash")))
    assert rows(drift.stale_nodes(old, new, ["source"], ["source", "node_id"])) == sorted([(None, "a"), (None, None), ("s", "b")], key=str)
    assert rows(drift.stale_nodes(old, new, ["source"], ["node_id"])) == sorted([("a",), ("b",), (None,)], key=str)


def test_operators_ship_the_package(tmp_path):
    """A session of its own whose workers don't find the package by path."""
    code = """
import sys
sys.path.insert(0, %r)
from pyspark.sql import SparkSession
from driftwood.operators.leases import lease_replay
spark = SparkSession.builder.master("local-cluster[1,1,512]").config("spark.executor.memory", "512m").config("spark.ui.enabled", "false").getOrCreate()
log = spark.createDataFrame([(1, 0, 1, 7, "acquire")], "resource long, sec long, event_id long, agent long, op string")
print([r.outcome for r in lease_replay(log, 30).collect()])
"""
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_ENV_LOADED", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")} | {"PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13"}
    out = subprocess.run([sys.executable, "-c", code % root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "['grant']" in out.stdout, out.stderr[-2000:]


def test_live_drift_over_two_streams(spark):
    def stream(schema, *parts):
        to = lambda rows: spark.createDataFrame(rows, schema).withColumn(schema.split()[-2], F.timestamp_seconds(schema.split()[-2]))
        return streams.staged([to(x) for x in parts], files=1)

    hour = 3600
    captures = stream("node_id string, baseline_hash string, captured_at long", [("a", "1", 1), ("b", "1", 10), ("c", "1", 20), ("d", "1", 30), (None, "1", 40)], [("e", "1", 5 * hour), ("late", "1", 0)], [("f", "1", 99 * hour)])
    changes = stream("node_id string, content_hash string, changed_at long", [("a", "2", 60), ("b", "1", 60), ("c", None, 60), ("a", "1", hour + 2)], [("d", "2", 31), ("e", "3", 5 * hour)], [("x", "1", 99 * hour)])
    got = streams.drained(streams.live_drift(captures, changes, "1 hour", "1 minute")).collect()
    seen = {(r.node_id, r.content_hash, r.status) for r in got}
    assert seen >= {("a", "2", "drifted"), ("b", "1", "same"), ("c", None, "gone"), ("d", "2", "drifted"), ("e", "3", "drifted"), (None, None, "quiet")}, seen
    assert not any(r.node_id in ("x", "f") for r in got)
    still = streams.live_drift(spark.createDataFrame([("a", "1")], "node_id string, baseline_hash string").withColumn("captured_at", F.timestamp_seconds(F.lit(0))), spark.createDataFrame([], "node_id string, content_hash string, changed_at timestamp"))
    assert [r.status for r in still.collect()] == ["quiet"]
