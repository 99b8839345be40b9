"""Ordered operators on groups that hold most of the rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from driftwood.operators import graph, leases, ordered

LOG = "resource long, sec long, event_id long, agent long, op string"


def random_log(seed, n, resources):
    r = random.Random(seed)
    return [
        (r.choice([*resources, None]), r.choice([r.randrange(3_000), r.randrange(3_000), None if r.random() < 0.1 else 5]), i, r.choice([1, 2, 3, None if r.random() < 0.2 else 1]), r.choice(["acquire", "acquire", "release", "failure", "stop", None]))
        for i in range(n)
    ]


@pytest.mark.parametrize("evict", ["eager", "lazy"])
def test_split_replay_is_the_replay(spark, rows, evict):
    for seed, ttl in ((1, 30), (2, 5), (3, 0), (4, 400)):
        log = spark.createDataFrame(random_log(seed, 900, [1, 2]), LOG)
        assert rows(leases.lease_replay_split(log, ttl, evict, width=50)) == rows(leases.lease_replay(log, ttl, evict))


def test_hot_resource_is_several_tasks(spark, monkeypatch):
    r = random.Random(5)
    log = spark.createDataFrame([(1, 100 * i + r.randrange(20), i, r.randrange(3), r.choice(["acquire", "release"])) for i in range(4_000)], LOG)
    kept = {}
    monkeypatch.setattr(leases, "written", lambda df, name: kept.setdefault(name, df))
    leases.lease_replay_split(log, 30)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = [r["count"] for r in kept["replayed"].groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 3_000


@pytest.mark.parametrize("inclusive", [False, True])
def test_last_before_is_the_window(spark, rows, inclusive):
    r = random.Random(6)
    data = [(r.choice(["hot", "hot", "hot", "a", None]), r.choice([r.randrange(500), None if r.random() < 0.1 else 7]), i, r.choice([None, None, r.randrange(99)])) for i in range(800)]
    df = spark.createDataFrame(data, "k string, sec long, id long, v int")
    order = Window.partitionBy("k").orderBy("sec", "id").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = df.withColumn("last", F.last("v", ignorenulls=True).over(order))
    assert rows(ordered.last_before(df, ["k"], "sec", ["sec", "id"], F.col("v"), 20, "last", inclusive)) == rows(want)


def test_ranks_are_row_numbers(spark, rows):
    r = random.Random(7)
    data = [(r.choice(["hot", "hot", "hot", "a", None]), r.randrange(50), i) for i in range(3_000)]
    df = spark.createDataFrame(data, "g string, p int, id long")
    got = ordered.ranked(df, ["g"], [F.col("p").desc(), F.col("id")], "place", pieces=7)
    want = df.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy(F.col("p").desc(), "id")))
    assert rows(got.withColumn("place", F.col("place").cast("long"))) == rows(want.withColumn("place", F.col("place").cast("long")))
    counts = df.repartitionByRange(7, "g", F.col("p").desc(), "id").where("g = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    assert len(counts) > 3  # the hot group is several tasks


def test_long_queue_and_many_dependents(spark):
    q = spark.createDataFrame([(i, 1, 9, i % 3) for i in range(2_000)] + [(5_000, None, 9, 1)], "id long, node long, agent long, priority int")
    got = {r.id: r.position for r in leases.queue_position(q).collect()}
    order = sorted(range(2_000), key=lambda i: (-(i % 3), i))
    assert got == {x: i for i, x in enumerate(order)} | {5_000: 0}
    reached = spark.createDataFrame([("s", f"n{i:04}", 1 + i % 3) for i in range(1_000)] + [("s", "s", 0)], "seed string, node string, hop int")
    places = [r.node for r in graph.dependents_order(reached).orderBy("place").collect()]
    assert places == sorted((f"n{i:04}" for i in range(1_000)), key=lambda n: (int(n[1:]) % 3 != 0, n))


def test_victim_gives_back_and_asks_again(spark, rows):
    log = spark.createDataFrame([(1, 5, 1, 7, "acquire"), (2, 6, 2, 7, "intent"), (2, 7, 3, 8, "acquire"), (1, 8, 4, 8, "intent"), (3, 30, 9, 7, "acquire")], LOG)
    victims = spark.createDataFrame([(7, 10, 5)], "agent long, sec long, event_id long")
    added = leases.victim_release_fanout(log, victims).exceptAll(log)
    assert rows(added) == [(1, 10, 5, 7, "release"), (2, 10, 5, 7, "intent")]


def test_walk_merges_what_it_has_seen(spark, monkeypatch):
    monkeypatch.setattr(graph, "MERGED", 2)
    edges = spark.createDataFrame([(i, i + 1) for i in range(7)] + [(3, 0)], "src long, dst long")
    got = graph.bounded_bfs(edges, spark.createDataFrame([(0,), (5,)], "node long"), None)
    assert {(r.seed, r.node): r.hop for r in got.collect()} == {(0, i): i for i in range(8)} | {(5, 5): 0, (5, 6): 1, (5, 7): 2}
