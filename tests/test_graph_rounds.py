"""Walks whose rounds must not follow the length of a path."""

from __future__ import annotations

import random

from driftwood.operators import graph


def components(edges):
    """Strongly connected components by reachability."""
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())
    reach = {}
    for a in out:
        seen, todo = set(), list(out[a])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out[x]
        reach[a] = seen
    return sorted((a, min(b for b in reach[a] if a in reach[b])) for a in out if a in reach[a])


def test_components_of_random_graphs(spark, rows):
    for seed, (n, m) in enumerate([(12, 14), (40, 44), (40, 60), (60, 62), (30, 90)]):
        r = random.Random(seed)
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)]
        # rings and paths hung on
        for k in range(3):
            at, ring = r.randrange(n), [100 * (k + 1) + i for i in range(r.randrange(1, 9))]
            r.shuffle(ring)
            edges += list(zip([at, *ring], [*ring, r.choice([at, r.randrange(n)])]))
        r.shuffle(edges)
        got = graph.cycle_components(spark.createDataFrame(edges + edges[:5], "src long, dst long"))
        assert rows(got) == sorted(components(edges), key=str), seed


def test_names_as_nodes(spark, rows):
    edges = [("b", "a"), ("a", "c"), ("c", "b"), ("x", "x"), ("y", "a"), ("c", "z")]
    assert rows(graph.cycle_components(spark.createDataFrame(edges, "src string, dst string"))) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x")]


def test_long_ring_and_chain_in_few_rounds(spark, monkeypatch):
    n, written, rounds = 10_000, graph.written, []
    monkeypatch.setattr(graph, "written", lambda df, name: (rounds.append(name), written(df, name))[1])
    ids = list(range(2 * n))
    random.Random(1).shuffle(ids)
    ring, chain = ids[:n], ids[n:]
    edges = list(zip(ring, ring[1:] + ring[:1])) + list(zip(chain, chain[1:]))
    got = graph.cycle_components(spark.createDataFrame(edges, "src long, dst long"))
    assert {tuple(x) for x in got.collect()} == {(x, min(ring)) for x in ring}
    assert rounds.count("cycle-nodes") <= 40 and rounds.count("colors") <= 8 and rounds.count("cycle-pointers") <= 8
