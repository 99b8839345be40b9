"""Walks over edge tables (src depends on dst)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.operators.ordered import ranked
from driftwood.sources.workspace import written


#: Rounds after which the tables of a walk become one.
MERGED = 6


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    forward = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    reverse = edges.select(F.col("dst").alias("node"), F.col("src").alias("next"))
    return {"forward": forward, "reverse": reverse, "both": forward.unionAll(reverse)}[direction].distinct()


def bounded_bfs(edges: DataFrame, seeds: DataFrame, depth: int | None, direction: str = "forward", on: list[str] | None = None) -> DataFrame:
    """(on ..., node, hop): what each seed reaches within ``depth`` hops (None: all), itself at hop 0.

    seeds has the columns ``on`` (what names a walk; the seed itself if none)
    and ``node``. Each round joins the frontier with the edges and takes off
    what the walk has seen; frontiers are written, so a lost executor repeats
    one round, and every few rounds what was seen is written as one table, so
    that a round does not scan one for each round before it. Only emptiness
    reaches the driver.
    """
    on = on or ["seed"]
    if on == ["seed"] and "seed" not in seeds.columns:
        seeds = seeds.select(F.col("node").alias("seed"), "node")
    steps = written(_steps(edges, direction), "steps")
    frontier = written(seeds.select(*on, "node").distinct().withColumn("hop", F.lit(0)), "frontier")
    seen, hop = frontier, 0
    while depth is None or hop < depth:
        hop += 1
        found = frontier.join(steps, "node").select(*on, F.col("next").alias("node")).distinct()
        frontier = written(found.join(seen, [*on, "node"], "left_anti").withColumn("hop", F.lit(hop)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
        if hop % MERGED == 0:
            seen = written(seen, "seen")
    return seen


def propagate_labels(edges: DataFrame, seeds: DataFrame, max_iter: int | None = None) -> DataFrame:
    """(node, label): a node has the labels of all that it depends on. seeds: (node, label). Cycles end by themselves."""
    out = bounded_bfs(edges, seeds.select("label", "node"), max_iter, "reverse", on=["label"])
    return out.select("node", "label")


def neighbourhood_minus_self(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "forward") -> DataFrame:
    return bounded_bfs(edges, seeds, depth, direction).where("seed <> node")


def dependents_order(reached: DataFrame) -> DataFrame:
    """(node, hop, place): direct dependents first, then by name; place from 1. A seed with very many dependents is many tasks."""
    return ranked(reached.where("hop > 0"), ["seed"], [F.col("hop") > 1, F.col("node")], "place")


def cold_nodes(candidates: DataFrame, nodes: DataFrame, col: str) -> DataFrame:
    return candidates.select(col).distinct().join(nodes.select(col), col, "left_anti")


def trimmed(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """The edges left after nodes without a way in or out are taken off, a few times: all cycles are in them."""
    edges = edges.distinct()
    for _ in range(rounds):
        edges = edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst")
    return written(edges, "cycle-edges")


def contracted(edges: DataFrame, first: int = 0) -> tuple[DataFrame, list[DataFrame]]:
    """(edges, taken): the edges of distinct ``edges`` after nodes that decide nothing about cycles are taken out.

    Nodes without a way in or out go. A node with one way in and one way out is
    on a cycle if and only if an edge from the one to the other would be, which
    takes its place; of neighbours the one with the largest hash goes, and each
    round has other hashes, so that a third of a path goes in a round and paths
    and rings of n nodes end after some log n rounds. taken: (node, from, to),
    the nodes for which an edge was put in, by round. Rounds go on while they
    take something worth it; what is left is right at any time.
    """
    taken: list[DataFrame] = []
    while size := edges.count():
        ways = F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("to"), F.lit(None).alias("from")), F.struct(F.col("dst").alias("node"), F.lit(None).alias("to"), F.col("src").alias("from")))
        ends = edges.select(F.inline(ways)).groupBy("node").agg(F.count("to").alias("outs"), F.count("from").alias("ins"), F.min("to").alias("to"), F.min("from").alias("from"))
        h = lambda x: F.xxhash64(x, F.lit(first + len(taken)))
        through = F.expr("ins = 1 and outs = 1 and from <> node and to <> node") & (h("node") > h("from")) & (h("node") > h("to"))
        gone = written(ends.where(F.expr("ins = 0 or outs = 0") | through).select("node", F.when(through, F.col("from")).alias("from"), F.when(through, F.col("to")).alias("to")), "cycle-nodes")
        n = gone.count()
        if not n:
            break
        out = gone.select("node")
        left = edges.join(out, F.col("src") == F.col("node"), "left_anti").join(out, F.col("dst") == F.col("node"), "left_anti")
        edges = written(left.unionAll(gone.where("from is not null").select(F.col("from").alias("src"), F.col("to").alias("dst"))).distinct(), "cycle-edges")
        taken.append(gone.where("from is not null"))
        if n * 20 < size:
            break
    return edges, taken


def _least_reaching(edges: DataFrame) -> DataFrame:
    """(node, color): the smallest node from which each node can be reached.

    Besides along edges, a color is taken over from the node that is the color
    so far, as what reaches that one reaches this one too; colors so come from
    twice as far each round along most ways.
    """
    color = written(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("color", F.col("node")), "colors")
    while True:
        far = color.select(F.col("node").alias("at"), F.col("color").alias("far"))
        near = edges.join(far, F.col("src") == F.col("at")).groupBy("dst").agg(F.min("far").alias("near"))
        step = color.join(near, F.col("node") == F.col("dst"), "left").join(far, F.col("color") == F.col("at"), "left")
        best = F.least("color", "near", "far")
        step = written(step.select("node", best.alias("color"), (best < F.col("color")).alias("moved")), "colors")
        color = step.select("node", "color")
        if step.where("moved").isEmpty():
            return color


def _lasting(taken: DataFrame) -> DataFrame:
    """(node, from, to): for nodes that were taken out the edge that stands for them in the end, by pointer doubling over edges that took each other's place."""
    key = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    own = key("from", "to")
    pointer = written(taken.select(F.inline(F.array(F.struct(key("from", "node").alias("edge"), own.alias("by")), F.struct(key("node", "to").alias("edge"), own.alias("by"))))), "cycle-pointers")
    at = taken.select("node", own.alias("edge"))
    while True:
        further = pointer.select(F.col("edge").alias("by"), F.col("by").alias("then"))
        step = written(pointer.join(further, "by", "left").select("edge", F.coalesce("then", "by").alias("by"), F.col("then").isNotNull().alias("moved")), "cycle-pointers")
        pointer = step.select("edge", "by")
        if step.where("moved").isEmpty():
            break
    last = at.join(pointer, "edge", "left").select("node", F.coalesce("by", "edge").alias("edge"))
    return last.select("node", F.col("edge.a").alias("from"), F.col("edge.b").alias("to"))


def cycle_components(edges: DataFrame) -> DataFrame:
    """(node, cycle): nodes on cycles of edges (src, dst), with the smallest node of their strongly connected component.

    Paths and rings are contracted first. Then each round gives every node the
    smallest node that reaches it as its color, and within a color the smallest
    node that it reaches: those that reach the color's own node are its component
    and go, at least one a color. At last contracted nodes join the component
    that both ends of the edge in their place are in. No table has more rows than
    the graph has nodes or edges, and rounds follow the logarithm of a path's
    length, not the length.
    """
    edges, taken = contracted(written(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "cycle-edges"))
    parts: list[DataFrame] = []
    while not edges.isEmpty():
        color = _least_reaching(edges)
        ends = lambda x: color.select(F.col("node").alias(x), F.col("color").alias(f"{x}_color"))
        inside = written(edges.join(ends("src"), "src").join(ends("dst"), "dst").where("src_color = dst_color").select("src", "dst"), "cycle-edges")
        back = _least_reaching(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumnRenamed("color", "back")
        members = written(color.join(back, "node", "left").where("color = coalesce(back, node)").select("node", F.col("color").alias("cycle")), "components")
        alone = edges.where("src = dst").select(F.col("src").alias("node"))
        many = members.groupBy("cycle").agg(F.count("*").alias("n")).where("n > 1").select("cycle")
        parts.append(members.join(many, "cycle", "left_semi").select("node", "cycle").union(members.join(alone, "node", "left_semi").select("node", "cycle")).distinct())
        gone = members.select("node")
        left = edges.join(gone, F.col("src") == F.col("node"), "left_anti").join(gone, F.col("dst") == F.col("node"), "left_anti")
        edges, more = contracted(written(left, "cycle-edges"), len(taken))
        taken += more
    if not parts:
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("cycle"))
    found = written(reduce(DataFrame.unionAll, parts), "components")
    if taken:
        of = lambda x: found.select(F.col("node").alias(x), F.col("cycle").alias(f"{x}_cycle"))
        on = _lasting(written(reduce(DataFrame.unionAll, taken), "cycle-nodes")).join(of("from"), "from").join(of("to"), "to").where("from_cycle = to_cycle")
        found = written(found.unionAll(on.select("node", F.col("from_cycle").alias("cycle"))), "components")
    least = found.groupBy("cycle").agg(F.min("node").alias("least"))
    return found.join(least, "cycle").select("node", F.col("least").alias("cycle"))


def wait_cycles(edges: DataFrame, max_len: int | None = None) -> DataFrame:
    """(node): nodes on a cycle of wait-for edges (src waits for dst), of at most max_len steps if given.

    Without that bound by components; with it each node of the core is walked
    from for max_len steps.
    """
    if max_len is None:
        return cycle_components(edges).select("node")
    core = trimmed(edges)
    first = core.select(F.col("src").alias("seed"), F.col("dst").alias("node"))
    return bounded_bfs(core, first, max_len - 1, "forward", on=["seed"]).where("seed = node").select("node").distinct()


def impact_set(changed: DataFrame, edges: DataFrame, nodes: DataFrame, leases: DataFrame, depth: int = 2) -> DataFrame:
    """(node_id, file, hop): structural and external nodes of files that depend on a changed file, without those leased by others.

    changed: (file, agent); nodes: (node_id, file, kind); leases: (node_id, holder).
    """
    walk = bounded_bfs(edges, changed.select("agent", F.col("file").alias("node")), depth, "reverse", on=["agent"]).where("hop > 0")
    hit = walk.withColumnRenamed("node", "file").join(nodes.where(F.col("kind") != "benign"), "file")
    taken = leases.select(F.col("node_id").alias("leased"), "holder")
    free = hit.join(taken, (hit["node_id"] == taken["leased"]) & (hit["agent"] != taken["holder"]), "left_anti")
    return free.select("node_id", "file", "hop").distinct()


def reindex_set(flags: DataFrame, edges: DataFrame) -> DataFrame:
    """(file): changed files, and the direct dependents of those whose node set or kinds changed or that are gone.

    flags: (file, ids_changed, kinds_changed, deleted, changed).
    """
    moved = flags.where("ids_changed or kinds_changed or deleted").select(F.col("file").alias("dst"))
    return flags.where("changed and not deleted").select("file").union(edges.join(moved, "dst", "left_semi").select("src")).distinct()
