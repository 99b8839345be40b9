"""Merkle digests and drift between two versions of an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwood.functions.digests import ordered_digest


def file_leaf(order: str, value: str) -> Column:
    """Aggregate: SHA-256 of a file's hashes in line order (an array of one file's nodes)."""
    return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value]), ""), 256)


def merkle_root(nodes: DataFrame, group: list[str], file: str = "file", order: str = "line_no", value: str = "content_hash") -> DataFrame:
    """(group ..., root): SHA-256 over the leaves of a group's files in path order; a leaf is over its nodes in line order."""
    leaves = nodes.groupBy(*group, file).agg(file_leaf(order, value).alias("leaf"))
    return ordered_digest(leaves, group, [file], "leaf", "root")


def whole_file(node_id: str) -> Column:
    """Whether an id stands for a file as a whole."""
    return F.coalesce(F.substring_index(node_id, "::", -1) == "__file__", F.lit(False))


def places_in_order(nodes: DataFrame, group: list[str], file: str, order: str) -> DataFrame:
    """nodes with ``place``: the position of each row in its group, by file, then order; from 1.

    Only one row per file goes through the group's running sum; the rows of a
    file are numbered among themselves, so a large group is no single task's.
    """
    inside = F.row_number().over(Window.partitionBy(*group, file).orderBy(order))
    before = F.sum("n").over(Window.partitionBy(*group).orderBy(file).rowsBetween(Window.unboundedPreceding, -1))
    files = nodes.groupBy(*group, file).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(before, F.lit(0)))
    keys = [*group, file]
    files = files.select(*(F.col(x).alias(f"file_{i}") for i, x in enumerate(keys)), "before")
    same = [F.col(x).eqNullSafe(F.col(f"file_{i}")) for i, x in enumerate(keys)]
    rows = nodes.withColumn("inside", inside).join(files, same)
    return rows.withColumn("place", F.col("inside") + F.col("before")).select(*nodes.columns, "place")


def merkle_of_nodes(nodes: DataFrame, ids: DataFrame, group: list[str], id_col: str = "node_id", **names: str) -> DataFrame:
    """The root of a given set of nodes; ids that are unknown add nothing."""
    return merkle_root(nodes.join(ids.select(id_col).distinct(), id_col, "left_semi"), group, **names)


def view_digest(nodes: DataFrame, group: list[str], name: str, value: str) -> DataFrame:
    """(group ..., digest): SHA-256 of the sorted 'name:hash' tokens joined by '|'."""
    tokens = nodes.select(*group, F.concat_ws(":", F.col(name), F.col(value)).alias("token"))
    return ordered_digest(tokens, group, ["token"], "token", "digest", "|")


def _versions(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    a = old.select(*keys, F.col("content_hash").alias("old_hash"))
    b = new.select(*keys, F.col("content_hash").alias("new_hash"))
    return a.join(b, keys, "full_outer")


def file_fresh(stored: DataFrame, current: DataFrame, file: str = "file") -> DataFrame:
    """(file, fresh): stored and current nodes are the same; files without stored nodes are not fresh."""
    both = _versions(stored, current, [file, "node_id"])
    return both.groupBy(file).agg(F.bool_and(F.col("old_hash").eqNullSafe(F.col("new_hash")) & F.col("old_hash").isNotNull()).alias("fresh"))


def index_change_flags(old: DataFrame, new: DataFrame, file: str = "file") -> DataFrame:
    """Per file: did the set of node ids change, did a kind change, is it gone, did any hash change. Nodes have a kind."""
    return index_states(old, new, file).drop("fresh")


def index_states(old: DataFrame, new: DataFrame, file: str = "file") -> DataFrame:
    """As ``index_change_flags``, with what ``file_fresh`` tells, from one join."""
    a = old.select(file, "node_id", F.col("content_hash").alias("h0"), F.col("kind").alias("k0"))
    b = new.select(file, "node_id", F.col("content_hash").alias("h1"), F.col("kind").alias("k1"))
    known, left = F.bool_or(F.col("h0").isNotNull()), F.bool_or(F.col("h1").isNotNull())
    return a.join(b, [file, "node_id"], "full_outer").groupBy(file).agg(
        (known & F.bool_or(F.col("h0").isNull() | F.col("h1").isNull())).alias("ids_changed"),
        (known & F.bool_or(F.coalesce(F.col("k0") != F.col("k1"), F.lit(False)))).alias("kinds_changed"),
        (~left).alias("deleted"),
        F.bool_or(~F.col("h0").eqNullSafe(F.col("h1"))).alias("changed"),
        F.bool_and(F.col("h0").eqNullSafe(F.col("h1")) & F.col("h0").isNotNull()).alias("fresh"),
    )


def _same(a: list[str], b: list[str]) -> list[Column]:
    return [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(a, b, strict=True)]


def stale_nodes(canonical: DataFrame, view: DataFrame, group: list[str], keys: list[str]) -> DataFrame:
    """(keys ...) present in both versions with another hash. Groups whose digests agree are left out first.

    Nulls in groups and keys are values like others.
    """
    a, b = (x.groupBy(*group).agg(F.sum(F.xxhash64(*keys, "content_hash").cast("decimal(38,0)")).alias("d"), F.count("*").alias("n")) for x in (canonical, view))
    other = lambda x, names, tag: x.withColumnsRenamed({y: f"{tag}_{y}" for y in names})
    own, theirs = [*group, "d", "n"], [f"b_{x}" for x in (*group, "d", "n")]
    differs = other(a.join(other(b, own, "b"), _same(own, theirs), "left_anti").select(*group), group, "g")
    new = other(view.select(*keys, F.col("content_hash").alias("h1")), keys, "k")
    old = canonical.join(differs, _same(group, [f"g_{x}" for x in group]), "left_semi").select(*keys, F.col("content_hash").alias("h0"))
    return old.join(new, _same(keys, [f"k_{x}" for x in keys])).where("h0 <> h1").select(*keys)


def snapshot_drift(baseline: DataFrame, current: DataFrame, traversal: DataFrame) -> DataFrame:
    """(agent, lease_node, node_id, missing): captured nodes that changed or are gone while a lease was held.

    baseline: (agent, lease_node, node_id, content_hash); current: (node_id,
    content_hash); traversal: (agent, node_id), what the agent itself visited,
    which does not count, unless it is the lease's own node. New nodes do not
    count, nor do the marks of whole files ('file::__file__'), which no index has.
    """
    visited = traversal.select("agent", "node_id").distinct().withColumn("own", F.lit(True))
    now = current.select("node_id", F.col("content_hash").alias("now"))
    rows = baseline.where(~whole_file("node_id")).join(now, "node_id", "left").join(visited, ["agent", "node_id"], "left")
    counted = F.col("own").isNull() | (F.col("node_id") == F.col("lease_node"))
    return rows.where(counted & ~F.col("now").eqNullSafe(F.col("content_hash"))).select("agent", "lease_node", "node_id", F.col("now").isNull().alias("missing"))


def batch_drift(drifted: DataFrame) -> DataFrame:
    """One row per agent and lease that drifted."""
    return drifted.groupBy("agent", "lease_node").agg(F.count("*").alias("n_nodes"), F.count_if("missing").alias("n_missing"))


def restore_plan(drifted: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(file, node_id, snapshot): each drifted file once, by its first node that has a snapshot."""
    rows = drifted.select("file", "node_id").join(snapshots.where("snapshot is not null"), ["file", "node_id"])
    return rows.groupBy("file").agg(F.min(F.struct("node_id", "snapshot")).alias("s")).select("file", "s.node_id", "s.snapshot")
