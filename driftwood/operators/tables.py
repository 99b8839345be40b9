"""Scans, routing and maintenance of keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
#: Folder names that a scan leaves out; a parameter of the scans.
SKIPPED = (".venv", "venv", ".env", "env", "site-packages", "__pycache__", ".git", "node_modules", ".tox", "build", "dist")


def corpus_scan_df(files: DataFrame, skip_parts: tuple[str, ...] = SKIPPED, suffix: str = "") -> DataFrame:
    """Rows of (path, ...) whose path below the root has none of the skipped parts and ends with the suffix."""
    return files.where(F.col("path").endswith(suffix) & ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, skip_parts))))


def corpus_scan(spark: SparkSession, root: str, glob: str = "*.py", skip_parts: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(path, source) of the files below a root; path is relative to it."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).select("value", F.input_file_name().alias("file"))
    base = root.rstrip("/").split(":")[-1].lstrip("/") + "/"
    return corpus_scan_df(files.select(F.substring_index("file", base, -1).alias("path"), F.col("value").alias("source")), skip_parts)


def event_ingest(raw: DataFrame, json_col: str) -> DataFrame:
    """Hook events from JSON to columns; the agent falls back to the session, also if it is ''."""
    schema = "session_id string, agent_id string, agent_type string, tool_name string, tool_input struct<file_path: string>"
    e = F.from_json(json_col, schema)
    blank = lambda x: F.coalesce(e[x], F.lit(""))
    return raw.select(
        "*", blank("session_id").alias("session_id"), F.coalesce(F.nullif(e["agent_id"], F.lit("")), blank("session_id")).alias("agent_id"),
        blank("agent_type").alias("agent_type"), blank("tool_name").alias("tool_name"), F.coalesce(e["tool_input"]["file_path"], F.lit("")).alias("file_path"),
    )


def event_router(events: DataFrame, rules: list[tuple[Column, str]], default: str, out: str = "mode") -> DataFrame:
    """The first rule that holds names the mode."""
    mode = F.lit(default)
    for holds, name in reversed(rules):
        mode = F.when(holds, F.lit(name)).otherwise(mode)
    return events.withColumn(out, mode)


def upsert_last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. An aggregate, so that a hot key is combined before the shuffle."""
    others = [x for x in rows.columns if x not in keys]
    best = F.max_by(F.struct(*others), F.struct(*order)).alias("__row")
    return rows.groupBy(*keys).agg(best).select(*keys, *(F.col("__row")[x].alias(x) for x in others)).select(rows.columns)


def append_first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    others = [x for x in rows.columns if x not in keys]
    best = F.min_by(F.struct(*others), F.struct(*order)).alias("__row")
    return rows.groupBy(*keys).agg(best).select(*keys, *(F.col("__row")[x].alias(x) for x in others)).select(rows.columns)


def replace_by_file(old: DataFrame, new: DataFrame, file_col: str) -> DataFrame:
    """All rows of the files in ``new`` are replaced by its rows."""
    return old.join(new.select(file_col).distinct(), file_col, "left_anti").select(old.columns).unionByName(new)


def purge_file(nodes: DataFrame, edges: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes(file), edges(src, dst), removed(file) -> nodes left, edges left, direct dependents of what was removed."""
    gone = removed.select("file").distinct()
    nodes = nodes.join(gone, "file", "left_anti")
    left = edges.join(gone, edges["src"] == gone["file"], "left_anti")
    kept = left.join(gone, left["dst"] == gone["file"], "left_anti")
    dependents = left.join(gone, left["dst"] == gone["file"], "left_semi").select(F.col("src").alias("file")).distinct()
    return nodes, kept, dependents


def event_log_query(log: DataFrame, filters: dict[str, object], order: str, limit: int = 100) -> DataFrame:
    """The newest rows that equal all filters that are given."""
    for name, value in filters.items():
        if value not in (None, ""):
            log = log.where(F.col(name) == F.lit(value))
    return log.orderBy(F.col(order).desc()).limit(limit)


def json_report(rows: DataFrame, key: str) -> DataFrame:
    """(key, report): each row as JSON."""
    return rows.select(key, F.to_json(F.struct(*rows.columns)).alias("report"))


def json_sink(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes rows as JSON lines, one file per partition."""
    rows.write.mode(mode).json(path)


def json_source(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def json_read(reports: DataFrame, schema: T.StructType) -> DataFrame:
    return reports.select(F.from_json("report", schema).alias("r")).select("r.*")


def kind_file_filter(nodes: DataFrame, kinds: list[str], files: DataFrame, file_col: str, kind_col: str = "kind") -> DataFrame:
    """Nodes of the given kinds in the files of a table; the file list is joined, never an IN list."""
    return nodes.where(F.col(kind_col).isin(kinds)).join(files.select(file_col).distinct(), file_col, "left_semi")


def prefix_exists(names: DataFrame, prefixes: DataFrame, like_compat: bool = False) -> DataFrame:
    """Prefixes with a name below them ('Prefix.rest'). like_compat: case and '_' of the prefix count as LIKE does."""
    heads = names.where(F.col("name").contains(".")).select(F.substring_index("name", ".", 1).alias("prefix")).distinct()
    if not like_compat:
        return prefixes.join(heads, "prefix", "left_semi")
    # a '_' of a prefix stands for any character: heads meet prefixes of the same length and the same places of '_', without what stands there
    low = prefixes.withColumn("low_", F.lower("prefix"))
    holes = F.filter(F.transform(F.split("low_", ""), lambda x, i: F.when(x == "_", i)), lambda i: i.isNotNull())
    low = low.withColumns({"holes_": holes, "size_": F.length("low_")})
    shapes = low.select("size_", "holes_").distinct()
    heads = heads.select(F.lower("prefix").alias("head")).distinct().withColumn("size_", F.length("head")).join(shapes, "size_")
    open_ = F.array_join(F.transform(F.split("head", ""), lambda x, i: F.when(F.array_contains("holes_", i), "_").otherwise(x)), "")
    return low.join(heads.select(open_.alias("low_")).distinct(), "low_", "left_semi").drop("low_", "holes_", "size_")


def node_id_parts(nodes: DataFrame) -> DataFrame:
    """node_id 'file::label' and its parts; the label's class is what stands before a dot."""
    label = F.substring_index("node_id", "::", -1)
    return nodes.withColumns({
        "label": label, "whole_file": label == "__file__",
        "class_name": F.when(F.contains(label, F.lit(".")), F.substring_index(label, ".", 1)),
        "member": F.substring_index(label, ".", -1),
    })


def priority_of(rows: DataFrame, col: str, mapping: dict[str, int], default: int = 0) -> DataFrame:
    known = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    return rows.withColumn("priority", F.coalesce(F.element_at(known, F.col(col)), F.lit(default)))


def changed_files_dedupe(*lists: DataFrame) -> DataFrame:
    """(path, ordinal) of several lists (path, ordinal) joined in turn; each path once, where it came first."""
    whole = None
    for i, x in enumerate(lists):
        x = x.select("path", F.lit(i).alias("list"), "ordinal")
        whole = x if whole is None else whole.unionAll(x)
    return whole.groupBy("path").agg(F.min(F.struct("list", "ordinal")).alias("at")).select("path", F.col("at.list").alias("list"), F.col("at.ordinal").alias("ordinal"))
