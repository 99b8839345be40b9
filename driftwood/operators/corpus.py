"""Segments, references and labels of text and of Python code."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwood.operators.graph import propagate_labels
from driftwood.sources.workspace import shipped

# Fixed values.
#: Modules whose calls are effects outside of the program; a parameter of direct_external.
EXTERNAL = (
    "requests", "httpx", "aiohttp", "urllib", "urllib3", "socket", "smtplib", "ftplib", "psycopg2", "asyncpg", "pymysql", "sqlalchemy", "pymongo", "redis", "elasticsearch",
    "boto3", "botocore", "openai", "anthropic", "subprocess",
)
PARSED = "path string, record string, name string, a string, b string, level int, position int, line_start int, line_end int, content_hash string"


def segment_lines(docs: DataFrame, file: str = "doc_id", text: str = "text") -> DataFrame:
    """docs' other columns with (line_no from 1, node_id, content_hash) of each line; a null text has one empty line."""
    others = [x for x in docs.columns if x != text]
    rows = docs.select(*others, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("pos", "line"))
    line = (F.col("pos") + 1).cast("long")
    return rows.select(*others, line.alias("line_no"), F.concat_ws("::", F.col(file).cast("string"), line.cast("string")).alias("node_id"), F.sha2("line", 256).alias("content_hash"))


def line_map(file: Column, text: Column) -> Column:
    """A map of node_id to content_hash of the lines of a text, as in ``segment_lines``."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.map_from_entries(F.transform(lines, lambda x, i: F.struct(F.concat_ws("::", file, (i + 1).cast("string")), F.sha2(x, 256))))


def paragraphs(chunks: DataFrame, lines: int, group: list[str]) -> DataFrame:
    """Spans (line_start, line_end) of ``lines`` lines each."""
    span = F.floor((F.col("line_no") - 1) / lines)
    return chunks.groupBy(*group, span.alias("span")).agg(F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"))


#: What the parser and the reader of literals raise on odd source.
UNREADABLE = (SyntaxError, ValueError, TypeError, RecursionError, MemoryError)


def _records(path: str, source: str) -> Iterator[tuple]:
    try:
        tree = ast.parse(source)
    except UNREADABLE:
        yield path, "status", "syntax_error", None, None, None, None, None, None, None
        return
    yield path, "status", "ok", None, None, None, None, None, None, None
    seen: dict[str, int] = {}
    raw = source.encode("utf-8", "surrogatepass")
    line = [0, *(m.end() for m in re.finditer(rb"\r\n|\r|\n", raw))]  # where each line starts

    def node(x: ast.stmt, name: str | None) -> Iterator[tuple]:
        label = name or str(x.lineno)
        n = seen[label] = seen.get(label, 0) + 1
        segment = raw[line[x.lineno - 1] + x.col_offset : line[x.end_lineno - 1] + x.end_col_offset]
        yield path, "node", label if n == 1 else f"{label}#{n}", name, None, None, n, x.lineno, x.end_lineno, hashlib.sha256(segment).hexdigest()
        for i, call in enumerate(c for c in ast.walk(x) if name and isinstance(c, ast.Call)):
            target = call.func
            parts: list[str] = []
            while isinstance(target, ast.Attribute):
                parts.append(target.attr)
                target = target.value
            if isinstance(target, ast.Name):
                parts.append(target.id)
                try:
                    args = repr(([ast.literal_eval(v) for v in call.args], {k.arg: ast.literal_eval(k.value) for k in call.keywords}))
                except UNREADABLE:
                    args = None
                yield path, "call", name, ".".join(reversed(parts)), args, None, i, call.lineno, None, None

    for x in tree.body:
        if isinstance(x, ast.ClassDef):
            for y in x.body:
                if isinstance(y, ast.FunctionDef | ast.AsyncFunctionDef):
                    yield from node(y, f"{x.name}.{y.name}")
        elif isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef):
            yield from node(x, x.name)
        elif isinstance(x, ast.Import):
            for i, v in enumerate(x.names):
                yield path, "import", v.asname or v.name.split(".")[0], v.name, None, 0, x.lineno * 100 + i, x.lineno, None, None
        elif isinstance(x, ast.ImportFrom):
            for i, v in enumerate(x.names):
                yield path, "import", v.asname or v.name, x.module or "", v.name, x.level, x.lineno * 100 + i, x.lineno, None, None
        else:
            yield from node(x, None)


def parsed(files: DataFrame) -> DataFrame:
    """What is read off Python files (path, source), by record: status, node, import (name bound, module, symbol, level), call (function, callee, literal arguments).

    Source that cannot be parsed, for whatever reason, gives its status only.
    """
    names = [x.split()[0] for x in PARSED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, source in zip(batch["path"], batch["source"], strict=True):
                yield pd.DataFrame(list(_records(path, source or "")), columns=names).astype({x: "Int32" for x in ("level", "position", "line_start", "line_end")})

    return shipped(files).select("path", "source").mapInPandas(run, PARSED)


def code_nodes(records: DataFrame) -> DataFrame:
    """(node_id, file_path, name, line_start, line_end, content_hash); repeated labels of a file are numbered."""
    rows = records.where("record = 'node'")
    return rows.select(F.concat_ws("::", "path", "name").alias("node_id"), F.col("path").alias("file_path"), F.col("a").alias("name"), "line_start", "line_end", "content_hash")


def import_aliases(records: DataFrame) -> DataFrame:
    """(path, name, module): the root module of each name bound by an absolute import; the last binding holds."""
    rows = records.where("record = 'import' and level = 0 and coalesce(b, '') <> '*'")
    return rows.groupBy("path", "name").agg(F.max_by("a", "position").alias("a")).select("path", "name", F.substring_index("a", ".", 1).alias("module"))


def bound_symbols(records: DataFrame, files: DataFrame) -> DataFrame:
    """(path, name, file, symbol): names bound by from-imports of project files; the last binding holds."""
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    up = F.when(F.col("level") > 0, F.array_join(F.slice(F.split(folder, "/"), 1, F.greatest(F.size(F.split(folder, "/")) - F.col("level") + 1, F.lit(0))), "/")).otherwise(F.lit(""))
    base = F.concat_ws("/", F.nullif(up, F.lit("")), F.nullif(F.replace("a", F.lit("."), F.lit("/")), F.lit("")))
    rows = records.where("record = 'import' and b is not null and b <> '*'").select("path", "name", "b", "position", F.posexplode(F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))).alias("rank", "file"))
    hit = rows.join(files.select(F.col("path").alias("file")), "file", "left_semi").where("file <> path")
    best = hit.groupBy("path", "name", "position", "b").agg(F.min_by("file", "rank").alias("file"))
    return best.groupBy("path", "name").agg(F.max_by(F.struct("file", "b"), "position").alias("m")).select("path", "name", "m.file", F.col("m.b").alias("symbol"))


def direct_external(records: DataFrame, modules: tuple[str, ...] = EXTERNAL) -> DataFrame:
    """(path, name): functions with a call whose root, through the file's imports, is a listed module."""
    calls = records.where("record = 'call'").select("path", F.col("name").alias("function"), F.substring_index("a", ".", 1).alias("name"))
    return calls.join(import_aliases(records), ["path", "name"]).where(F.col("module").isin(list(modules))).select("path", F.col("function").alias("name")).distinct()


def call_edges(records: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(src, dst): calls between functions, by node id: bare names at top level, self./cls. in the same class, and imported symbols if files are given.

    A name that the file itself defines is not looked up among its imports.
    """
    own = records.where("record = 'node' and a is not null").select("path", F.col("a").alias("callee")).distinct()
    calls = records.where("record = 'call'").select("path", "name", F.col("a").alias("target"))
    on_self = F.col("target").rlike("^(self|cls)[.][^.]+$") & F.contains("name", F.lit("."))
    callee = F.when(on_self, F.concat(F.substring_index("name", ".", 1), F.lit("."), F.substring_index("target", ".", -1))).when(~F.contains("target", F.lit(".")), F.col("target"))
    calls = calls.withColumn("callee", callee).where("callee is not null")
    ident = lambda p, n: F.concat_ws("::", p, n)
    inside = calls.join(own, ["path", "callee"], "left_semi").select(ident("path", "name").alias("src"), ident("path", "callee").alias("dst"))
    if files is None:
        return inside.distinct()
    bound = bound_symbols(records, files).select("path", F.col("name").alias("callee"), "file", "symbol")
    across = calls.join(own, ["path", "callee"], "left_anti").join(bound, ["path", "callee"]).select(ident("path", "name").alias("src"), ident("file", "symbol").alias("dst"))
    return inside.unionAll(across).distinct()


def external_functions(records: DataFrame, files: DataFrame | None = None, modules: tuple[str, ...] = EXTERNAL, extra: DataFrame | None = None) -> DataFrame:
    """(node_id): functions that call something external, directly or over others; over files too if these are given.

    extra: (node_id), more functions known to be external.
    """
    seeds = direct_external(records, modules).select(F.concat_ws("::", "path", "name").alias("node"))
    if extra is not None:
        seeds = seeds.union(extra.select("node_id")).distinct()
    return propagate_labels(call_edges(records, files), seeds.withColumn("label", F.lit("external"))).select(F.col("node").alias("node_id"))


def call_site_args(functions: DataFrame, records: DataFrame) -> DataFrame:
    """(name, path, args): for each function (name) the first call, by file and place, whose arguments are all literals."""
    last = F.substring_index("a", ".", -1)
    calls = records.where("record = 'call' and b is not null").select(last.alias("short"), "path", F.col("b").alias("args"), "line_start", "position")
    first = calls.groupBy("short").agg(F.min_by(F.struct("path", "args"), F.struct("path", "line_start", "position")).alias("first"))
    names = functions.select("name", F.substring_index("name", ".", -1).alias("short")).distinct()
    return names.join(first, "short").select("name", "first.path", "first.args")
