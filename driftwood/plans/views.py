"""Views that the queries derive from the tables, in Spark and, with the same names, in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwood.operators.corpus import segment_lines
from driftwood.sources.tables import table

TTL = 6 * 3600


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("source", "doc_id", "text")


def text_v2() -> Column:
    """Some documents have another first line, some have one line more."""
    i = F.col("doc_id")
    return F.when(i % 13 == 0, F.concat(F.lit("X"), "text")).when(i % 11 == 0, F.concat("text", F.lit("\nappended"))).otherwise(F.col("text"))


def documents_v2(spark: SparkSession, folder: str) -> DataFrame:
    """As ``text_v2``; some documents are gone."""
    return documents(spark, folder).where(F.col("doc_id") % 7 != 0).select("source", "doc_id", text_v2().alias("text"))


def with_kind(lines: DataFrame) -> DataFrame:
    return lines.withColumn("kind", F.when(F.col("line_no") == 1, "structural").when(F.col("content_hash").like("0%"), "external").otherwise("benign"))


def chunks(spark: SparkSession, folder: str, version: int = 1) -> DataFrame:
    return with_kind(segment_lines((documents if version == 1 else documents_v2)(spark, folder)))


def fk_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and what their foreign keys point to."""
    def edge(name: str, a: str, x: str, b: str, y: str) -> DataFrame:
        return table(spark, folder, name).select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"))

    pairs = [("nation", "n", "n_nationkey", "r", "n_regionkey"), ("customer", "c", "c_custkey", "n", "c_nationkey"), ("supplier", "s", "s_suppkey", "n", "s_nationkey"), ("orders", "o", "o_orderkey", "c", "o_custkey")]
    out = edge(*pairs[0])
    for x in pairs[1:]:
        out = out.unionAll(edge(*x))
    return out


def seconds(ts: str) -> Column:
    """Whole seconds since 1970 of a time without zone, whatever the session's zone."""
    return (F.datediff(F.col(ts).cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("long")


def events(spark: SparkSession, folder: str) -> DataFrame:
    return as_log(table(spark, folder, "events"))


def as_log(rows: DataFrame) -> DataFrame:
    op = F.when(F.col("event_type") == "click", "acquire").when(F.col("event_type") == "view", "release").when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "purchase", "intent").otherwise("stop")
    return rows.select(F.get_json_object("props", "$.k").cast("long").alias("resource"), seconds("ts").alias("sec"), "event_id", F.col("user_id").alias("agent"), op.alias("op"))


def holders(log: DataFrame) -> DataFrame:
    """(node_id, holder): the last to acquire each resource."""
    return log.where("op = 'acquire'").groupBy(F.col("resource").alias("node_id")).agg(F.max_by("agent", F.struct("sec", "event_id")).alias("holder"))


def intents(log: DataFrame) -> DataFrame:
    return log.where("op = 'intent'").select("agent", F.col("resource").alias("node_id")).distinct()


SQL = {
    "docs_v2": "SELECT source, doc_id, CASE WHEN doc_id % 13 = 0 THEN 'X' || text WHEN doc_id % 11 = 0 THEN text || chr(10) || 'appended' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0",
    "fk_edges": """SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
      UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders""",
    "log": """SELECT json_extract(props, '$.k')::BIGINT AS resource, floor(epoch(ts))::BIGINT AS sec, event_id, user_id AS agent,
      CASE event_type WHEN 'click' THEN 'acquire' WHEN 'view' THEN 'release' WHEN 'error' THEN 'failure' WHEN 'purchase' THEN 'intent' ELSE 'stop' END AS op FROM events""",
    "holders": "SELECT resource AS node_id, arg_max(agent, struct_pack(a := sec, b := event_id)) AS holder FROM log WHERE op = 'acquire' GROUP BY resource",
    "intents": "SELECT DISTINCT agent, resource AS node_id FROM log WHERE op = 'intent'",
    "wait_edges": "SELECT DISTINCT agent AS src, holder AS dst FROM intents JOIN holders USING (node_id) WHERE agent <> holder",
}
for _name, _docs in (("chunks", "documents"), ("chunks2", "docs_v2")):
    SQL[_name] = f"""SELECT *, doc_id || '::' || line_no AS node_id, CASE WHEN line_no = 1 THEN 'structural' WHEN content_hash LIKE '0%' THEN 'external' ELSE 'benign' END AS kind FROM (
      SELECT source, doc_id, sha256(line) AS content_hash, line_no FROM (SELECT source, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS line_no
      FROM (SELECT source, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM {_docs})))"""
_NEEDS = {"chunks2": ["docs_v2"], "holders": ["log"], "intents": ["log"], "wait_edges": ["intents", "holders"]}


def with_views(sql: str, *names: str, recursive: bool = False) -> str:
    """A WITH clause of these views and those they need, then sql (which may go on with further ones after a comma)."""
    order: list[str] = []

    def add(x: str) -> None:
        for y in _NEEDS.get(x, []):
            add(y)
        if x not in order:
            order.append(x)

    for x in names:
        add(x)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(f"{x} AS ({SQL[x]})" for x in order) + " " + sql
