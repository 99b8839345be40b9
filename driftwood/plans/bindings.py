"""Queries over the driver's tables, and their SQL. Each one applies an operator to whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwood.operators import contracts, corpus, drift, graph, leases, spans
from driftwood.operators import tables as t
from driftwood.plans import views as v
from driftwood.plans.views import TTL, with_views
from driftwood.sources.tables import live_table, table
from driftwood.sources.workspace import shared_dir, written
from driftwood.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Scans, sources, sinks, maintenance


@query("SELECT source || '/' || doc_id || '.txt' AS path, length(coalesce(text, ''))::BIGINT AS n_chars FROM documents WHERE source NOT IN ('src3', 'src7')")
def corpus_scan(s, d):
    files = v.documents(s, d).select(F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text")
    return t.corpus_scan_df(files, ("src3", "src7"), ".txt").select("path", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))


@query("""SELECT event_id, 's' || user_id % 50 AS session_id, CASE WHEN user_id % 3 = 0 THEN 's' || user_id % 50 ELSE 'a' || user_id END AS agent_id,
  event_type AS tool_name, 'f' || json_extract(props, '$.k')::VARCHAR AS file_path FROM events""")
def event_ingest(s, d):
    e = table(s, d, "events")
    agent = F.when(F.col("user_id") % 3 == 0, "").otherwise(F.concat(F.lit("a"), F.col("user_id").cast("string")))
    body = F.struct(F.concat(F.lit("s"), (F.col("user_id") % 50).cast("string")).alias("session_id"), agent.alias("agent_id"), F.col("event_type").alias("tool_name"),
                    F.struct(F.concat(F.lit("f"), F.get_json_object("props", "$.k")).alias("file_path")).alias("tool_input"))
    return t.event_ingest(e.select("event_id", F.to_json(body).alias("raw")), "raw").select("event_id", "session_id", "agent_id", "tool_name", "file_path")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'failure' WHEN event_type = 'signup' THEN 'stop' WHEN value > 250 THEN 'large' ELSE 'edit' END AS mode FROM events")
def event_router(s, d):
    rules = [(F.col("event_type") == "error", "failure"), (F.col("event_type") == "signup", "stop"), (F.col("value") > 250, "large")]
    return t.event_router(table(s, d, "events"), rules, "edit").select("event_id", "mode")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def upsert_last_wins(s, d):
    return t.upsert_last_wins(table(s, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


_FIRST = "SELECT agent, resource, event_id FROM (SELECT *, row_number() OVER (PARTITION BY agent, resource ORDER BY sec, event_id) AS n FROM log) WHERE n = 1"


@query(with_views(_FIRST, "log"))
def append_first_wins(s, d):
    return t.append_first_wins(v.events(s, d).select("agent", "resource", "sec", "event_id"), ["agent", "resource"], ["sec", "event_id"]).select("agent", "resource", "event_id")


@query(with_views(", changed AS (SELECT * FROM chunks2 WHERE doc_id % 13 = 0 OR doc_id % 11 = 0) SELECT doc_id, line_no, content_hash FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM changed) UNION ALL SELECT doc_id, line_no, content_hash FROM changed", "chunks", "chunks2"))
def replace_by_file(s, d):
    cols = ["doc_id", "line_no", "content_hash"]
    new = v.chunks(s, d, 2).where("doc_id % 13 = 0 or doc_id % 11 = 0")
    return t.replace_by_file(v.chunks(s, d).select(cols), new.select(cols), "doc_id")


_GONE = ", gone AS (SELECT 'n' || n_nationkey AS f FROM nation WHERE n_nationkey % 5 = 0) "


@query(with_views(_GONE + """SELECT 'edge' AS what, src AS a, dst AS b FROM fk_edges WHERE src NOT IN (FROM gone) AND dst NOT IN (FROM gone)
  UNION ALL SELECT 'dependent', src, NULL FROM (SELECT DISTINCT src FROM fk_edges WHERE dst IN (FROM gone) AND src NOT IN (FROM gone))
  UNION ALL SELECT 'node', 'n' || n_nationkey, NULL FROM nation WHERE n_nationkey % 5 <> 0""", "fk_edges"))
def purge_file(s, d):
    nations = table(s, d, "nation")
    files = nations.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("file"))
    nodes, edges, dependents = t.purge_file(files, v.fk_edges(s, d), nations.where("n_nationkey % 5 = 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("file")))
    none = F.lit(None).cast("string")
    return edges.select(F.lit("edge").alias("what"), F.col("src").alias("a"), F.col("dst").alias("b")).unionAll(dependents.select(F.lit("dependent"), "file", none)).unionAll(nodes.select(F.lit("node"), "file", none))


_LOG = "SELECT event_id, user_id, substr(sha256(event_id::VARCHAR), 1, 8) AS short FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 100"


@query(_LOG)
def event_log_query(s, d):
    e = table(s, d, "events").select("event_id", "user_id", "event_type", F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 8).alias("short"))
    return t.event_log_query(e, {"event_type": "error", "user_id": None}, "event_id", 100).drop("event_type")


@query("SELECT event_id, user_id, event_type FROM events")
def json_report(s, d):
    e = table(s, d, "events").select("event_id", "user_id", "event_type")
    return t.json_read(t.json_report(e, "event_id"), e.schema)


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'failure' WHEN event_type = 'signup' THEN 'stop' WHEN value > 250 THEN 'large' ELSE 'edit' END AS mode FROM events")
def event_router_stream(s, d):
    """The events as a stream, split into one folder per mode."""
    rules = [(F.col("event_type") == "error", "failure"), (F.col("event_type") == "signup", "stop"), (F.col("value") > 250, "large")]
    at = f"{shared_dir(s)}/routed-{uuid.uuid4().hex}"
    streams.routed(live_table(s, d, "events").select("event_id", "event_type", "value"), rules, "edit", at, f"{at}-state").awaitTermination()
    return s.read.schema("event_id long, mode string").parquet(at)


@query("SELECT event_id, user_id, event_type FROM events")
def json_sink(s, d):
    """Written as JSON lines and read back."""
    e = table(s, d, "events").select("event_id", "user_id", "event_type")
    at = f"{shared_dir(s)}/json-{uuid.uuid4().hex}"
    t.json_sink(e, at)
    return t.json_source(s, at, e.schema)


# Projections, predicates, scalars


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de') AND doc_id IN (SELECT doc_id FROM labels)")
def kind_file_filter(s, d):
    return t.kind_file_filter(table(s, d, "documents").select("doc_id", "lang"), ["en", "de"], table(s, d, "labels"), "doc_id", "lang")


@query("SELECT DISTINCT p_brand AS prefix FROM part p WHERE EXISTS (SELECT 1 FROM part q WHERE q.p_size > 25 AND q.p_brand = p.p_brand)")
def prefix_exists(s, d):
    part = table(s, d, "part")
    return t.prefix_exists(part.where("p_size > 25").select(F.concat_ws(".", "p_brand", "p_type").alias("name")), part.select(F.col("p_brand").alias("prefix")).distinct())


@query(with_views("SELECT node_id, line_no::VARCHAR AS label, false AS whole_file FROM chunks", "chunks"))
def node_id_parts(s, d):
    return t.node_id_parts(v.chunks(s, d).select("node_id")).select("node_id", "label", "whole_file")


_PARAS = ", paras AS (SELECT doc_id, (line_no - 1) // 5 AS span, min(line_no) AS line_start, max(line_no) AS line_end FROM chunks GROUP BY ALL) "


@query(with_views(_PARAS + "SELECT doc_id || '#' || span AS node_id, 30 + 2 * (line_end - line_start) AS ttl FROM paras UNION ALL SELECT 'unknown', 30", "chunks"))
def lease_ttl(s, d):
    nodes = corpus.paragraphs(v.chunks(s, d), 5, ["doc_id"]).select(F.concat_ws("#", F.col("doc_id").cast("string"), F.col("span").cast("string")).alias("node_id"), "line_start", "line_end")
    return leases.lease_ttl(nodes.select("node_id").unionAll(nodes.select(F.lit("unknown")).distinct()), nodes)


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 100 WHEN '2-HIGH' THEN 80 ELSE 0 END AS priority FROM orders")
def priority_of(s, d):
    return t.priority_of(table(s, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", {"1-URGENT": 100, "2-HIGH": 80}).drop("o_orderpriority")


_LEASES = ", held AS (SELECT resource AS node_id, arg_max(agent, struct_pack(a := sec, b := event_id)) AS holder, max(sec) + 21600 AS expires_at FROM log WHERE op = 'acquire' GROUP BY resource), as_of AS (SELECT max(sec) AS s FROM log) "


@query(with_views(_LEASES + """, late AS (SELECT node_id, node_id % 10 AS file, CASE WHEN node_id % 3 <> 0 THEN 'text ' || node_id END AS snapshot FROM held, as_of WHERE expires_at < s)
  SELECT node_id, file, snapshot, snapshot IS NOT NULL AND row_number() OVER (PARTITION BY file ORDER BY snapshot IS NULL, node_id) = 1 AS restores FROM late""", "log"))
def expired_leases(s, d):
    log = v.events(s, d)
    held = log.where("op = 'acquire'").groupBy(F.col("resource").alias("node_id")).agg((F.max("sec") + TTL).alias("expires_at")).withColumn("file", F.col("node_id") % 10)
    shots = held.where("node_id % 3 <> 0").select("node_id", F.concat(F.lit("text "), F.col("node_id").cast("string")).alias("snapshot"))
    return leases.expired_leases(held, shots, log.agg(F.max("sec")).first()[0] or 0).select("node_id", "file", "snapshot", "restores")


@query(with_views(""", diff AS (SELECT coalesce(a.source, b.source) AS source, coalesce(a.doc_id, b.doc_id) AS doc_id FROM documents a FULL JOIN docs_v2 b USING (doc_id) WHERE a.text IS DISTINCT FROM b.text),
  known AS (SELECT DISTINCT source FROM documents UNION ALL SELECT 'nowhere')
  SELECT k.source, count(doc_id) > 0 AS dirty, coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id), '') AS files, CASE WHEN k.source = 'nowhere' THEN 'error' ELSE 'ok' END AS state
  FROM known k LEFT JOIN diff USING (source) GROUP BY k.source""", "docs_v2"))
def short_status(s, d):
    old, new = v.documents(s, d), v.documents_v2(s, d).select("doc_id", F.col("text").alias("now"))
    diff = old.join(new, "doc_id", "left").where(~F.col("text").eqNullSafe(F.col("now"))).select("source", "doc_id")
    known = old.select("source").distinct().withColumn("ok", F.lit(True))
    asked = known.select("source").unionAll(known.select(F.lit("nowhere")).distinct())
    files = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",")
    return asked.join(known, "source", "left").join(diff, "source", "left").groupBy("source", "ok").agg((F.count("doc_id") > 0).alias("dirty"), files.alias("files")).select("source", "dirty", "files", F.when(F.col("ok"), "ok").otherwise("error").alias("state"))


# Joins

_LINKS = "links AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS ref FROM pages)"
_KNOWN = "known AS (SELECT DISTINCT '/' || lower(n.w) AS path FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) n WHERE regexp_full_match(w, '[a-z]+'))"


def _links(s, d):
    return table(s, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("ref"))


def _words(s, d):
    return table(s, d, "benchmark").select(F.explode(F.split("text", " ")).alias("w")).where(F.col("w").rlike("^[a-z]+$")).select(F.concat(F.lit("/"), "w").alias("path")).distinct()


@query(f"""WITH {_LINKS}, {_KNOWN}, forms AS (SELECT DISTINCT page_id, ref, unnest([0, 1]) AS rank, unnest([ref, rtrim(ref, ',.')]) AS dst FROM links)
  SELECT page_id AS src, ref, arg_min(dst, rank) AS dst, min(rank) AS rank FROM forms JOIN known ON dst = path GROUP BY page_id, ref""")
def resolve_references(s, d):
    refs = _links(s, d).select(F.col("page_id").cast("string").alias("src"), "ref").distinct()
    out = spans.resolve_references(refs, _words(s, d), [F.col("ref"), F.regexp_replace("ref", "[,.]+$", "")])
    return out.select(F.col("src").cast("long").alias("src"), "ref", "dst", "rank")


_HITS = """, hits AS (SELECT doc_id, item_id, unnest(list_filter(range(1, length(d.text) - length(b.text) + 2), lambda i: substr(d.text, i, length(b.text)) = b.text)) AS place, d.text, b.text AS needle
  FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> ''),
  found AS (SELECT doc_id, item_id, place, 1 + length(substr(text, 1, place - 1)) - length(replace(substr(text, 1, place - 1), chr(10), '')) AS line_start, length(needle) - length(replace(needle, chr(10), '')) AS more FROM hits) """


@query("WITH x AS (SELECT 1)" + _HITS + "SELECT doc_id, item_id, place, line_start, line_start + more AS line_end FROM found")
def occurrence_scan(s, d):
    out = spans.occurrence_scan(table(s, d, "documents").select("doc_id", "text"), table(s, d, "benchmark"))
    return out.withColumnRenamed("at", "place").select("doc_id", "item_id", *(F.col(x).cast("long").alias(x) for x in ("place", "line_start", "line_end")))


@query(with_views(_PARAS + _HITS + "SELECT f.doc_id, item_id, place, span FROM found f JOIN paras p ON f.doc_id = p.doc_id AND f.line_start <= p.line_end AND p.line_start <= f.line_start + f.more", "chunks"))
def span_targets(s, d):
    nodes = corpus.paragraphs(v.chunks(s, d), 5, ["doc_id"]).select(F.col("doc_id").alias("file"), F.col("span").alias("node_id"), "line_start", "line_end")
    hits = occurrence_scan(s, d).withColumnRenamed("doc_id", "file")
    return spans.span_targets(hits, nodes, bucket=64).select(F.col("file").alias("doc_id"), "item_id", "place", F.col("node_id").alias("span"))


_NODES = ", nodes AS (SELECT DISTINCT resource AS node_id, resource % 10 AS file, CASE WHEN resource % 4 = 0 THEN 'benign' ELSE 'structural' END AS kind FROM log), deps AS (SELECT DISTINCT file AS src, (file + 1) % 10 AS dst FROM nodes) "


def _lease_nodes(log):
    nodes = log.select(F.col("resource").alias("node_id")).distinct().select("node_id", (F.col("node_id") % 10).alias("file"), F.when(F.col("node_id") % 4 == 0, "benign").otherwise("structural").alias("kind"))
    return nodes, nodes.select(F.col("file").alias("src"), ((F.col("file") + 1) % 10).alias("dst")).distinct()


@query(with_views(_NODES + """, asked AS (SELECT agent, node_id FROM intents UNION SELECT DISTINCT i.agent, n.node_id FROM intents i JOIN deps ON i.node_id % 10 = src JOIN nodes n ON n.file = dst AND kind <> 'benign')
  SELECT DISTINCT agent, node_id, holder FROM asked JOIN holders USING (node_id) WHERE holder <> agent""", "intents", "holders"))
def lease_conflicts(s, d):
    log = v.events(s, d)
    nodes, edges = _lease_nodes(log)
    return leases.lease_conflicts(v.intents(log).withColumn("file", F.col("node_id") % 10), v.holders(log), nodes, edges)


@query(with_views("SELECT agent, node_id FROM intents i WHERE node_id % 4 = 0 AND EXISTS (SELECT 1 FROM holders h WHERE h.node_id % 10 = i.node_id % 10 AND h.holder <> i.agent)", "intents", "holders"))
def benign_blocked(s, d):
    log = v.events(s, d)
    asked = v.intents(log).where("node_id % 4 = 0").withColumn("file", F.col("node_id") % 10)
    return leases.benign_blocked(asked, v.holders(log).select("holder", (F.col("node_id") % 10).alias("file"))).select("agent", "node_id")


@query(with_views("SELECT src, dst FROM wait_edges", "wait_edges"))
def wait_for_edges(s, d):
    log = v.events(s, d)
    return leases.wait_for_edges(v.intents(log), v.holders(log))


_SITE = "regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')"


@query(f"""WITH p AS (SELECT DISTINCT {_SITE} AS path FROM pages), roots AS (SELECT DISTINCT regexp_extract(path, '^[^/]*', 0) AS root FROM p UNION SELECT DISTINCT regexp_extract(path, '^[^/]*/(en|de)', 0) FROM p WHERE regexp_matches(path, '^[^/]*/(en|de)')),
  hit AS (SELECT path, arg_max(root, length(root)) AS root FROM p JOIN roots ON path = root OR starts_with(path, root || '/') GROUP BY path)
  SELECT path, root, substr(path, length(root) + 2) AS relative FROM hit""")
def path_prefix_map(s, d):
    site = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    paths = table(s, d, "pages").select(site.alias("path")).distinct()
    roots = paths.select(F.regexp_extract("path", "^[^/]*", 0).alias("root")).union(paths.select(F.regexp_extract("path", "^[^/]*/(en|de)", 0).alias("root")).where("root <> ''"))
    return spans.path_prefix_map(paths, roots)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 400000)")
def cold_nodes(s, d):
    return graph.cold_nodes(table(s, d, "customer"), table(s, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query(with_views(", g AS (SELECT resource, event_id, op, sec, max(CASE WHEN op = 'release' THEN struct_pack(s := sec, e := event_id) END) OVER (PARTITION BY resource ORDER BY sec, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM log) SELECT resource, event_id, sec - last.s AS gap FROM g WHERE op = 'failure'", "log"))
def change_to_block_gap(s, d):
    return leases.change_to_block_gap(v.events(s, d).withColumnRenamed("op", "kind"), "resource", "release", "failure")


# Aggregations

_ROOT = ", leaves AS (SELECT {g}doc_id, sha256(string_agg(content_hash, '' ORDER BY line_no)) AS leaf FROM {c} GROUP BY ALL) SELECT {g}sha256(string_agg(leaf, '' ORDER BY doc_id)) AS root FROM leaves{by}"


@query(with_views(_ROOT.format(g="source, ", c="chunks", by=" GROUP BY source"), "chunks"))
def merkle_root(s, d):
    return drift.merkle_root(v.chunks(s, d), ["source"], "doc_id")


@query(with_views(_ROOT.format(g="source, ", c="(SELECT * FROM chunks WHERE kind <> 'benign')", by=" GROUP BY source"), "chunks"))
def merkle_of_nodes(s, d):
    c = v.chunks(s, d)
    return drift.merkle_of_nodes(c, c.where("kind <> 'benign'").select("node_id"), ["source"], file="doc_id")


_VIEW = "SELECT source, sha256(string_agg(tok, '|' ORDER BY tok)) AS digest FROM (SELECT source, node_id || ':' || content_hash AS tok FROM {}) GROUP BY source"


@query(with_views(f", a AS ({_VIEW.format('chunks')}), b AS ({_VIEW.format('chunks2')}) SELECT a.source, a.digest, b.digest AS digest2, a.digest = b.digest AS equal FROM a JOIN b USING (source)", "chunks", "chunks2"))
def view_digest(s, d):
    a, b = (drift.view_digest(v.chunks(s, d, i), ["source"], "node_id", "content_hash") for i in (1, 2))
    return a.join(b.withColumnRenamed("digest", "digest2"), "source").withColumn("equal", F.col("digest") == F.col("digest2"))


_FRESH = ", fresh AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, bool_and(coalesce(a.content_hash = b.content_hash, false)) AS fresh FROM chunks a FULL JOIN chunks2 b ON a.doc_id = b.doc_id AND a.node_id = b.node_id GROUP BY ALL) "


@query(with_views(_FRESH + "SELECT count(*) AS n, count(*) FILTER (WHERE fresh) AS n_fresh, count(*) FILTER (WHERE NOT fresh) AS n_stale FROM fresh", "chunks", "chunks2"))
def crawl_summary(s, d):
    f = file_fresh(s, d)
    return f.agg(F.count("*").alias("n"), F.count_if("fresh").alias("n_fresh"), F.count_if(~F.col("fresh")).alias("n_stale"))


@query(with_views("SELECT holder AS agent, count(*) AS n FROM holders GROUP BY holder", "holders"))
def active_leases(s, d):
    return v.holders(v.events(s, d)).groupBy(F.col("holder").alias("agent")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS cascade, count(DISTINCT l_linenumber) AS n_required, count(DISTINCT l_linenumber) FILTER (WHERE l_linestatus = 'F') AS n_done, n_required = n_done AS complete FROM lineitem GROUP BY l_orderkey")
def cascade_progress(s, d):
    rows = table(s, d, "lineitem").select(F.col("l_orderkey").alias("cascade"), F.col("l_linenumber").alias("node_id"), "l_linestatus")
    return leases.cascade_progress(rows, rows.where("l_linestatus = 'F'"))


_CYCLE = ", reach(a, b) AS (SELECT src, dst FROM wait_edges UNION SELECT r.a, e.dst FROM reach r JOIN wait_edges e ON r.b = e.src), members AS (SELECT a AS node FROM reach WHERE a = b), cycles AS (SELECT r.a AS node, min(r.b) AS cycle FROM reach r JOIN reach q ON q.a = r.b AND q.b = r.a GROUP BY r.a) "


@query(with_views(_CYCLE + "SELECT cycle, arg_min(node, struct_pack(p := node % 3, n := node)) AS victim FROM cycles GROUP BY cycle", "wait_edges", recursive=True))
def cycle_victim(s, d):
    """A victim for each group of agents that wait for each other in rings."""
    m = graph.cycle_components(wait_for_edges(s, d))
    return leases.cycle_victim(m.select("cycle", F.col("node").alias("agent"), (F.col("node") % 3).alias("priority")))


@query(with_views(_CYCLE + "SELECT node, cycle FROM cycles", "wait_edges", recursive=True))
def cycle_components(s, d):
    return graph.cycle_components(wait_for_edges(s, d))


_FLAGS = """, flags AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, bool_or(a.node_id IS NOT NULL) AND bool_or(a.node_id IS NULL OR b.node_id IS NULL) AS ids_changed,
  bool_or(a.node_id IS NOT NULL) AND bool_or(coalesce(a.kind <> b.kind, false)) AS kinds_changed, NOT bool_or(b.node_id IS NOT NULL) AS deleted, bool_or(a.content_hash IS DISTINCT FROM b.content_hash) AS changed
  FROM chunks a FULL JOIN chunks2 b ON a.doc_id = b.doc_id AND a.node_id = b.node_id GROUP BY ALL) """


@query(with_views(_FLAGS + "FROM flags", "chunks", "chunks2"))
def index_change_flags(s, d):
    return drift.index_change_flags(v.chunks(s, d), v.chunks(s, d, 2), "doc_id")


# Windows, order, sets

_POS = ", pos AS (SELECT o_orderkey AS id, o_custkey AS node, o_orderkey % 7 AS agent, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 100 WHEN '2-HIGH' THEN 80 ELSE 0 END DESC, o_orderkey) - 1 AS position FROM orders) "


@query("WITH x AS (SELECT 1)" + _POS + "SELECT id, node, position FROM pos")
def queue_position(s, d):
    return _positions(s, d).select("id", "node", "position")


def _positions(s, d):
    q = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("node"), (F.col("o_orderkey") % 7).alias("agent"), "o_orderpriority")
    return leases.queue_position(t.priority_of(q, "o_orderpriority", {"1-URGENT": 100, "2-HIGH": 80}))


@query("WITH x AS (SELECT 1)" + _POS + "SELECT agent, min(position) AS best FROM pos GROUP BY agent")
def best_position(s, d):
    p = _positions(s, d)
    return leases.best_position(p.select("agent", "node").distinct(), p)


_BFS = ", walk AS (SELECT '{seed}' AS node, 0 AS hop UNION SELECT e.{to}, w.hop + 1 FROM walk w JOIN fk_edges e ON e.{of} = w.node WHERE w.hop < {depth}), reached AS (SELECT node, min(hop) AS hop FROM walk GROUP BY node) "


def _reached(s, d, seed, depth, direction):
    return graph.bounded_bfs(v.fk_edges(s, d), s.range(1).select(F.lit(seed).alias("node")), depth, direction)


@query(with_views(_BFS.format(seed="r1", to="src", of="dst", depth=2) + "SELECT node, hop, dense_rank() OVER (ORDER BY hop > 1, node) AS place FROM reached WHERE hop > 0", "fk_edges", recursive=True))
def dependents_order(s, d):
    return graph.dependents_order(_reached(s, d, "r1", 2, "reverse")).select("node", "hop", F.col("place").cast("long").alias("place"))


@query(with_views("SELECT doc_id, line_no, row_number() OVER (PARTITION BY source ORDER BY doc_id, line_no) AS place FROM chunks", "chunks"))
def nodes_in_order(s, d):
    return drift.places_in_order(v.chunks(s, d), ["source"], "doc_id", "line_no").select("doc_id", "line_no", F.col("place").cast("long").alias("place"))


@query("""WITH both_lists AS (SELECT doc_id AS path, 0 AS list, doc_id AS ordinal FROM documents WHERE doc_id % 13 = 0 UNION ALL SELECT doc_id, 1, -doc_id FROM labels)
  SELECT path, list, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY list, ordinal) AS n FROM both_lists) WHERE n = 1""")
def changed_files_dedupe(s, d):
    a = table(s, d, "documents").where("doc_id % 13 = 0").select(F.col("doc_id").alias("path"), F.col("doc_id").alias("ordinal"))
    return t.changed_files_dedupe(a, table(s, d, "labels").select(F.col("doc_id").alias("path"), (-F.col("doc_id")).alias("ordinal")))


@query(with_views(_BFS.format(seed="n3", to="src", of="dst", depth=1) + "SELECT node FROM reached WHERE hop > 0", "fk_edges", recursive=True))
def neighbourhood_minus_self(s, d):
    seeds = s.range(1).select(F.lit("n3").alias("node"))
    return graph.neighbourhood_minus_self(v.fk_edges(s, d), seeds, 1, "reverse").select("node")


# Graphs


@query(with_views(_BFS.format(seed="r1", to="src", of="dst", depth=3) + "SELECT node, hop FROM reached", "fk_edges", recursive=True))
def bounded_bfs(s, d):
    return _reached(s, d, "r1", 3, "reverse").select("node", "hop")


@query(with_views(", both_ways AS (SELECT src, dst FROM fk_edges UNION SELECT dst, src FROM fk_edges)" + _BFS.format(seed="c1", to="dst", of="src", depth=2).replace("fk_edges", "both_ways") + "SELECT node, hop FROM reached", "fk_edges", recursive=True))
def bounded_bfs_both(s, d):
    return _reached(s, d, "c1", 2, "both").select("node", "hop")


@query(with_views(", seeds AS (SELECT 'n' || n_nationkey AS node FROM nation WHERE n_regionkey = 2), lab AS (SELECT node FROM seeds UNION SELECT e.src FROM lab JOIN fk_edges e ON e.dst = lab.node) SELECT node, 'external' AS label FROM lab", "fk_edges", recursive=True))
def propagate_labels(s, d):
    seeds = table(s, d, "nation").where("n_regionkey = 2").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"), F.lit("external").alias("label"))
    return graph.propagate_labels(v.fk_edges(s, d), seeds)


@query(with_views(_CYCLE + "SELECT node FROM members", "wait_edges", recursive=True))
def wait_cycles(s, d):
    return graph.wait_cycles(wait_for_edges(s, d))


@query(with_views(_BFS.format(seed="r2", to="src", of="dst", depth=2) + "SELECT node AS node_id, node AS file, hop FROM reached WHERE hop > 0 AND NOT (node LIKE 'c%' AND substr(node, 2)::BIGINT % 5 = 0)", "fk_edges", recursive=True))
def impact_set(s, d):
    edges = v.fk_edges(s, d)
    nodes = edges.select(F.col("src").alias("node_id"), F.col("src").alias("file"), F.lit("structural").alias("kind")).distinct()
    held = table(s, d, "customer").where("c_custkey % 5 = 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node_id"), F.lit("other").alias("holder"))
    return graph.impact_set(s.range(1).select(F.lit("r2").alias("file"), F.lit("me").alias("agent")), edges, nodes, held, 2)


_DOC_EDGES = ", doc_edges AS (SELECT DISTINCT a.doc_id AS src, b.doc_id AS dst FROM documents a JOIN documents b ON b.doc_id = a.doc_id // 2 AND a.doc_id <> b.doc_id) "


@query(with_views(_FLAGS + _DOC_EDGES + "SELECT doc_id FROM flags WHERE changed AND NOT deleted UNION SELECT src FROM doc_edges WHERE dst IN (SELECT doc_id FROM flags WHERE ids_changed OR kinds_changed OR deleted)", "chunks", "chunks2"))
def reindex_set(s, d):
    flags = index_change_flags(s, d).withColumnRenamed("doc_id", "file")
    ids = table(s, d, "documents").select("doc_id")
    edges = ids.select(F.col("doc_id").alias("src"), F.expr("doc_id div 2").alias("dst")).join(ids.select(F.col("doc_id").alias("dst")), "dst", "left_semi").where("src <> dst").select("src", "dst")
    return graph.reindex_set(flags, edges).select(F.col("file").alias("doc_id"))


@query(with_views(", seeds AS (SELECT 'r' || r_regionkey AS node, r_name AS label FROM region), lab AS (SELECT node, label FROM seeds UNION SELECT e.src, label FROM lab JOIN fk_edges e ON e.dst = lab.node) SELECT node, label FROM lab", "fk_edges", recursive=True))
def effect_types(s, d):
    seeds = table(s, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"), F.col("r_name").alias("label"))
    return graph.propagate_labels(v.fk_edges(s, d), seeds)


# Drift


@query(with_views(_FRESH + "FROM fresh", "chunks", "chunks2"))
def file_fresh(s, d):
    return drift.file_fresh(v.chunks(s, d), v.chunks(s, d, 2), "doc_id")


@query(with_views("SELECT a.doc_id, a.node_id FROM chunks a JOIN chunks2 b ON a.doc_id = b.doc_id AND a.node_id = b.node_id WHERE a.content_hash <> b.content_hash", "chunks", "chunks2"))
def stale_nodes(s, d):
    return drift.stale_nodes(v.chunks(s, d), v.chunks(s, d, 2), ["source", "doc_id"], ["doc_id", "node_id"])


_DRIFT = """, base AS (SELECT source AS agent, doc_id || '::1' AS lease_node, node_id, content_hash FROM chunks UNION ALL SELECT source, doc_id || '::__file__', node_id, content_hash FROM chunks WHERE doc_id % 5 = 0 AND line_no = 2), visited AS (SELECT DISTINCT source AS agent, c.node_id FROM labels JOIN chunks c USING (doc_id) WHERE quality = 0),
  drifted AS (SELECT b.agent, lease_node, b.node_id, n.node_id IS NULL AS missing FROM base b LEFT JOIN chunks2 n USING (node_id) LEFT JOIN visited o ON o.agent = b.agent AND o.node_id = b.node_id
  WHERE (o.node_id IS NULL OR b.node_id = lease_node) AND n.content_hash IS DISTINCT FROM b.content_hash) """


@query(with_views(_DRIFT + "FROM drifted", "chunks", "chunks2"))
def snapshot_drift(s, d):
    c = v.chunks(s, d)
    base = c.select(F.col("source").alias("agent"), F.concat(F.col("doc_id").cast("string"), F.lit("::1")).alias("lease_node"), "node_id", "content_hash")
    # a lease on a whole file also captures the mark of that file, which is in no index
    whole = c.where("doc_id % 5 = 0").select(F.col("source").alias("agent"), F.concat(F.col("doc_id").cast("string"), F.lit("::__file__")).alias("lease_node"), "node_id", "content_hash", "line_no")
    marks = whole.where("line_no = 1").select("agent", "lease_node", F.col("lease_node").alias("node_id"), "content_hash")
    base = base.unionByName(whole.where("line_no = 2").drop("line_no")).unionByName(marks)
    own = c.join(table(s, d, "labels").where("quality = 0").select("doc_id"), "doc_id", "left_semi").select(F.col("source").alias("agent"), "node_id")
    return drift.snapshot_drift(base, v.chunks(s, d, 2), own)


@query(with_views(_DRIFT + "SELECT agent, lease_node, count(*) AS n_nodes, count(*) FILTER (WHERE missing) AS n_missing FROM drifted GROUP BY ALL", "chunks", "chunks2"))
def batch_drift(s, d):
    return drift.batch_drift(snapshot_drift(s, d))


@query(with_views(_DRIFT + """, files AS (SELECT DISTINCT split_part(lease_node, '::', 1) AS file, node_id FROM drifted)
  SELECT file, min(node_id) AS node_id, sha256(arg_min(text, node_id)) AS text_hash FROM files JOIN documents ON doc_id::VARCHAR = file WHERE text IS NOT NULL GROUP BY file""", "chunks", "chunks2"))
def restore_plan(s, d):
    rows = snapshot_drift(s, d).select(F.substring_index("lease_node", "::", 1).alias("file"), "node_id")
    shots = v.documents(s, d).select(F.col("doc_id").cast("string").alias("file"), F.sha2("text", 256).alias("snapshot"))
    return drift.restore_plan(rows, rows.distinct().join(shots, "file")).withColumnRenamed("snapshot", "text_hash")


# Contracts

#: Records of four levels, as SQL for both engines. Later ones lack a key, have another type inside, a number for null, more keys, a level for a
#: dotted key, or in half of them no object.
_BODY = """CASE WHEN NOT early AND event_id % 23 = 0 THEN NULL ELSE '{' || CASE WHEN NOT early AND event_type = 'error' THEN '"k2": ' ELSE '"k": ' END || k
  || CASE WHEN NOT early AND event_type = 'signup' AND event_id % 2 = 0 THEN '' ELSE ', "a": {"b": {"c": {"d": ' || CASE WHEN NOT early AND event_type = 'view' THEN '"' || k || '"' ELSE k END || '}}}' END
  || ', "n": ' || CASE WHEN NOT early AND event_type = 'purchase' THEN '5' ELSE 'null' END || ', "l": ' || CASE WHEN NOT early AND event_type = 'purchase' THEN '[1]' ELSE '[]' END
  || ', "m": ' || CASE WHEN NOT early AND event_type = 'signup' AND event_id % 4 = 1 THEN '[]' ELSE '[{"x": 1.5}]' END
  || CASE WHEN NOT early AND event_type = 'error' THEN ', "p": {"q": 1}' ELSE ', "p.q": 1' END || ', "[]": 1'
  || CASE WHEN event_id % 2 = 0 THEN ', "o": 1' ELSE '' END || CASE WHEN NOT early AND event_type = 'click' THEN ', "extra": true' ELSE '' END || '}' END"""
_SPOTS = ["$", "$.k", "$.k2", "$.a", "$.a.b", "$.a.b.c", "$.a.b.c.d", "$.n", "$.l", "$.l[]", "$.m", "$.m[]", "$.m[].x", "$.o", "$.extra", '$["p.q"]', "$.p", "$.p.q", '$["[]"]']
_VALUES = ", ".join("('{}', '{}', {})".format(x, x.replace("[]", "[0]") if x.endswith("[]") or "[]." in x else x.replace('["', '."').replace('"]', '"'), f"'{x[:-2]}'" if x.endswith("[]") else "NULL::VARCHAR") for x in _SPOTS)
_E = f"""WITH raw AS (SELECT event_id, event_type, user_id, ts < TIMESTAMP '2024-01-15' AS early, json_extract(props, '$.k')::VARCHAR AS k FROM events),
  e AS (SELECT event_type AS entity, early, {_BODY} AS body FROM raw), spots(path, spot, lst) AS (VALUES {_VALUES}),
  typed AS (SELECT entity, early, path, CASE WHEN lst IS NOT NULL AND json_array_length(body, lst) = 0 THEN 'UNKNOWN' ELSE json_type(body, spot) END AS t FROM e, spots WHERE body IS NOT NULL),
  types AS (SELECT entity, early, path, CASE t WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'VARCHAR' THEN 'STRING' ELSE t END AS type FROM typed WHERE t IS NOT NULL),
  totals AS (SELECT entity, early, count(*) AS n FROM types WHERE path = '$' GROUP BY ALL)"""
_CHECK = """, required AS (SELECT entity, path, list(DISTINCT type) AS allowed FROM types JOIN totals USING (entity, early) WHERE early GROUP BY entity, path, n HAVING count(*) = n),
  here AS (SELECT r.entity, r.path, count(t.type) AS n, count(*) FILTER (WHERE t.type IS NOT NULL AND NOT list_contains(allowed, 'UNKNOWN') AND NOT list_contains(allowed, t.type)) AS wrong
    FROM required r LEFT JOIN (FROM types WHERE NOT early) t USING (entity, path) GROUP BY ALL),
  checked AS (SELECT entity, max(c.n) AS n_records, sum(c.n - h.n)::BIGINT AS n_missing, sum(wrong)::BIGINT AS n_mismatched FROM here h JOIN (FROM totals WHERE NOT early) c USING (entity) GROUP BY entity)"""


def _bodies(s, d):
    k, early = F.get_json_object("props", "$.k"), F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    return table(s, d, "events").select("event_id", "event_type", "user_id", early.alias("early"), k.alias("k")).withColumn("body", F.expr(_BODY))


@query(_E + " SELECT entity, path, type, count(*) AS n_records FROM types WHERE NOT early GROUP BY ALL")
def infer_structure(s, d):
    return contracts.infer_structure(_bodies(s, d).where("not early"), "event_type", "body")


@query(_E + _CHECK + " SELECT entity, n_records, n_missing, n_mismatched, n_missing + n_mismatched = 0 AS satisfied FROM checked")
def superset_check(s, d):
    """Later records against the paths that all earlier ones have."""
    both = contracts.infer_structure(_bodies(s, d).withColumn("side", F.struct("event_type", "early")), "side", "body")
    old, new = (both.where(x).withColumn("entity", F.col("entity.event_type")) for x in ("entity.early", "not entity.early"))
    return contracts.superset_check(contracts.required_paths(old), new)


@query(_E + _CHECK + """, uses AS (SELECT DISTINCT user_id::VARCHAR AS u, event_type FROM events)
  SELECT entity, u AS dependent, 1 AS hop, row_number() OVER (PARTITION BY entity ORDER BY u) AS place FROM checked JOIN uses ON entity = event_type WHERE n_missing + n_mismatched > 0""")
def contract_report(s, d):
    edges = table(s, d, "events").select(F.col("user_id").cast("string").alias("src"), F.col("event_type").alias("dst")).distinct()
    return contracts.contract_report(superset_check(s, d), edges, 2)


@query("""SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'unavailable' WHEN event_id % 19 = 0 THEN 'invalid' WHEN event_type = 'signup' THEN 'skipped' ELSE 'ok' END AS status FROM events""")
def contract_status(s, d):
    i = F.col("event_id")
    e = table(s, d, "events").select("event_id", "event_type", F.when(i % 17 == 0, None).when(i % 19 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props")).alias("body"))
    return contracts.contract_status(e, "body", F.col("event_type") != "signup").select("event_id", "status")


# Segments


@query(with_views("SELECT doc_id, node_id, line_no, content_hash FROM chunks", "chunks"))
def segment_corpus(s, d):
    return corpus.segment_lines(v.documents(s, d)).select("doc_id", "node_id", "line_no", "content_hash")


@query(f"WITH {_LINKS}, {_KNOWN} SELECT page_id, bool_or(rtrim(ref, ',.') IN (FROM known)) AS external FROM links GROUP BY page_id")
def direct_external(s, d):
    listed = _words(s, d).withColumn("listed", F.lit(True))
    refs = _links(s, d).select("page_id", F.regexp_replace("ref", "[,.]+$", "").alias("path"))
    return refs.join(listed, "path", "left").groupBy("page_id").agg(F.bool_or(F.col("listed").isNotNull()).alias("external"))


#: Links of pages as bindings of names: the first letter of a link is bound to its word; the last binding of a page holds.
_BOUND = """WITH refs AS (SELECT page_id, unnest(r) AS ref, generate_subscripts(r, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS r FROM pages)),
  bound AS (SELECT page_id, pos, substr(word, 1, 1) AS name, word FROM (SELECT page_id, pos, rtrim(substr(ref, 2), ',.') AS word FROM refs))"""


def _bindings(s, d):
    refs = table(s, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("pos", "ref"))
    word = F.regexp_replace(F.expr("substring(ref, 2)"), "[,.]+$", "")
    return refs.select(
        F.col("page_id").cast("string").alias("path"), F.lit("import").alias("record"), F.substring(word, 1, 1).alias("name"), word.alias("a"), F.lit(None).cast("string").alias("b"),
        F.lit(0).alias("level"), (F.col("pos") + 1).alias("position"), (F.col("pos") + 1).alias("line_start"),
    )


@query(_BOUND + " SELECT page_id, name, arg_max(word, pos) AS module FROM bound GROUP BY ALL")
def import_aliases(s, d):
    out = corpus.import_aliases(_bindings(s, d).withColumn("a", F.concat("a", F.lit(".part"))))
    return out.select(F.col("path").cast("long").alias("page_id"), "name", "module")


@query(_BOUND + f""", {_KNOWN} SELECT page_id, name, arg_max(word, pos) || '.py' AS file, name AS symbol FROM bound WHERE '/' || word IN (SELECT path FROM known) GROUP BY ALL""")
def bound_symbols(s, d):
    files = _words(s, d).select(F.concat(F.expr("substring(path, 2)"), F.lit(".py")).alias("path"))
    out = corpus.bound_symbols(_bindings(s, d).withColumn("b", F.col("name")), files)
    return out.select(F.col("path").cast("long").alias("page_id"), "name", "file", "symbol")


@query("""WITH calls AS (SELECT event_type AS name, 'u' || user_id AS path, props AS args, event_id FROM events WHERE value > 20)
  SELECT name, arg_min(path, struct_pack(p := path, e := event_id)) AS path, arg_min(args, struct_pack(p := path, e := event_id)) AS args FROM calls GROUP BY name""")
def call_site_args(s, d):
    """For each kind of event the first call, by user and event, whose arguments are known."""
    e = table(s, d, "events")
    args = F.when(F.col("value") > 20, F.col("props"))
    calls = e.select(F.lit("call").alias("record"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.concat(F.lit("mod."), "event_type").alias("a"), args.alias("b"), F.col("event_id").alias("line_start"), F.lit(0).alias("position"))
    return corpus.call_site_args(e.select(F.col("event_type").alias("name")).distinct(), calls)


_CALLS = """links AS (SELECT page_id AS src, page_id // 2 - pos AS dst FROM refs WHERE pos <= 3), edges AS (SELECT l.* FROM links l JOIN pages p ON p.page_id = l.dst WHERE src <> dst),
  lab AS (SELECT page_id AS node FROM pages WHERE page_id % 50 IN (3, 4) UNION SELECT src FROM lab JOIN edges ON dst = lab.node)"""


@query(_BOUND.replace("WITH", "WITH RECURSIVE", 1) + f", {_CALLS} SELECT node AS page_id FROM lab")
def cross_file_labels(s, d):
    """Pages as files of one function, which calls those of the pages that its first links stand for; some call out, some are known to."""
    refs = _bindings(s, d).where("position <= 3")
    name, none, no = (lambda x: F.concat(F.lit("p"), x.cast("string"))), F.lit(None).cast("string"), F.lit(0)
    pages = table(s, d, "pages").select("page_id")
    path = lambda x: F.concat(name(x), F.lit(".py"))
    record = lambda kind, of, n, a, b: [of.alias("path"), F.lit(kind).alias("record"), n.alias("name"), a.alias("a"), b.alias("b"), no.alias("level"), no.alias("position"), no.alias("line_start")]
    page, target = F.col("path").cast("long"), F.expr("cast(path as long) div 2 - position")
    fun = F.concat(F.lit("f"), F.col("position").cast("string"))
    out = pages.where("page_id % 50 = 3")
    parts = [
        pages.select(*record("node", path(F.col("page_id")), F.lit("main"), F.lit("main"), none)), refs.select(*record("import", path(page), fun, name(target), F.lit("main"))), refs.select(*record("call", path(page), F.lit("main"), fun, none)),
        out.select(*record("import", path(F.col("page_id")), F.lit("net"), F.lit("requests"), none)), out.select(*record("call", path(F.col("page_id")), F.lit("main"), F.lit("net.get"), none)),
    ]
    records = written(reduce(DataFrame.unionAll, parts), "page-records")
    extra = pages.where("page_id % 50 = 4").select(F.concat(path(F.col("page_id")), F.lit("::main")).alias("node_id"))
    got = corpus.external_functions(records, pages.select(path(F.col("page_id")).alias("path")), extra=extra)
    return got.select(F.regexp_extract("node_id", "^p([0-9]+)", 1).cast("long").alias("page_id"))


# Leases in time and streams

_REPLAY = """, ranked AS (SELECT *, row_number() OVER (PARTITION BY resource ORDER BY sec, event_id) AS n FROM {log}),
run AS (
  SELECT resource, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::VARCHAR AS outcome, NULL::BIGINT AS holder, 0::BIGINT AS expires FROM (SELECT DISTINCT resource FROM ranked)
  UNION ALL
  SELECT resource, n, event_id, outcome,
    CASE outcome WHEN 'release' THEN NULL WHEN 'block' THEN holder WHEN 'noop' THEN holder ELSE agent END,
    CASE WHEN outcome IN ('grant', 'grant_after_expiry', 'reenter') THEN sec + 21600 WHEN outcome = 'release' THEN 0 ELSE expires END
  FROM (SELECT k.resource, k.n, k.event_id, k.agent, k.sec, r.holder, r.expires,
    CASE WHEN k.op = 'acquire' AND r.holder IS NULL THEN 'grant' WHEN k.op = 'acquire' AND r.expires < k.sec THEN 'grant_after_expiry' WHEN k.op = 'acquire' AND r.holder = k.agent THEN 'reenter' WHEN k.op = 'acquire' THEN 'block'
         WHEN k.op IN ('release', 'failure') AND r.holder = k.agent {lazy} THEN 'release' ELSE 'noop' END AS outcome
    FROM run r JOIN ranked k ON k.resource = r.resource AND k.n = r.n + 1)
) """
_OPS = ", ops AS (SELECT * FROM log WHERE op IN ('acquire', 'release', 'failure'))"
_EAGER = "AND r.expires >= k.sec"


def _ops(s, d):
    return v.events(s, d).where("op in ('acquire', 'release', 'failure')")


@query(with_views(_OPS + _REPLAY.format(log="ops", lazy=_EAGER) + "SELECT event_id, outcome FROM run WHERE n > 0", "log", recursive=True))
def lease_replay(s, d):
    return leases.lease_replay(_ops(s, d), TTL).select("event_id", "outcome")


@query(with_views(_OPS + _REPLAY.format(log="ops", lazy="") + "SELECT event_id, outcome FROM run WHERE n > 0", "log", recursive=True))
def lease_replay_lazy(s, d):
    return leases.lease_replay(_ops(s, d), TTL, "lazy").select("event_id", "outcome")


@query(with_views(_OPS + _REPLAY.format(log="ops", lazy=_EAGER) + "SELECT event_id, outcome FROM run WHERE n > 0", "log", recursive=True))
def lease_replay_split(s, d):
    return leases.lease_replay_split(_ops(s, d), TTL).select("event_id", "outcome")


_FAN = """, held AS (SELECT DISTINCT agent, resource FROM log WHERE op = 'acquire'), ops AS (SELECT resource, sec, event_id, agent, op FROM log WHERE op <> 'stop'
  UNION ALL SELECT h.resource, l.sec, l.event_id, l.agent, 'release' FROM log l JOIN held h USING (agent) WHERE l.op = 'stop')"""


@query(with_views(_FAN + _REPLAY.format(log="ops", lazy=_EAGER) + "SELECT resource, event_id, outcome FROM run WHERE n > 0", "log", recursive=True))
def agent_release_fanout(s, d):
    return leases.lease_replay_fanout(v.events(s, d).withColumn("session", F.col("agent")), TTL, "stop").select("resource", "event_id", "outcome")


_END = """, held AS (SELECT DISTINCT agent % 5 AS session, agent, resource FROM log WHERE op = 'acquire'), ends AS (SELECT agent % 5 AS session, sec, event_id FROM log WHERE op = 'stop' AND event_id % 50 = 0),
  ops AS (SELECT resource, sec, event_id, agent, op FROM log WHERE op IN ('acquire', 'release', 'failure') UNION ALL SELECT h.resource, e.sec, e.event_id, h.agent, 'release' FROM ends e JOIN held h USING (session))"""


@query(with_views(_END + _REPLAY.format(log="ops", lazy=_EAGER) + "SELECT resource, event_id, outcome FROM run WHERE n > 0", "log", recursive=True))
def session_release_fanout(s, d):
    """The end of a session releases what its agents hold."""
    log = v.events(s, d).withColumns({"session": F.col("agent") % 5, "op": F.when((F.col("op") == "stop") & (F.col("event_id") % 50 == 0), "end").otherwise(F.col("op"))})
    ops = log.where("op in ('acquire', 'release', 'failure', 'end')")
    return leases.lease_replay_fanout(ops, TTL).select("resource", "event_id", "outcome")


_WOUND = _CYCLE + """, wounds AS (SELECT arg_min(node, struct_pack(p := node % 3, n := node)) AS agent, (SELECT max(sec) FROM log) AS sec, (SELECT max(event_id) + 1 FROM log) AS event_id FROM cycles GROUP BY cycle),
  ops AS (SELECT resource, sec, event_id, agent, op FROM log WHERE op IN ('acquire', 'release', 'failure')
    UNION ALL SELECT h.resource, w.sec, w.event_id, w.agent, 'release' FROM wounds w JOIN (SELECT DISTINCT agent, resource FROM log WHERE op = 'acquire') h USING (agent))"""


@query(with_views(_WOUND + _REPLAY.format(log="ops", lazy=_EAGER) + "SELECT resource, event_id, outcome FROM run WHERE n > 0", "log", "wait_edges", recursive=True))
def victim_release_fanout(s, d):
    """The victims of all rings of waiting agents give back what they hold when the log ends."""
    log = v.events(s, d)
    end = log.agg(F.max("sec").alias("sec"), (F.max("event_id") + 1).alias("event_id")).first()
    victims = cycle_victim(s, d).select(F.col("victim").alias("agent"), F.lit(end.sec).alias("sec"), F.lit(end.event_id).alias("event_id"))
    ops = log.where("op in ('acquire', 'release', 'failure')")
    return leases.lease_replay(leases.victim_release_fanout(ops, victims), TTL).select("resource", "event_id", "outcome")


@query(with_views(_FIRST.replace("event_id FROM (SELECT *", "min(event_id) AS n_first FROM (SELECT *").replace(" WHERE n = 1", " GROUP BY ALL"), "log").replace("min(event_id) AS n_first", "true AS visited"))
def traversal_dedupe(s, d):
    return streams.traversal_dedupe(v.events(s, d).select("agent", "resource"), ["agent", "resource"]).withColumn("visited", F.lit(True))


@query(with_views(_OPS + _REPLAY.format(log="ops", lazy=_EAGER) + "SELECT date_trunc('day', ts)::DATE::VARCHAR AS day, count(*) FILTER (WHERE outcome = 'block') AS n_block, count(*) AS n_events FROM run JOIN events USING (event_id) WHERE n > 0 GROUP BY ALL", "log", recursive=True))
def contention_rate(s, d):
    out = lease_replay(s, d).join(table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts")), "event_id")
    return streams.contention_rate(out, "ts").select(F.col("start").cast("date").cast("string").alias("day"), "n_block", "n_events")


@query(with_views(_OPS + _REPLAY.format(log="ops", lazy=_EAGER) + """, done AS (SELECT DISTINCT r.resource, r.expires, r.holder FROM run r LEFT JOIN ranked k ON k.resource = r.resource AND k.n = r.n + 1 WHERE r.holder IS NOT NULL AND (k.sec IS NULL OR k.sec > r.expires))
  SELECT resource, event_id, replace(outcome, '_after_expiry', '') AS outcome, NULL::BIGINT AS holder, NULL::BIGINT AS expired FROM run WHERE n > 0 UNION ALL SELECT resource, NULL, 'expired', holder, expires FROM done""", "log", recursive=True))
def lease_stream(s, d):
    """The events as a stream of four micro-batches in which they are up to a day out of order, then a tick long after the last one."""
    log, day = _ops(s, d).select("resource", "sec", "event_id", "agent", "op"), 86400
    first, last = log.agg(F.min("sec"), F.max("sec")).first()
    place = F.col("sec") + F.pmod(F.xxhash64("event_id"), F.lit(day)) - (first or 0)
    log = written(log.withColumn("part", F.floor(place * 4 / ((last or 0) - (first or 0) + day + 1))), "lease-log")
    tick = log.agg(F.max("sec").alias("sec")).select(F.lit(-1).cast("long").alias("resource"), (F.col("sec") + TTL + 3 * day).alias("sec"), *(F.lit(-1).cast("long").alias(x) for x in ("event_id", "agent")), F.lit("tick").alias("op"))
    live = streams.staged([*(log.where(F.col("part") == i).drop("part") for i in range(4)), tick])
    out = streams.drained(streams.lease_stream(live, TTL, "1 day"))
    gone = F.col("outcome") == "expired"
    return out.select("resource", "event_id", "outcome", F.when(gone, F.col("agent")).alias("holder"), F.when(gone, F.col("sec")).alias("expired"))


@query(with_views("SELECT DISTINCT agent, resource, true AS visited FROM log", "log"))
def traversal_dedupe_stream(s, d):
    """A visit is forgotten after a year, so that state ends; the events span less."""
    live = v.as_log(live_table(s, d, "events")).select("agent", "resource", F.timestamp_seconds("sec").alias("at"))
    return streams.drained(streams.traversal_dedupe(live, ["agent", "resource"], "at", "365 days")).select("agent", "resource").withColumn("visited", F.lit(True))


_LIVE = """WITH c AS (SELECT event_id, json_extract(props, '$.k')::BIGINT AS node, floor(value)::BIGINT % 3 AS h, ts FROM events WHERE event_type = 'click'),
  x AS (SELECT event_id AS change_id, json_extract(props, '$.k')::BIGINT AS node, CASE WHEN event_id % 5 > 0 THEN floor(value)::BIGINT % 3 END AS h, ts FROM events WHERE event_type = 'error')"""


@query(_LIVE + """ SELECT event_id, change_id, CASE WHEN change_id IS NULL THEN 'quiet' WHEN x.h IS NULL THEN 'gone' WHEN x.h = c.h THEN 'same' ELSE 'drifted' END AS status
  FROM c LEFT JOIN x ON c.node = x.node AND x.ts >= c.ts AND x.ts <= c.ts + INTERVAL 6 HOUR""")
def live_drift(s, d):
    """Clicks capture a node, errors change it; both come as streams, and one last row each moves the watermarks past the end."""
    e = table(s, d, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("node_id"), (F.floor("value") % 3).cast("string").alias("hash"), F.col("ts").cast("timestamp").alias("at"))
    captures = e.where("event_type = 'click'").select("event_id", "node_id", F.col("hash").alias("baseline_hash"), F.col("at").alias("captured_at"))
    changes = e.where("event_type = 'error'").select(F.col("event_id").alias("change_id"), "node_id", F.when(F.col("event_id") % 5 > 0, F.col("hash")).alias("content_hash"), F.col("at").alias("changed_at"))
    last = lambda x: x.limit(1).withColumn(x.columns[-1], F.lit("2100-01-01").cast("timestamp"))
    streams_ = [streams.staged([x.withColumn("node_id", F.col("node_id")), last(x)]) for x in (captures, changes)]
    out = streams.drained(streams.live_drift(*streams_, within="6 hours").select("captured_at", "event_id", "change_id", "status"))
    return out.where("captured_at < '2099-01-01'").select("event_id", "change_id", "status")


@query(with_views("SELECT a.node_id, a.content_hash AS baseline_hash, b.content_hash FROM chunks a LEFT JOIN chunks2 b USING (node_id) WHERE a.content_hash IS DISTINCT FROM b.content_hash", "chunks", "chunks2"))
def drift_monitor(s, d):
    """The second version arrives as a stream and is held against the first; every seventh document is deleted."""
    live = live_table(s, d, "documents")
    nodes = corpus.line_map(F.col("doc_id").cast("string"), v.text_v2())
    gone = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    changes = live.select(F.col("doc_id").alias("file"), F.when(F.col("doc_id") % 7 == 0, gone).otherwise(nodes).alias("nodes"))
    base = v.chunks(s, d).select(F.col("doc_id").alias("file"), "node_id", F.col("content_hash").alias("baseline_hash"))
    return streams.drained(streams.drift_monitor(changes, base)).select("node_id", "baseline_hash", "content_hash")


@query(with_views(_FLAGS + """, gone AS (SELECT doc_id FROM documents WHERE doc_id % 7 = 0) SELECT 'node' AS what, node_id AS a, content_hash AS b FROM chunks2
  UNION ALL SELECT 'edge', doc_id::VARCHAR, (doc_id // 2)::VARCHAR FROM documents WHERE doc_id % 7 <> 0 AND doc_id <> doc_id // 2 AND doc_id // 2 NOT IN (FROM gone)
  UNION ALL SELECT 'refresh', doc_id::VARCHAR, '' FROM documents WHERE doc_id <> doc_id // 2 AND doc_id // 2 IN (SELECT doc_id FROM flags WHERE ids_changed OR kinds_changed OR deleted)""", "chunks", "chunks2"))
def index_stream(s, d):
    """Both versions of the documents arrive as change events; every seventh document is taken out, and most are as they were. Each document depends on the one with half of its id."""
    docs, i = table(s, d, "documents"), F.col("doc_id")
    change = lambda seq, event, text: docs.select(i.cast("string").alias("file"), F.lit(seq).cast("long").alias("seq"), event.alias("event"), text.alias("text"))
    live = streams.staged([change(1, F.lit("change"), F.col("text")), change(2, F.when(i % 7 == 0, "unlink").otherwise("change"), v.text_v2())])
    index = streams.Index(s, f"{shared_dir(s)}/index-{uuid.uuid4().hex}")
    half = lambda x: x.select(F.col("file").alias("src"), F.expr("cast(cast(file as long) div 2 as string)").alias("dst")).where("src <> dst")
    streams.index_stream(live, index, lambda x: v.with_kind(corpus.segment_lines(x, "file")), half, f"{index.path}/state").awaitTermination()
    nodes, edges, refresh = (index.read(x) for x in ("nodes", "edges", "refresh"))
    return nodes.select(F.lit("node").alias("what"), F.col("node_id").alias("a"), F.col("content_hash").alias("b")).unionAll(edges.select(F.lit("edge"), "src", "dst")).unionAll(refresh.select(F.lit("refresh"), "file", F.lit("")))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Which sources drifted between two versions of the corpus, with their roots and stale documents."""
    a = drift.merkle_root(v.chunks(spark, folder), ["source"], "doc_id")
    b = drift.merkle_root(v.chunks(spark, folder, 2), ["source"], "doc_id").withColumnRenamed("root", "root2")
    stale = v.documents(spark, folder).select("source", "doc_id").join(file_fresh(spark, folder), "doc_id").groupBy("source").agg(F.count_if(~F.col("fresh")).alias("n_stale"), F.count("*").alias("n_docs"))
    return a.join(b, "source", "left").join(stale, "source").withColumn("drifted", ~F.col("root").eqNullSafe(F.col("root2")))


QUERIES["drifted_sources"] = flagship
ORACLES["drifted_sources"] = with_views(
    ", a AS (" + _ROOT.format(g="source, ", c="chunks", by=" GROUP BY source").removeprefix(", ").replace("leaves AS", "WITH leaves AS", 1) + "), b AS ("
    + _ROOT.format(g="source, ", c="chunks2", by=" GROUP BY source").removeprefix(", ").replace("leaves AS", "WITH leaves AS", 1) + ")" + _FRESH
    + ", s AS (SELECT source, count(*) FILTER (WHERE NOT fresh) AS n_stale, count(*) AS n_docs FROM documents JOIN fresh USING (doc_id) GROUP BY source) "
    "SELECT source, a.root, b.root AS root2, n_stale, n_docs, a.root IS DISTINCT FROM b.root AS drifted FROM a LEFT JOIN b USING (source) JOIN s USING (source)",
    "chunks", "chunks2",
)
