"""The operators on live tables, with Structured Streaming."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftwood.operators.drift import index_states
from driftwood.operators.graph import reindex_set
from driftwood.operators.leases import outcome
from driftwood.operators.tables import event_router, upsert_last_wins
from driftwood.sources.workspace import shared_dir, shipped, written


def lease_stream(log: DataFrame, ttl: int, late: str = "1 day") -> DataFrame:
    """Leases on a stream (resource, sec, event_id, agent, op), by event time.

    Events wait in the state of their resource until the watermark, ``late``
    behind the newest event, has passed them, and then count in (sec, event_id)
    order, however they were dealt to micro-batches; those that come later than
    that are 'late' and change nothing. Outcomes are those of ``lease_replay`` with eager
    eviction, but that a lease past its expiry is taken off: it comes out as a
    row of its own (op and outcome 'expired', sec its expiry, agent its holder, no
    event_id), by a timer if nobody asks for it, and a grant after it is a
    'grant'. The state of a resource without lease or waiting events is removed.
    An event without time, agent or op is a 'noop' at once.
    """
    cols = ["resource", "sec", "event_id", "agent", "op", "outcome"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        holder, expires, waiting = state.get if state.exists else (None, 0, "[]")
        queue, out = json.loads(waiting), []
        resource, passed = None if pd.isna(key[0]) else int(key[0]), state.getCurrentWatermarkMs()
        for rows in batches:
            for event in zip(*(rows[x] for x in ("sec", "event_id", "agent", "op")), strict=True):
                sec, event_id, agent, op = (None if pd.isna(x) else x if i == 3 else int(x) for i, x in enumerate(event))
                if sec is None or agent is None or op is None:
                    out.append((resource, sec, event_id, agent, op, "noop"))
                elif 0 < passed and sec * 1000 <= passed:
                    out.append((resource, sec, event_id, agent, op, "late"))
                else:
                    queue.append((sec, -1 if event_id is None else event_id, agent, op))
        queue = sorted(map(tuple, queue))
        n = sum(x[0] * 1000 <= passed for x in queue)

        def sweep(sec: int) -> None:
            nonlocal holder
            if holder is not None and expires < sec:
                out.append((resource, expires, None, holder, "expired", "expired"))
                holder = None

        for sec, event_id, agent, op in queue[:n]:
            sweep(sec)
            what, holder, expires = outcome(op, agent, sec, holder, expires, ttl, True)
            out.append((resource, sec, None if event_id < 0 else event_id, agent, op, what))
        queue = queue[n:]
        sweep(min(passed // 1000, queue[0][0] if queue else passed // 1000))
        if queue or holder is not None:
            state.update((holder, expires, json.dumps(queue)))
            at = [queue[0][0] * 1000 - 1] if queue else []
            at += [expires * 1000 + 999] if holder is not None else []
            state.setTimeoutTimestamp(max(passed + 1, min(at)))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame({x: pd.array([r[i] for r in out], "Int64" if i < 4 else "object") for i, x in enumerate(cols)})

    # as strings, since a column of numbers with nulls would lose digits in pandas
    rows = shipped(log).select("resource", F.timestamp_seconds("sec").alias("ts"), *(F.col(x).cast("string").alias(x) for x in ("sec", "event_id", "agent", "op")))
    return rows.withWatermark("ts", late).groupBy("resource").applyInPandasWithState(
        run, "resource long, sec long, event_id long, agent long, op string, outcome string", "holder long, expires long, waiting string", "append", GroupStateTimeout.EventTimeTimeout
    )


def traversal_dedupe(visits: DataFrame, keys: list[str], time: str | None = None, within: str | None = None) -> DataFrame:
    """Each key's first visit: on a stream by state, on a table by an aggregate.

    With the column ``time`` and ``within``, a stream forgets a key when the
    watermark is past its visit by that long, so that state does not grow for
    ever; a visit that far apart counts anew.
    """
    if time and visits.isStreaming:
        return visits.withWatermark(time, within or "1 day").dropDuplicatesWithinWatermark(keys)
    return visits.dropDuplicates(keys)


def drift_monitor(changes: DataFrame, baseline: DataFrame) -> DataFrame:
    """(file, node_id, baseline_hash, content_hash): captured nodes that a change altered, or took away (no content_hash).

    changes: a stream of whole files as they are now, (file, nodes: map of
    node_id to content_hash; empty or null for a deleted file); baseline: a
    table (file, node_id, baseline_hash), whose repeated rows are each compared.
    Each change meets its own file's nodes; these are grouped and written once.
    """
    captured = written(baseline.groupBy("file").agg(F.collect_list(F.struct("node_id", "baseline_hash")).alias("captured")), "captured")
    hit = changes.join(captured, "file").select("file", "nodes", F.inline("captured"))
    rows = hit.select("file", "node_id", "baseline_hash", F.try_element_at("nodes", F.col("node_id")).alias("content_hash"))
    return rows.where(~F.col("content_hash").eqNullSafe(F.col("baseline_hash")))


def live_drift(captures: DataFrame, changes: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """What became of nodes captured with a live lease, as two streams (or tables) meet.

    captures: (node_id, baseline_hash, captured_at ...); changes: (node_id,
    content_hash, changed_at ...), a null hash for a node that is gone. Each
    capture meets the changes of its node in the time ``within`` from it on.
    Returns the captures' columns, the changes' other columns, content_hash and
    status: 'same', 'drifted', 'gone', or 'quiet' for a capture without a change,
    which a stream tells when both watermarks, ``late`` behind, have passed that
    time. Rows later than that are dropped by Spark. Null ids meet nothing.

    Time is cut into pieces no shorter than ``within``. A capture stands in its
    own piece, a change in its own and in the one before, so that a node's
    captures are held against the changes around them and each pair meets once.
    """
    if captures.isStreaming:
        captures, changes = captures.withWatermark("captured_at", late), changes.withWatermark("changed_at", late)
    start = "timestamp'2001-01-01 00:00:00'"
    span = captures.sparkSession.sql(f"SELECT unix_micros({start} + interval {within}) - unix_micros({start})").first()[0]
    width = max(1, span + span // 6)  # days and months are of unequal length
    piece = lambda at: F.expr(f"unix_micros(cast({at} as timestamp)) div {width}")
    captures = captures.withColumn("piece", piece("captured_at"))
    new = changes.withColumnRenamed("node_id", "changed_id").withColumn("changed", F.explode(F.array(piece("changed_at") - 1, piece("changed_at"))))
    in_time = (F.col("changed_at") >= F.col("captured_at")) & (F.col("changed_at") <= F.col("captured_at") + F.expr(f"interval {within}"))
    both = captures.join(new, (F.col("node_id") == F.col("changed_id")) & (F.col("piece") == F.col("changed")) & in_time, "left_outer")
    status = F.when(F.col("changed").isNull(), "quiet").when(F.col("content_hash").isNull(), "gone").when(F.col("content_hash").eqNullSafe(F.col("baseline_hash")), "same").otherwise("drifted")
    return both.withColumn("status", status).drop("changed_id", "changed", "piece")


def contention_rate(outcomes: DataFrame, time: str, every: str = "1 day", late: str = "1 day") -> DataFrame:
    """Blocked and all requests by window of event time."""
    rows = outcomes.withWatermark(time, late) if outcomes.isStreaming else outcomes
    return rows.groupBy(F.window(time, every).alias("w")).agg(F.count_if(F.col("outcome") == "block").alias("n_block"), F.count("*").alias("n_events")).select(F.col("w.start").alias("start"), "n_block", "n_events")


def routed(events: DataFrame, rules: list[tuple[Column, str]], default: str, path: str, checkpoint: str) -> StreamingQuery:
    """Splits a stream by mode: each micro-batch goes to one folder per mode ('mode=...') below path."""
    return event_router(events, rules, default).writeStream.partitionBy("mode").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Index:
    """Tables of an index in Parquet, in folders by hash of the file, so that a change rewrites the folders of its files only.

    nodes: (file, node_id, content_hash, kind); edges: (src, dst), by src;
    refresh: (batch, file), what each micro-batch asks to be looked at again.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets

    SCHEMAS = {"nodes": "file string, node_id string, content_hash string, kind string, bucket int", "edges": "src string, dst string, bucket int", "refresh": "file string, batch long"}

    def bucket(self, col: str) -> Column:
        return F.pmod(F.xxhash64(col), F.lit(self.buckets)).cast("int")

    def create(self) -> Index:
        """Makes tables that are not there yet."""
        for name, schema in self.SCHEMAS.items():
            self.spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.path}/{name}")
        return self

    def read(self, name: str) -> DataFrame:
        rows = self.spark.read.schema(self.SCHEMAS[name]).parquet(f"{self.path}/{name}")
        return rows.where(f"{rows.columns[0]} is not null")

    def replace(self, name: str, rows: DataFrame, touched: DataFrame) -> None:
        """The touched buckets hold these rows from now on; they must not be read from the table itself. A row of nulls keeps an empty one from being skipped."""
        none = [F.lit(None).cast("string").alias(x) for x in rows.columns if x != "bucket"]
        rows.unionByName(touched.select(*none, "bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{name}")


def index_stream(changes: DataFrame, index: Index, segment: Callable[[DataFrame], DataFrame], links: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Keeps an index current from a stream (file, seq, event, text).

    In each micro-batch the last event of a file counts. Files whose nodes are
    as stored are left alone; the nodes and outgoing edges of others are
    replaced, and after 'unlink' taken out, with the edges that lead to the file.
    Direct dependents of files whose node set or kinds changed, or that are gone,
    are noted for refresh. segment: (file, text) to (file, node_id,
    content_hash, kind); links: (file, text) to (src, dst). A batch that is
    repeated writes the same rows again.
    """

    def apply(batch: DataFrame, number: int) -> None:
        events = batch.select("file", "seq", "event", "text")
        if not events.groupBy("file").count().where("count > 1").isEmpty():
            events = written(upsert_last_wins(events, ["file"], ["seq"]), "changes")
        # texts of files that come once are read where they are, neither shuffled nor written
        last = written(events.select("file", "event", index.bucket("file").alias("bucket")), "changes")
        there = events.where("event <> 'unlink'").select("file", "text")
        new = written(segment(there).select("file", "node_id", "content_hash", "kind").withColumn("bucket", index.bucket("file")), "segments")
        touched = [r.bucket for r in last.select("bucket").distinct().collect()]  # ``buckets`` values at most
        stored = written(index.read("nodes").where(F.col("bucket").isin(touched)), "stored")
        first = stored.isEmpty()  # then no file is known, and there is nothing to compare
        states = None if first else written(index_states(stored.join(last.select("file"), "file", "left_semi"), new), "states")
        stale = last.select("file") if first else written(last.select("file", "event").join(states.where("fresh"), "file", "left_anti"), "stale").select("file")
        if stale.isEmpty():
            return
        of_stale = lambda x: x if first else x.join(stale, "file", "left_semi")
        edges = index.read("edges")
        moved = last.limit(0).select("file") if first else states.where("ids_changed or kinds_changed or deleted").select("file")
        refresh = reindex_set(moved.select("file", *(F.lit(x == "deleted").alias(x) for x in ("ids_changed", "kinds_changed", "deleted", "changed"))), edges.select("src", "dst"))
        refresh.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{index.path}/refresh")
        gone = last.where("event = 'unlink'").select(F.col("file").alias("dst"))
        added = links(of_stale(there)).select("src", "dst").distinct().join(gone, "dst", "left_anti").select("src", "dst").withColumn("bucket", index.bucket("src"))
        lost = written(edges.join(gone, "dst", "left_semi").select("bucket").union(of_stale(last).select("bucket")).distinct(), "lost")
        kept = written(edges.join(lost, "bucket", "left_semi"), "edges").join(stale.select(F.col("file").alias("src")), "src", "left_anti").join(gone, "dst", "left_anti")
        index.replace("edges", kept.select("src", "dst", "bucket").unionByName(added), lost)
        kept = stored if first else stored.join(stale, "file", "left_anti")
        index.replace("nodes", kept.select("file", "node_id", "content_hash", "kind", "bucket").unionByName(of_stale(new)), last.select("bucket").distinct())

    index.create()
    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def staged(parts: list[DataFrame], files: int = 8) -> DataFrame:
    """Tables as one stream that brings them in turn: each is written to the shared folder in up to ``files`` files, as many as a micro-batch takes."""
    spark = parts[0].sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    for part in parts:
        part.repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", files).parquet(path)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now, into a table of the shared folder, and reads that."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
