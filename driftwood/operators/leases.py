"""Lease logs: conflicts, expiry, queues, waiting and replay."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwood.functions.digests import comparable
from driftwood.operators.ordered import last_before, ranked
from driftwood.sources.workspace import shipped, written

BASE_TTL, TTL_PER_LINE = 30, 2
#: Ends of a session in a block that meets leases at once, ends that may be broadcast, and releases that one task makes.
END_BLOCK, BROADCAST_ENDS, RELEASES = 128, 200_000, 2_000_000
#: Agents of a piece of leases, pieces below which a session's ends are cut into slices, and ends of a slice that is not broadcast.
AGENTS, SPREAD, END_SLICE = 512, 1_000, 16_384


def lease_ttl(requests: DataFrame, nodes: DataFrame, base: int = BASE_TTL, per_line: int = TTL_PER_LINE) -> DataFrame:
    """Requests (node_id ...) with a ttl by the span of the node; the base for unknown nodes."""
    span = F.greatest(F.lit(0), F.col("line_end") - F.col("line_start"))
    return requests.join(nodes.select("node_id", "line_start", "line_end"), "node_id", "left").withColumn("ttl", (F.lit(base) + per_line * F.coalesce(span, F.lit(0))).cast("long")).drop("line_start", "line_end")


def expired_leases(leases: DataFrame, snapshots: DataFrame, as_of: int) -> DataFrame:
    """Leases past their expiry (strictly), with the text to restore on the first lease of each file. No expiry: never."""
    late = leases.where(F.col("expires_at").isNotNull() & (F.col("expires_at") < as_of)).join(snapshots, "node_id", "left")
    first = F.row_number().over(Window.partitionBy("file").orderBy(F.col("snapshot").isNull(), "node_id")) == 1
    return late.withColumn("restores", first & F.col("snapshot").isNotNull())


def lease_conflicts(requests: DataFrame, leases: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(agent, node_id, holder): requested nodes, and structural or external nodes of the files their file depends on, that others hold.

    requests: (agent, node_id, file); leases: (node_id, holder); nodes: (node_id, file, kind); edges: (src, dst).
    """
    around = requests.select("agent", F.col("file").alias("src")).distinct().join(edges, "src").select("agent", F.col("dst").alias("file")).join(nodes.where(F.col("kind") != "benign"), "file").select("agent", "node_id")
    wanted = requests.select("agent", "node_id").unionAll(around).distinct()
    return wanted.join(leases, "node_id").where("holder <> agent").select("agent", "node_id", "holder").distinct()


def benign_blocked(requests: DataFrame, leases: DataFrame) -> DataFrame:
    """Requests (agent, file) of files in which another agent holds a lease. leases: (holder, file)."""
    held = leases.select(F.col("file").alias("held"), "holder").distinct()
    return requests.join(held, (F.col("file") == F.col("held")) & (F.col("agent") != F.col("holder")), "left_semi")


def wait_for_edges(intents: DataFrame, leases: DataFrame) -> DataFrame:
    """(src, dst): the agent of an intent waits for the holder of its node."""
    return intents.join(leases, "node_id").where("agent <> holder").select(F.col("agent").alias("src"), F.col("holder").alias("dst")).distinct()


def queue_position(queue: DataFrame) -> DataFrame:
    """(id, node, agent, priority) with a 0-based position by priority, then arrival. A long queue is many tasks."""
    return ranked(queue, ["node"], [F.col("priority").desc(), F.col("id")], "position").withColumn("position", (F.col("position") - 1).cast("long"))


def best_position(requests: DataFrame, positions: DataFrame) -> DataFrame:
    """(agent, best): the least position of an agent in the queues of the nodes it asks for; 0 where it is in none."""
    own = positions.select("node", "agent", "position")
    return requests.select("agent", "node").join(own, ["node", "agent"], "left").groupBy("agent").agg(F.min(F.coalesce("position", F.lit(0).cast("long"))).alias("best"))


def cycle_victim(members: DataFrame) -> DataFrame:
    """(cycle, victim) of (cycle, agent, priority): the least priority, of equals the smallest agent."""
    return members.groupBy("cycle").agg(F.min(F.struct("priority", "agent")).alias("m")).select("cycle", F.col("m.agent").alias("victim"))


def cascade_progress(required: DataFrame, completed: DataFrame) -> DataFrame:
    """(cascade, n_required, n_done, complete): complete when all required nodes are done."""
    done = completed.select("cascade", "node_id").distinct().withColumn("done", F.lit(True))
    marked = required.select("cascade", "node_id").distinct().join(done, ["cascade", "node_id"], "left")
    n_done = F.count_if(F.col("done").isNotNull())
    return marked.groupBy("cascade").agg(F.count("*").alias("n_required"), n_done.alias("n_done"), (n_done == F.count("*")).alias("complete"))


def agent_release_fanout(log: DataFrame) -> DataFrame:
    """Adds a release on every resource that an agent ever asked for when it stops. log: (resource, sec, event_id, agent, op)."""
    held = log.where("op = 'acquire'").select("agent", "resource").distinct()
    stops = log.where("op = 'stop'").select("sec", "event_id", "agent").join(held, "agent")
    return log.where("op <> 'stop'").unionByName(stops.select("resource", "sec", "event_id", "agent", F.lit("release").alias("op")))


def session_release_fanout(log: DataFrame) -> DataFrame:
    """Adds a release of every lease that any agent of a session ever asked for when the session ends (op 'end').

    log: (session, resource, sec, event_id, agent, op); the result has no session.
    """
    held = log.where("op = 'acquire'").select("session", "agent", "resource").distinct()
    ends = log.where("op = 'end'").select("session", "sec", "event_id").join(held, "session")
    return log.where("op <> 'end'").drop("session").unionByName(ends.select("resource", "sec", "event_id", "agent", F.lit("release").alias("op")))


def victim_release_fanout(log: DataFrame, victims: DataFrame) -> DataFrame:
    """Adds a release of every lease that a victim ever asked for when it is wounded, and its own ask again after that.

    log: (resource, sec, event_id, agent, op); victims: (agent, sec, event_id),
    when a cycle's victim was chosen. The asks ('intent') that it had before are
    put at the end of their queues: each comes again with the wound's event.
    """
    wound = victims.select("agent", F.col("sec").alias("at"), F.col("event_id").alias("wound"))
    before = F.expr("sec < at or (sec = at and event_id < wound)")
    own = log.where("op in ('acquire', 'intent')").join(wound, "agent").where(before).select("resource", "agent", "op", "at", "wound").distinct()
    op = F.when(F.col("op") == "acquire", "release").otherwise("intent")
    return log.unionByName(own.select("resource", F.col("at").alias("sec"), F.col("wound").alias("event_id"), "agent", op.alias("op")))


def outcome(op: str | None, agent, sec: int | None, holder, expires: int, ttl: int, eager: bool) -> tuple[str, object, int]:
    """What one event does to a lease: the outcome, then the holder and expiry. Events without agent, time or op do nothing."""
    if op is None or agent is None or sec is None:
        return "noop", holder, expires
    late = holder is not None and expires < sec
    if op == "acquire":
        if holder is None or late:
            return ("grant_after_expiry" if late else "grant"), agent, sec + ttl
        return ("reenter", agent, sec + ttl) if holder == agent else ("block", holder, expires)
    if op in ("release", "failure") and holder == agent and not (eager and late):
        return "release", None, 0
    return "noop", holder, expires


def lease_replay(log: DataFrame, ttl: int, evict: str = "eager") -> DataFrame:
    """(resource, sec, event_id, agent, op, outcome): each event of a lease log and what came of it.

    Events of a resource pass through one task in (sec, event_id) order, as each
    depends on the one before; only the holder and the expiry are held, and Spark
    spills the sort. A null resource is one resource. evict="eager": past its
    expiry a lease is not held, so its holder's release does nothing; "lazy": it
    still counts.
    """
    names = ["resource", "sec", "event_id", "agent", "op"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, holder, expires = (), None, 0
        for batch in batches:
            out = []
            for resource, sec, agent, op in zip(*(batch.column(x).to_pylist() for x in ("resource", "sec", "agent", "op")), strict=True):
                if (key := comparable((resource,))) != now:
                    now, holder, expires = key, None, 0
                what, holder, expires = outcome(op, agent, sec, holder, expires, ttl, evict == "eager")
                out.append(what)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(out, pa.string())], [*names, "outcome"])

    rows = shipped(log).select(*names).repartition("resource").sortWithinPartitions("resource", "sec", "event_id")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("outcome", T.StringType())]))


def lease_replay_fanout(log: DataFrame, ttl: int, ends: str = "end", evict: str = "eager", width: int | None = None) -> DataFrame:
    """As ``lease_replay(session_release_fanout(log), ttl, evict)``, with the releases of a session's end added after the replay.

    log: (session, resource, sec, event_id, agent, op), sec and event_id whole
    numbers. There are as many releases as ends times leases that their session
    ever asked for, and of an end and a resource at most one does anything. So
    only the log's own events are replayed: an acquire knows the next end of its
    session, found as of in pieces of ``width`` seconds (a TTL), which frees the
    lease if the agent still has it. The other releases are made by
    ``quiet_releases`` and are neither shuffled nor sorted. Where an agent asked
    for a resource in several sessions, its releases are replayed one by one.
    """
    width, eager = width or max(1, ttl), evict == "eager"
    names, pair = ["resource", "sec", "event_id", "agent", "op"], ["agent", "resource"]
    same = [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in pair]
    other = lambda x: x.withColumnsRenamed({y: f"_{y}" for y in pair})
    closing = ranked(log.where((F.col("op") == ends) & F.col("session").isNotNull()).select("session", "sec", "event_id"), ["session"], [F.col("sec"), F.col("event_id")], "nth")
    closing = written(closing, "ends")
    asked = log.where("op = 'acquire'").select("session", *pair)
    single = (F.min("session") == F.max("session")) & (F.count("session") == F.count("*"))
    held = written(asked.groupBy(*pair).agg(F.min("session").alias("session"), single.alias("single")).where("session is not null"), "held")

    own = log.where(F.col("op") != ends)
    waits = F.coalesce(F.expr("op = 'acquire' and session is not null and sec is not null"), F.lit(False))
    nothing = F.lit(None).cast("long")
    marks = closing.where("sec is not null").select("session", *(F.lit(None).cast(log.schema[x].dataType).alias(x) if x in pair else F.lit(ends).alias(x) if x == "op" else F.col(x) for x in names), "nth")
    timed = own.where(waits).select("session", *names, nothing.alias("nth")).unionByName(marks)
    back = {"_sec": F.bitwise_not("sec"), "_id": F.coalesce(F.bitwise_not("event_id"), F.lit(2**63 - 1))}  # backwards: the last before is the next
    timed = last_before(timed.withColumns(back), ["session"], "_sec", [*back], F.when(F.col("nth").isNotNull(), F.struct("sec", "event_id", "nth")), width, "next")
    rows = timed.where("nth is null").select(*names, F.col("next.sec").alias("end_sec"), F.col("next.event_id").alias("end_id"), F.col("next.nth").alias("end_nth"), "session")
    never = [F.lit(None).cast(rows.schema[x].dataType).alias(x) for x in ("end_sec", "end_id", "end_nth", "session")]
    rows = rows.unionByName(own.where(~waits).select(*names, *never))
    several = other(held.where("not single").select(*pair))
    if not several.isEmpty():
        sessions = asked.where("session is not null").distinct().join(several, same, "left_semi")
        rows = rows.unionByName(closing.join(sessions, "session").select(*(F.lit("release").alias(x) if x == "op" else x for x in names), *never))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, resource, holder, expires, end, freed = (), None, None, 0, None, []
        first = float("-inf")

        def close() -> None:
            nonlocal holder, end
            if not (eager and expires < end[0]):
                freed.append((resource, end[0], end[1], holder, "release", end[2], end[3], "release"))
                holder = None
            end = None

        def released(schema: pa.Schema) -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in freed], t) for i, t in enumerate([*(schema.field(x).type for x in names), pa.int64(), schema.field("session").type, pa.string()])], [*names, "end_nth", "session", "outcome"])
            freed.clear()
            return out

        schema = None
        for batch in batches:
            out, schema = [], batch.schema
            for key, sec, event_id, agent, op, *at in zip(*(batch.column(x).to_pylist() for x in (*names, "end_sec", "end_id", "end_nth", "session")), strict=True):
                if (own_key := comparable((key,))) != now:
                    if end:
                        close()
                    now, resource, holder, expires, end = own_key, key, None, 0, None
                if end and sec is not None and (end[0], first if end[1] is None else end[1]) < (sec, first if event_id is None else event_id):
                    close()
                what, holder, expires = outcome(op, agent, sec, holder, expires, ttl, eager)
                if what in ("grant", "grant_after_expiry", "reenter"):
                    end = None if at[2] is None else at
                elif holder is None:
                    end = None
                out.append(what)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.nulls(len(out), pa.int64()), pa.nulls(len(out), schema.field("session").type), pa.array(out, pa.string())], [*names, "end_nth", "session", "outcome"])
            if freed:
                yield released(schema)
        if end:
            close()
        if freed:
            yield released(schema)

    dealt = shipped(rows).repartition("resource").sortWithinPartitions("resource", "sec", "event_id")
    fields = [T.StructField(x.name, x.dataType) for x in dealt.select(*names).schema.fields]
    fields += [T.StructField("end_nth", T.LongType()), T.StructField("session", dealt.schema["session"].dataType), T.StructField("outcome", T.StringType())]
    replayed = written(dealt.mapInArrow(run, T.StructType(fields)), "replayed")
    freed = replayed.where("end_nth is not null").select("session", *pair, F.col("end_nth").alias("nth"))
    quiet = quiet_releases(held.where("single").select("session", *pair), closing, freed)
    added = quiet.select(*(F.lit("release").alias(x) if x == "op" else x for x in names), F.lit("noop").alias("outcome"))
    return replayed.select(*names, "outcome").unionByName(added)


def quiet_releases(leases: DataFrame, closing: DataFrame, freed: DataFrame) -> DataFrame:
    """(agent, resource, sec, event_id): each lease at each end of its session, but for those freed there.

    leases: (session, agent, resource), all different; closing: (session, sec,
    event_id, nth), the ends of a session numbered from 1; freed: (session, agent,
    resource, nth). The result is a product, but what is shuffled grows with the
    leases and the ends only. Leases go in pieces of agents of one resource, once
    each (those freed: once for each stretch of ends in between), and meet blocks
    of ends within their task, by broadcast. Beyond BROADCAST_ENDS slices of ends
    are shuffled, a copy for as many leases as the slice has ends.
    """
    pair = ["agent", "resource"]
    block = F.floor((F.col("nth") - 1) / END_BLOCK)
    counts = leases.groupBy("session").agg(F.count("*").alias("n_leases")).join(closing.groupBy("session").agg(F.count("*").alias("n_ends")), "session")
    total, most = counts.agg(F.sum(F.col("n_leases") * F.col("n_ends")), F.max("n_ends")).first()
    crowds = leases.groupBy("session", "resource").agg(F.ceil(F.count("*") / AGENTS).alias("pieces"))
    n_pieces, n_crowds = crowds.agg(F.sum("pieces"), F.count_if(F.col("pieces") > 1)).first()
    stopped = freed.select("session", *pair).distinct()
    n_ends, n_stopped = closing.count(), stopped.count()
    few = n_ends <= BROADCAST_ENDS
    near = lambda x, n=n_ends: F.broadcast(x) if n <= BROADCAST_ENDS else x

    parts = int(min(20_000, max(1, (total or 0) // RELEASES)))
    blocks = -(-(most or 1) // END_BLOCK)
    width = max(1, blocks // -(-min(parts, SPREAD) // (n_pieces or 1)))  # blocks of a slice: few pieces go to more tasks
    width = width if few else min(width, max(1, END_SLICE // END_BLOCK))
    parts = min(parts, (n_pieces or 1) * -(-blocks // width))
    slice_of = lambda nth: F.floor((nth - 1) / (width * END_BLOCK))

    # stretches of ends at which a lease is not freed
    same = [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in ("session", *pair)]
    whole = leases.join(near(stopped.withColumnsRenamed({x: f"_{x}" for x in ("session", *pair)}), n_stopped), same, "left_anti").join(near(counts), "session")
    whole = whole.withColumns({"first": F.lit(1).cast("long"), "last": F.col("n_ends")})
    until = freed.select("session", *pair, "nth").unionByName(stopped.join(near(counts), "session").select("session", *pair, (F.col("n_ends") + 1).alias("nth")))
    before = F.lag("nth").over(Window.partitionBy("session", *pair).orderBy("nth"))
    between = until.select("session", *pair, (F.coalesce(before, F.lit(0)) + 1).alias("first"), (F.col("nth") - 1).alias("last")).where("first <= last").join(near(counts), "session")

    crowds = crowds.where("pieces > 1").select(F.col("session").alias("_session"), F.col("resource").alias("_resource"), "pieces")
    rows = whole.unionByName(between).join(near(crowds, n_crowds), (F.col("session") == F.col("_session")) & F.col("resource").eqNullSafe(F.col("_resource")), "left")
    rows = rows.withColumns({"piece": F.pmod(F.xxhash64("agent"), F.coalesce("pieces", F.lit(1))), "slice": F.explode(F.sequence(slice_of(F.col("first")), slice_of(F.col("last"))))})
    n = F.least(F.lit(width * END_BLOCK), F.col("n_ends") - F.col("slice") * width * END_BLOCK)  # ends of the slice
    copies = F.greatest(F.lit(1), F.least(F.floor(F.col("n_leases") * n / RELEASES), F.floor(F.col("n_leases") / n)))
    key = ["session", "resource", "piece", "first", "last", "slice"]
    pieces = rows.withColumn("copies", copies).repartition(parts, *key).groupBy(*key).agg(F.collect_list("agent").alias("agents"), F.bool_or(F.col("agent").isNull()).alias("nobody"), F.max("copies").alias("copies"))
    nobody = F.when(F.col("nobody"), F.array(F.lit(None).cast(leases.schema["agent"].dataType))).otherwise(F.array().cast(pieces.schema["agents"].dataType))
    pieces = pieces.withColumn("agents", F.concat("agents", nobody))
    ends = closing.groupBy("session", slice_of(F.col("nth")).alias("slice"), block.alias("block")).agg(F.collect_list(F.struct("sec", "event_id", "nth")).alias("ends"))
    if few:
        by, dealt = ["session", "slice"], F.broadcast(ends)
    else:
        by = ["session", "slice", "copy"]
        dealt = ends.join(counts, "session").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).select(*by, "block", "ends").repartition(parts, *by)
        pieces = pieces.withColumn("copy", F.pmod(F.xxhash64("resource", "piece"), "copies")).repartition(parts, *by)
    met = pieces.join(dealt, by).where((F.col("block") * END_BLOCK < F.col("last")) & ((F.col("block") + 1) * END_BLOCK >= F.col("first")))
    # Spark holds what one row becomes within a stage of generated code: the filter has no such code, so that it is one piece and block
    met = met.select("resource", "agents", F.filter("ends", lambda x: (x["nth"] >= F.col("first")) & (x["nth"] <= F.col("last"))).alias("ends"))
    return met.select("resource", "agents", F.inline("ends")).select("resource", "sec", "event_id", F.explode("agents").alias("agent"))


def lease_replay_split(log: DataFrame, ttl: int, evict: str = "eager", width: int | None = None) -> DataFrame:
    """As ``lease_replay``, with the log of a resource in parts, so that a hot resource is many tasks.

    An acquire more than the TTL after the last one before it meets no live
    lease, whatever came before: with it a part begins, and the lease after it is
    known. Parts are replayed on their own. Only the first outcome of a part asks
    for the one before: whether an expired lease was still there. ``width``:
    seconds to a piece of the as-of steps (16 TTLs). A resource whose lease is
    asked for again and again within the TTL is one part, as each outcome then
    depends on the one before.
    """
    width, order = width or 16 * max(1, ttl), ["sec", "event_id"]
    names = ["resource", "sec", "event_id", "agent", "op"]
    whole = F.expr("sec is not null and agent is not null and op is not null")
    noop = log.select(*names).where(~whole).withColumn("outcome", F.lit("noop"))
    rows = last_before(log.select(*names).where(whole), ["resource"], "sec", order, F.when(F.col("op") == "acquire", F.col("sec")), width, "acquired")
    rows = rows.withColumn("begins", (F.col("op") == "acquire") & (F.col("acquired").isNull() | (F.col("sec") - F.col("acquired") > ttl)))
    rows = last_before(rows, ["resource"], "sec", order, F.when(F.col("begins"), F.struct(*order)), width, "part", inclusive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, holder, expires = (), None, 0
        for batch in batches:
            out, held = [], []
            for resource, part, sec, agent, op in zip(*(batch.column(x).to_pylist() for x in ("resource", "part", "sec", "agent", "op")), strict=True):
                if (key := comparable((resource, *(part or {}).values()))) != now:
                    now, holder, expires = key, None, 0
                what, holder, expires = outcome(op, agent, sec, holder, expires, ttl, evict == "eager")
                out.append(what)
                held.append(holder is not None)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in (*names, "begins")), pa.array(out, pa.string()), pa.array(held, pa.bool_())], [*names, "begins", "outcome", "held"])

    dealt = shipped(rows).select(*names, "begins", "part").repartition("resource", "part").sortWithinPartitions("resource", "part", *order)
    fields = [x for x in dealt.schema.fields if x.name != "part"]
    replayed = dealt.mapInArrow(run, T.StructType([*fields, T.StructField("outcome", T.StringType()), T.StructField("held", T.BooleanType())]))
    replayed = last_before(written(replayed, "replayed"), ["resource"], "sec", order, F.col("held"), width, "before")
    fixed = F.when(F.col("begins") & F.coalesce("before", F.lit(False)), "grant_after_expiry").otherwise(F.col("outcome"))
    return replayed.select(*names, fixed.alias("outcome")).unionAll(noop)


def change_to_block_gap(log: DataFrame, key: str, change: str, blocked: str, width: int = 86_400) -> DataFrame:
    """For each blocked event the seconds since the last change of its key. log: (key, sec, event_id, kind).

    An as-of join in pieces of ``width`` seconds, so that a hot key is many tasks.
    """
    rows = last_before(log, [key], "sec", ["sec", "event_id"], F.when(F.col("kind") == change, F.col("sec")), width, "changed_at")
    return rows.where(F.col("kind") == blocked).select(key, "event_id", (F.col("sec") - F.col("changed_at")).alias("gap"))
