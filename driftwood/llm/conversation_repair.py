"""Repair of damaged conversations: cheapest edits, and of these the least audit.

An automaton accepts the role initials (s?(ua)+)?. Its states are the start,
after s, after u and after a; in each of them there is at most one initial that
an inserted or re-roled turn may have. A dynamic program over (row, state), from
the last row back, gives the cost to go; arcs that keep it are optimal.

The audit of a path is the string of its edits' initials. Nodes are the optimal
arcs; an arc's rank orders the least audits that begin with it. Ranks are found
by prefix doubling: the rank by 2d edits is that of the pair (rank by d edits,
rank by d edits of the arc d edits further on), where pointers that skip 1, 2,
4 ... edits are composed. The arcs out of a node have different initials, so the
least arc of each node is known from the first rank on and the pointers from it.
From the start, the arcs at 0, 1, 2, 3 ... edits follow from the doubled pointers.

A conversation streams through its task twice, sorted by Spark: backward for the
costs to go, which each row keeps, and forward in blocks of bounded size for
ranks, audit and digest. Only the audit is held, one character for each edit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwood.sources.workspace import shipped

#: Costs of the edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, S, U, A = range(4)
#: The state after a role initial is taken in a state, and the initial that a new turn of a state has.
STEP = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
WANTED = {START: "u", S: "u", U: "a", A: "u"}
ROLE = {"u": "user", "a": "assistant"}
#: Rows of a conversation whose arcs are ranked together.
BLOCK = 16_384
NEVER = 1 << 40
BLANK, DUPLICATE, TRUNCATED_FAULT = 1, 2, 3


def fault_of(text, again):
    """The first fault of a row's text; ``again``: its role and text came before."""
    bare = F.rtrim(text, F.lit(" \t\n\x0b\x0c\r"))
    last = F.substring(bare, -1, 1)
    return F.when(bare == "", BLANK).when(again, DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED_FAULT).otherwise(0)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copy of rows after damage; a dropped row keeps conv_id and has a null copy.

    The damage follows from crc32(conv_id:turn) % 20; nulls are one space there, and in role and text.
    """
    space = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 0, F.array(F.lit(None).cast("int"))).when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def row_costs(initial: str, fault: int) -> list[list[tuple[str, int, int]]]:
    """For every state the arcs (edit, cost, next state) that take one row."""
    extra = TRUNCATED if fault == TRUNCATED_FAULT else 0
    out = []
    for state in range(4):
        arcs = [("D", DELETE, state)]
        if fault not in (BLANK, DUPLICATE):
            if (state, initial) in STEP:
                arcs.append(("K", extra, STEP[state, initial]))
            arcs.append(("R", REROLE + extra, STEP[state, WANTED[state]]))
        out.append(arcs)
    return out


def through_inserts(togo: list[int]) -> list[int]:
    """Costs to go of the states when turns may be inserted first."""
    out = list(togo)
    for _ in range(3):
        for state in range(4):
            out[state] = min(out[state], INSERT + out[STEP[state, WANTED[state]]])
    return out


#: Costs to go after the last row.
END = through_inserts([0, NEVER, NEVER, 0])


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each row, which come last first, the costs to go after it."""
    now, begun, togo = None, False, END
    arcs_of: dict[tuple[str, int], list] = {}
    for batch in batches:
        found = []
        for conv, copy, initial, fault in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "copy", "initial", "fault")), strict=True):
            if not begun or conv != now:
                now, begun, togo = conv, True, END
            found.append(togo)
            if copy is not None:
                key = (initial, fault)
                if key not in arcs_of:
                    arcs_of[key] = row_costs(*key)
                togo = through_inserts([min(cost + togo[to] for _, cost, to in arcs) for arcs in arcs_of[key]])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * 4, pa.int32()), pa.array(np.array(found, np.int64).ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "togo"])


def optimal_arcs(initials: list[str], faults: list[int], togo: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Optimal arcs of a block of rows as (node, edit, next node). A node is 4 * row + state; togo[i]: costs to go after row i.

    Nodes after the last row of a block that is not ``last`` have no arcs: the next block goes on from there.
    """
    n = len(initials)
    cost = np.full((n + 1, 4), NEVER)
    cost[1:] = togo
    arcs_of = {key: row_costs(*key) for key in set(zip(initials, faults, strict=True))}
    if n:
        cost[0] = through_inserts([min(c + togo[0][to] for _, c, to in arcs) for arcs in arcs_of[initials[0], faults[0]]])
    elif last:
        cost[0] = END
    node, edit, after = [], [], []
    kinds = np.array([list(arcs_of).index(x) for x in zip(initials, faults, strict=True)], np.int64)
    for kind, arcs in enumerate(arcs_of.values()):
        rows = np.flatnonzero(kinds == kind)
        for state in range(4):
            for letter, c, to in arcs[state]:
                at = rows[cost[rows, state] == c + cost[rows + 1, to]]
                node.append(4 * at + state)
                edit.append(np.full(len(at), ord(letter)))
                after.append(4 * (at + 1) + to)
    for state in range(4):
        to = STEP[state, WANTED[state]]
        at = np.flatnonzero(cost[: n + bool(last), state] == INSERT + cost[: n + bool(last), to])
        node.append(4 * at + state)
        edit.append(np.full(len(at), ord("I")))
        after.append(4 * at + to)
    return tuple(np.concatenate(x).astype(np.int64) for x in (node, edit, after))


def least_path(node: np.ndarray, edit: np.ndarray, after: np.ndarray, nodes: int, start: int) -> np.ndarray:
    """The arcs, in order, of the path from ``start`` with the least string of edits, found by prefix doubling."""
    m = len(node)
    if not m:
        return np.empty(0, np.int64)
    rank = np.unique(edit, return_inverse=True)[1] + 1
    order = np.lexsort((rank, node))  # of each node the least arc first
    least = np.full(nodes, m)
    least[node[order[::-1]]] = order[::-1]
    skip = np.append(least[after], m)  # the arc one edit further on; m: the path has ended
    rank = np.append(rank, 0)  # a string that ends is less than one that goes on
    pointers = [skip]
    while (pointers[-1] < m).any():
        pair = rank * (rank.max() + 1) + rank[pointers[-1]]
        rank = np.unique(pair, return_inverse=True)[1]
        pointers.append(pointers[-1][pointers[-1]])
    first = np.flatnonzero(node == start)
    if not len(first):
        return np.empty(0, np.int64)
    path = first[[np.argmin(rank[first])]]
    for pointer in pointers:  # 1, 2, 4 ... arcs are known; those as many edits further on follow
        path = np.concatenate([path, pointer[path]])
    return path[path < m]


class _Repair:
    """One conversation, fed row by row."""

    def __init__(self) -> None:
        self.state, self.cost, self.audit, self.sha, self.begun = START, None, [], hashlib.sha256(), False
        self.faults, self.illegal, self.before = [0, 0, 0, 0], 0, None
        self.turns, self.distinct, self.least, self.most = None, 0, None, None
        self.rows: list[dict] = []

    def feed(self, row: dict) -> None:
        self.faults[row["fault"]] += 1
        if self.before is not None and self.before + row["initial"] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = row["initial"]
        turn = row["turn"]
        if turn is not None:
            if self.most is None or turn != self.most:  # sorted
                self.distinct += 1
            self.least = turn if self.least is None else self.least
            self.most = turn
        self.rows.append(row)
        if len(self.rows) >= BLOCK:
            self._apply(last=False)

    def _apply(self, last: bool) -> None:
        initials, faults = [r["initial"] for r in self.rows], [r["fault"] for r in self.rows]
        togo = np.array([r["togo"] for r in self.rows], np.int64).reshape(-1, 4)
        node, edit, after = optimal_arcs(initials, faults, togo, last)
        if self.cost is None:
            row = row_costs(initials[0], faults[0]) if initials else None
            self.cost = through_inserts([min(c + togo[0][to] for _, c, to in arcs) for arcs in row])[START] if row else 0
        path = least_path(node, edit, after, 4 * (len(self.rows) + 1), self.state)
        for letter, at, to in zip(edit[path].tolist(), node[path].tolist(), after[path].tolist(), strict=True):
            letter = chr(letter)
            self.audit.append(letter)
            self.state = to % 4
            if letter != "D":
                row = self.rows[at // 4] if letter != "I" else None
                role = row["role"] if letter == "K" else ROLE[WANTED[at % 4]]
                line = f"{role}:{row['text'] if row else ''}"
                self.sha.update((("\n" if self.begun else "") + line).encode())
                self.begun = True
        self.rows = []

    def row(self, conv: int | None) -> tuple:
        self._apply(last=True)
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        return conv, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


_NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_TYPES = [*[pa.int64()] * 7, pa.string(), pa.string()]


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: list[tuple] = []
    table = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(_TYPES)], _NAMES)
    repair, now = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if repair is None or row["conv_id"] != now:
                if repair:
                    done.append(repair.row(now))
                repair, now = _Repair(), row["conv_id"]
            if row["copy"] is not None:
                repair.feed(row)
        yield table()
        done = []
    if repair:
        done.append(repair.row(now))
    yield table()


def repaired(conversations: DataFrame) -> DataFrame:
    """Faults, cheapest repair and its audit, for each conversation after the planted damage.

    conversations: conv_id bigint, turn bigint, role, text; other columns are
    ignored. Returns a row per conv_id: conv_id, gaps, blank, duplicate,
    truncated, illegal, cost (longs), audit, repaired_sha256. Nulls in role and
    text are one space; rows with a null conv_id are one conversation; a null
    turn comes first and is no turn for the gaps. Rows of equal turn are taken
    by role, then text; repeated rows are rows of their own (all but the first
    are duplicates). A conversation whose rows are all dropped has zeros, an
    empty audit and the digest of the empty string. An empty table gives an
    empty table. A long conversation streams through one task, as its digest
    reads it in sequence; see the module.
    """
    rows = damaged(shipped(conversations)).repartition("conv_id")
    seen = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("copy").isNull(), "turn", "copy")
    rows = rows.withColumn("nth", F.row_number().over(seen))  # tells equal rows apart
    rows = rows.select("conv_id", "turn", "role", "text", "nth", "copy", F.substring("role", 1, 1).alias("initial"), fault_of(F.col("text"), F.col("nth") > 1).alias("fault"))
    schema = "conv_id long, turn long, role string, text string, nth int, copy int, initial string, fault int"
    order = ["turn", "role", "text", "nth"]
    costed = rows.sortWithinPartitions("conv_id", *(F.col(x).desc() for x in order)).mapInArrow(_costs, schema + ", togo array<long>")
    return costed.sortWithinPartitions("conv_id", *order).mapInArrow(_repaired, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
