"""Repair of conversations' structure at least cost, by a recursive DuckDB query inside hash-partitioned batches.

A repaired conversation's roles read `(s?(ua)+)?` by their initials. Four states of this grammar, edits
with costs, and a recursive query that advances one turn of every conversation of a batch at a time and
keeps for each state the least cost and, among equal ones, the ASCII-least string of edits.

Spark deals conversations out by conv_id and sorts each by turn (nulls first), then role, then text. A
batch is a few MB of that order. A conversation that a batch's end cuts is taken up by the next one: for
each state there go along its cost, its edits and a running SHA-256 of the text repaired so far, so no
conversation is ever held whole. Its text is hashed in order, which is what ties a conversation to one
task.

Special cases. Nulls in role and text are one space, which makes such a text blank and such a role one
that can't be kept; null ids are one conversation; null turns come first and don't count in gaps. Rows of
equal turns, repeated rows too, are kept and ordered by role and text. A conversation whose rows are all
dropped has zeros, no edits and the hash of an empty string. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.shared import lean, trim

# Costs of the edits, and the characters that count as white space and as an end.
RENAME, DELETE, INSERT, UNENDED = 3, 4, 3, 3
SPACE, END = r"\x20\x09-\x0D", ".!?"

#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a (0 and 3 may end). From each one goes one of u and a.
KEEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
NEXT = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
ROLE = {"u": "user", "a": "assistant"}
#: Edits that end a conversation in each state.
CLOSING = {0: "", 1: "II", 2: "I", 3: ""}


def _moves() -> list[tuple]:
    """(state before, letter, initial that is needed or None, state after, cost, edits) of one row, up to two insertions before it: more would only come round to the same state."""
    out = []
    for before in range(4):
        state, edits, cost = before, "", 0
        for _ in range(3):
            out.append((before, "D", None, state, cost + DELETE, edits + "D"))
            out.append((before, "R", None, NEXT[state][1], cost + RENAME, edits + "R"))
            out += [(before, "K", initial, after, cost, edits + "K") for (s, initial), after in KEEPS.items() if s == state]
            state, edits, cost = NEXT[state][1], edits + "I", cost + INSERT
    return out


_CHEAPEST = f"""
WITH RECURSIVE best(piece, begun, state, i, cost, audit) USING KEY (piece, begun, state) AS (
  SELECT piece, begun, begun, 0, 0::BIGINT, '' FROM starts
  UNION ALL
  SELECT piece, begun, state, i, least.cost, least.audit FROM (
    SELECT b.piece, b.begun, m.after AS state, r.i, min({{'cost': b.cost + m.cost + CASE WHEN m.letter <> 'D' AND r.unended THEN {UNENDED} ELSE 0 END, 'audit': b.audit || m.edits}}) AS least
    FROM best b JOIN turns r ON r.piece = b.piece AND r.i = b.i + 1
    JOIN moves m ON m.before = b.state AND (m.letter = 'D' OR NOT r.goes) AND (m.initial IS NULL OR m.initial = r.initial)
    GROUP BY b.piece, b.begun, m.after, r.i
  )
)
SELECT b.piece, b.begun, b.state, b.cost, b.audit FROM best b JOIN starts s USING (piece, begun) WHERE b.i = s.n
"""


@dataclass
class State:
    """The cheapest way into a grammar state: its cost, its edits, and the hash of what it has written."""

    cost: int = 0
    audit: str = ""
    hasher: object = field(default_factory=hashlib.sha256)
    any: bool = False

    def after(self, begun: int, cost: int, edits: str, roles: list[str], texts: list[str]) -> State:
        """Further edits over further rows, from grammar state `begun`."""
        new = State(self.cost + cost, self.audit + edits, self.hasher.copy(), self.any)
        state, at = begun, 0
        for edit in edits:
            initial, following = NEXT[state]
            if edit == "D":
                at += 1
            elif edit == "I":
                state = following
                new._write(ROLE[initial], "")
            else:
                role = roles[at] if edit == "K" else ROLE[initial]
                state = KEEPS[state, role[0]] if edit == "K" else following
                new._write(role, texts[at])
                at += 1
        return new

    def _write(self, role: str, text: str) -> None:
        self.hasher.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True


class Ongoing:
    """A conversation as far as its rows have come."""

    def __init__(self, conv):
        self.conv = conv
        self.states = {0: State()}
        self.counts = np.zeros(5, np.int64)  # gaps' distinct turns, blank, duplicate, truncated, illegal
        self.first = self.last = None

    def count(self, counts: np.ndarray, turns: list) -> None:
        self.counts += counts
        known = [t for t in turns if t is not None]
        if known:
            self.first = known[0] if self.first is None else self.first
            self.last = known[-1]

    def row(self) -> dict:
        ends = []
        for state, way in self.states.items():
            edits = CLOSING[state]
            ends.append((way.cost + INSERT * len(edits), way.audit + edits, state, edits, way))
        cost, audit, state, edits, way = min(ends, key=lambda e: e[:2])
        gaps = 0 if self.first is None else self.last - self.first + 1 - int(self.counts[0])
        return {"conv_id": self.conv, "gaps": gaps, **dict(zip(("blank", "duplicate", "truncated", "illegal"), self.counts[1:].tolist(), strict=True)), "cost": cost, "audit": audit, "repaired_sha256": way.after(state, 0, edits, [], []).hasher.hexdigest()}


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_ARROW = pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in (c.split()[0] for c in RESULT.split(", "))])


def _cheapest(con, starts: dict, turns: dict) -> dict[int, list[tuple]]:
    """By piece: (state before, state after, cost, edits) of the cheapest ways through its rows."""
    con.register("starts", pa.table(starts))
    con.register("turns", pa.table(turns))
    found: dict[int, list[tuple]] = {}
    for piece, *way in con.execute(_CHEAPEST).fetchall():
        found.setdefault(piece, []).append(tuple(way))
    return found


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB"})
    con.execute("CREATE TABLE moves (before INT, letter VARCHAR, initial VARCHAR, after INT, cost BIGINT, edits VARCHAR)")
    con.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?, ?)", _moves())
    going: Ongoing | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        column = {n: batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "initial")}
        flag = {n: np.asarray(batch.column(n).to_numpy(zero_copy_only=False), np.int64) for n in ("present", "new_turn", "blank", "duplicate", "truncated", "illegal")}
        convs = column["conv_id"]
        edges = [0, *(i for i in range(1, len(convs)) if convs[i] != convs[i - 1]), len(convs)]
        pieces = []
        done = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if going is None or going.conv != convs[a]:
                if going is not None:
                    done.append(going)
                going = Ongoing(convs[a])
            # rows that the damage left come before those that it dropped
            pieces.append((going, a, a + int(flag["present"][a:b].sum())))
        starts = {"piece": [], "begun": [], "n": []}
        for k, (conv, a, b) in enumerate(pieces):
            for state in conv.states:
                starts["piece"].append(k)
                starts["begun"].append(state)
                starts["n"].append(b - a)
        spots = np.concatenate([np.arange(a, b) for _, a, b in pieces])
        turns = {
            "piece": np.repeat(np.arange(len(pieces)), [b - a for _, a, b in pieces]), "i": np.concatenate([np.arange(1, b - a + 1) for _, a, b in pieces]),
            "initial": pa.array([column["initial"][i] for i in spots], pa.string()), "goes": (flag["blank"] | flag["duplicate"])[spots].astype(bool), "unended": flag["truncated"][spots].astype(bool),
        }
        ways = _cheapest(con, starts, turns)
        for k, (conv, a, b) in enumerate(pieces):
            conv.count(np.array([flag[n][a:b].sum() for n in ("new_turn", "blank", "duplicate", "truncated", "illegal")]), column["turn"][a:b])
            into: dict[int, tuple] = {}
            for begun, state, cost, edits in ways[k]:
                way = (conv.states[begun].cost + cost, conv.states[begun].audit + edits, begun, cost, edits)
                into[state] = min(into.get(state, way), way)
            conv.states = {state: conv.states[begun].after(begun, cost, edits, column["role"][a:b], column["text"][a:b]) for state, (_, _, begun, cost, edits) in into.items()}
        if done:
            yield pa.RecordBatch.from_pylist([c.row() for c in done], schema=_ARROW)
    if going is not None:
        yield pa.RecordBatch.from_pylist([going.row()], schema=_ARROW)
    con.close()
    trim()


def repair(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """One row for each conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    turns: conv_id, turn, role and text are read. Rows that are not present count for nothing but that
    their conversation is answered. See the module's special cases.
    """
    lean(turns.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), (F.lit(True) if present is None else present).alias("present"))
    # One exchange: what is dealt out by conv_id is also grouped by conv_id and anything else
    dealt = rows.repartition("conv_id")
    place = [F.asc_nulls_first("turn"), F.col("role"), F.col("text"), F.col("time")]
    same = Window.partitionBy("conv_id", "present", "role", "text").orderBy(F.asc_nulls_first("turn"))
    order = Window.partitionBy("conv_id", "present").orderBy(*place)
    stripped = F.regexp_extract("text", f"([^{SPACE}])[{SPACE}]*\\z", 1)
    seen = dealt.withColumn("time", F.row_number().over(same)).withColumns({"end": stripped, "initial": F.substring("role", 1, 1)})
    blank = F.col("end") == ""
    fault = F.when(~F.col("present"), "").when(blank, "blank").when(F.col("time") > 1, "duplicate").when(~F.col("end").isin(*END), "truncated").otherwise("")
    before = F.lag("initial").over(order)
    flags = seen.select(
        "conv_id", "turn", "role", "text", "initial", "present", "time",
        (F.col("present") & F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(order))).alias("new_turn"),
        *((fault == kind).alias(kind) for kind in ("blank", "duplicate", "truncated")),
        (F.col("present") & before.isNotNull() & ~F.concat(before, "initial").isin("su", "ua", "au")).alias("illegal"),
    )
    return flags.sortWithinPartitions("conv_id", F.desc("present"), *place).mapInArrow(_repair, RESULT)


def damaged(turns: DataFrame) -> DataFrame:
    """turns with faults by crc32 of `conv_id:turn` modulo 20, and the mark `present`: 0 drops a row, 1 empties its text, 2 takes ends out of it, 3 repeats it, 4 makes its role user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    return rows.withColumn("kind", kind).select(
        "conv_id", "turn", (F.col("kind") != 0).alias("present"), F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", f"[{re.escape(END)}]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")
