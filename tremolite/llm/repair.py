"""Conversation structure repair: a generalised LR parser with a graph-structured stack that deletes, reroles and inserts turns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: The grammar of roles: C -> (nothing) | P | s P;  P -> T | P T;  T -> u a. Its LR(0) states are numbered by what stands
#: on top of the stack: 0 nothing, 2 s, 5 u, 8 u a, 4 a first T, 7 a further T, 3 P, 6 P after s.
SHIFT = {0: {"s": 2, "u": 5}, 2: {"u": 5}, 3: {"u": 5}, 6: {"u": 5}, 5: {"a": 8}}
REDUCE = {8: ("T", 2), 4: ("P", 1), 7: ("P", 2)}
GOTO = {(0, "T"): 4, (2, "T"): 4, (3, "T"): 7, (6, "T"): 7, (0, "P"): 3, (2, "P"): 6}
ACCEPT = frozenset({0, 3, 6})
#: States that read the rest of any input alike are one top: P, whether s stands below it or not.
TOP = {0: 0, 2: 2, 3: 3, 5: 5, 6: 3}
ROLE = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

#: Rows of a conversation, and characters of its texts, that are taken as one piece.
PIECE_ROWS, PIECE_CHARS = 4096, 1 << 22

BLANK_OR_COPY = ("blank", "duplicate")
#: Initials of roles that may follow each other.
LEGAL = ("su", "ua", "au")
COUNTS = ("blank", "duplicate", "truncated", "illegal")
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


@dataclass(frozen=True)
class Node:
    """A node of the stack graph: its state, the node below it, and the least (cost, audit) that leads to it."""

    state: int
    below: Node | None
    cost: int = 0
    audit: str = ""


def _read(node: Node, symbol: str, cost: int, letter: str) -> Node | None:
    """The stack after ``symbol`` has been shifted and all that is complete has been reduced; None if it can't be shifted."""
    to = SHIFT[node.state].get(symbol)
    if to is None:
        return None
    cost, audit, top = node.cost + cost, node.audit + letter, Node(to, node)
    while top.state in REDUCE:
        left, n = REDUCE[top.state]
        for _ in range(n):
            top = top.below
        top = Node(GOTO[top.state, left], top)
    return Node(top.state, top.below, cost, audit)


def _merge(tops: dict[int, Node], node: Node | None) -> bool:
    """Puts a node among the stack tops; of equal tops the one with the least (cost, audit) stays."""
    if node is None:
        return False
    old = tops.get(TOP[node.state])
    if old is not None and (old.cost, old.audit) <= (node.cost, node.audit):
        return False
    tops[TOP[node.state]] = node
    return True


def _inserted(tops: dict[int, Node]) -> dict[int, Node]:
    """The tops, and those that inserted turns lead to. Each insertion costs, so this ends."""
    todo = list(tops.values())
    while todo:
        node = todo.pop()
        if tops[TOP[node.state]] is not node:
            continue
        for symbol in SHIFT[node.state]:
            if symbol in ROLE and _merge(tops, new := _read(node, symbol, INSERT, "I")):
                todo.append(new)
    return tops


def step(tops: dict[int, Node], initial: str, fault: str) -> dict[int, Node]:
    """The tops after a row with this role's initial and fault ("" if none)."""
    after: dict[int, Node] = {}
    worse = TRUNCATED if fault == "truncated" else 0
    for node in _inserted(tops).values():
        _merge(after, Node(node.state, node.below, node.cost + DELETE, node.audit + "D"))
        if fault not in BLANK_OR_COPY:
            if initial:
                _merge(after, _read(node, initial, KEEP + worse, "K"))
            for symbol in ROLE:
                _merge(after, _read(node, symbol, REROLE + worse, "R"))
    return after


def start(top: int) -> dict[int, Node]:
    """The stack that a piece of a conversation begins with, by its top."""
    return {top: Node(top, None) if top == 0 else Node(top, Node(0, None))}


def replay(audit: str, top: int, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired turns of a piece that begins at ``top``. What R and I stand for follows from the stack."""
    node = next(iter(start(top).values()))
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        symbol = role[:1] if letter == "K" else next(s for s in ROLE if s in SHIFT[node.state])
        yield (role if letter == "K" else ROLE[symbol]), text
        node = _read(node, symbol, 0, "")


def damaged(df: DataFrame) -> DataFrame:
    """Damages conversations by crc32 of ``conv_id:turn`` modulo 20 (null: one space): 0 drops a row, 1 empties its text,
    2 removes its sentence ends, 3 repeats it, 4 gives it the role user. Null roles and texts are one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    t = df.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), how.alias("how")).filter("how <> 0")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return t.select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("how") == 3, 2).otherwise(1).alias("n"))


def _faulty(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n, fault): equal rows as one with their number n; fault is that of the first of them."""
    # a conversation's text is known by its length and the role's, so that no two (role, text) look alike
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    one = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("said", said)
    nulls_first = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = one.groupBy(F.col("conv_id").alias("c"), F.col("said").alias("s")).agg(F.min(nulls_first).alias("first"))
    both = one.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")), "left")
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\f\r")), F.lit(1))
    fault = F.when(last == "", "blank").when(nulls_first > F.col("first"), "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    return both.select("conv_id", "turn", "role", "text", "n", fault.alias("fault"))


@dataclass
class Piece:
    """A run of a conversation's rows: what is counted in it, and for each top it may begin with the tops it may end with."""

    conv_id: int | None
    tops: dict[int, dict[int, Node]]
    rows: list[tuple[str, str]]
    counts: dict[str, int]
    turns: list[int | None]  # first and last known turn, their number without repeats
    initials: list[str | None]  # of the first and the last row
    chars: int = 0

    @classmethod
    def of(cls, conv_id: int | None, tops: tuple[int, ...]) -> Piece:
        return cls(conv_id, {t: start(t) for t in tops}, [], dict.fromkeys(COUNTS, 0), [None, None, 0], [None, None])

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        initial = role[:1]
        self.rows.append((role, text))
        self.chars += len(text)
        if turn is not None and turn != self.turns[1]:
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn, self.turns[2] + 1]
        if fault:
            self.counts[fault] += 1
        if self.initials[0] is None:
            self.initials[0] = initial
        else:
            self.counts["illegal"] += self.initials[1] + initial not in LEGAL
        self.initials[1] = initial
        self.tops = {t: step(tops, initial, fault) for t, tops in self.tops.items()}


_PATHS = pa.list_(pa.struct([("from", pa.int8()), ("to", pa.int8()), ("cost", pa.int64()), ("audit", pa.string())]))
_ROWS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_PIECE = pa.schema([
    ("conv_id", pa.int64()), ("whole", pa.bool_()), ("gaps", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()),
    ("piece", pa.int64()), ("turns", pa.list_(pa.int64())), ("initials", pa.list_(pa.string())), ("paths", _PATHS), ("rows", _ROWS),
])
_PIECE_DDL = f"""conv_id long, whole boolean, {REPORT}, piece long, turns array<long>, initials array<string>,
    paths array<struct<from:tinyint,to:tinyint,cost:bigint,audit:string>>, rows array<struct<role:string,text:string>>"""


def _best(tops: dict[int, Node]) -> Node:
    """The least node that a conversation may end with."""
    return min((n for n in _inserted(tops).values() if n.state in ACCEPT), key=lambda n: (n.cost, n.audit))


def _gaps(turns: list[int | None]) -> int:
    return turns[1] - turns[0] + 1 - turns[2] if turns[2] else 0


def _line(first: bool, role: str, text: str) -> bytes:
    return ("" if first else "\n").encode() + f"{role}:{text}".encode()


def _done(p: Piece) -> dict:
    """The report of a conversation that is one piece."""
    best, said = _best(dict(p.tops[0])), hashlib.sha256()
    for n, (role, text) in enumerate(replay(best.audit, 0, iter(p.rows))):
        said.update(_line(n == 0, role, text))
    return {"conv_id": p.conv_id, "whole": True, "gaps": _gaps(p.turns), **p.counts, "cost": best.cost, "audit": best.audit, "repaired_sha256": said.hexdigest()}


def _open(p: Piece, number: int) -> dict:
    """A piece of a conversation that may go on elsewhere."""
    paths = [{"from": a, "to": b, "cost": n.cost, "audit": n.audit} for a, tops in p.tops.items() for b, n in tops.items()]
    return {"conv_id": p.conv_id, "whole": False, **p.counts, "piece": number, "turns": p.turns, "initials": p.initials, "paths": paths, "rows": [{"role": r, "text": t} for r, t in p.rows]}


def _pieces(piece_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number, out, size = TaskContext.get().partitionId() << 32, 0, [], 0
        piece, whole = None, False  # whole: the piece holds its conversation from its first row on
        for batch in batches:
            for conv_id, turn, role, text, n, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for copy in range(n):
                    if piece is not None and (conv_id != piece.conv_id or len(piece.rows) >= piece_rows or piece.chars >= PIECE_CHARS):
                        same = conv_id == piece.conv_id
                        out.append(_done(piece) if whole and not same else _open(piece, base + number))
                        size += piece.chars + 64 * len(piece.rows)
                        number += 1
                        piece, whole = None, not same
                        if size >= PIECE_CHARS:
                            yield pa.RecordBatch.from_pylist(out, schema=_PIECE)
                            out, size = [], 0
                    if piece is None:  # only a whole one is known to begin with an empty stack
                        piece = Piece.of(conv_id, (0,) if whole else (0, 2, 3, 5))
                    piece.add(turn, role, text, "duplicate" if copy and fault != "blank" else fault)
        if piece is not None:  # the next task may hold more of it
            out.append(_open(piece, base + number))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_PIECE)

    return run


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one conversation's pieces, in order, the path to take through each: its top at the start, cost and audit."""
    pdf = pdf.sort_values("piece")
    best: dict[int, tuple[int, str]] = {0: (0, "")}
    came: list[dict[int, tuple[int, int, str]]] = []
    for paths in pdf["paths"]:
        after, step_from = {}, {}
        for p in paths:
            if p["from"] in best:
                cost, audit = best[p["from"]]
                new = (cost + p["cost"], audit + p["audit"])
                if p["to"] not in after or new < after[p["to"]]:
                    after[p["to"]], step_from[p["to"]] = new, (p["from"], p["cost"], p["audit"])
        best = after
        came.append(step_from)
    ends = _ends(best)
    top, tail_cost, tail = min(ends, key=lambda e: (best[e[0]][0] + e[1], best[e[0]][1] + e[2]))
    taken = []
    for n in reversed(range(len(came))):
        begin, cost, audit = came[n][top]
        taken.append((begin, cost + (tail_cost if n == len(came) - 1 else 0), audit + (tail if n == len(came) - 1 else "")))
        top = begin
    taken.reverse()
    return pd.DataFrame({"piece": pdf["piece"].to_numpy(), "begin": [t[0] for t in taken], "path_cost": [t[1] for t in taken], "path": [t[2] for t in taken]})


def _ends(tops: dict[int, object]) -> list[tuple[int, int, str]]:
    """(top, cost, audit) of the insertions that end a conversation from each top, least ones."""
    out = []
    for top in tops:
        end = _best(start(top))
        out.append((top, end.cost, end.audit))
    return out


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The report of conversations whose pieces come in order; of one piece at a time the texts are held."""
    schema = pa.schema([_PIECE.field(n) for n in ("conv_id", "gaps", *COUNTS, "cost", "audit", "repaired_sha256")])
    now: dict | None = None

    def report() -> pa.RecordBatch:
        got = {c: now[c] for c in ("conv_id", *COUNTS, "cost")}
        return pa.RecordBatch.from_pylist([got | {"gaps": _gaps(now["turns"]), "audit": "".join(now["audit"]), "repaired_sha256": now["said"].hexdigest()}], schema=schema)

    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            if now is None or now["conv_id"] != r["conv_id"]:
                if now is not None:
                    yield report()
                now = dict.fromkeys((*COUNTS, "cost"), 0) | {"conv_id": r["conv_id"], "turns": [None, None, 0], "last": None, "audit": [], "said": hashlib.sha256(), "lines": 0}
            for c in COUNTS:
                now[c] += r[c]
            now["cost"] += r["path_cost"]
            if now["last"] is not None:
                now["illegal"] += now["last"] + r["initials"][0] not in LEGAL
            now["last"] = r["initials"][1]
            first, end, n = r["turns"]
            if n:
                begun, until, known = now["turns"]
                now["turns"] = [first if begun is None else begun, end, known + n - (until == first)]
            now["audit"].append(r["path"])
            for role, text in replay(r["path"], r["begin"], iter([(x["role"], x["text"]) for x in r["rows"]])):
                now["said"].update(_line(now["lines"] == 0, role, text))
                now["lines"] += 1
    if now is not None:
        yield report()


def repair_structure(rows: DataFrame, conv_ids: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """conv_id and the columns of ``REPORT``: what is wrong with each conversation, its cheapest repair, and the repaired text's hash.

    ``rows`` (conv_id, turn, role, text, n: so many equal ones) in order of turn (nulls first), then role and text; ``conv_ids`` (conv_id) are those to
    report, also those without a row (zeros, empty audit, hash of nothing). A null conv_id is a conversation of its own. No conversation,
    no row. An empty role has no initial and can't be kept.

    Rows are sorted over the whole table and cut into pieces, so that tasks share a long conversation. A conversation that
    lies inside a task's run is repaired there. Of others, each piece gives its cheapest path from any stack top to any; the
    paths of a conversation's pieces (one byte a row and path, no texts) are chained. Its hash is one stream by nature: its
    pieces pass one task in order, one at a time.
    """
    t = _faulty(rows).select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text", F.col("n").cast("int"), "fault")
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    pieces = staged(t.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces(piece_rows), _PIECE_DDL), "pieces")
    columns = [c.split()[0] for c in REPORT.split(", ")]
    some = pieces.filter("NOT whole").drop("whole", "gaps", "cost", "audit", "repaired_sha256")
    paths = some.select("conv_id", "piece", "paths").groupBy("conv_id").applyInPandas(_chain, "piece long, begin int, path_cost long, path string")
    chained = some.drop("paths").join(paths, "piece").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    found = pieces.filter("whole").select("conv_id", *columns).unionByName(chained.mapInArrow(_told, f"conv_id long, {REPORT}"))
    asked = conv_ids.select(F.col("conv_id").cast("long").alias("asked")).distinct()
    zero: dict[str, Column] = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", *COUNTS, "cost")}
    zero |= {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))}
    return asked.join(found, F.col("asked").eqNullSafe(F.col("conv_id")), "left").select(F.col("asked").alias("conv_id"), *[v.alias(c) for c, v in zero.items()])


def repair_report(df: DataFrame) -> DataFrame:
    """``repair_structure`` of the damaged conversations. Repeated rows are rows of their own; other columns aren't read."""
    return repair_structure(damaged(df), df)
