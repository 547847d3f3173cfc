"""Repair of conversation structure by weighted interval parsing.

A well-formed conversation has roles that start with ``s?(ua)+`` (or no turn at all). Each
row is kept, gets another role, or is deleted, and empty turns are inserted, at
least cost; among the cheapest repairs the one whose edits' initials (D, I, K, R)
come first in ASCII order is taken.

The grammar is in Chomsky normal form. A symbol X[p, q] spans rows whose repaired
roles lead from state p to state q of the pattern; its rules are X[p, q] -> X[p, r] X[r, q]
for every r, and X[p, q] -> the edits of one row. A cell holds the least (cost, audit).
Two audits of one span, one symbol and one cost are never prefixes of one another, as what
follows a prefix could only be insertions, which cost; so cells combine by
adding costs and joining audits. Insertions are closed beforehand: each row's cell is
wrapped in the cheapest insertions that lead from state to state. As symbols carry the
state at both ends, every split of a span gives the same cell, so that
spans are combined bottom-up by length with one split each: of 1, 2, 4, ... rows inside a
task, then over the tasks that hold a conversation's ranges. Work is linear in the rows.

Faults are found without texts: repeats by a digest, with equal rows
counted before the shuffle. Rows are dealt by ranges of (conversation, turn), so a
conversation of any length is parsed in many tasks, which hold a byte a row for each cell.
Texts are shuffled once, to write the repaired turns in order; a task streams them. A
conversation's final digest is a chain over its whole text and so the work of
one task, which holds its audit (a byte a row) and one batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize

#: Costs of the edits, and of leaving a truncated row in.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States of the pattern s?(ua)+ : nothing yet, after the system turn, after a user's, after an assistant's.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
FINAL = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: Initials as codes; any other is 0.
INITIALS = "sua"
LEGAL = ("su", "ua", "au")
NOT_SPACE = r"[^\x20\x09-\x0D]"
CUT = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"

Cells = dict[tuple[int, int], tuple[int, str]]


def combine(left: Cells, right: Cells) -> Cells:
    """Cells of a span from those of its two parts."""
    out: Cells = {}
    for (p, r), (cost, audit) in left.items():
        for q in range(4):
            more = right.get((r, q))
            if more is not None:
                new = (cost + more[0], audit + more[1])
                if (p, q) not in out or new < out[p, q]:
                    out[p, q] = new
    return out


def insertions() -> Cells:
    """Cheapest insertions from state to state, none included."""
    once: Cells = {(p, p): (0, "") for p in range(4)}
    once.update({(p, q): (INSERT, "I") for (p, c), q in STEPS.items() if c in ROLES})
    closed = once
    while (more := combine(closed, once)) != closed:
        closed = more
    return closed


def row_cells(kind: int) -> Cells:
    """Cells of one row: 0 must be deleted, else 1 + 2 * initial + truncated."""
    edits: Cells = {(p, p): (DELETE, "D") for p in range(4)}
    if kind:
        initial, cut = divmod(kind - 1, 2)
        for (p, c), q in STEPS.items():
            offers = [(REROLE + TRUNCATED * cut, "R")] if c in ROLES else []
            if initial and c == INITIALS[initial - 1]:
                offers.append((KEEP + TRUNCATED * cut, "K"))
            if offers:
                edits[p, q] = min(offers)
    around = insertions()
    return combine(combine(around, edits), around)


def parse(spans: list[Cells]) -> Cells:
    """Adjacent spans combined in pairs, shortest first, until one is left."""
    while len(spans) > 1:
        pairs = [combine(a, b) for a, b in zip(spans[::2], spans[1::2])]
        spans = pairs + spans[len(pairs) * 2 :]
    return spans[0]


def best(cells: Cells) -> tuple[int, str]:
    return min(cells[0, q] for q in FINAL if (0, q) in cells)


def _initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, fault) of each row, without its text: blank, duplicate, truncated or null."""
    lean = rows.select(
        "conv_id", "turn", "role", F.unhex(F.md5(F.encode("text", "utf-8"))).alias("digest"),
        F.when(~F.col("text").rlike(NOT_SPACE), "blank").when(F.col("text").rlike(CUT), "truncated").alias("own"),
    )
    same = lean.groupBy("conv_id", "role", "digest", "turn").agg(F.first("own").alias("own"), F.count("*").alias("n"))
    same = materialize(same, "turns")
    # a null turn comes first
    first = same.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("k"), F.col("turn").alias("t"))).alias("first"))
    first = first.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "first.t")
    met = same.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d")))
    each = met.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    again = ~F.col("turn").eqNullSafe(F.col("t")) | (F.col("copy") > 1)
    fault = F.when(F.col("own") == "blank", "blank").when(again, "duplicate").otherwise(F.col("own"))
    return each.select("conv_id", "turn", "role", "digest", fault.alias("fault"))


def _pack(cells: Cells) -> list[dict]:
    return [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in cells.items()]


_CELLS = "cells array<struct<p:int,q:int,cost:long,audit:string>>"
_PART = f"conv_id long, part long, head string, tail string, illegal long, {_CELLS}"
_ARROW_PART = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int64()), ("head", pa.string()), ("tail", pa.string()), ("illegal", pa.int64()),
    ("cells", pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))),
])
#: Rows that are parsed, and spans that are kept, before they are combined.
PIECE = 256


class _Span:
    """The rows of one conversation seen so far: counts at the seams and cells by span length."""

    def __init__(self, conv, part: int) -> None:
        self.conv, self.part, self.head, self.tail, self.illegal = conv, part, None, None, 0
        self.open: list[Cells] = []
        self.done: list[tuple[int, Cells]] = []  # (spans of PIECE rows, cells), lengths falling

    def add(self, head: str, tail: str, illegal: int, cells: Cells) -> None:
        if self.tail is None:
            self.head = head
        else:
            self.illegal += self.tail + head not in LEGAL
        self.tail = tail
        self.illegal += illegal
        self.open.append(cells)
        if len(self.open) == PIECE:
            self.done.append((1, parse(self.open)))
            self.open = []
            while len(self.done) > 1 and self.done[-1][0] == self.done[-2][0]:
                n, right = self.done.pop()
                self.done[-1] = (2 * n, combine(self.done[-1][1], right))

    def row(self) -> dict:
        spans = [c for _, c in self.done] + ([parse(self.open)] if self.open else [])
        while len(spans) > 1:  # the shortest are last
            right = spans.pop()
            spans[-1] = combine(spans[-1], right)
        return {"conv_id": self.conv, "part": self.part, "head": self.head, "tail": self.tail, "illegal": self.illegal, "cells": _pack(spans[0])}


def _spans(rows: Iterator[tuple], part: int) -> Iterator[pa.RecordBatch]:
    """One row for each run of a conversation's (conv_id, head, tail, illegal, cells)."""
    now, out = None, []
    for conv, *piece in rows:
        if now is None or now.conv != conv:
            if now:
                out.append(now.row())
            now = _Span(conv, part)
        now.add(*piece)
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW_PART)
            out = []
    if now:
        out.append(now.row())
    yield pa.RecordBatch.from_pylist(out, schema=_ARROW_PART)


def _parse_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [row_cells(k) for k in range(9)]
    rows = ((c, i, i, 0, kinds[k]) for b in batches for c, i, k in zip(*(x.to_pylist() for x in b.columns)))
    return _spans(rows, TaskContext.get().partitionId())


def _join_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (
        (r["conv_id"], r["head"], r["tail"], r["illegal"], {(c["p"], c["q"]): (c["cost"], c["audit"]) for c in r["cells"]})
        for b in batches for one in range(b.num_rows) for r in b.slice(one, 1).to_pylist()
    )
    return _spans(rows, 0)


def audits(found: DataFrame) -> DataFrame:
    """(conv_id, illegal, cost, audit) from the faults of rows."""
    initial = _initial(F.col("role"))
    code = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    must = F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False))
    kind = F.when(must, 0).otherwise(1 + 2 * code + F.coalesce(F.col("fault") == "truncated", F.lit(False)).cast("int"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "digest"]
    rows = found.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", initial.alias("initial"), kind.alias("kind"))
    # written, so that the ranges are the same for whoever reads them
    parts = materialize(rows.mapInArrow(_parse_ranges, _PART), "spans")
    whole = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_join_ranges, _PART)
    ends = F.filter("cells", lambda c: (c["p"] == 0) & c["q"].isin(*FINAL))
    least = F.array_min(F.transform(ends, lambda c: F.struct(c["cost"].alias("cost"), c["audit"].alias("audit"))))
    return whole.select("conv_id", "illegal", least["cost"].alias("cost"), least["audit"].alias("audit"))


def diagnose(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation that has rows.

    ``rows`` has conv_id and turn (whole numbers), role and text. A null conv_id is one
    conversation of its own; null turns come first and count for no gap; a null role or
    text is one space. Rows of one turn are ordered by role, then by the digest of their text;
    of equal rows all but one are duplicates. An empty role fits nowhere. A gap count beyond a
    long is null. An empty table gives an empty one. Other columns are not looked at.
    """
    bound_batches(rows.sparkSession)
    found = materialize(faults(_plain(rows)), "faults")
    turn = F.col("turn").cast("decimal(38,0)")
    gaps = (F.max(turn) - F.min(turn) + 1 - F.count("turn")).try_cast("long")
    turns = found.groupBy("conv_id", "turn").agg(*[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    counts = turns.groupBy("conv_id").agg(
        F.when(F.count("turn") > 0, gaps).otherwise(0).alias("gaps"), *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")]
    )
    parsed = audits(found).withColumnRenamed("conv_id", "_c")
    return counts.join(parsed, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")


def _plain(rows: DataFrame) -> DataFrame:
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), space("role"), space("text"))


REPAIRED = "conv_id long, place long, edit string, turn long, role string, text string"
_ARROW_REPAIRED = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired turns of conversations that come as their audit, then their rows in order."""
    state = {"conv": None, "audit": "", "at": 0, "place": 0, "last": ""}

    def put(out: list, edit: str, turn, role: str | None, text: str) -> None:
        want = "a" if state["last"] == "u" else "u"
        role = ROLES[want] if role is None else role
        out.append((state["conv"], state["place"], edit, turn, role, text))
        state["place"] += 1
        state["last"] = role[:1]

    def inserted(out: list) -> None:
        while state["audit"][state["at"] : state["at"] + 1] == "I":
            put(out, "I", None, None, "")
            state["at"] += 1

    def batch(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, _ARROW_REPAIRED.types)], schema=_ARROW_REPAIRED)

    for b in batches:
        out: list[tuple] = []
        for conv, audit, turn, role, text in zip(*(x.to_pylist() for x in b.columns)):
            if audit is not None:
                inserted(out)
                state.update(conv=conv, audit=audit, at=0, place=0, last="")
                continue
            inserted(out)
            edit = state["audit"][state["at"]]
            state["at"] += 1
            if edit != "D":
                put(out, edit, turn, role if edit == "K" else None, text)
        yield batch(out)
    out = []
    inserted(out)
    yield batch(out)


def repaired(rows: DataFrame, diagnosed: DataFrame) -> DataFrame:
    """The repaired turns: (conv_id, place, edit, turn, role, text), edits K, R or I.

    ``diagnosed`` is what ``diagnose`` gives for the same rows. A conversation's turns come together and in
    order, in one partition; place counts them from 0. Inserted turns have a null turn and an empty text.
    """
    none = F.lit(None)
    heads = diagnosed.select("conv_id", F.lit(0).alias("o"), "audit", none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("text"), none.cast("binary").alias("digest"))
    body = _plain(rows).select("conv_id", F.lit(1).alias("o"), none.cast("string").alias("audit"), "turn", "role", "text", F.unhex(F.md5(F.encode("text", "utf-8"))).alias("digest"))
    order = ["conv_id", "o", F.col("turn").asc_nulls_first(), "role", "digest"]
    both = heads.union(body).repartition("conv_id").sortWithinPartitions(*order)
    return both.select("conv_id", "audit", "turn", "role", "text").mapInArrow(_apply, REPAIRED)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    chain, now, out = None, None, []
    for b in batches:
        for conv, place, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "place", "role", "text"))):
            if place == 0:
                if chain is not None:
                    out.append((now, chain.hexdigest()))
                chain, now = hashlib.sha256(), conv
            chain.update((f"\n{role}:{text}" if place else f"{role}:{text}").encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(schema.types)], schema=schema)
        out = []
    if chain is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([chain.hexdigest()], pa.string())], schema=schema)


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``role:text`` lines, from what ``repaired`` gives, in its order."""
    return turns.mapInArrow(_digest, "conv_id long, repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with one row in four damaged by a checksum of its place: dropped, emptied, cut, repeated, or given to the user."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = _plain(conversations).withColumn("_k", F.crc32(key) % 20).where("_k != 0")
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_k") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("_k") == 3, 2).otherwise(1))).alias("_n"))
    return rows.drop("_n")


def report(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each conv_id of ``conversations``: ``diagnose`` of ``rows`` and the digest of the repaired turns.

    A conversation without rows has zeros, an empty audit and the digest of the empty string.
    """
    found = materialize(diagnose(rows), "diagnosed")
    chains = digests(repaired(rows, found)).withColumnRenamed("conv_id", "_d")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    mine = found.withColumnRenamed("conv_id", "_c")
    out = ids.join(mine, F.col("conv_id").eqNullSafe(F.col("_c")), "left").join(chains, F.col("conv_id").eqNullSafe(F.col("_d")), "left")
    zero = lambda c: F.when(F.col("_c").isNull() & F.col("audit").isNull(), 0).otherwise(F.col(c)).alias(c)
    return out.select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
