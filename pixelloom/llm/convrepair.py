"""Conversation structure repair: the cheapest edits that give each conversation the roles `(s?(ua)+)?`, in linear space.

Rows are taken by turn (nulls first), those of one turn by role and by the SHA-256 of the text. Edits are Keep, Rerole, Delete
and Insert. What has been emitted is one of four states: nothing, after s, after u, after a. From each state at most one role of
user and assistant may follow, so that a string of edit initials fixes the roles it gives.

A *unit* is one row with the inserts before it: for each pair of states its cost, its edits, and, among the units that leave a
state, the order of their edits as strings. Edits of equally many whole units are never proper prefixes of each other, so an
order of the four states after any number of units says which of them has the ASCII-least cheapest edits (`_after`).
`meet` is Hirschberg's divide and conquer over units: the forward cost vector, with that order, and the backward one meet in the
middle, the cheapest crossing with the least edits is fixed, and both halves are solved by themselves. Only two vectors of four
states are held at a time.

On Spark: rows are collapsed by (conversation, turn, role, digest) and range partitioned in order, whatever their conversation,
so that a conversation with a third of all rows spreads over tasks. Each run of at most BLOCK rows of a conversation becomes a
block with the 4 x 4 matrix of what it costs to cross it. Blocks of a conversation meet as matrices (16 pairs of numbers for
BLOCK rows), `meet` fixes the states between blocks, and then works within each block. Texts are shuffled apart from this, once
to their edits and once to their conversation, where one pass in order makes the SHA-256, which cannot be split, row by row.

Defined results: a null role or text is one space. Null conv_ids are one conversation. A row is a duplicate if its role and text
came earlier in the conversation; exactly repeated rows are duplicates after their first. A conversation without rows has no
faults, an empty audit and the hash of nothing. A role's initial is its first character; an empty role has none, which is
neither legal nor kept. Empty tables give empty results. Columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import _common as C

#: Rows of one conversation in a block.
BLOCK = 4096
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NONE = 1 << 60
STATES = range(4)
#: The states: nothing yet, after s, after u, after a. The user or assistant that may follow each, and the state it leads to.
FOLLOWS = (("u", 2), ("u", 2), ("a", 3), ("u", 2))
_NAMES = {"u": "user", "a": "assistant"}


class Unit:
    """What it costs to go from state s to state t, the edits that do, and the order of the edits that leave s."""

    def __init__(self, ways: dict[tuple[int, int], list[tuple[int, str]]]):
        best = {k: min(v) for k, v in ways.items() if v}
        self.cost = [[best.get((s, t), (NONE, ""))[0] for t in STATES] for s in STATES]
        self.edits = [[best.get((s, t), (NONE, ""))[1] for t in STATES] for s in STATES]
        self.order = [[sum(best[s, o][1] < best[s, t][1] for o in STATES if (s, o) in best) if (s, t) in best else 0 for t in STATES] for s in STATES]


class Span:
    """Like a unit, for a run of units whose edits are not known yet."""

    def __init__(self, cost: list[list[int]], order: list[list[int]]):
        self.cost, self.order = cost, order


def _inserted(s: int) -> list[tuple[int, int, str]]:
    """(state, cost, edits) after none to two inserts; a third would only repeat a state."""
    out = [(s, 0, "")]
    for _ in range(2):
        q, c, e = out[-1]
        out.append((FOLLOWS[q][1], c + INSERT, e + "I"))
    return out


@cache
def unit(initial: str, must_go: bool, truncated: bool) -> Unit:
    """A row: its role's initial (s, u, a or other), whether it has to be deleted, and whether keeping its text costs more."""
    ways: dict[tuple[int, int], list[tuple[int, str]]] = {(s, t): [] for s in STATES for t in STATES}
    more = TRUNCATED if truncated else 0
    for s in STATES:
        for q, cost, edits in _inserted(s):
            ways[s, q].append((cost + DELETE, edits + "D"))
            if must_go:
                continue
            role, t = FOLLOWS[q]
            ways[s, t].append((cost + REROLE + more, edits + "R"))
            if initial == role:
                ways[s, t].append((cost + KEEP + more, edits + "K"))
            elif initial == "s" and q == 0:
                ways[s, 1].append((cost + KEEP + more, edits + "K"))
    return Unit(ways)


#: After the last row: inserts up to an accepted state (nothing, or after a); all of them lead to state 0.
END = Unit({(s, 0): [(c, e) for q, c, e in _inserted(s) if q in (0, 3)] for s in STATES})


def _after(units: list, lo: int, hi: int, s: int) -> tuple[list[int], list[int]]:
    """Forward from state s over units[lo:hi]: the cost of each state, and the order of their least edits."""
    cost, order = [NONE] * 4, [0] * 4
    cost[s] = 0
    for x in units[lo:hi]:
        new, by = [NONE] * 4, [(0, 0)] * 4
        for q in STATES:
            if cost[q] < NONE:
                row, ranks = x.cost[q], x.order[q]
                for t in STATES:
                    if row[t] < NONE:
                        c, o = cost[q] + row[t], (order[q], ranks[t])
                        if c < new[t] or c == new[t] and o < by[t]:
                            new[t], by[t] = c, o
        known = [t for t in STATES if new[t] < NONE]
        order = [sum(by[o] < by[t] for o in known) for t in STATES]
        cost = new
    return cost, order


def _before(units: list, lo: int, hi: int, t: int) -> list[int]:
    """Backward from state t over units[lo:hi]: the cost from each state."""
    cost = [NONE] * 4
    cost[t] = 0
    for x in reversed(units[lo:hi]):
        cost = [min(NONE, *(x.cost[s][q] + cost[q] for q in STATES)) for s in STATES]
    return cost


def meet(units: list, s: int, t: int) -> list[int]:
    """The states before, between and after units on the cheapest way from s to t that has the least edits."""
    out = [s] + [0] * (len(units) - 1) + [t] if units else [s]
    work = [(0, len(units))]
    while work:
        lo, hi = work.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        cost, order = _after(units, lo, mid, out[lo])
        rest = _before(units, mid, hi, out[hi])
        out[mid] = min(STATES, key=lambda q: (cost[q] + rest[q], order[q]))
        work += [(lo, mid), (mid, hi)]
    return out


def audit(units: list[Unit]) -> str:
    """The least cheapest edits of a whole conversation."""
    units = [*units, END]
    at = meet(units, 0, 0)
    return "".join(x.edits[s][t] for x, s, t in zip(units, at, at[1:], strict=False))


# ---------------------------------------------------------------- rows
def _conversation(conv: str) -> Column:
    """A key that is never null and tells a null from every value."""
    return F.coalesce(F.concat(F.lit("v"), F.col(conv).cast("string")), F.lit("n"))


def damaged(table: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times) after damage drawn from crc32 of conv_id:turn. times: how often the row stands there."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = table.select("conv_id", F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"))


def _keyed(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, times, digest, fault) with fault 1 for blank, 3 for truncated texts, else 0."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    out = rows.select(_conversation("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"), "times")
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    fault = F.when(last == "", 1).when(last.isin(".", "!", "?"), 0).otherwise(3)
    return out.withColumns({"digest": F.unhex(F.sha2("text", 256)), "fault": fault.cast("int")})


ROW = {"at": pa.int64(), "turn": pa.int64(), "role": pa.string(), "digest": pa.binary(), "fault": pa.int32(), "times": pa.int64()}
BLOCKS = "conv string, first long, matrix array<long>, order array<int>, rows array<struct<at: long, turn: long, role: string, digest: binary, fault: int, times: long>>"


def _units(rows: list[dict]) -> list[Unit]:
    """The units of rows; what repeats a row comes as a unit of its own."""
    out = []
    for r in rows:
        fault = r["fault"]
        out.append(unit(r["role"][:1] if r["role"][:1] in ("s", "u", "a") else "", fault in (1, 2), fault == 3))
        out += [unit("", True, False)] * (r["times"] - 1)
    return out


def _blocked(block: int):
    """Blocks of rows (conv, at, turn, role, digest, fault, times) that come in order."""

    def made(blocks: list[tuple[str, list[dict]]]) -> pa.RecordBatch:
        across = []
        for _, rows in blocks:
            units = _units(rows)
            across.append([_after(units, 0, len(units), s) for s in STATES])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([c for c, _ in blocks], pa.string()),
                pa.array([rows[0]["at"] for _, rows in blocks], pa.int64()),
                pa.array([[c for cost, _ in x for c in cost] for x in across], pa.list_(pa.int64())),
                pa.array([[o for _, order in x for o in order] for x in across], pa.list_(pa.int32())),
                pa.array([rows for _, rows in blocks], pa.list_(pa.struct(ROW.items()))),
            ],
            ["conv", "first", "matrix", "order", "rows"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[str, list[dict]]] = []
        conv, rows, held = None, [], 0
        for batch in batches:
            for c, *values in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                r = dict(zip(ROW, values, strict=True))
                if c != conv or held >= block:
                    if rows:
                        done.append((conv, rows))
                    conv, rows, held = c, [], 0
                rows.append(r)
                held += r["times"]
            if sum(len(x) for _, x in done) >= block:
                yield made(done)
                done = []
        if rows:
            done.append((conv, rows))
        yield made(done)

    return run


def _crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(first, s, t, last) of blocks (conv, first, matrix, order) that come in order: the states before and after each."""

    def settle(blocks: list[tuple]) -> list[tuple]:
        square = lambda x: [x[4 * i : 4 * i + 4] for i in STATES]
        at = meet([*(Span(square(m), square(o)) for _, m, o in blocks), END], 0, 0)
        return [(b[0], s, t, i == len(blocks) - 1) for i, (b, s, t) in enumerate(zip(blocks, at, at[1:], strict=False))]

    def made(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], ["first", "s", "t", "last"])

    conv, blocks, out = None, [], []
    for batch in batches:
        for c, *b in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if c != conv:
                out += settle(blocks) if blocks else []
                conv, blocks = c, []
            blocks.append(b)
        if len(out) > 10_000:
            yield made(out)
            out = []
    yield made(out + (settle(blocks) if blocks else []))


EDITED = "conv string, at long, turn long, role string, digest binary, fault int, times long, s int, edits string, after string"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the state before them and their edits (`after`: inserts at the conversation's end), of blocks whose outer states are known."""
    kinds = (pa.string(), *ROW.values(), pa.int32(), pa.string(), pa.string())
    names = [x.split()[0] for x in EDITED.split(", ")]
    for batch in batches:
        out = []
        for conv, rows, s, t, last in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            units = _units(rows)
            at, k = meet(units, s, t), 0
            for r in rows:
                edits = "".join(units[i].edits[at[i]][at[i + 1]] for i in range(k, k + r["times"]))
                k += r["times"]
                out.append((conv, *r.values(), at[k - r["times"]], edits, END.edits[t][0] if last and r is rows[-1] else ""))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], names)


class _Report:
    """What is said of one conversation, row by row; texts are hashed as they pass."""

    def __init__(self):
        self.digest, self.first, self.audit = hashlib.sha256(), True, []
        self.faults, self.illegal, self.cost, self.initial = [0, 0, 0, 0], 0, 0, None
        self.least = self.most = self.turn = None
        self.turns = 0

    def line(self, role: str, text: str) -> None:
        self.digest.update((("" if self.first else "\n") + role + ":" + text).encode())
        self.first = False

    def apply(self, edits: str, state: int, role: str, text: str, more: int) -> None:
        self.audit.append(edits)
        for e in edits:
            if e == "D":
                self.cost += DELETE
                continue
            follows, then = FOLLOWS[state]
            if e == "I":
                self.cost += INSERT
                self.line(_NAMES[follows], "")
            elif e == "R":
                self.cost += REROLE + more
                self.line(_NAMES[follows], text)
            else:
                self.cost += KEEP + more
                self.line(role, text)
                then = 1 if role.startswith("s") else then
            state = then
        self.state = state

    def row(self, turn: int | None, role: str, fault: int, times: int, s: int, edits: str, after: str, text: str | None) -> None:
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.turns += turn != self.turn
            self.most = self.turn = turn
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.illegal += times - 1
        self.initial = initial
        self.faults[fault] += 1
        self.faults[1 if fault == 1 else 2] += times - 1
        self.apply(edits, s, role, text or "", TRUNCATED if fault == 3 else 0)
        self.apply(after, self.state, "", "", 0)

    def result(self) -> tuple:
        gaps = 0 if self.least is None else min(self.most - self.least + 1 - self.turns, (1 << 63) - 1)
        return gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


REPORT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reports of rows (conv, turn, role, fault, times, s, edits, after, text) that come in order."""
    kinds, names = (pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()), [x.split()[0] for x in REPORT.split(", ")]

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], names)

    conv, report, out = None, None, []
    for batch in batches:
        for c, *r in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if c != conv:
                out += [(conv, *report.result())] if report else []
                conv, report = c, _Report()
            report.row(*r)
        if len(out) > 10_000:
            yield made(out)
            out = []
    yield made(out + ([(conv, *report.result())] if report else []))


def _same(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}"))
    return out


def edited(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """EDITED of rows (conv, turn, role, digest, fault, times): each row's place `at` in the order of all, and its edits."""
    spark = rows.sparkSession
    parts = C.partitions(spark)
    once = rows.groupBy("conv", "turn", "role", "digest").agg(F.max("fault").alias("fault"), F.sum("times").alias("times"))
    stands = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = once.groupBy("conv", "role", "digest").agg(F.min(stands).alias("start"), F.count("*").alias("n")).where("n > 1").select("conv", "role", "digest", "start")
    once = once.join(again, ["conv", "role", "digest"], "left")
    fault = F.when(F.col("fault") == 1, 1).when(F.col("start").isNotNull() & (stands > F.col("start")), 2).otherwise(F.col("fault"))
    order = ("conv", F.col("turn").asc_nulls_first(), "role", "digest")
    placed = once.select("conv", "turn", "role", "digest", fault.cast("int").alias("fault"), "times").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = placed.select("conv", F.monotonically_increasing_id().alias("at"), "turn", "role", "digest", "fault", "times")
    blocks = C.written(placed.mapInArrow(_blocked(block), BLOCKS), "blocks")
    crossed = blocks.select("conv", "first", "matrix", "order").repartition(parts, "conv").sortWithinPartitions("conv", "first")
    crossed = crossed.mapInArrow(_crossed, "first long, s int, t int, last boolean")
    return blocks.select("conv", "first", "rows").join(crossed, "first").select("conv", "rows", "s", "t", "last").mapInArrow(_edited, EDITED)


def repaired(conversations: DataFrame, rows: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """conv_id and REPORT of every conversation. rows: what stands in for its rows, as from `damaged`; else they are as given."""
    spark = conversations.sparkSession
    if rows is None:
        rows = conversations.select("conv_id", "turn", "role", "text", F.lit(1).alias("times"))
    keyed = _keyed(rows)
    found = C.written(edited(keyed.select("conv", "turn", "role", "digest", "fault", "times"), block), "edited")
    needed = F.col("edits").rlike("[KR]")
    key = ("conv", "turn", "role", "digest")
    texts = keyed.select(*key, "text").dropDuplicates(list(key))
    whole = found.where(needed).alias("l").join(texts.alias("r"), _same(*key), "left").select("l.*", "r.text")
    whole = whole.unionByName(found.where(~needed).withColumn("text", F.lit(None).cast("string")))
    stream = whole.repartition(C.partitions(spark), "conv").sortWithinPartitions("conv", "at").select("conv", "turn", "role", "fault", "times", "s", "edits", "after", "text")
    reports = stream.mapInArrow(_reported, REPORT)
    names = conversations.select("conv_id").distinct().withColumn("conv", _conversation("conv_id"))
    nothing = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()} | dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0)
    return names.join(reports, "conv", "left").drop("conv").na.fill(nothing, list(nothing))
