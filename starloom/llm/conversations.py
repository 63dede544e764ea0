"""Repair the turn structure of conversations by the cheapest edits.

Role initials of a conversation should read `(s?(ua)+)?`: user and assistant in turn, after at most one system
row. Edits: Keep a row (0), Rerole it to user or assistant (1), Delete it (2), Insert an empty row of the user
or assistant (5). Blank rows and repetitions of an earlier role and text must be deleted; a truncated row
(its last sign ends no sentence) costs 5 unless deleted. The audit lists the edits' initials in order; of equally
cheap ones the least in ASCII is taken.

Rows are aligned to the grammar's string of each feasible length by a Wagner-Fischer table of costs still to
come, kept to the diagonals that can beat the cheapest audit so far (Ukkonen's band); lengths whose
difference alone costs more are passed over, and the audits traced back are compared.

A conversation may hold any share of all rows. Rows are sorted over range partitions and cut into fragments of
at most FRAGMENT rows. A fragment is aligned once for each state of the grammar before and after it, to the
strings that lead from one to the other. Every audit of a fragment ends with a row's edit, and none is the
beginning of another, so which is less can be told by a rank; costs and ranks of neighbouring fragments add up to those of
their union, in a tree of FAN nodes a group, up to the whole conversation. From its cheapest way the
states between fragments follow on the way down. What is sequential by definition, the SHA-256 of the repaired
text, passes one task as a stream.

Rows go by turn, nulls first; rows of one turn by role and the SHA-256 of their text. Null roles and texts count as
one space, rows without a conv_id as one conversation. Equal rows are counted as one with `copies`:
after the first, all are repetitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import Scratch

FRAGMENT, FAN = 24, 64
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
ROLE = {"u": "user", "a": "assistant"}
WHITE = " \t\n\v\f\r"
#: States of the grammar: nothing yet, after the system row, after a user's, after an assistant's.
NONE, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 60


class Row(NamedTuple):
    """What a row means to the alignment."""

    initial: str
    must_go: bool
    truncated: bool
    copies: int


# ---- alignment


def alternating(first: str, n: int) -> str:
    return ("uaua" if first == "u" else "auau")[:2] * (n // 2) + (first if n % 2 else "")


def _apart(d: int) -> int:
    """The least cost of coming d letters ahead of the rows, or -d behind."""
    return INSERT * d if d > 0 else -DELETE * d


def _edit(row: Row, letter: str) -> tuple[int, str] | None:
    """Cost and initial of making a row the letter."""
    if row.must_go:
        return None
    if row.initial == letter:
        return TRUNCATED * row.truncated, "K"
    return (RENAME + TRUNCATED * row.truncated, "R") if letter != "s" else None


def align(rows: list[Row], target: str, limit: int, open_end: bool) -> tuple[int, str] | None:
    """The cheapest audit that makes the rows the target, if it costs no more than `limit`; ties to the
    least. Letters are inserted before a row, and after the last one if `open_end`."""
    n, m = len(rows), len(target)
    if _apart(m - n) > limit:
        return None
    below, above = 0, 0
    while below - 1 >= -n and _apart(below - 1) + _apart(m - n - below + 1) <= limit:
        below -= 1
    while above + 1 <= m and _apart(above + 1) + _apart(m - n - above - 1) <= limit:
        above += 1
    # to_go[i][j - first[i]]: from i rows and j letters on
    to_go: list[list[int]] = [[] for _ in range(n + 1)]
    first = [max(0, i + below) for i in range(n + 1)]
    last = [min(m, i + above) for i in range(n + 1)]
    ends = [j == m or open_end and target[j] != "s" for j in range(first[n], last[n] + 1)]
    to_go[n] = [INSERT * (m - j) if ends[j - first[n]] else FAR for j in range(first[n], last[n] + 1)]
    for i in range(n - 1, -1, -1):
        row, after, shift = rows[i], to_go[i + 1], first[i + 1]
        costs = {c: edit[0] for c in "uas" if (edit := _edit(row, c))}
        here = [FAR] * (last[i] - first[i] + 1)
        best = FAR
        for j in range(last[i], first[i] - 1, -1):
            letter = target[j] if j < m else ""
            best = best + INSERT if letter and letter != "s" else FAR
            if shift <= j <= last[i + 1]:
                best = min(best, DELETE + after[j - shift])
            if letter in costs and shift <= j + 1 <= last[i + 1]:
                best = min(best, costs[letter] + after[j + 1 - shift])
            here[j - first[i]] = best
        to_go[i] = here
    if to_go[0][0] > min(limit, FAR - 1):
        return None
    cost, audit, i, j = to_go[0][0], [], 0, 0
    left = cost
    while i < n or j < m:
        if i < n and first[i + 1] <= j <= last[i + 1] and DELETE + to_go[i + 1][j - first[i + 1]] == left:
            left -= DELETE
            audit.append("D" * rows[i].copies)
            i += 1
        elif j < m and target[j] != "s" and j + 1 <= last[i] and INSERT + to_go[i][j + 1 - first[i]] == left:
            left -= INSERT
            audit.append("I")
            j += 1
        else:
            price, sign = _edit(rows[i], target[j])
            left -= price
            audit.append(sign + "D" * (rows[i].copies - 1))
            i, j = i + 1, j + 1
    return cost, "".join(audit)


def cheapest(rows: list[Row], prefix: str, first: str, lengths: range, open_end: bool, limit: int = FAR) -> tuple[int, str] | None:
    """The cheapest and least audit over the targets: `prefix`, and `first` alternating, of each length.

    Lengths near the number of rows that may stay come first, and each cheapest cost so far limits the
    tables of the next."""
    best = None
    n, staying = len(rows), len(rows) - sum(r.must_go for r in rows) - len(prefix)
    for length in sorted(lengths, key=lambda k: (_apart(k - staying), k)):
        if _apart(length + len(prefix) - n) > limit:
            continue
        found = align(rows, prefix + alternating(first, length), limit, open_end)
        if found and (best is None or found < best):
            best, limit = found, found[0]
    return best


def _lengths(rows: list[Row], least: int) -> range:
    """Lengths of one parity. Deleting all rows and inserting the rest is dearer beyond these."""
    most = len(rows) + 2 + len(rows) * max(DELETE, RENAME + TRUNCATED) // INSERT
    return range(least, most + 1, 2)


def repair_rows(rows: list[Row]) -> tuple[int, str]:
    """Cost, without that of copies, and audit of a whole conversation."""
    gone = (DELETE * len(rows), "D" * sum(r.copies for r in rows))
    best = min(gone, cheapest(rows, "", "u", _lengths(rows, 2), True, gone[0]) or gone)
    return min(best, cheapest(rows, "s", "u", _lengths(rows, 2), True, best[0]) or best)


class Way(NamedTuple):
    """Through a fragment, from the state before it to the one after it."""

    enter: int
    leave: int
    cost: int
    audit: str


def ways(rows: list[Row]) -> list[Way]:
    """All ways through a fragment, each the cheapest and least of its two states."""
    gone = (DELETE * len(rows), "D" * sum(r.copies for r in rows))
    found = {(first, least): cheapest(rows, "", first, _lengths(rows, least), False) for first in "ua" for least in (1, 2)}
    system = {least: cheapest(rows, "s", "u", _lengths(rows, least), False) for least in (1, 2)}
    alone = cheapest(rows, "s", "u", range(1), False)
    u_user, u_assistant, a_assistant, a_user = found["u", 1], found["u", 2], found["a", 1], found["a", 2]
    choices = {
        (NONE, NONE): [gone],
        (NONE, SYSTEM): [alone],
        (NONE, USER): [u_user, system[1]],
        (NONE, ASSISTANT): [u_assistant, system[2]],
        (SYSTEM, SYSTEM): [gone],
        (SYSTEM, USER): [u_user],
        (SYSTEM, ASSISTANT): [u_assistant],
        (USER, USER): [gone, a_user],
        (USER, ASSISTANT): [a_assistant],
        (ASSISTANT, ASSISTANT): [gone, u_assistant],
        (ASSISTANT, USER): [u_user],
    }
    out = []
    for (enter, leave), some in choices.items():
        there = [x for x in some if x]
        if there:
            out.append(Way(enter, leave, *min(there)))
    return out


#: What ends a conversation in each state: cost, and edits.
ENDS = {NONE: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}


# ---- ways through neighbouring fragments: [enter][leave] -> (cost, rank), rank among those of one `enter`

Costs = list[list[tuple[int, int]]]


def costs_of(found: list[Way]) -> Costs:
    out = [[(FAR, 0)] * 4 for _ in range(4)]
    for enter in range(4):
        audits = sorted((w.audit, w.leave, w.cost) for w in found if w.enter == enter)
        for rank, (_, leave, cost) in enumerate(audits):
            out[enter][leave] = (cost, rank)
    return out


def _forward(start: list[tuple[int, int]], step: Costs) -> tuple[list[tuple[int, int]], list[int]]:
    """Cost and rank per state after one more fragment, and the state before it that each comes from."""
    best, came = [], []
    for leave in range(4):
        options = [
            (start[mid][0] + step[mid][leave][0], start[mid][1], step[mid][leave][1], mid)
            for mid in range(4)
            if start[mid][0] < FAR and step[mid][leave][0] < FAR
        ]
        best.append(min(options, default=(FAR, 0, 0, 0)))
        came.append(best[-1][3])
    order = {key: rank for rank, key in enumerate(sorted({b[1:3] for b in best if b[0] < FAR}))}
    return [(b[0], order.get(b[1:3], 0)) for b in best], came


def joined(steps: list[Costs]) -> Costs:
    out = []
    for enter in range(4):
        now = [(0 if state == enter else FAR, 0) for state in range(4)]
        for step in steps:
            now, _ = _forward(now, step)
        out.append(now)
    return out


def states_between(steps: list[Costs], enter: int, leave: int) -> list[int]:
    """The states before, between and after the fragments on the cheapest and least way."""
    now = [(0 if state == enter else FAR, 0) for state in range(4)]
    back = []
    for step in steps:
        now, came = _forward(now, step)
        back.append(came)
    states = [leave]
    for came in reversed(back):
        states.append(came[states[-1]])
    return states[::-1]


def last_state(whole: Costs) -> int:
    """Where the cheapest and least way through a whole conversation ends."""
    return min(range(4), key=lambda state: (whole[NONE][state][0] + ENDS[state][0], whole[NONE][state][1]))


# ---- rows to fragments


def _same(*names: str) -> Column:
    on = F.lit(True)
    for name in names:
        on = on & F.col(f"_l.{name}").eqNullSafe(F.col(f"_r.{name}"))
    return on


def distinct_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: nulls of role and text as one space, equal rows counted."""
    plain = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    return plain.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))


def marked(turns: DataFrame) -> DataFrame:
    """`turns` (from `distinct_turns`) without text: conv_id, turn, role, digest, copies, blank, first (of its role
    and text in the conversation), truncated."""
    body = F.rtrim("text", F.lit(WHITE))
    rows = turns.select(
        "conv_id",
        "turn",
        "role",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        "copies",
        (body == "").alias("blank"),
        (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    key = ["conv_id", "role", "digest"]
    earliest = rows.groupBy(*key).agg(F.max(F.col("turn").isNull()).alias("any_null"), F.min("turn").alias("least"))
    both = rows.alias("_l").join(earliest.alias("_r"), _same(*key))
    first = F.when(F.col("any_null"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("least"))
    return both.select("_l.*", first.alias("first")).withColumn("truncated", F.expr("NOT blank AND cut AND first")).drop("cut")


ITEM = pa.struct(
    [("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary())]
    + [("must_go", pa.bool_()), ("truncated", pa.bool_()), ("copies", pa.int64())]
)
WAY = pa.struct([("enter", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
FRAGMENT_FIELDS = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int64()), ("seq", pa.int64()), ("whole", pa.bool_())]
    + [("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string())]
    + [("ways", pa.list_(WAY)), ("items", pa.list_(ITEM))]
)
FRAGMENT_SCHEMA = (
    "conv_id long, part long, seq long, whole boolean, illegal long, first string, last string,"
    " ways array<struct<enter: int, leave: int, cost: bigint, audit: string>>,"
    " items array<struct<turn: bigint, role: string, digest: binary, must_go: boolean, truncated: boolean, copies: bigint>>"
)


def _illegal(before: str, after: str) -> bool:
    return before + after not in ("su", "ua", "au")


def _row(item: dict) -> Row:
    return Row(item["role"][:1], item["must_go"], item["truncated"], item["copies"])


def _fragment(conv_id: int | None, part: int, seq: int, items: list[dict], whole: bool) -> dict:
    rows = [_row(i) for i in items]
    if whole:
        cost, audit = repair_rows(rows)
        found = [Way(NONE, NONE, cost, audit)]
    else:
        found = ways(rows)
    illegal = sum(_illegal(a.initial, b.initial) for a, b in pairwise(rows)) + sum(
        (r.copies - 1) * _illegal(r.initial, r.initial) for r in rows
    )
    return {
        "conv_id": conv_id,
        "part": part,
        "seq": seq,
        "whole": whole,
        "illegal": illegal,
        "first": rows[0].initial,
        "last": rows[-1].initial,
        "ways": [w._asdict() for w in found],
        "items": items,
    }


def fragments(rows: DataFrame) -> DataFrame:
    """`rows` (from `marked`, a written table) in order, as aligned fragments: FRAGMENT_SCHEMA. `part` and `seq` order
    them. A conversation that begins and ends within a partition, and is one fragment, is `whole`."""
    size = FRAGMENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        out: list[dict] = []
        items: list[dict] = []
        conv_id, seq, edge = None, 0, True  # edge: it may have begun in the partition before

        def close(whole: bool) -> None:
            if items:
                out.append(_fragment(conv_id, part, seq, list(items), whole))
                items.clear()

        for batch in batches:
            for row in batch.to_pylist():
                row_id = row.pop("conv_id")
                if items and row_id != conv_id:
                    close(whole=not edge and seq == 0)
                    conv_id, seq, edge = row_id, 0, False
                elif len(items) == size:
                    close(whole=False)
                    seq += 1
                elif not items:
                    conv_id = row_id
                items.append(row)
            if len(out) >= 200:
                yield pa.RecordBatch.from_pylist(out, FRAGMENT_FIELDS)
                out.clear()
        close(whole=False)
        yield pa.RecordBatch.from_pylist(out, FRAGMENT_FIELDS)

    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    sorted_rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    needed = sorted_rows.select(
        "conv_id", "turn", "role", "digest", (F.col("blank") | ~F.col("first")).alias("must_go"), "truncated", "copies"
    )
    return needed.mapInArrow(run, FRAGMENT_SCHEMA)


# ---- the tree of fragments

NODE = pa.schema(
    [("conv_id", pa.int64()), ("no", pa.int64()), ("cost", pa.list_(pa.int64())), ("rank", pa.list_(pa.int64()))]
    + [("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string())]
)
NODE_SCHEMA = "conv_id long, no long, cost array<bigint>, rank array<bigint>, illegal long, first string, last string"
CHOSEN = pa.schema([("conv_id", pa.int64()), ("no", pa.int64()), ("enter", pa.int32()), ("leave", pa.int32())])
CHOSEN_SCHEMA = "conv_id long, no long, enter int, leave int"


def _costs(node: dict) -> Costs:
    pairs = list(zip(node["cost"], node["rank"], strict=True))
    return [pairs[4 * k : 4 * k + 4] for k in range(4)]


def _node(conv_id: int | None, no: int, costs: Costs, illegal: int, first: str, last: str) -> dict:
    flat = [pair for line in costs for pair in line]
    return {
        "conv_id": conv_id,
        "no": no,
        "cost": [c for c, _ in flat],
        "rank": [r for _, r in flat],
        "illegal": illegal,
        "first": first,
        "last": last,
    }


def leaves(parts: DataFrame) -> DataFrame:
    """Fragments (with `no`) as nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [
                _node(r["conv_id"], r["no"], costs_of([Way(**w) for w in r["ways"]]), r["illegal"], r["first"], r["last"])
                for r in batch.to_pylist()
            ]
            yield pa.RecordBatch.from_pylist(nodes, NODE)

    return parts.select("conv_id", "no", "ways", "illegal", "first", "last").mapInArrow(run, NODE_SCHEMA)


def unite(nodes: DataFrame) -> DataFrame:
    """One level up: up to FAN neighbouring nodes of a conversation as one."""
    fan = FAN

    def run(group: pa.Table) -> pa.Table:
        some = sorted(group.drop_columns(["up"]).to_pylist(), key=lambda r: r["no"])
        illegal = sum(r["illegal"] for r in some) + sum(_illegal(a["last"], b["first"]) for a, b in pairwise(some))
        costs = joined([_costs(r) for r in some])
        one = _node(some[0]["conv_id"], some[0]["no"] // fan, costs, illegal, some[0]["first"], some[-1]["last"])
        return pa.Table.from_pylist([one], NODE)

    with_up = nodes.withColumn("up", F.expr(f"no div {fan}"))
    return with_up.groupBy("conv_id", "up").applyInArrow(run, NODE_SCHEMA)


def decide(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """One level down: the states before and after each of the nodes, from those of the nodes above."""
    fan = FAN

    def run(group: pa.Table) -> pa.Table:
        some = sorted(group.to_pylist(), key=lambda r: r["no"])
        states = states_between([_costs(r) for r in some], some[0]["enter"], some[0]["leave"])
        rows = [
            {"conv_id": r["conv_id"], "no": r["no"], "enter": a, "leave": b}
            for r, (a, b) in zip(some, pairwise(states), strict=True)
        ]
        return pa.Table.from_pylist(rows, CHOSEN)

    below = nodes.select("conv_id", "no", "cost", "rank", F.expr(f"no div {fan}").alias("up"))
    above = chosen.withColumnRenamed("no", "up")
    both = below.alias("_l").join(above.alias("_r"), _same("conv_id", "up")).select("_l.*", "enter", "leave")
    return both.groupBy("conv_id", "up").applyInArrow(run, CHOSEN_SCHEMA)


def roots(nodes: DataFrame) -> DataFrame:
    """Nodes of whole conversations: the states before and after them, cost and illegal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                costs = _costs(r)
                leave = last_state(costs)
                price, tail = costs[NONE][leave][0] + ENDS[leave][0], ENDS[leave][1]
                out.append({"conv_id": r["conv_id"], "no": 0, "enter": NONE, "leave": leave, "cost": price, "tail": tail, "illegal": r["illegal"]})
            fields = list(CHOSEN) + [pa.field("cost", pa.int64()), pa.field("tail", pa.string()), pa.field("illegal", pa.int64())]
            yield pa.RecordBatch.from_pylist(out, pa.schema(fields))

    return nodes.mapInArrow(run, f"{CHOSEN_SCHEMA}, cost long, tail string, illegal long")


LINE = pa.schema(
    [("conv_id", pa.int64()), ("no", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("new_role", pa.string())]
    + [("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary())]
)
LINE_SCHEMA = "conv_id long, no long, place long, edit string, new_role string, turn long, role string, digest binary"


def edited(items: list[dict], audit: str, state: int) -> Iterator[tuple[str, str, dict | None]]:
    """The rows that an audit leaves, from a state on: edit, new role, and the item (None if inserted)."""
    at, k = 0, 0
    while k < len(audit):
        sign = audit[k]
        item = None
        if sign != "I":
            item = items[at]
            at += 1
            k += item["copies"] - 1
        k += 1
        if sign == "D":
            continue
        if sign == "K":
            role = item["role"]
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
        else:
            state = ASSISTANT if state == USER else USER
            role = ROLE["a" if state == ASSISTANT else "u"]
        yield sign, role, item


def lines(parts: DataFrame) -> DataFrame:
    """Fragments with `enter` and `audit` as the rows left: LINE_SCHEMA. conv_id, no and place order them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                for place, (edit, role, item) in enumerate(edited(r["items"], r["audit"], r["enter"])):
                    source = item or {"turn": None, "role": None, "digest": None}
                    out.append(
                        {"conv_id": r["conv_id"], "no": r["no"], "place": place, "edit": edit, "new_role": role}
                        | {k: source[k] for k in ("turn", "role", "digest")}
                    )
            yield pa.RecordBatch.from_pylist(out, LINE)

    return parts.select("conv_id", "no", "items", "audit", "enter").mapInArrow(run, LINE_SCHEMA)


def text_hashes(rows: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its `role:text` lines, joined by line ends, as one stream per conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_id, digest = None, None
        for batch in batches:
            done = []
            for row_id, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if digest is None or row_id != conv_id:
                    if digest is not None:
                        done.append((conv_id, digest.hexdigest()))
                    conv_id, digest = row_id, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(role.encode())
                digest.update(b":")
                digest.update(text.encode())
            yield _hashed(done)
        yield _hashed([] if digest is None else [(conv_id, digest.hexdigest())])

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "no", "place")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, repaired_sha256 string")


def _hashed(done: list[tuple]) -> pa.RecordBatch:
    ids, hashes = [d[0] for d in done], [d[1] for d in done]
    return pa.record_batch([pa.array(ids, pa.int64()), pa.array(hashes, pa.string())], names=["conv_id", "repaired_sha256"])


class Repaired(NamedTuple):
    """conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    turns: conv_id, no, place (these order them), edit (K, R or I), role, text."""

    conversations: DataFrame
    turns: DataFrame


def repair(turns: DataFrame, scratch: Scratch) -> Repaired:
    """Repair `turns` (conv_id, turn, role, text). `gaps` counts the numbers missing between the least and the
    greatest turn (null beyond 63 bits), `illegal` neighbours whose role initials are not su, ua or au."""
    texts = scratch.keep(distinct_turns(turns), "texts")
    rows = scratch.keep(marked(texts), "marked")
    parts = scratch.keep(fragments(rows), "fragments")

    per_turn = rows.groupBy("conv_id", "turn").agg(
        F.sum(F.expr("if(blank, copies, 0)")).alias("blank"),
        F.sum(F.expr("if(blank, 0, copies - if(first, 1, 0))")).alias("duplicate"),
        F.sum(F.expr("if(truncated, 1L, 0L)")).alias("truncated"),
        F.sum(F.expr("copies - 1")).alias("again"),
    )
    span = F.max("turn").cast("decimal(20,0)") - F.min("turn").cast("decimal(20,0)")
    missing = (span + 1 - F.count("turn").cast("decimal(20,0)")).try_cast("long")
    gaps = F.when(F.count("turn") == 0, 0).otherwise(missing)
    counts = per_turn.groupBy("conv_id").agg(
        gaps.cast("long").alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "again")],
    )

    # up to one node per conversation, and down to the states around each fragment
    numbers = parts.filter("NOT whole").agg(F.max("part").alias("part"), F.max("seq").alias("seq")).first()
    width = (numbers.seq or 0) + 1
    parts = parts.withColumn("no", F.col("part") * width + F.col("seq"))
    levels = [scratch.keep(leaves(parts.filter("NOT whole")), "level0")]
    greatest = (numbers.part or 0) * width + (numbers.seq or 0)
    while greatest:
        greatest //= FAN
        levels.append(scratch.keep(unite(levels[-1]), f"level{len(levels)}"))
    top = scratch.keep(roots(levels[-1]), "roots")
    chosen = top.select("conv_id", "no", "enter", "leave")
    for k in range(len(levels) - 2, -1, -1):
        chosen = scratch.keep(decide(levels[k], chosen), f"chosen{k}")

    way = F.expr("filter(ways, w -> w.enter = _r.enter AND w.leave = _r.leave)[0].audit")
    pieces = parts.filter("NOT whole").alias("_l").join(chosen.alias("_r"), _same("conv_id", "no"))
    pieces = pieces.select("_l.conv_id", "_l.no", "items", way.alias("audit"), "_r.enter")
    whole = parts.filter("whole").select(
        "conv_id", "no", "items", F.expr("ways[0].audit").alias("audit"), F.lit(NONE).alias("enter")
    )
    # edits after the last row of a conversation of several fragments follow it
    tails = top.filter("tail != ''").select(
        "conv_id",
        F.lit(1 << 62).alias("no"),
        F.expr(f"cast(array() AS {_items_type()})").alias("items"),
        F.col("tail").alias("audit"),
        F.col("leave").alias("enter"),
    )
    audited = scratch.keep(pieces.unionByName(whole).unionByName(tails), "audited")
    audits = audited.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "audit"))), lambda x: x["audit"]), "").alias("audit")
    )
    prices = top.select("conv_id", "cost", "illegal").unionByName(
        parts.filter("whole").select("conv_id", F.expr("ways[0].cost").alias("cost"), "illegal")
    )

    left = lines(audited)
    source = texts.withColumn("digest", F.unhex(F.sha2("text", 256)))
    key = ["conv_id", "turn", "role", "digest"]
    known = left.filter("digest IS NOT NULL").alias("_l").join(source.alias("_r"), _same(*key))
    known = known.select("_l.conv_id", "no", "place", "edit", F.col("new_role").alias("role"), "text")
    inserted = left.filter("digest IS NULL").select(
        "conv_id", "no", "place", "edit", F.col("new_role").alias("role"), F.lit("").alias("text")
    )
    repaired = scratch.keep(known.unionByName(inserted), "turns")

    out = counts.alias("_l").join(prices.alias("_r"), _same("conv_id")).select(
        "_l.*", "illegal", (F.col("cost") + DELETE * F.col("again")).alias("cost")
    )
    out = out.alias("_l").join(audits.alias("_r"), _same("conv_id")).select("_l.*", "audit")
    out = out.alias("_l").join(text_hashes(repaired).alias("_r"), _same("conv_id"), "left").select("_l.*", "repaired_sha256")
    empty = hashlib.sha256(b"").hexdigest()
    return Repaired(
        out.select(
            "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
            F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
        ),
        repaired,
    )


def _items_type() -> str:
    return FRAGMENT_SCHEMA.partition(" items ")[2]
