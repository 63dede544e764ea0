"""Conversation repair against enumeration of all edits and against a forward search, whole and in fragments."""

import hashlib
import itertools
import random

import pytest

from starloom.llm import conversations
from starloom.llm.conversations import ENDS, Row, align, alternating, cheapest, repair_rows, ways

WHITE = " \t\n\v\f\r"


def legal(initials):
    if not initials:
        return True
    rest = initials[1:] if initials[0] == "s" else initials
    return bool(rest) and len(rest) % 2 == 0 and all(c == "ua"[k % 2] for k, c in enumerate(rest))


def enumerated(rows):
    """Every choice of an edit per row, with none or one row inserted before each and up to two at the end."""
    best = None
    per_row = [[""] if r.must_go else ["", "K", "Ru", "Ra"] for r in rows]
    for inserts in itertools.product(["", "u", "a"], repeat=len(rows)):
        for end in ["", "u", "a", "ua"]:
            for edits in itertools.product(*per_row):
                made, audit, cost = "", "", 0
                for r, e, i in zip(rows, edits, inserts, strict=True):
                    made, audit, cost = made + i, audit + "I" * len(i), cost + 5 * len(i)
                    made += "" if not e else r.initial if e == "K" else e[1]
                    audit += e[:1] or "D"
                    cost += 2 if not e else (e != "K") + 5 * r.truncated
                made, audit, cost = made + end, audit + "I" * len(end), cost + 5 * len(end)
                if legal(made) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


def forward(rows):
    """Cheapest and least audit by the states of the grammar, row after row: (cost, audit, lines)."""
    far = (10**9, "", ())
    n, s, u, a = (0, "", ()), far, far, far

    def put(state, cost, audit, *lines):
        return far if state is far else (state[0] + cost, state[1] + audit, state[2] + lines)

    for r, role, text in rows:
        cut = 5 * r.truncated
        end = "D" * (r.copies - 1)

        def made(letter, *states, r=r, role=role, text=text, cut=cut, end=end):
            if r.must_go:
                return far
            if r.initial == letter:
                return min(put(x, cut, "K" + end, (role, text)) for x in states)
            name = {"u": "user", "a": "assistant"}[letter]
            return min(put(x, cut + 1, "R" + end, (name, text)) for x in states)

        ins = lambda x, name: put(x, 5, "I", (name, ""))
        gone = ["D" + end] * 4
        keep = put(n, cut, "K" + end, (role, text)) if r.initial == "s" and not r.must_go else far
        n, s, u, a = (
            put(n, 2, gone[0]),
            min(put(s, 2, gone[1]), keep),
            min(put(u, 2, gone[2]), made("u", n, s, a, ins(u, "assistant"))),
            min(put(a, 2, gone[3]), made("a", u, ins(n, "user"), ins(s, "user"), ins(a, "user"))),
        )
    return min(n, a, put(u, 5, "I", ("assistant", "")), put(s, 10, "II", ("user", ""), ("assistant", "")))


def brute_force(turns):
    """conv_id -> gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    out = {}
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in turns]
    sha = lambda t: hashlib.sha256(t.encode()).digest()
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), sha(r[2])))
        seen, counts, items = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, role, text in mine:
            body = text.rstrip(WHITE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            items.append((Row(role[:1], fault in ("blank", "duplicate"), fault == "truncated", 1), role, text))
        numbers = [r[0] for r in mine if r[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, audit, lines = forward(items)
        text = "\n".join(f"{r}:{t}" for r, t in lines)
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def random_rows(rng, n):
    return [Row(rng.choice("uuuaaas "), rng.random() < 0.2, rng.random() < 0.25, 1) for _ in range(n)]


def test_alternating():
    assert [alternating("u", n) for n in range(5)] == ["", "u", "ua", "uau", "uaua"]
    assert alternating("a", 3) == "aua"


def test_whole_like_enumeration():
    rng = random.Random(1)
    for _ in range(150):
        rows = random_rows(rng, rng.randint(0, 4))
        assert repair_rows(rows) == enumerated(rows), rows


def test_whole_like_forward_search():
    rng = random.Random(2)
    for _ in range(300):
        rows = random_rows(rng, rng.randint(1, 40))
        assert repair_rows(rows) == forward([(r, "x", "") for r in rows])[:2]


def test_band_does_not_change_results():
    rng = random.Random(3)
    for _ in range(100):
        rows = random_rows(rng, rng.randint(1, 12))
        target = rng.choice(["", "s"]) + alternating(rng.choice("ua"), rng.randint(0, 12))
        whole = align(rows, target, conversations.FAR, True)
        if whole:
            assert align(rows, target, whole[0], True) == whole
            assert align(rows, target, whole[0] - 1, True) is None


def test_copies_follow_their_row():
    rows = [Row("u", False, False, 3), Row("a", False, False, 2), Row("u", True, False, 2)]
    assert repair_rows(rows) == (2, "KDDKDDD")


def test_lengths_stop_at_the_incumbent(monkeypatch):
    """Of the feasible lengths only those that could still win are aligned."""
    rows = [Row("ua"[k % 2], False, False, 1) for k in range(40)]
    rows[7] = Row("u", True, False, 1)
    tried = []
    monkeypatch.setattr(conversations, "align", lambda *a: tried.append(len(a[1])) or align(*a))
    assert cheapest(rows, "", "u", conversations._lengths(rows, 2), True)
    assert len(tried) < 8


@pytest.mark.parametrize("size", [1, 2, 5])
def test_ways_join_to_the_whole(size):
    rng = random.Random(size)
    for _ in range(60):
        rows = random_rows(rng, rng.randint(1, 23))
        parts = [rows[k : k + size] for k in range(0, len(rows), size)]
        found = [ways(p) for p in parts]
        steps = [conversations.costs_of(w) for w in found]
        halves = [conversations.joined(steps[: len(steps) // 2]), conversations.joined(steps[len(steps) // 2 :])]
        whole = conversations.joined(halves)
        leave = conversations.last_state(whole)
        states = conversations.states_between(steps, 0, leave)
        audit = ""
        for w, (a, b) in zip(found, itertools.pairwise(states), strict=True):
            audit += next(x.audit for x in w if (x.enter, x.leave) == (a, b))
        cost = whole[0][leave][0] + ENDS[leave][0]
        assert (cost, audit + ENDS[leave][1]) == repair_rows(rows)


ROLES = ["user", "assistant", "system", "tool", "", None, "ünïcode"]
TEXTS = ["Hello there.", "What now?", "no end", "", "  \t\n", None, "Yes! \n", "a.", "long " * 3000 + "."]


def random_turns(rng, conversations_, rows):
    out = []
    for _ in range(rows):
        turn = rng.choice([None, *range(12)])
        role = rng.choice(["user", "assistant"]) if rng.random() < 0.8 else rng.choice(ROLES)
        text = f"t{rng.randint(0, 400)}" + rng.choice([".", "?", ""]) if rng.random() < 0.7 else rng.choice(TEXTS)
        out.append((rng.choice(conversations_), turn, role, text))
    return out + out[: rows // 10]


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def found(df):
    rows = df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


@pytest.fixture
def whole_partitions(spark):
    """Small partitions are not merged."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


@pytest.mark.parametrize(("fragment", "fan"), [(64, 64), (3, 2), (1, 3)])
def test_repair(spark, scratch, monkeypatch, fragment, fan):
    monkeypatch.setattr(conversations, "FRAGMENT", fragment)
    monkeypatch.setattr(conversations, "FAN", fan)
    rng = random.Random(9)
    rows = random_turns(rng, [None, 1, 1, 1, *range(2, 30)], 400)
    result = conversations.repair(frame(spark, rows).repartition(3), scratch())
    want = brute_force(rows)
    assert found(result.conversations) == want
    for conv, lines in itertools.groupby(
        sorted(result.turns.collect(), key=lambda r: (str(r.conv_id), r.no, r.place)), key=lambda r: r.conv_id
    ):
        text = "\n".join(f"{r.role}:{r.text}" for r in lines)
        assert hashlib.sha256(text.encode()).hexdigest() == want[conv][-1]


def test_one_conversation_of_all_rows(spark, scratch, whole_partitions):
    """Its rows are cut into fragments over all partitions, and its result is that of the whole."""
    rng = random.Random(10)
    rows = [(5, k, rng.choice(["user", "assistant"]), f"{rng.randint(0, 1500)}" + rng.choice([".", ".", ""])) for k in range(3000)]
    name = scratch()
    assert found(conversations.repair(frame(spark, rows).repartition(4), name).conversations) == brute_force(rows)
    parts = spark.read.parquet(name.path("fragments"))
    assert parts.select("part").distinct().count() > 1
    assert parts.selectExpr("max(size(items))").first()[0] <= conversations.FRAGMENT


def test_many_equal_rows(spark, scratch):
    rows = [(1, None, "user", "same.")] * 700 + [(1, 3, "assistant", "yes."), (1, 2, "user", "same.")]
    (row,) = conversations.repair(frame(spark, rows), scratch()).conversations.collect()
    assert row.audit == "K" + "D" * 700 + "K"
    assert (row.cost, row.duplicate, row.illegal) == (1400, 700, 700)


def test_empty_and_clashing(spark, scratch):
    assert conversations.repair(frame(spark, []), scratch()).conversations.collect() == []
    rows = [(1, 0, "user", "a."), (1, 1, "assistant", "b")]
    names = "no part seq cost audit blank first copies digest items enter up rank".split()
    wide = frame(spark, rows).selectExpr("*", *[f"'x' AS {n}" for n in names])
    assert found(conversations.repair(wide, scratch()).conversations) == brute_force(rows)


def test_far_turns(spark, scratch):
    rows = [(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b.")]
    (row,) = conversations.repair(frame(spark, rows), scratch()).conversations.collect()
    assert row.gaps is None and row.audit == "KK"
