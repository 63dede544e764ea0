"""Line dedup against brute force."""

import hashlib
import random
from collections import Counter

import pytest

import corpus_pipeline
from starloom.llm import line_dedup, queries
from starloom.llm.line_dedup import dedupe_lines, lookups, within


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def far(a, b, edits):
    """Whether the counts of signs differ by more than edits can make them: two per edit."""
    return sum((a - b).values()) + sum((b - a).values()) > 2 * edits


def brute_force(rows, edits, min_chars):
    first = {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        for n, line in enumerate(text.split("\n") if text is not None else []):
            if len(line) >= min_chars:
                first.setdefault(line, (doc_id, n))
    late = set()
    lines = list(first)
    signs = {x: Counter(x) for x in lines}
    for i, a in enumerate(lines):
        for b in lines[:i]:
            if abs(len(a) - len(b)) <= edits and not far(signs[a], signs[b], edits) and distance(a, b) <= edits:
                late.add(max(a, b, key=first.get))
    out = {}
    for doc_id, text in rows:
        if text is None:
            out[doc_id] = (None, 0, 0)
            continue
        lines = text.split("\n")
        kept = [
            x for n, x in enumerate(lines) if len(x) < min_chars or (first[x] == (doc_id, n) and x not in late)
        ]
        out[doc_id] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def edited(seed):
    rng = random.Random(seed)
    base = ["abcdefghij" * 3, "the quick brown fox jumps", "pqrs tuv wxyz 0123 äöü ß", "x" * 25, "x" * 26, "short"]

    def line():
        signs = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            at, kind = rng.randrange(len(signs) + 1), rng.random()
            if kind < 0.33:
                signs.insert(at, rng.choice("abx ü"))
            elif at < len(signs):
                signs[at : at + 1] = [rng.choice("abx ü")] if kind < 0.66 else []
        return "".join(signs)

    rows = [(i, "\n".join(line() for _ in range(rng.randint(0, 8)))) for i in range(90)]
    rows += [(1000, None), (1001, ""), (1002, "\n\n"), (1003, "y" * 30_000 + "\n" + "y" * 29_999)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_like_brute_force(documents, scratch, edits):
    rows = [r for r in edited(3) if r[0] != 1003]
    found = dedupe_lines(documents(rows), scratch(), edits, 20).collect()
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in found} == brute_force(rows, edits, 20)


@pytest.mark.parametrize("edits", [0, 1, 2, 4])
def test_bit_parallel_distance(spark, edits):
    lines = [x for _, t in edited(8) if t and len(t) < 1000 for x in t.split("\n") if x][:120]
    pairs = [(a, b) for a in lines for b in lines[:40] if abs(len(a) - len(b)) <= edits]
    frame = spark.createDataFrame(pairs, "a string, b string")
    found = frame.selectExpr("a", "b", within("a", "b", edits) + " AS near").collect()
    assert all(r.near == (distance(r.a, r.b) <= edits) for r in found)
    assert {r.near for r in found} == {True, False} or edits == 0


def test_long_lines(documents, scratch):
    (row,) = dedupe_lines(documents([(1, "y" * 30_000 + "\n" + "y" * 29_999)]), scratch(), 2, 20).collect()
    assert (row.text, row.n_removed) == ("y" * 30_000, 1)


def test_empty_repeated_and_clashing(documents, clashing, scratch):
    assert dedupe_lines(documents([]), scratch(), 2, 20).collect() == []
    line = "a line of more than twenty signs"
    rows = [(1, line), (1, line), (2, line), (None, line), (None, None)]
    found = dedupe_lines(clashing(rows), scratch(), 2, 20).collect()
    assert sorted((r.doc_id or 99, r.text or "", r.n_removed) for r in found) == [
        (1, line, 0), (1, line, 0), (2, "", 1), (99, "", 0), (99, "", 1),
    ]


def test_hot_line_and_segment(documents, scratch):
    """One line in a third of all documents, and many lines with one segment in common."""
    rows = [(i, "the very same line in many documents") for i in range(300)]
    rows += [(i, f"a common beginning of lines {i * 7919 % 100_003:06d} {i * 104_729:012d}") for i in range(300, 700)]
    found = {r.doc_id: r.n_removed for r in dedupe_lines(documents(rows), scratch(), 2, 20).collect()}
    want = {d: v[2] for d, v in brute_force(rows, 2, 20).items()}
    assert found == want


@pytest.mark.parametrize(("edits", "together"), [(1, 2), (2, 2), (2, 9)])
def test_refined_keys(documents, scratch, monkeypatch, edits, together):
    """Pieces that many lines share are refined, down to rests of a few signs."""
    monkeypatch.setattr(line_dedup, "MOST_TOGETHER", together)
    rng = random.Random(edits)
    signs = "abcdefghij"
    lines = ["the same template of all, " + "".join(rng.choices(signs, k=rng.randint(2, 9))) + ", and its long end" for _ in range(60)]
    lines += ["one beginning of many " + "".join(rng.choices(signs, k=30)) for _ in range(30)]
    lines += [f"line number {n:05d} of the whole document" for n in rng.sample(range(100_000), 40)]
    rows = list(enumerate(lines)) + [r for r in edited(4) if r[0] < 60 and r[0] > 40]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    found = dedupe_lines(documents(rows), scratch(), edits, 20).collect()
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in found} == brute_force(rows, edits, 20)


def test_deletions(spark):
    expr = line_dedup._deletions("t", 2)
    frame = spark.createDataFrame([("",), ("a",), ("abc",), ("aab",)], "t string")
    got = {r.t: set(r.d) for r in frame.selectExpr("t", f"{expr} AS d").collect()}
    assert got == {"": {""}, "a": {"a", ""}, "abc": {"abc", "ab", "ac", "bc", "a", "b", "c"}, "aab": {"aab", "aa", "ab", "a", "b"}}


def test_many_lines_of_one_beginning(documents, scratch):
    """20,000 lines that share a beginning and nothing else."""
    rng = random.Random(6)
    rows = [(k, "a beginning they all have" + "".join(rng.choices("abcdefghijklmnop", k=50))) for k in range(20_000)]
    rows += [(20_000, rows[77][1] + "!"), (20_001, rows[99][1][:-2])]
    found = dedupe_lines(documents(rows), scratch(), 2, 20).filter("n_removed > 0").collect()
    assert sorted(r.doc_id for r in found) == [20_000, 20_001]


def brute_force_all(rows, edits, min_chars):
    """With exact repeats of shorter lines removed too, but for blank ones."""
    near = brute_force(rows, edits, min_chars)
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        if text is None:
            out[doc_id] = near[doc_id]
            continue
        long_kept = iter([x for x in near[doc_id][0].split("\n") if len(x) >= min_chars])
        awaited, kept = next(long_kept, None), []
        for line in text.split("\n"):
            if len(line) >= min_chars:
                if line == awaited and line not in seen:
                    kept.append(line)
                    awaited = next(long_kept, None)
            elif not line.strip() or line not in seen:
                kept.append(line)
            seen.add(line)
        n = text.count("\n") + 1
        out[doc_id] = ("\n".join(kept), n, n - len(kept))
    return out


def short_and_long(seed):
    """`edited` with short lines, equal, near and blank ones, dealt among its lines."""
    rng = random.Random(seed)
    short = ["Read more", "Read more.", "Share this article", "这篇文章很好。", "a", "", " ", "\t", "\u3000", "\r"]
    rows = []
    for doc_id, text in edited(seed):
        if doc_id < 1000:
            lines = [*text.split("\n"), *rng.choices(short, k=rng.randint(0, 4))]
            rng.shuffle(lines)
            text = "\n".join(lines)
        rows.append((doc_id, text))
    return [r for r in rows if r[0] != 1003]


def test_exact_repeats_of_short_lines(documents, scratch):
    rows = short_and_long(5)
    found = dedupe_lines(documents(rows), scratch(), 2, 20, short_repeats=True).collect()
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in found} == brute_force_all(rows, 2, 20)


def test_lookups_of_two_edits():
    assert sum(s == 0 for s, _, _ in lookups(2)) == 5
    assert len(lookups(2)) == 12


def test_min_chars_above_edits(documents, scratch):
    with pytest.raises(ValueError):
        dedupe_lines(documents([(1, "a")]), scratch(), 2, 2)


def test_query_and_stage_like_brute_force(spark, tmp_path):
    """The registered query and the pipeline's stage, with their own parameters, kept text included."""
    rows = short_and_long(7)[:60]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    want = brute_force_all(rows, queries.LINE_EDITS, queries.LINE_CHARS)
    sha = lambda text: None if text is None else hashlib.sha256(text.encode()).hexdigest()
    found = queries.op5_line_dedup(spark, str(tmp_path)).collect()
    got = {r.doc_id: (r.kept_sha256, r.n_lines, r.n_removed) for r in found}
    assert got == {i: (sha(text), n, gone) for i, (text, n, gone) in want.items()}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.dedupe_lines(spark, docs, str(tmp_path)).collect()}
    kept = {i: text for i, (text, n, gone) in want.items() if gone == 0 or gone < n}
    assert left == {i: (text, 0 if text is None else len(text)) for i, text in kept.items()}
