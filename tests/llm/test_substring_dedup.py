"""Substring dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from starloom.llm import substring_dedup
from starloom.llm.substring_dedup import dedupe_passages, pack_sorted, unpack_sorted


def brute_force(rows, width):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            window = tuple(words[i : i + width])
            if window in seen:
                gone[i : i + width] = [True] * width
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((doc_id, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def passages(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(200):
        text = []
        for _ in range(rng.randint(0, 6)):
            if rng.random() < 0.5:
                text += [rng.choice("a b c Dé e f g h".split()) for _ in range(rng.randint(1, 15))]
            else:
                fixed = random.Random(rng.randint(0, 9))
                text += [f"{fixed.choice('abc')}{fixed.randint(0, 99)}" for _ in range(40)][: rng.randint(1, 40)]
        if rng.random() < 0.05:
            text += ["x"] * 50
        rows.append((i * 7 - 500, rng.choice([" ", "\n", "\t ", "\x0b"]).join(text)))
    rows += [(None, "q " * 30), (99999, None), (99998, ""), (99997, "  "), (0, rows[3][1]), (0, rows[3][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("width", "group"), [(20, 8), (5, 3), (20, 256), (2, 16)])
def test_like_brute_force(documents, scratch, monkeypatch, width, group):
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    monkeypatch.setattr(substring_dedup, "PART_BYTES", 2000)
    rows = passages(1)
    found = dedupe_passages(documents(rows, 5), scratch(), width).collect()
    assert all(sum(b - a for a, b in r.removed) == r.n_removed for r in found)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found]
    assert sorted(got, key=str) == brute_force(rows, width)


def test_empty_and_clashing(documents, clashing, scratch):
    assert dedupe_passages(documents([]), scratch(), 20).collect() == []
    words = " ".join(f"w{i}" for i in range(30))
    found = dedupe_passages(clashing([(5, words), (3, "x " + words)]), scratch(), 20).collect()
    assert {r.doc_id: (r.n_words, r.n_removed) for r in found} == {3: (31, 0), 5: (30, 30)}


def test_long_text(documents, scratch):
    """A period of 7 words, 70,000 words long: all but the first 7 windows repeat."""
    (row,) = dedupe_passages(documents([(1, "a b c d e f g " * 10_000)]), scratch(), 20).collect()
    assert (row.n_words, row.n_removed) == (70_000, 70_000 - 7)


def _group_sizes(spark, scratch):
    """Documents of each group, which one Python call holds."""
    docs = spark.read.parquet(scratch.path("extended")).filter("hashes IS NULL")
    return [r["count"] for r in docs.groupBy("g").count().collect()]


@pytest.mark.parametrize("of", ["outlier", "no id", "one id", "no id, one beginning"])
def test_groups_are_bounded_whatever_the_ids(spark, documents, scratch, monkeypatch, of):
    monkeypatch.setattr(substring_dedup, "GROUP", 16)
    ids = {"outlier": lambda i: i if i < 299 else 10**9, "one id": lambda i: 7}.get(of, lambda i: None)
    begin = "z " * 300 if "beginning" in of else ""
    rows = [(ids(i), f"{begin}a{i % 50} b{i % 50} c{i % 50} d{i} e{i} f{i}") for i in range(300)]
    folder = scratch()
    found = dedupe_passages(documents(rows), folder, 3).collect()
    assert max(_group_sizes(spark, folder)) <= 16
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found], key=str) == brute_force(rows, 3)


def test_groups_are_bounded_in_bytes(spark, documents, scratch, monkeypatch):
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", 1000, raising=False)
    rows = [(i, f"w{i % 9} " * (150 if i % 2 else 400)) for i in range(40)]
    folder = scratch()
    found = dedupe_passages(documents(rows), folder, 5).collect()
    # any two neighbours have over 1000 bytes
    assert max(_group_sizes(spark, folder)) == 1
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found], key=str) == brute_force(rows, 5)


def test_packed_numbers():
    values = np.array([0, 1, 5, 5 + (1 << 16), 1 << 31, (1 << 32) - 1], np.uint32)
    assert (unpack_sorted(pack_sorted(values)) == values).all()
    values = np.unique(np.random.default_rng(0).integers(0, 1 << 32, 5000, dtype=np.uint32))
    assert (unpack_sorted(pack_sorted(values)) == values).all()
    assert len(pack_sorted(values)) < 3.1 * len(values)
