"""Importance resampling against its definition, word by word."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from starloom.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def small(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def runs(text, longest):
    w = WORD.findall(small(text))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def brute_force(rows, target, longest, buckets, seed, least_words, percent):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    of = [runs(t, longest) for _, t in rows]
    s = Counter(bucket(f) for _, fs in of for f in fs)
    t = Counter(bucket(f) for text in target for f in runs(text, longest)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [
        math.floor(1000 * math.log((t[b] + 1.0) * (n_s + buckets) / ((s[b] + 1.0) * (n_t + buckets)))) for b in range(buckets)
    ]
    out = []
    for (doc_id, _), (n, fs) in zip(rows, of, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        out.append([doc_id, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296.0)))])
    able = [r for r in out if r[1] >= least_words]
    key = lambda r: (-r[4], r[0] is None, r[0] or 0, r[1], r[2], r[3])
    ranks = {id(r): k + 1 for k, r in enumerate(sorted(able, key=key)[: len(able) * percent // 100])}
    return [(*r, ranks.get(id(r))) for r in out]


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


ROWS = [
    (1, "The cat sat. The CAT ran; the dog did not."),
    (2, "Étion dans la maison, la MAISON est là."),
    (3, None),
    (4, ""),
    (5, "!!! ... \t\n"),
    (6, "word " * 3000),
    (7, "x" * 5000 + " y"),
    (8, "the cat sat the cat"),
    (8, "the cat sat the cat"),
    (8, "another text of that id"),
    (None, "the cat sat on"),
    (None, None),
    (10, "a1b2_c3-d4Éé　日本語 İstanbul K"),
]


@pytest.mark.parametrize("longest", [1, 3])
def test_like_definition(documents, scratch, longest):
    target = [t for _, t in ROWS[:2]] + [None, "cat"]
    df = resampling.resample(documents(ROWS), documents([(0, t) for t in target]), scratch(), longest, 97, 5, 3, 60)
    assert found(df) == sorted(brute_force(ROWS, target, longest, 97, 5, 3, 60), key=str)


def test_empty_tables(documents, scratch):
    none = documents([])
    assert resampling.resample(none, none, scratch(), 2, 10, 1, 1, 50).collect() == []
    df = resampling.resample(documents(ROWS), none, scratch(), 1, 97, 5, 3, 50)
    assert found(df) == sorted(brute_force(ROWS, [], 1, 97, 5, 3, 50), key=str)


def test_clashing_names(clashing, documents, scratch):
    df = resampling.resample(clashing(ROWS), documents(ROWS[:1]), scratch(), 1, 97, 5, 1, 100)
    assert found(df) == sorted(brute_force(ROWS, [ROWS[0][1]], 1, 97, 5, 1, 100), key=str)


def test_many_equal_rows(documents, scratch, monkeypatch):
    """They are one row until the end, and listed in runs; every rank is given once."""
    monkeypatch.setattr(resampling, "RUN", 16)
    rows = [(9, "the same few words")] * 500 + ROWS
    df = resampling.resample(documents(rows), documents(ROWS), scratch(), 1, 97, 5, 1, 100)
    got = found(df)
    assert got == sorted(brute_force(rows, [t for _, t in ROWS], 1, 97, 5, 1, 100), key=str)
    ranks = sorted(r[-1] for r in got if r[-1])
    assert ranks == list(range(1, len(ranks) + 1))


def test_join_crc():
    rng = np.random.default_rng(3)
    texts = [rng.bytes(n) for n in [*range(20), 255, 256, 5000]]
    pairs = [(a, b) for a in texts for b in texts]
    crc = lambda ts: np.array([zlib.crc32(t) for t in ts], np.uint32)
    first, second = zip(*pairs, strict=True)
    joined = resampling.join_crc(crc(first), crc(second), np.array([len(b) for b in second]))
    assert joined.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_automaton_and_rest_agree(monkeypatch):
    """The same buckets before, while and after words are learned, with few places and small scans."""
    monkeypatch.setattr(resampling, "NEW_WORDS", 5)
    monkeypatch.setattr(resampling, "SCAN_BYTES", 50)
    known = resampling.Dictionary(most=20)
    rng = np.random.default_rng(4)
    sizes = []
    for _ in range(30):
        texts = [" ".join(f"w{n}" for n in rng.zipf(1.4, 60) % 200) + " é" * 3 for _ in range(4)] + [None, ""]
        crcs, at, n_words = resampling.feature_crcs(pa.array(texts), 2, known)
        for i, text in enumerate(texts):
            want = [zlib.crc32(f.encode()) for f in runs(text, 2)[1]]
            assert sorted(crcs[at[i] : at[i + 1]].tolist()) == sorted(want)
            assert n_words[i] == len(WORD.findall(small(text)))
        sizes.append(len(known.crc))
    assert 0 < sizes[-1] <= 20
