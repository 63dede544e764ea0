"""The similarity join against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from starloom.llm import jaccard_join
from starloom.llm.components import components
from starloom.llm.jaccard_join import Similarity, group_similar


def brute_force(rows, similarity):
    sets = {}
    for doc_id, text in rows:
        found = (text or "").encode().lower().split()
        n = max(len(found) - similarity.width + 1, 1 if found else 0)
        sets[doc_id] = frozenset(tuple(found[i : i + similarity.width]) for i in range(n))
    parent = {d: d for d in sets}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    holders = defaultdict(list)
    for doc_id in sorted(sets):
        shared = Counter()
        for gram in sets[doc_id]:
            shared.update(holders[gram])
            holders[gram].append(doc_id)
        for other, both in shared.items():
            if similarity.over * both >= similarity.under * (len(sets[doc_id]) + len(sets[other]) - both):
                a, b = top(doc_id), top(other)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), top(d)) for d, s in sets.items()}


def near_copies(seed, documents=500):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 9, 12, 20, 40, 80, 150]))] for _ in range(30)]
    rows = []
    for doc_id in range(documents):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4])):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        if rng.random() < 0.1:
            text += rng.choice(base)[:5]
        rows.append((doc_id * 3 - 100, " ".join(text)))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "A b"), (5004, "a\tB"), (5005, "x")]
    rng.shuffle(rows)
    return rows


def grouped(frame, scratch, similarity):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in group_similar(frame, scratch(), similarity).collect()}


@pytest.mark.parametrize(
    ("similarity", "block", "center_cost"),
    [
        (Similarity(3, 90, 100), 512, 1.2),
        (Similarity(5, 80, 100), 7, 1.2),
        (Similarity(3, 70, 100), 16, 1e9),  # comparisons so dear that segments with one deletion are used
        (Similarity(3, 80, 100), 16, 0.0),
    ],
)
def test_like_brute_force(documents, scratch, monkeypatch, similarity, block, center_cost):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "CENTER_COST", center_cost)
    rows = near_copies(5)
    assert grouped(documents(rows), scratch, similarity) == brute_force(rows, similarity)


def test_frequent_signatures(documents, scratch, monkeypatch):
    """One group of near copies, all of whose signatures count as frequent."""
    monkeypatch.setattr(jaccard_join, "SHOWN", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK", 50)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for doc_id in range(300):
        text = list(base)
        for k in range(rng.randint(0, 6)):
            text[rng.randrange(100)] = f"{doc_id}x{k}"
        rows.append((doc_id, " ".join(text)))
    similarity = Similarity(3, 90, 100)
    assert grouped(documents(rows), scratch, similarity) == brute_force(rows, similarity)


def test_empty_and_clashing(documents, clashing, scratch, spark):
    similarity = Similarity(3, 90, 100)
    assert grouped(documents([]), scratch, similarity) == {}
    rows = [(1, "a b c d"), (2, "A  b c d"), (3, None), (4, "a b"), (2, "A  b c d")]
    assert grouped(clashing(rows), scratch, similarity) == {1: (2, 1), 2: (2, 1), 3: (0, 3), 4: (1, 4)}
    rows = group_similar(documents([(None, "a b c d"), (7, "a b c d")]), scratch(), similarity).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in rows) == [(0, 0), (7, 7)]


def test_hot_copies(documents, scratch):
    rows = [(i, "one two three four five") for i in range(1000, 400, -1)] + [(i, f"w{i} x{i} y{i}") for i in range(300)]
    found = grouped(documents(rows), scratch, Similarity(3, 90, 100))
    assert {found[i][1] for i in range(401, 1001)} == {401}
    assert all(found[i] == (1, i) for i in range(300))


def test_bands_hold_all_partners():
    similarity = Similarity(3, 90, 100)
    plan = jaccard_join.bands({s: 10 for s in range(1, 3000)}, similarity)
    of = {s: k for k, b in enumerate(plan) for s in range(b.first, b.last + 1)}
    for size in range(1, 2700):
        largest = size * 100 // 90
        assert of[min(largest, 2999)] - of[size] <= 1
    for band in plan:
        assert band.exact + 2 * band.deletion >= similarity.most_difference(band.last + band.last * 100 // 90) + 1


def test_allocation():
    few, many = jaccard_join.allocate(30, 100, 4), jaccard_join.allocate(30, 10**13, 4)
    assert few[1] == 0
    assert many[1] > 0
    exact, deletion, smallest = jaccard_join.allocate(500, 10_000, 112)
    assert deletion == 0 and smallest >= 1 and exact > 112
    assert jaccard_join.allocate(5, 10, 1)[0] >= 1


def test_ngrams_count_words_of_ascii_space_only():
    column = pa.array(["a\x0bb c", "a b\xa0c", None, "A B C"])
    grams, at = jaccard_join.ngrams(column, 3)
    assert np.diff(at).tolist() == [1, 1, 0, 1]
    assert grams[0] == grams[2] != grams[1]


def test_fewer_words_than_a_gram_in_all_texts():
    grams, at = jaccard_join.ngrams(pa.array(["a", "b", "a"]), 5)
    assert np.diff(at).tolist() == [1, 1, 1]
    assert grams[0] == grams[2] != grams[1]
    assert len(jaccard_join.ngrams(pa.array([None, ""], pa.string()), 5)[0]) == 0


def test_components(spark, scratch):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(300, 340)]
    links += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)] + [(7, 7)]
    want = {}
    parent = {x: x for pair in links for x in pair}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    want = {x: top(x) for pair in links if pair[0] != pair[1] for x in pair}
    found = components(spark.createDataFrame(links, "a long, b long"), scratch(), "c").collect()
    assert {r.node: r.component for r in found} == want
    assert len(found) == len(want)
    assert components(spark.createDataFrame([], "a long, b long"), scratch(), "c").count() == 0
