"""Water-filling and sampling."""

import pytest

from starloom.llm import mixing


def targets_of(spark, sizes, weights=(5, 2, 1), share=1.5, epochs=2):
    frame = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    return {r.source: r.target for r in mixing.source_targets(frame, weights, share, epochs).collect()}


def filled_step_by_step(sizes, weights, share, epochs):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, open_ = {}, dict(weight)
    while open_:
        rest = share * sum(sizes.values()) - sum(capped.values())
        level = rest / sum(open_.values())
        over = [s for s, w in open_.items() if w * level > epochs * sizes[s]]
        if not over:
            return capped | {s: w * level for s, w in open_.items()}
        for s in over:
            capped[s] = epochs * sizes[s]
            del open_[s]
    return capped


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 100, "b": 100, "c": 100},
        {"a": 10, "b": 1000, "c": 50, "d": 7, None: 300, "é": 90, "Z": 40},
        {"a": 1, "b": 1, "c": 10_000, "d": 3},
        {"only": 12},
        {"a": 0, "b": 10},
    ],
)
def test_water_filling(spark, sizes):
    found = targets_of(spark, sizes)
    want = filled_step_by_step(sizes, (5, 2, 1), 1.5, 2)
    assert found == pytest.approx(want)
    assert sum(found.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(found[s] <= 2 * n + 1e-9 for s, n in sizes.items())


def mixed(spark, scratch, rows, seed=7):
    s = scratch()
    sizes = spark.createDataFrame(rows, "doc_id long, source string, size long, target string")
    sizes = s.keep(mixing.numbered(sizes.repartition(3) if rows else sizes), "sizes")
    targets = mixing.source_targets(sizes, (5, 2, 1), 1.5, 2)
    rates = s.keep(mixing.rates(sizes, targets, seed), "rates")
    return mixing.with_copies(sizes, rates, seed).collect()


def test_sampling(spark, scratch):
    rows = [(i, "abcdef"[i % 6] if i % 7 else None, 10 + i * 37 % 90, "x") for i in range(2000)]
    first = mixed(spark, scratch, rows)
    assert len(first) == 2000
    taken = {}
    for r in first:
        assert 0 <= r.copies <= 2
        taken[r.source, r.target] = taken.get((r.source, r.target), 0) + r.copies * r.size
    assert all(abs(n - target) <= 50 for (_, target), n in taken.items())
    again = {r.doc_id: r.copies for r in mixed(spark, scratch, rows)}
    assert again == {r.doc_id: r.copies for r in first}
    other = {r.doc_id: r.copies for r in mixed(spark, scratch, rows, seed=8)}
    assert other != again


def test_sampling_of_odd_inputs(spark, scratch):
    assert mixed(spark, scratch, []) == []
    assert [r.copies for r in mixed(spark, scratch, [(1, None, 0, None), (None, None, 0, None)])] == [0, 0]
    rows = [(1, "a", 5, ""), (1, "a", 5, ""), (2, "a", 5, ""), (None, None, 9, ""), (3, "hot", 1000, "")]
    assert len(mixed(spark, scratch, rows)) == 5


@pytest.mark.parametrize("doc_id", [None, 5])
def test_rows_of_one_id_are_taken_one_by_one(spark, scratch, doc_id):
    """Equal rows, of one doc_id or none, and rows of it that differ in size: the border runs between them."""
    rows = [(doc_id, "a", 4, "") for _ in range(1000)] + [(k, "b", 10, "") for k in range(100, 150)]
    rows += [(doc_id, "b", 3 + k % 5, "") for k in range(200)]
    taken, targets = {}, {}
    for r in mixed(spark, scratch, rows):
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
        targets[r.source] = r.target
    assert all(abs(taken[s] - targets[s]) <= 5 for s in targets)


def test_clashing_names(spark, scratch):
    s = scratch()
    docs = spark.range(50).selectExpr(
        "id AS doc_id", "'a' AS source", "id AS size", "'x' AS whole", "'y' AS until", "'z' AS target", "1 AS copies", "2 AS source_size"
    )
    docs = s.keep(mixing.numbered(docs), "docs")
    targets = mixing.source_targets(docs.select("source", "size"), (1,), 1.5, 2)
    rates = s.keep(mixing.rates(docs, targets, 7), "rates")
    got = mixing.with_copies(docs, rates, 7).collect()
    assert len(got) == 50 and all((r.whole, r.until, r.source_size) == ("x", "y", 1225) for r in got)
    assert abs(sum(r.copies * r.size for r in got) - 1.5 * 1225) <= 25


def test_words(spark):
    texts = [("a b",), ("",), (None,), (" \t\n",), ("x\xa0y z\x1cq\x0bw",)]
    frame = spark.createDataFrame(texts, "text string")
    assert [r.n for r in frame.select(mixing.n_words("text").alias("n")).collect()] == [2, 0, 0, 0, 3]
