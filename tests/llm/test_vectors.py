"""Exact top-k and the metric join, against numpy."""

import math

import numpy as np
import pytest

from starloom.llm import metric_join, queries, top_k


def clustered(seed, n=400, width=12):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(8, width))
    x = centers[rng.integers(0, 8, n)] + rng.normal(size=(n, width)) * rng.choice([0.02, 0.1, 0.5], n)[:, None]
    x[rng.integers(0, n, 30)] = x[0]
    return x


def neighbours(vectors, queries, k):
    out = set()
    for q, a in queries:
        scores = sorted(((-int(np.dot(a, b)), i) for i, b in vectors if i != q))[:k]
        out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)}
    return out


@pytest.mark.parametrize(("lists", "k"), [(1, 3), (2, 10), (3, 10), (5, 1)])
def test_top_k(spark, scratch, monkeypatch, lists, k):
    monkeypatch.setattr(top_k, "QUERY_BLOCK", 7)
    monkeypatch.setattr(top_k, "VECTOR_BLOCK", 50)
    x = np.floor(clustered(1) * 30).astype(np.int64)
    vectors = [(i * 5 - 300, v.tolist()) for i, v in enumerate(x)]
    queries = vectors[::25]
    schema = "vec_id long, v array<long>"
    found = top_k.top_k(
        spark.createDataFrame(vectors, schema), spark.createDataFrame(queries, schema), scratch(), k, lists
    ).collect()
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in found}
    assert len(got) == len(found)
    assert got == neighbours([(i, np.array(v)) for i, v in vectors], [(i, np.array(v)) for i, v in queries], k)


def test_top_k_with_many_equal_vectors_and_few(spark, scratch):
    schema = "vec_id long, v array<long>"
    vectors = [(i, [1, 2]) for i in range(40, 0, -1)] + [(100, [5, 5]), (101, [-1, 0])]
    frame = spark.createDataFrame(vectors, schema)
    as_arrays = [(i, np.array(v)) for i, v in vectors]
    got = {
        (r.query_id, r["rank"], r.vec_id, r.score)
        for r in top_k.top_k(frame, frame.filter("vec_id IN (1, 7, 40, 101)"), scratch(), 5).collect()
    }
    assert got == neighbours(as_arrays, [p for p in as_arrays if p[0] in (1, 7, 40, 101)], 5)
    few = spark.createDataFrame(vectors[:3], schema)
    assert top_k.top_k(few, few, scratch(), 5).count() == 6
    one = spark.createDataFrame(vectors[:1], schema)
    assert top_k.top_k(one, one, scratch(), 5).collect() == []
    none = spark.createDataFrame([], schema)
    assert top_k.top_k(none, none, scratch(), 5).collect() == []
    assert top_k.top_k(few, none, scratch(), 5).collect() == []


def test_large_products_stay_exact():
    a = np.array([[2**30 + 1, 2**30 - 1]])
    assert top_k._product(a, a)[0, 0] == (2**30 + 1) ** 2 + (2**30 - 1) ** 2


def test_usable(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [math.nan, 1.0]), (5, [math.inf]), (6, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {r.vec_id for r in top_k.usable(frame, "embedding").collect()} == {1, 6}


def linked(rows, threshold):
    """vec_id -> (links, component), by all pairs."""
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows], float)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    label = np.array([r[2] for r in rows])
    m = (x @ x.T >= threshold) & (label[:, None] == label[None, :])
    np.fill_diagonal(m, False)
    component = np.array(ids)
    while True:
        new = np.minimum(component, np.where(m, component[None, :], np.iinfo(np.int64).max).min(1))
        if (new == component).all():
            break
        component = new
    return {i: (int(n), int(c)) for i, n, c in zip(ids, m.sum(1), component, strict=True)}


@pytest.mark.parametrize(("cell", "block", "threshold"), [(4096, 2048, 0.98), (40, 16, 0.98), (30, 1000, 0.9)])
def test_metric_join(spark, scratch, monkeypatch, cell, block, threshold):
    monkeypatch.setattr(metric_join, "CELL", cell)
    monkeypatch.setattr(metric_join, "BLOCK", block)
    x = clustered(2)
    rows = [((i * 7919) % 10_007, v.tolist(), i % 2) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = metric_join.group_near(frame, scratch(), threshold).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == linked(rows, threshold)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    assert len(found) == len(rows)


def test_metric_join_of_odd_rows(spark, scratch):
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1),
        (6, [0.0, 0.0], 1), (7, [math.nan, 1.0], 1), (8, [1.0, None], 1), (9, [], 1), (10, [math.inf, 0.0], 1),
        (11, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (12, [1.0, 0.0], 1), (13, [1e200, 0.0], 1),
    ]
    schema = "vec_id long, embedding array<double>, label int"
    found = metric_join.group_near(spark.createDataFrame(rows, schema), scratch(), 0.98).collect()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found}
    assert len(found) == len(rows)
    for i in (3, 4, 5, 6, 7, 8, 9, 10, 11):
        assert got[i] == (0, i, True)
    assert got[1] == (3, 1, True)
    assert got[2] == got[12] == got[13] == (3, 1, False)
    assert got[None] == (0, None, True)
    assert metric_join.group_near(spark.createDataFrame([], schema), scratch(), 0.98).collect() == []


def test_vectors_of_other_lengths(spark, tmp_path):
    """Empty ones, and those of another length than most, take no part in the registered query."""
    rows = [(k, [float(k % 7), 1.0, -float(k % 3)]) for k in range(120)] + [(500, []), (600, [1.0]), (700, [9.0] * 4), (800, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    frame.write.parquet(str(tmp_path / "embeddings.parquet"))
    found = queries.op4_exact_top_k(spark, str(tmp_path)).collect()
    assert {r.query_id for r in found} == {0, 100}
    assert {r.vec_id for r in found} <= set(range(120))
    scores = lambda q: sorted((-sum(int(1024 * a) * int(1024 * b) for a, b in zip(rows[q][1], v, strict=True)), i) for i, v in rows[:120] if i != q)
    for q in (0, 100):
        got = [(-r.score, r.vec_id) for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)]
        assert got == scores(q)[:10]
    spark.createDataFrame([(0, [])], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "none" / "embeddings.parquet"))
    assert queries.op4_exact_top_k(spark, str(tmp_path / "none")).collect() == []


@pytest.mark.parametrize("pass_bytes", [1, 3 * 7 * 12 * 8])
def test_top_k_in_passes(spark, scratch, monkeypatch, pass_bytes):
    """Queries that do not fit one broadcast meet the candidates pass after pass."""
    monkeypatch.setattr(top_k, "QUERY_BLOCK", 7)
    monkeypatch.setattr(top_k, "VECTOR_BLOCK", 50)
    monkeypatch.setattr(top_k, "PASS_BYTES", pass_bytes)
    x = np.floor(clustered(3) * 30).astype(np.int64)
    vectors = [(i, v.tolist()) for i, v in enumerate(x)]
    schema = "vec_id long, v array<long>"
    frame = spark.createDataFrame(vectors, schema)
    found = top_k.top_k(frame, frame.filter("vec_id % 4 = 0"), scratch(), 5).collect()
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in found}
    as_arrays = [(i, np.array(v)) for i, v in vectors]
    assert len(got) == len(found)
    assert got == neighbours(as_arrays, as_arrays[::4], 5)


def test_top_k_copies_no_queries(spark, scratch, monkeypatch):
    """The queries' blocks were copied for each block of candidates, and the copies gathered in the driver."""
    monkeypatch.setattr(top_k, "VECTOR_BLOCK", 50)
    plans, held = [], scratch()
    keep = type(held).keep

    def watched(self, df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return keep(self, df, name)

    monkeypatch.setattr(type(held), "keep", watched)
    vectors = [(i, [i, -i, 7]) for i in range(300)]
    frame = spark.createDataFrame(vectors, "vec_id long, v array<long>")
    assert top_k.top_k(frame, frame.filter("vec_id < 20"), held, 3).count() == 60
    met = [plan for plan in plans if "MapInArrow" in plan]
    assert met and not any("explode(" in plan for plan in met)
