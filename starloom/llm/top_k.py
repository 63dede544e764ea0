"""Exact top-k by integer inner product, by the three-phase uniform threshold.

The dimensions are cut into `lists` equal parts. Each part scores every candidate by its own dimensions;
a score is the sum of a candidate's part scores. Per query:

1. Gather: every part's k highest local scores, and its lowest. The candidates seen in any part get a
   lower bound of their score: what is known, and the lowest of a part where they were not seen. The k-th
   highest bound is a score that k candidates reach.
2. Cutoff: scores counted from the parts' lowest ones, a candidate that stays below 1 / lists of the k-th
   bound in each part cannot reach it. The cutoffs are broadcast to the blocks, and only entries at
   or above one in some part are collected.
3. Resolve: of each candidate collected the scores of the other parts are added, and the k
   highest sums are the answer.

Equal vectors are searched once, with their k + 1 smallest ids; that is all of them that a list of k
can hold. Queries and candidates meet in blocks: each row of the joined input is
some blocks of queries with one of candidates. The blocks of candidates are dealt one by one; those of the queries are
broadcast, about `PASS_BYTES` of them at a time, in as many passes as that takes. So the memory of the driver and of
the tasks is bounded and the work is dealt evenly, whatever the number of either.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.common import PARTS, Scratch
from starloom.operators.joins import shuffled

QUERY_BLOCK, VECTOR_BLOCK = 512, 4096
#: So many bytes of queries (8 a component) meet the candidates in one pass.
PASS_BYTES = 16 << 20


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector and all its components are there and finite."""
    good = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col(column).isNotNull() & good)


def of_one_length(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector has the most frequent length, of several the greatest; empty vectors are no candidates.
    Vectors of other lengths have no inner product with these and take no part."""
    size = F.size(column)
    common = vectors.filter(size > 0).groupBy(size.alias("_size")).agg(F.count("*").alias("_n"))
    common = common.orderBy(F.desc("_n"), F.desc("_size")).limit(1)
    return vectors.join(F.broadcast(common.select("_size")), size == F.col("_size"), "left_semi")


def _blocks(rows: DataFrame, key: str, size: int, name: str) -> tuple[DataFrame, int]:
    """Rows of about `size` vectors each: `name`, ids, values (one after the other)."""
    n = rows.count()
    blocks = max(1, -(-n // size))
    dealt = rows.withColumn(name, F.pmod(F.xxhash64(key), F.lit(blocks)))
    packed = dealt.groupBy(name).agg(F.collect_list(F.struct(F.col(key).alias("id"), "v")).alias("rows"))
    return packed.select(name, F.col("rows.id").alias("ids"), F.flatten("rows.v").alias("values")), blocks


def passes(query_blocks: DataFrame, n: int) -> list[DataFrame]:
    """The `n` blocks of queries, written ones, in parts of about `PASS_BYTES`; a block at least."""
    width = query_blocks.agg(F.max(F.size("values") / F.size("ids"))).first()[0] or 0
    each = max(1, int(PASS_BYTES // max(1, QUERY_BLOCK * width * 8)))
    return [query_blocks.filter(F.col("qb").between(first, min(n, first + each) - 1)) for first in range(0, n, each)]


def _matrix(column: pa.Array, row: int, n: int) -> np.ndarray:
    flat = column.slice(row, 1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(n, -1) if n else flat.reshape(0, 1)


def _pairs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list | None]]:
    """Of each block of candidates with each of the queries' blocks in its row: ids and vectors of the candidates,
    then of the queries, and the queries' cutoffs, if there are."""
    for row in range(batch.num_rows):
        reps = np.array(batch.column("ids")[row].as_py(), np.int64)
        x = _matrix(batch.column("values"), row, len(reps))
        asked = batch.column("asked").slice(row, 1).flatten()
        columns = dict(zip([field.name for field in asked.type], asked.flatten(), strict=True))
        for at in range(len(asked)):
            q_ids = np.array(columns["ids"][at].as_py(), np.int64)
            q = _matrix(columns["values"], at, len(q_ids))
            yield reps, x, q_ids, q, columns["cutoffs"][at].as_py() if "cutoffs" in columns else None


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where they hold every sum exactly."""
    largest = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if largest < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def top_k(vectors: DataFrame, queries: DataFrame, scratch: Scratch, k: int, lists: int = 2) -> DataFrame:
    """The `k` rows of `vectors` (vec_id, v: array<long>) with the highest inner product with each row
    of `queries` (vec_id, v), the row of the query's own vec_id left out; ties to the smaller vec_id.

    Returns query_id, rank (from 1), vec_id, score. Rows are assumed usable, of one length, with
    vec_id not null and not repeated. Fewer candidates than k give fewer rows, none give none.
    """
    ids = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "v").withColumn("_n", ids)
    few = few.filter(F.col("_n") <= k + 1)
    classes = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("vec_ids"))
    classes = scratch.keep(classes.withColumn("rep", F.element_at("vec_ids", 1)), "classes")
    asked = scratch.keep(queries.select(F.col("vec_id").cast("long").alias("vec_id"), "v"), "queries")

    query_blocks, n_query = _blocks(asked, "vec_id", QUERY_BLOCK, "qb")
    vector_blocks, n_vector = _blocks(classes.select("rep", "v"), "rep", VECTOR_BLOCK, "vb")
    query_blocks = scratch.keep(query_blocks, "query_blocks")
    vector_blocks = scratch.keep(vector_blocks, "vector_blocks")

    def meet(query_blocks: DataFrame, score: Callable, schema: str) -> list[DataFrame]:
        """`score` of each block of candidates with the blocks of queries (`asked`) of a pass; one for each pass."""
        parts = min(n_vector, PARTS)
        dealt = vector_blocks.repartitionById(parts, F.pmod("vb", F.lit(parts)).cast("int"))
        asked = [some.agg(F.collect_list(F.struct(*some.columns)).alias("asked")) for some in passes(query_blocks, n_query)]
        return [dealt.crossJoin(F.broadcast(some)).mapInArrow(score, schema) for some in asked]

    def kept(scored: list[DataFrame], name: str) -> DataFrame:
        """Pass after pass is run and written, so that the queries of one at a time are broadcast."""
        return reduce(DataFrame.unionAll, [scratch.keep(some, f"{name}_{i}") for i, some in enumerate(scored)])

    # the query's own class can take one of the places
    deep = k + 1

    def parts(width: int) -> list[slice]:
        edges = [width * i // lists for i in range(lists + 1)]
        return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per query and part: the highest scores of this block, and its lowest (rep null)."""
        for batch in batches:
            for reps, x, q_ids, q, _ in _pairs(batch):
                for p, of in enumerate(parts(x.shape[1])):
                    score = _product(q[:, of], x[:, of])
                    few = min(deep, len(reps))
                    top = np.argpartition(-score, few - 1, axis=1)[:, :few]
                    least = score.min(1)
                    n = top.shape[1]
                    unseen = np.repeat([False, True], [len(q_ids) * n, len(q_ids)])
                    yield pa.record_batch(
                        [
                            pa.array(np.concatenate([np.repeat(q_ids, n), q_ids])),
                            pa.array(np.full(len(q_ids) * (n + 1), p), pa.int32()),
                            pa.array(np.concatenate([reps[top].ravel(), q_ids * 0]), mask=unseen),
                            pa.array(np.concatenate([np.take_along_axis(score, top, 1).ravel(), least])),
                        ],
                        names=["query_id", "part", "rep", "score"],
                    )

    gathered = kept(meet(query_blocks, local, "query_id long, part int, rep long, score long"), "local_scores")
    lowest = gathered.filter("rep IS NULL").groupBy("query_id", "part").agg(F.min("score").alias("lowest"))
    shifts = lowest.groupBy("query_id").agg(
        F.sum("lowest").alias("all_lowest"),
        F.transform(F.sort_array(F.collect_list(F.struct("part", "lowest"))), lambda s: s["lowest"]).alias("lowests"),
    )
    first = Window.partitionBy("query_id", "part").orderBy(F.desc("score"), "rep")
    tops = gathered.filter("rep IS NOT NULL").withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= deep)
    bounds = (
        tops.join(lowest, ["query_id", "part"])
        .groupBy("query_id", "rep")
        .agg(F.sum(F.col("score") - F.col("lowest")).alias("above"))
    )
    nth = Window.partitionBy("query_id").orderBy(F.desc("above"), "rep")
    kth = bounds.withColumn("_n", F.row_number().over(nth)).filter(F.col("_n") <= deep)
    # with fewer candidates than places every one is collected
    cut = kth.groupBy("query_id").agg(F.when(F.count("*") == deep, F.min("above")).otherwise(0).alias("bound"))
    cutoffs = scratch.keep(shifts.join(cut, "query_id"), "cutoffs")
    per_block = (
        cutoffs.join(shuffled(asked.select(F.col("vec_id").alias("query_id"))), "query_id")
        .withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(n_query)))
        .groupBy("qb")
        .agg(F.collect_list(F.struct("query_id", "bound", "lowests")).alias("cutoffs"))
    )

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per query: the candidates of this block with an entry at or above the cutoff in some
        part, their other parts added, and of these the highest."""
        for batch in batches:
            for reps, x, q_ids, q, cutoffs in _pairs(batch):
                by_id = {c["query_id"]: c for c in cutoffs}
                bound = np.array([by_id[i]["bound"] for i in q_ids.tolist()], np.int64)
                least = np.array([by_id[i]["lowests"] for i in q_ids.tolist()], np.int64).reshape(len(q_ids), lists)
                scores = [_product(q[:, of], x[:, of]) for of in parts(x.shape[1])]
                enough = np.zeros((len(q_ids), len(reps)), bool)
                for p, score in enumerate(scores):
                    enough |= (score - least[:, p : p + 1]) * lists >= bound[:, None]
                sums = np.where(enough, sum(scores), np.iinfo(np.int64).min)
                at = len(reps) - min(deep, len(reps))
                # at or above a query's last place: the places, and ties with the last
                q_at, x_at = np.nonzero(enough & (sums >= np.partition(sums, at, axis=1)[:, at : at + 1]))
                total = sums[q_at, x_at]
                order = np.lexsort((reps[x_at], -total, q_at))
                q_at, x_at, total = q_at[order], x_at[order], total[order]
                starts = np.searchsorted(q_at, np.arange(len(q_ids)))
                near = np.arange(len(q_at)) - starts[q_at] < deep
                yield pa.record_batch(
                    [pa.array(q_ids[q_at[near]]), pa.array(reps[x_at[near]]), pa.array(total[near])],
                    names=["query_id", "rep", "score"],
                )

    with_cutoffs = scratch.keep(query_blocks.join(shuffled(per_block), "qb"), "query_blocks_with_cutoffs")
    scored = meet(with_cutoffs, resolve, "query_id long, rep long, score long")
    found = scored[0] if len(scored) == 1 else kept(scored, "found")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
    found = found.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= deep)
    members = found.join(classes.select("rep", "vec_ids"), "rep").select(
        "query_id", "score", F.explode("vec_ids").alias("vec_id")
    )
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranks = members.filter("vec_id != query_id").withColumn("rank", F.row_number().over(ranked))
    return ranks.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
