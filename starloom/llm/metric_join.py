"""Near duplicates among vectors of a label, exact, by a metric range join.

On unit vectors a cosine of at least t is a distance of at most r = sqrt(2 - 2 t). Of each large label
some vectors are pivots; every vector has its home in the cell of the nearest. By the triangle
inequality a vector within r of x is nearest to a pivot whose distance from x is at most 2 r more than
that of x's own pivot, so x is copied to the cells of just these; in Euclidean space the same argument on
the plane between two pivots cuts further (d(x, q)^2 - d(x, p)^2 <= 2 r d(p, q)). Each cell then joins
its homes with all its members, independently: every ordered pair is met once, at the first one's home.

A cell's homes and members are dealt into blocks, and a group is one block of each, whatever the size of a
cell. A group returns, for each home vector, how many it is linked with, and pairs that connect what the
links connect, not the links themselves. Equal vectors are joined before, with their number, so
copies cost nothing here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.common import Scratch
from starloom.llm.components import components
from starloom.llm.jaccard_join import connected

#: A label gets a pivot for so many vectors, and all labels together at most MOST_PIVOTS, those with
#: the most vectors first. The pivots go to every task, so their number is bounded; without one a
#: label is a single cell, in blocks.
CELL, MOST_PIVOTS = 4096, 2048
BLOCK = 2048
#: Distances are computed up to this error.
SLACK = 1e-6


def group_near(vectors: DataFrame, scratch: Scratch, threshold: float) -> DataFrame:
    """`vectors` (vec_id, embedding: array of float or double, label) as one row each: vec_id, n_links (other
    vectors of the label with a cosine of at least `threshold`), component_id (the smallest vec_id that
    links reach) and kept (whether it is that one).

    Cosines are computed in double precision. Without a label, or with a vector that is null, zero, of no
    components or holds null or non-finite ones, a row is linked with nothing. Vectors of
    different lengths are not linked. vec_id is taken to be unique; a row without one stays alone, with no
    component_id.
    """
    spark = scratch.spark
    v = F.transform("embedding", lambda x: x.cast("double"))
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v"))
    fit = given.filter(_fits())
    classes = fit.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = scratch.keep(classes, "classes")

    sizes = classes.groupBy("label", F.size("v").alias("width")).agg(F.count("*").alias("n"))
    large = sizes.filter(F.col("n") > CELL).orderBy(F.desc("n"), "label", "width").limit(MOST_PIVOTS // 2).collect()
    wanted, left = [], MOST_PIVOTS
    for row in large:
        pivots = min(-(-row["n"] // CELL), left)
        if pivots > 1:
            wanted.append((row["label"], row["width"], pivots))
            left -= pivots
    pivots: dict[tuple, list] = {}
    if wanted:
        schema = f"label {classes.schema['label'].dataType.simpleString()}, width int, pivots int"
        asked = F.broadcast(spark.createDataFrame(wanted, schema))
        some = classes.withColumn("width", F.size("v")).join(asked, ["label", "width"])
        first = F.row_number().over(Window.partitionBy("label", "width").orderBy(F.xxhash64("rep"), "rep"))
        for row in some.withColumn("_n", first).filter(F.col("_n") <= F.col("pivots")).collect():
            pivots.setdefault((row["label"], row["width"]), []).append(row["v"])
    unit_pivots = {key: _unit(np.array(rows)) for key, rows in pivots.items()}
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            width = np.asarray(pc.list_value_length(lists))
            labels = batch.column("label").to_pylist()
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(labels, width.tolist(), strict=True)):
                groups.setdefault(key, []).append(i)
            for key, rows in groups.items():
                at = np.array(rows)
                if key not in unit_pivots:
                    row, cell, home = at, np.zeros(len(at), np.int64), np.ones(len(at), bool)
                else:
                    p = unit_pivots[key]
                    x = _unit(lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1))
                    near = np.sqrt(np.maximum(0, 2 - 2 * x @ p.T))
                    between = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))
                    own = near.argmin(1)
                    least = near[np.arange(len(at)), own][:, None]
                    copied = near - least <= 2 * reach
                    copied &= near**2 - least**2 <= 2 * reach * between[own] + SLACK
                    copied[np.arange(len(at)), own] = True
                    i, cell = np.nonzero(copied)
                    row, home = at[i], cell == own[i]
                out = batch.take(pa.array(row))
                out = out.append_column("cell", pa.array(cell, pa.int64()))
                yield out.append_column("home", pa.array(home, pa.bool_()))

    label = classes.schema["label"].dataType.simpleString()
    dealt = classes.mapInArrow(
        deal, f"label {label}, v array<double>, rep long, copies long, cell long, home boolean"
    )
    dealt = scratch.keep(dealt.withColumn("width", F.size("v")), "cells")
    of_cell = ["label", "width", "cell"]
    blocks = dealt.groupBy(*of_cell).agg(
        F.ceil(F.count(F.when(F.col("home"), 1)) / BLOCK).alias("rows"), F.ceil(F.count("*") / BLOCK).alias("columns")
    )
    members = dealt.join(blocks.filter("rows > 0"), of_cell)
    part = lambda n: F.pmod(F.xxhash64("rep"), n)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    kept = [*of_cell, "rep", "copies", "v"]
    homes = members.filter("home").select(
        *kept, part(F.col("rows")).alias("i"), upto("columns").alias("j"), F.lit(True).alias("row")
    )
    others = members.select(*kept, upto("rows").alias("i"), part(F.col("columns")).alias("j"), F.lit(False).alias("row"))

    def compare(group: pa.Table) -> pa.Table:
        row = group.column("row").to_numpy()
        rep, copies = group.column("rep").to_numpy(), group.column("copies").to_numpy()
        v = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rep), -1)
        x = _unit(v)
        linked = x[row] @ x[~row].T >= threshold
        linked &= rep[row][:, None] != rep[~row][None, :]
        n = linked @ copies[~row]
        a, b = connected(linked, rep[row], rep[~row])
        some = n > 0
        return pa.table(
            {
                "rep": np.concatenate([rep[row][some], a]),
                "n": pa.array(np.concatenate([n[some], a * 0]), pa.int64()),
                "other": np.concatenate([rep[row][some], b]),
            }
        )

    found = homes.select(*kept, "i", "j", "row").union(others.select(*kept, "i", "j", "row"))
    found = found.groupBy(*of_cell, "i", "j").applyInArrow(compare, "rep long, n long, other long")
    found = scratch.keep(found, "links")
    joined = components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")), scratch, "components")
    counted = found.groupBy("rep").agg(F.sum("n").alias("n"))
    per_class = (
        classes.join(counted, "rep", "left")
        .join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select(
            "label",
            "v",
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    done = fit.join(per_class, ["label", "v"]).select("vec_id", "n_links", "component_id")
    rest = given.filter(~_fits())
    rest = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _fits() -> Column:
    """The conditions of a row that can be linked, never null."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists("v", lambda x: F.coalesce(x != 0, F.lit(False)))
    ids = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    return ids & F.coalesce(finite & nonzero, F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled by their largest component first, so that no square overflows."""
    x = np.asarray(x, float)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))
