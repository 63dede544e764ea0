"""Mix sources to target weights, without passing a limit of repetitions per source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.common import WORD_PATTERN, small, with_running_sum

#: Up to so many sources (some 100 bytes each) their rates are broadcast; beyond, joined.
MOST_SOURCES = 200_000


def n_words(text: Column | str) -> Column:
    """Words of a text; of a null, 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float], total_share: float, max_epochs: float
) -> DataFrame:
    """Capped water-filling over the sources of `sizes` (source, size).

    The sources, by code point and null last, have the `weights`, repeating. They share
    `total_share` of the sum of all sizes by weight; a source's share stops at `max_epochs` times
    its own size and what is above goes to the others by weight, until none is above. In one pass: at
    the water level L a source gets min(max_epochs * size, L * weight), so sources fill up in the
    order of size / weight, and running sums in that order tell which are full at the final level.

    Returns source, source_size, target. One row per source goes through one task.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    position = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (position - 1) % len(weights) + 1)
    s = per_source.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(max_epochs))
    filling = Window.partitionBy(F.lit(0)).orderBy(
        F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last()
    )
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    s = s.withColumns(
        {
            "_total": F.sum("source_size").over(everything) * F.lit(total_share),
            "_all_w": F.sum("_w").over(everything),
            "_caps_before": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
            "_w_before": F.coalesce(F.sum("_w").over(before), F.lit(0.0)),
        }
    )
    # full if the level that the sources not yet full would reach is at or above its own
    rest, rest_w = F.col("_total") - F.col("_caps_before"), F.col("_all_w") - F.col("_w_before")
    s = s.withColumn("_full", F.col("_w") * rest / rest_w >= F.col("_cap"))
    s = s.withColumns(
        {
            "_full_caps": F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(everything),
            "_open_w": F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_w"))).over(everything),
        }
    )
    share = F.col("_w") * (F.col("_total") - F.col("_full_caps")) / F.col("_open_w")
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(share)
    return s.select("source", "source_size", target.alias("target"))


def place(doc_id: Column | str, seed: int) -> Column:
    """Seeded random order of documents, as text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))


def numbered(docs: DataFrame) -> DataFrame:
    """`docs` with `row`, a number of each row: what tells rows apart that share a doc_id. Rows get others when it
    is worked out anew, so write the result and use that."""
    return docs.withColumn("row", F.monotonically_increasing_id())


def rates(sizes: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """Per source: source_size, target, `whole` and `until`, for `with_copies`.

    The rate of a source is target / source_size. Each row is taken floor(rate) times, and the rows that
    come first in a seeded random order of the source once more, until their sizes have the rest of the
    rate; the row at the border goes where the total is nearer to the target. So a source misses its
    target by at most half a row, and reruns agree. Rows of one doc_id, or of none, follow each other in that order,
    by size and row. `until` is the place, size and row of the last that is taken once more, null if there is none.
    A source without words has rate 0. `sizes` (doc_id, source, size, row) must be a written table: it is read
    several times.
    """
    seeded = sizes.select("source", "size", "doc_id", "row", F.lit(str(seed)).alias("_seed"))
    placed = with_running_sum(seeded, ["source"], ["_seed", "doc_id"], F.col("size"), "_before", ties=["size", "row"])
    t = targets.withColumn("whole", F.floor(F.col("target") / F.nullif("source_size", F.lit(0))))
    t = t.withColumn("_rest", F.col("target") - F.col("whole") * F.col("source_size"))
    renamed = t.withColumnRenamed("source", "_source")
    again = placed.join(renamed, F.col("source").eqNullSafe(F.col("_source"))).filter(
        F.col("_before") + F.col("size") / 2 <= F.col("_rest")
    )
    at = again.select(F.col("source").alias("_source"), place("doc_id", seed).alias("_place"), "size", "row")
    last = at.groupBy("_source").agg(F.max(F.struct("_place", "size", "row")).alias("until"))
    joined = t.join(last, F.col("source").eqNullSafe(F.col("_source")), "left")
    return joined.select("source", "source_size", "target", "whole", "until")


def with_copies(docs: DataFrame, per_source: DataFrame, seed: int) -> DataFrame:
    """`docs` (doc_id, source, size, row, and any others) with the times the mix takes each row (`copies`) and its
    source's source_size and target, in place of columns of these names. `per_source`, from `rates`, is best a
    written table."""
    r = small(per_source.select(*[F.col(c).alias(f"_r_{c}") for c in per_source.columns]), MOST_SOURCES)
    joined = docs.join(r, docs["source"].eqNullSafe(F.col("_r_source")))
    here = F.struct(place("doc_id", seed).alias("_place"), F.col("size").cast("long"), F.col("row"))
    again = F.coalesce(here <= F.col("_r_until"), F.lit(False))
    copies = F.coalesce(F.col("_r_whole") + again.cast("long"), F.lit(0)).cast("int")
    others = [docs[c] for c in docs.columns if c not in ("source_size", "target", "copies")]
    return joined.select(
        *others, F.col("_r_source_size").alias("source_size"), F.col("_r_target").alias("target"), copies.alias("copies")
    )
