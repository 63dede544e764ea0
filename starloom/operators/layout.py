"""Rows laid out so that each file holds a narrow range of several columns at once.

Each column's values get a rank of BITS bits, and the ranks' bits are interleaved, the highest first. The leading bits
are a row's cell: 2 ** (columns * k) cells cut every column into 2 ** k ranges, so a filter on one of three columns
finds its value within the bounds of files ** (2 / 3) files, and Parquet's statistics skip the others' rows. Within a
file rows go by all bits. Sorting by one column first would serve that column alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 5
#: The bounds of the ranks are taken from so many different values of a column, those of the smallest hashes.
SAMPLE = 10_000


def bounds(df: DataFrame, column: str, parts: int, sample: int = SAMPLE) -> list[Any]:
    """Values that cut a column's different values into about equal parts, in order; fewer if it has fewer."""
    values = df.select(F.col(column).alias("v")).filter("v IS NOT NULL").distinct()
    chosen = sorted(r.v for r in values.orderBy(F.xxhash64("v"), "v").limit(sample).collect())
    cuts = {chosen[len(chosen) * k // parts] for k in range(1, parts)} if chosen else set()
    return sorted(cuts)


def interleaved(df: DataFrame, columns: Sequence[str], bits: int = BITS) -> Column:
    """The interleaved ranks of the columns; nulls and values below the first bound have rank 0."""
    if not 0 < bits * len(columns) < 64:
        raise ValueError(f"{bits} bits of each of {list(columns)} do not fit into 63")
    z = F.lit(0).cast("long")
    for at, column in enumerate(columns):
        rank = F.lit(0)
        for bound in bounds(df, column, 1 << bits):
            rank = rank + F.coalesce((F.col(column) >= F.lit(bound)).cast("int"), F.lit(0))
        for bit in range(bits):
            one = F.shiftright(rank, bit).bitwiseAND(1).cast("long")
            z = z.bitwiseOR(F.shiftleft(one, bit * len(columns) + len(columns) - 1 - at))
    return z


def clustered(df: DataFrame, columns: Sequence[str], files: int, bits: int = BITS) -> DataFrame:
    """`df` dealt to about `files` files by cells of the interleaved columns. A cell with more rows than a file's share
    gets more files, among which a hash of the row decides.

    `df` is read once per column, once to count the cells (at most `files`) and once more, so it is best a written table.
    """
    n = len(columns)
    kept = min(bits, max(0, (files.bit_length() - 1) // n))
    marked = df.withColumn("_z", interleaved(df, columns, bits))
    marked = marked.withColumn("_cell", F.shiftright("_z", (bits - kept) * n))
    counts = marked.groupBy("_cell").agg(F.count("*").alias("n")).collect()
    share = max(1, sum(r.n for r in counts) // files)
    first, rows = 0, []
    for r in sorted(counts, key=lambda r: r["_cell"]):
        parts = max(1, round(r.n / share))
        rows.append((r["_cell"], first, parts))
        first += parts
    places = df.sparkSession.createDataFrame(rows, "_cell long, _first int, _parts int")
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.col("_parts"))
    placed = marked.join(F.broadcast(places), "_cell").withColumn("_file", (F.col("_first") + spread).cast("int"))
    dealt = placed.repartitionById(max(1, first), "_file").sortWithinPartitions("_z")
    return dealt.select(*df.columns)
