"""Equi-joins that stay balanced when one key holds a large share of the rows.

Adaptive execution splits uneven join partitions by itself, and is all that most joins need. Keys
known to be hot beforehand, from `count_hot_keys`, are spread whatever the settings.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more rows than this is hot; it is split into parts of about this many rows.
HOT_ROWS = 10_000_000
#: Values are first counted by so many hash buckets per column.
HOT_BUCKETS = 1 << 16
#: A table of more rows is never broadcast. So many rows of a few numbers take some 55 MB of the driver's memory.
BROADCAST_ROWS = 500_000


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the data, never to be broadcast.

    Spark takes the bytes of a table's files for its size. Of compressed columns a few MB hold millions of rows, which
    it would gather and hash in the driver's memory.
    """
    return df.hint("merge")


def by_rows(df: DataFrame) -> DataFrame:
    """A side of a join, columns of a written table: left to Spark if it has at most `BROADCAST_ROWS` rows, else
    `shuffled`. The rows are counted at once, from the ends of the files."""
    return df if df.count() <= BROADCAST_ROWS else shuffled(df)


def count_hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """`key` (a column's name), `value` (as text) and `rows` of the values of these columns that have
    more than `hot_rows` rows. Exact counts.

    A first pass, run at once, counts the rows per column and hash bucket. Only values of a bucket with more than
    `hot_rows` rows can be hot, and only these are shuffled and counted one by one, in one pass more: on most data
    there are none. `df` is best a written table."""
    text = {k: F.col(k).cast("string") for k in keys}
    bucket = {k: F.pmod(F.xxhash64(text[k]), F.lit(HOT_BUCKETS)).cast("int") for k in keys}
    places = F.array(*[F.struct(F.lit(i).alias("key"), bucket[k].alias("bucket")) for i, k in enumerate(keys)])
    sums = df.select(F.explode(places).alias("p")).groupBy("p.key", "p.bucket").agg(F.count("*").alias("rows"))
    wide: dict[str, list[int]] = {}
    for row in sums.filter(F.col("rows") > hot_rows).collect():
        wide.setdefault(keys[row["key"]], []).append(row["bucket"])
    if not wide:
        return df.sparkSession.sql("SELECT '' AS key, '' AS value, 0L AS rows WHERE false")
    pairs = [
        F.when(bucket[k].isin(found), F.struct(F.lit(k).alias("key"), text[k].alias("value"))) for k, found in wide.items()
    ]
    pair = df.select(F.explode(F.array_compact(F.array(*pairs))).alias("p"))
    counts = pair.groupBy("p.key", "p.value").agg(F.count("*").alias("rows"))
    return counts.filter((F.col("rows") > hot_rows) & F.col("value").isNotNull())


@dataclass(frozen=True)
class HotKeys:
    """Hot values of one column, and into how many parts to split each."""

    parts: tuple[tuple[str, int], ...] = ()
    hot_rows: int = HOT_ROWS

    @staticmethod
    def of(counts: DataFrame, hot_rows: int = HOT_ROWS) -> dict[str, HotKeys]:
        """By column, from a table that `count_hot_keys` made: at most a row per column and `hot_rows`
        rows of the data, 300,000 for three columns of 10^12 rows."""
        found: dict[str, list[Any]] = {}
        for row in counts.collect():
            found.setdefault(row["key"], []).append((row["value"], -(-row["rows"] // hot_rows)))
        return {key: HotKeys(tuple(sorted(parts)), hot_rows) for key, parts in found.items()}


def join_many_to_one(
    many: DataFrame,
    one: DataFrame,
    key: str,
    how: str = "inner",
    hot: HotKeys | None = None,
    null_keys: bool = True,
) -> DataFrame:
    """Join `many`, whose `key` may have hot values, to `one`, which has few rows per key.

    Without hot keys this is Spark's join, with a second key that is always 0: both sides are then shuffled
    for this very join even if `one` is already dealt by `key`, and so adaptive execution can split
    an uneven partition. Rows with a hot key are joined apart: equal ones are
    counted, each count is cut into chunks of at most `hot_rows`, the chunks are dealt to parts by a
    hash, and the key's rows in `one` are copied to each part; afterwards a chunk becomes its rows again.
    This depends on the rows alone, so a repeated task deals them alike.

    In a left join rows without a key find nothing, so they go past it, unless `null_keys` says
    that there are none.
    """
    if how == "left" and null_keys:
        joined = join_many_to_one(many.filter(F.col(key).isNotNull()), one, key, how, hot, null_keys=False)
        return joined.unionByName(many.filter(F.col(key).isNull()), allowMissingColumns=True)
    if hot is None or not hot.parts:
        part = F.pmod(F.hash(F.col(key)), F.lit(1))  # of any type; the optimizer does not see that it is 0
        return many.withColumn("_part", part).join(one.withColumn("_part", part), [key, "_part"], how).drop("_part")
    limits = many.sparkSession.createDataFrame(list(hot.parts), "_hot string, _parts long")
    limits = F.broadcast(limits)
    is_hot = lambda df: df[key].cast("string") == limits["_hot"]
    cold = join_many_to_one(many.join(limits, is_hot(many), "left_anti"), one, key, how, null_keys=False)

    spread = many.join(limits, is_hot(many)).drop("_hot")
    counted = spread.groupBy(*spread.columns).agg(F.count("*").alias("_n"))
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / hot.hot_rows)))
    chunked = counted.withColumn("_chunk", chunks).withColumns(
        {
            "_part": F.pmod(F.xxhash64(*many.columns) + F.col("_chunk"), F.col("_parts")),
            "_n": F.least(F.col("_n") - F.col("_chunk") * hot.hot_rows, F.lit(hot.hot_rows)).cast("int"),
        }
    )
    # `one` may hold the key as another type, so its parts come from the keys that `many` has
    present = chunked.select(F.col(key).alias("_key"), "_parts").distinct()
    copied = one.join(F.broadcast(present), one[key] == F.col("_key")).drop(key).withColumnRenamed("_key", key)
    copied = copied.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    joined = chunked.drop("_parts", "_chunk").join(copied.drop("_parts"), [key, "_part"], how)
    rows = joined.withColumn("_row", F.explode(F.array_repeat(F.lit(0), F.col("_n"))))
    return cold.unionByName(rows.select(*cold.columns))


def left_join_one_to_many(
    one: DataFrame, many: DataFrame, one_key: str, many_key: str, hot: HotKeys | None = None
) -> DataFrame:
    """Left outer join to `many`, the side with possibly hot keys; the key names differ.

    Without hot keys this is Spark's join, each side read once. The right side of a left outer join
    cannot be split, so with hot keys the matches come from an inner join, which can, and the rows
    without a match from the distinct keys of `many`.
    """
    if hot is None or not hot.parts:
        return one.join(many, F.col(one_key) == F.col(many_key), "left")
    matched = join_many_to_one(many.withColumn(one_key, F.col(many_key)), one, one_key, hot=hot)
    keys = many.select(F.col(many_key).alias(one_key)).distinct()
    unmatched = one.join(keys, one_key, "left_anti")
    return matched.select(*one.columns, *many.columns).unionByName(unmatched, allowMissingColumns=True)
