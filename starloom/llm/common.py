"""What the operators share: input tables, written intermediate tables, even ranks."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.session import scratch_dir

#: A word is a run of bytes other than space and \t \n \v \f \r. `bytes.split()` cuts there too.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Groups that are ranked or summed in order are dealt into so many parts by a hash.
PARTS = 4096


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Have Spark bring this package to the executors, for the operators' Python functions.

    Rows with whole texts are long, so batches between the JVM and Python are made smaller than Spark's
    default in sessions that have not set their size.
    """
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "1000")
    if (app := spark.sparkContext.applicationId) in _shipped:
        return
    _shipped.add(app)
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    # stays as long as the application: the driver serves it to executors that start later
    path = os.path.join(tempfile.mkdtemp(prefix="starloom-"), "starloom.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for at, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(at, name)
                    archive.write(file, os.path.relpath(file, os.path.dirname(package)))
    spark.sparkContext.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Scratch:
    """Written intermediate tables in a new folder below `spark.checkpoint.dir`.

    They cut lineage: what reads them survives the loss of executors without doing the work
    before them again.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship_package(spark)
        self.spark = spark
        self.folder = f"{scratch_dir(spark)}-{name}"

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """`df`, a table cheap to count, to be broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def with_running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], amount: Column, name: str, ties: Sequence[str] = ()
) -> DataFrame:
    """Add `name`: the sum of `amount` over the rows before this one in its group (`keys`), in
    the order of an md5 of the `order` columns (as text), ties by the columns themselves, then by `ties`.

    A group may hold any share of the rows: its rows are dealt by the first digits of the md5
    into `PARTS` parts, whose sums are added up in order, and only within a part rows are sorted.
    Equal rows get different sums, in any order. `df` is read twice: pass a written table.
    """
    text = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order])
    hashed = df.withColumn("_h", F.md5(text)).withColumn("_amount", amount.cast("long"))
    hashed = hashed.withColumn("_part", F.substring("_h", 1, 3))
    same = [F.col(f"_a.{k}").eqNullSafe(F.col(f"_b.{k}")) for k in [*keys, "_part"]]
    sums = hashed.groupBy(*keys, "_part").agg(F.sum("_amount").alias("_sum"))
    earlier_parts = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(earlier_parts), F.lit(0))).drop("_sum")
    within = (
        Window.partitionBy(*keys, "_part")
        .orderBy("_h", *order, *ties, "_amount")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = hashed.withColumn("_before", F.coalesce(F.sum("_amount").over(within), F.lit(0)))
    on = same[0]
    for part in same[1:]:
        on = on & part
    joined = rows.alias("_a").join(starts.alias("_b"), on)
    return joined.select(
        *[F.col(f"_a.`{c}`") for c in df.columns],
        (F.col("_a._before") + F.col("_b._start")).alias(name),
    )
