"""From the documents table to packed training sequences, in five stages.

Each stage is (spark, docs, sf_dir) -> DataFrame over all rows that the stage before kept; `run` writes
each result as Parquet and reads it as the next one's docs. All but the last return the columns
of their docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from starloom.llm import jaccard_join, language_id, line_dedup, mixing, packing
from starloom.llm.common import Scratch, table
from starloom.llm.queries import (
    CAPACITY,
    LINE_CHARS,
    LINE_EDITS,
    MAX_EPOCHS,
    SEED,
    TOTAL_SHARE,
    WEIGHTS,
    tokenizer_path,
)

#: Near duplicates: five words, a similarity of 0.8.
NEAR = jaccard_join.Similarity(width=5, under=80, over=100)

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def _packed(docs: DataFrame) -> tuple[DataFrame, list]:
    """doc_id, text, and all other columns in one, so that no name can clash with a stage's own."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(*[F.col(f"`{c}`") for c in others], F.lit(True).alias("_")).alias("_row")
    back = [F.col(c) if c in ("doc_id", "text") else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    return docs.select("doc_id", "text", row), back


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model, trained on a sample of them, accepts. Those without a letter,
    empty and null ones included, go; if no document has a lang, all go."""
    Scratch(spark, "language_id")  # brings the package to the executors
    model = language_id.train(docs)
    rows, back = _packed(docs)
    names = ("_lang_pred", "_score", "_accepted")
    return language_id.predict(rows, model, names).filter("_accepted").select(*back)


def dedupe_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that came before, n_chars counted anew. A document that loses all its
    lines goes; null and empty ones stay."""
    rows, back = _packed(docs)
    scratch = Scratch(spark, "line_dedup")
    cleaned = line_dedup.dedupe_lines(rows, scratch, LINE_EDITS, LINE_CHARS, short_repeats=True)
    left = cleaned.filter("n_removed = 0 OR n_removed < n_lines").select(*back)
    if "n_chars" not in docs.columns:
        return left
    kind = docs.schema["n_chars"].dataType
    changed = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(kind))
    return left.withColumn("n_chars", changed)


def _own_ids(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """`docs` (doc_id, text) with an id of its own for each text where several share a doc_id; and these ids with
    their doc_id (`_own`, `doc_id`), None if there are none. Equal rows share theirs."""
    hashes = {"_h1": F.xxhash64("text"), "_h2": F.xxhash64(F.lit(1), "text")}
    pairs = docs.filter("doc_id IS NOT NULL").select("doc_id", *[h.alias(n) for n, h in hashes.items()]).distinct()
    first = F.min(F.struct("_h1", "_h2")).over(Window.partitionBy("doc_id"))
    shared = pairs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    more = pairs.join(shared, "doc_id", "left_semi").withColumn("_first", first).filter("struct(_h1, _h2) != _first")
    more = scratch.keep(more.select("doc_id", "_h1", "_h2", F.monotonically_increasing_id().alias("_n")), "more")
    if more.isEmpty():
        return docs, None
    # below all ids, so that none is taken
    least = docs.agg(F.min("doc_id")).first()[0]
    more = more.select("doc_id", "_h1", "_h2", (F.lit(min(least, 0)) - 1 - F.col("_n")).alias("_own"))
    d, m = docs.withColumns(hashes).alias("d"), more.alias("m")
    same = (F.col("d.doc_id") == F.col("m.doc_id")) & (F.col("d._h1") == F.col("m._h1")) & (F.col("d._h2") == F.col("m._h2"))
    columns = [F.coalesce("_own", "d.doc_id").alias("doc_id") if c == "doc_id" else F.col(f"d.`{c}`") for c in docs.columns]
    return d.join(m, same, "left").select(*columns), more.select("_own", "doc_id")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents joined by links, the one of smallest doc_id. Of equal texts of one doc_id one
    row stays; different ones are documents of their own. Rows without a doc_id stay."""
    scratch = Scratch(spark, "jaccard")
    rows, back = _packed(docs)
    rows, shared = _own_ids(rows, scratch)
    if shared is not None:
        rows = scratch.keep(rows, "own_ids")
    found = jaccard_join.group_similar(rows, scratch, NEAR)
    first = found.filter("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    if shared is not None:
        # the smallest id of a group is that of its smallest doc_id
        members = found.select(F.col("doc_id").alias("_own"), "component_id").distinct().join(shared, "_own", "left")
        members = members.select("_own", "component_id", F.coalesce("doc_id", "_own").alias("doc_id"))
        least = members.groupBy("component_id").agg(F.min(F.struct("doc_id", "_own")).alias("least"))
        first = least.select(F.col("least._own").alias("_kept"))
    with_id = rows.filter("doc_id IS NOT NULL").join(first, F.col("doc_id") == F.col("_kept"), "left_semi")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", F.xxhash64("_row")))
    one = with_id.withColumn("_n", order).filter("_n = 1").drop("_n")
    if shared is not None:
        one = one.join(shared.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_own"), "left")
        one = one.select(F.coalesce("_id", "doc_id").alias("doc_id"), "text", "_row")
    return one.union(rows.filter("doc_id IS NULL")).select(*back)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: repeated rows, or none. Documents without words
    go as often as their source's whole repetitions."""
    scratch = Scratch(spark, "mixing")
    rows, back = _packed(docs)
    rows = rows.select("*", F.col("_row.source").alias("source"), mixing.n_words("text").alias("size"))
    rows = scratch.keep(mixing.numbered(rows), "rows")
    sizes = rows.select("doc_id", "source", "size", "row")
    targets = mixing.source_targets(sizes, WEIGHTS, TOTAL_SHARE, MAX_EPOCHS)
    rates = scratch.keep(mixing.rates(sizes, targets, SEED), "rates")
    mixed = mixing.with_copies(rows, rates, SEED)
    copies = F.explode(F.array_repeat(F.lit(0), F.col("copies")))
    return mixed.select("doc_id", "text", "_row", copies.alias("_copy")).select(*back)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each repetition on its own, with their places in sequences."""
    scratch = Scratch(spark, "packing")
    cut = scratch.keep(packing.pieces(docs, tokenizer_path(), end_id=0, capacity=CAPACITY), "pieces")
    return packing.pack(spark, cut, CAPACITY)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("line_dedup", dedupe_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
