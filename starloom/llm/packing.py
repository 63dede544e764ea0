"""Pack documents into as few token sequences of fixed capacity as it can.

Documents that fit stay whole; longer ones are cut into pieces of the capacity and one rest. How pieces go
together depends on their lengths alone, so the plan is made from the number of pieces of each
length (at most `capacity` numbers, however many documents there are): pieces above a third of the
capacity are matched greedily, at most two to a sequence, the longest first and each with the
longest partner that fits; smaller ones then fill the gaps best-fit, the longest first, before new
sequences are opened. The plan is a list of kinds of sequences with their counts. Pieces find their place by
their rank among the pieces of their length.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm import tokens, words
from starloom.llm.common import with_running_sum


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """`docs` (doc_id, text) as pieces: doc_id, piece, start, length, ids_crc32 and, if asked
    for, ids (little-endian unsigned 32-bit). A null text is empty: one piece, the end id."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer_path)
        for batch in words.slices(batches, 1000):
            ids, at = encoder.encode(batch.column("text"))
            n = np.diff(at) + 1
            count = (n + capacity - 1) // capacity
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(n[doc] - start, capacity)
            ended = np.insert(ids, at[1:], end_id).astype("<u4")
            first = at[doc] + doc + start
            data = [ended[f : f + m].tobytes() for f, m in zip(first.tolist(), length.tolist(), strict=True)]
            columns = {
                "doc_id": batch.column("doc_id").take(pa.array(doc)),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(x) for x in data], pa.int64()),
            }
            if with_ids:
                columns["ids"] = pa.array(data, pa.binary())
            yield pa.record_batch(list(columns.values()), names=list(columns))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Kinds of sequences for `counts` (length -> pieces): (how many, [(length, pieces of it), ...]).

    Works on runs of equal sequences: a step uses up a length or a run of sequences with some
    gap, so the number of steps depends on the capacity and not on the counts.
    """
    left = {z: n for z, n in counts.items() if n}
    runs: list[tuple[int, int, list[tuple[int, int]]]] = []  # how many, gap, content
    large = sorted((z for z in left if 3 * z > capacity), reverse=True)
    for z in large:
        while left[z]:
            partner = next((p for p in large if p <= min(z, capacity - z) and left[p] > (p == z)), None)
            if partner is None:
                runs.append((left[z], capacity - z, [(z, 1)]))
                left[z] = 0
            elif partner == z:
                runs.append((left[z] // 2, capacity - 2 * z, [(z, 2)]))
                left[z] %= 2
            else:
                n = min(left[z], left[partner])
                runs.append((n, capacity - z - partner, [(z, 1), (partner, 1)]))
                left[z] -= n
                left[partner] -= n

    by_gap: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    gaps: list[int] = []

    def put(n: int, gap: int, content: list[tuple[int, int]]) -> None:
        if gap not in by_gap:
            by_gap[gap] = []
            heapq.heappush(gaps, gap)
        by_gap[gap].append((n, content))

    for run in runs:
        put(*run)
    for z in sorted((z for z in left if 3 * z <= capacity), reverse=True):
        fitting = sorted(g for g in by_gap if g >= z)
        while left[z]:
            while fitting and not by_gap[fitting[0]]:
                fitting.pop(0)
            if fitting:
                gap = fitting[0]
                n, content = by_gap[gap].pop()
            else:
                gap, n, content = capacity, left[z], []
            each = gap // z
            full = min(n, left[z] // each)
            if full:
                put(full, gap - each * z, [*content, (z, each)])
                left[z] -= full * each
            n -= full
            if n and left[z]:  # fewer than one sequence takes
                put(1, gap - left[z] * z, [*content, (z, left[z])])
                left[z] = 0
                n -= 1
            if n and content:
                put(n, gap, content)
    return [(n, content) for gap in sorted(by_gap) for n, content in by_gap[gap]]


def places(kinds: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: (length, first rank, end rank, first sequence,
    pieces per sequence, offset)."""
    rows, sequence, ranks = [], 0, {}
    for n, content in kinds:
        offset = 0
        for z, each in content:
            first = ranks.get(z, 0)
            ranks[z] = first + n * each
            rows.append((z, first, ranks[z], sequence, each, offset))
            offset += z * each
        sequence += n
    return rows


def pack(spark: SparkSession, cut: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to `cut`, a written table of pieces (doc_id, piece, start, length,
    ids_crc32, ...).

    Only the counts per length reach the driver. The table of places is broadcast: its size depends on
    the capacity alone. Repeated rows each get a place. Without rows the result is empty.
    """
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    rows = places(plan(counts, capacity))
    where = spark.createDataFrame(
        rows or [(0, 0, 0, 0, 1, 0)],
        "_length long, _first long, _end long, _sequence long, _each long, _offset long",
    )
    ranked = with_running_sum(cut, ["length"], ["doc_id", "piece", "ids_crc32"], F.lit(1), "_rank")
    here = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end"))
    rank = F.col("_rank") - F.col("_first")
    each = F.col("_each")
    return ranked.join(F.broadcast(where), here).select(
        *cut.columns,
        (F.col("_sequence") + F.floor(rank / each)).alias("sequence_id"),
        (F.col("_offset") + rank % each * F.col("length")).alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces with their ids: sequence_id, ids (array of
    long), doc_ids. A sequence holds at most `capacity` ids, so a group is small."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("parts").to_pylist()
            ids = [np.frombuffer(b"".join(p["ids"] for p in r), "<u4").astype(np.int64) for r in rows]
            docs = [[p["doc_id"] for p in r] for r in rows]
            yield pa.record_batch(
                [batch.column("sequence_id"), pa.array(ids, pa.list_(pa.int64())), pa.array(docs, pa.list_(pa.int64()))],
                names=["sequence_id", "ids", "doc_ids"],
            )

    return packed.groupBy("sequence_id").agg(ordered.alias("parts")).mapInArrow(
        join, "sequence_id long, ids array<long>, doc_ids array<long>"
    )
