"""Importance resampling towards a target distribution, over hashed word n-grams.

Features are the runs of 1 to `longest` consecutive words, joined by one space; a feature's bucket is the
CRC-32 of its bytes modulo the number of buckets. An Aho-Corasick automaton holds words with a delimiter on
either side and, as payload, each word's CRC and length. One scan of a text emits the payloads of its words
in order, and the CRC of a longer feature is composed of those of its neighbours (`join_crc`), without
hashing its bytes. A worker's automaton holds at most MOST_WORDS words, those it has met more than once
first; the CRC of any other word is taken of its bytes, so the buckets are exact whatever it holds.

Buckets are counted over all documents and all target texts; a bucket's gain is the logarithm of how much more
frequent it is in the target, smoothed by one, and a document's weight the mean gain of its features. With
Gumbel noise, seeded by document, the highest scores are a sample without replacement in proportion to
the weights.

Words are runs of digits, letters and non-ASCII signs, A-Z made small. A null text has none. Rows of equal or null
doc_id get the same noise (null counts as the empty text); each is a row of its own and has its own rank.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm import words
from starloom.llm.common import Scratch

#: Of the words in an automaton: their number (some 150 bytes each) and their longest.
MOST_WORDS, LONGEST_WORD = 50_000, 64
#: An automaton is built anew when so many words more are known, and a quarter of those it has.
NEW_WORDS = 2_000
SCAN_BYTES = 1 << 20
#: Rows of equal values are listed in runs of so many.
RUN = 1 << 16

_SPACE = 0x20
_FOLD = np.full(256, _SPACE, np.uint8)
for _low, _high, _move in ((0x30, 0x39, 0), (0x41, 0x5A, 32), (0x61, 0x7A, 0), (0x80, 0xFF, 0)):
    _FOLD[_low : _high + 1] = np.arange(_low, _high + 1) + _move

POLYNOMIAL = 0xEDB88320


@cache
def _shift_by(length: int) -> np.ndarray:
    """What `length` zero bytes after a text do to its CRC, for each value of each of its four bytes."""

    def through(by_bit: list[int], crc: int) -> int:
        out = 0
        for i in range(32):
            if crc >> i & 1:
                out ^= by_bit[i]
        return out

    # one zero bit: the bits move down, the lowest one out and through the polynomial
    power = [POLYNOMIAL, *[1 << i for i in range(31)]]
    moved = [1 << i for i in range(32)]
    bits = 8 * length
    while bits:
        if bits & 1:
            moved = [through(power, x) for x in moved]
        power = [through(power, x) for x in power]
        bits >>= 1
    return np.array([[through(moved, v << 8 * k) for v in range(256)] for k in range(4)], np.uint32)


def join_crc(first: np.ndarray, second: np.ndarray, second_length: np.ndarray) -> np.ndarray:
    """The CRC-32 of each first text with its second after it, from theirs and the second's length."""
    moved = np.empty(len(first), np.uint32)
    distinct, of = np.unique(second_length, return_inverse=True)
    for k, length in enumerate(distinct.tolist()):
        rows = of == k
        table, crc = _shift_by(length), first[rows]
        moved[rows] = (
            table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]
        )
    return moved ^ second


@dataclass
class Dictionary:
    """Words with a delimiter on either side, in an automaton, and their payloads by number."""

    most: int = MOST_WORDS
    crc: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    length: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def __post_init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.seen: Counter[str] = Counter()

    def learn(self, missed: Counter[str]) -> None:
        """Count words that were missed; enter those met twice when there are enough of them."""
        room = self.most - len(self.crc)
        if room <= 0:
            return
        self.seen.update(missed)
        enough = max(NEW_WORDS, len(self.crc) // 4)
        if len(self.seen) < enough:
            return
        new = [w for w, n in self.seen.most_common() if n > 1][:room]
        if len(new) >= min(enough, room):
            for k, word in enumerate(new, len(self.crc)):
                self.automaton.add_word(f" {word} ", k)
            self.automaton.make_automaton()
            raw = [w.encode("latin-1") for w in new]
            self.crc = np.concatenate([self.crc, np.array([zlib.crc32(w) for w in raw], np.uint32)])
            self.length = np.concatenate([self.length, np.array([len(w) for w in raw], np.int64)])
            self.seen.clear()
        elif len(self.seen) > 4 * self.most:
            self.seen.clear()

    def payloads(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """CRC and length of every word of `data` (folded bytes, a space first and last)."""
        crc, length = np.zeros(len(start), np.uint32), end - start
        known = np.zeros(len(start), bool)
        i = 0
        while i < len(start) and len(self.crc):
            j = max(i + 1, int(np.searchsorted(end, start[i] + SCAN_BYTES, "right")))
            base = start[i] - 1
            text = data[base : end[j - 1] + 1].tobytes().decode("latin-1")
            found = np.fromiter(itertools.chain.from_iterable(self.automaton.iter(text)), np.int64)
            at = i + np.searchsorted(end[i:j], found[0::2] + base)
            crc[at], known[at] = self.crc[found[1::2]], True
            i = j
        missed: Counter[str] = Counter()
        rest = np.flatnonzero(~known)
        raw = data.tobytes() if len(rest) else b""
        for k, s, e in zip(rest.tolist(), start[rest].tolist(), end[rest].tolist(), strict=True):
            word = raw[s:e]
            crc[k] = zlib.crc32(word)
            if e - s <= LONGEST_WORD:
                missed[word.decode("latin-1")] += 1
        self.learn(missed)
        return crc, length


@cache
def dictionary(most: int = MOST_WORDS) -> Dictionary:
    """One per Python worker."""
    return Dictionary(most)


def feature_crcs(column: pa.Array, longest: int, known: Dictionary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: CRCs of their features, n + 1 offsets of the texts into them, words per text."""
    data, offsets = words.text_bytes(column)
    # a space before and after each text, for the delimiters
    spaced = np.full(len(data) + len(offsets), _SPACE, np.uint8)
    n = np.diff(offsets)
    spaced[words.ragged(offsets[:-1] + np.arange(1, len(offsets)), n)] = _FOLD[data]
    inside = np.concatenate([spaced != _SPACE, [False]])
    start = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    end = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    text_at = np.searchsorted(start, offsets + np.arange(len(offsets)))
    crc, length = known.payloads(spaced, start, end)
    text = np.repeat(np.arange(len(n)), np.diff(text_at))
    space = np.full(len(crc), zlib.crc32(b" "), np.uint32)
    runs, of_text, run = [crc], [text], crc
    for k in range(1, longest):
        run = join_crc(run[:-1], space[: len(run) - 1], np.ones(max(0, len(run) - 1), np.int64))
        run = join_crc(run, crc[k:], length[k:])
        whole = text[:-k] == text[k:]
        runs.append(run[whole])
        of_text.append(text[:-k][whole])
    owner = np.concatenate(of_text)
    order = np.argsort(owner, kind="stable") if longest > 1 else slice(None)
    at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)))]).astype(np.int64)
    return np.concatenate(runs)[order], at, np.diff(text_at)


def features(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """`texts` (doc_id, text) as doc_id, n_words, n_features, buckets: 32-bit numbers, least byte first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, 500):
            crcs, at, n_words = feature_crcs(batch.column("text"), longest, dictionary())
            found = (crcs % np.uint32(buckets)).astype("<u4")
            listed = [found[a:b].tobytes() for a, b in itertools.pairwise(at.tolist())]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(n_words), pa.array(np.diff(at)), pa.array(listed, pa.binary())],
                names=["doc_id", "n_words", "n_features", "buckets"],
            )

    kept = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return kept.mapInArrow(run, "doc_id long, n_words long, n_features long, buckets binary")


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bucket numbers of a column, and n + 1 offsets."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None:
        return np.zeros(0, "<u4"), np.zeros(len(at), np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view("<u4"), (at - at[0]) // 4


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """How many features fall into each bucket. Every task adds up its own; `buckets` numbers come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in words.slices(batches, 500):
            total += np.bincount(_numbers(batch.column("buckets"))[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    per_task = found.select("buckets").mapInArrow(run, "bucket long, n long")
    counted = per_task.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[counted["bucket"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's smoothed share of the target over that of the source."""
    n, all_s, all_t = len(source), float(source.sum()), float(target.sum())
    each = zip(source.tolist(), target.tolist(), strict=True)
    return np.array(
        [math.floor(1000 * math.log((t + 1.0) * (all_s + n) / ((s + 1.0) * (all_t + n)))) for s, t in each], np.int64
    )


def scores(found: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """`found` (from `features`) as doc_id, n_words, n_features, weight, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, 500):
            numbers, at = _numbers(batch.column("buckets"))
            sums = np.concatenate([[0], np.cumsum(gain[numbers])])
            n = np.diff(at)
            weight = (sums[at[1:]] - sums[at[:-1]]) // np.maximum(n, 1)
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("n_words"), batch.column("n_features"), pa.array(weight)],
                names=["doc_id", "n_words", "n_features", "weight"],
            )

    weighed = found.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weighed.withColumn("score", F.col("weight") + noise)


def draw(scored: DataFrame, scratch: Scratch, least_words: int, percent: int) -> DataFrame:
    """`scored` with `rank`: of the rows of at least `least_words` words, `percent` of a hundred have one, those
    of the highest scores, ties to the smaller doc_id (null last). `scored` must be a written table.

    Scores are whole numbers of a range that logarithms of 64-bit counts bound (some 10 ** 5), so counting
    rows per score tells how many rows stand before each. Rows within a score are put in order by
    doc_id after equal rows are counted as one, and listed again in runs of RUN.
    """
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    eligible = scored.filter(F.col("n_words") >= least_words)
    higher = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    per_score = eligible.groupBy("score").agg(F.count("*").alias("_n"))
    per_score = per_score.select("score", F.coalesce(F.sum("_n").over(higher), F.lit(0)).alias("_above"))
    above = scratch.keep(per_score.coalesce(1), "above")
    wanted = eligible.count() * percent // 100
    same = scored.groupBy(*columns).agg(F.count("*").alias("_n"))
    same = same.join(F.broadcast(above.filter(F.col("_above") < wanted)), "score", "left")
    same = scratch.keep(same, "same")
    drawn = same.filter((F.col("n_words") >= least_words) & F.col("_above").isNotNull())
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_words", "n_features", "weight")
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    drawn = drawn.withColumn("_first", F.col("_above") + before + 1)
    others = same.filter((F.col("n_words") < least_words) | F.col("_above").isNull())
    listed = drawn.unionByName(others.withColumn("_first", F.lit(None).cast("long")))
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {RUN}")))
    each = listed.withColumn("_run", runs)
    last = F.least(F.col("_n"), (F.col("_run") + 1) * RUN) - 1
    each = each.withColumn("_at", F.explode(F.sequence(F.col("_run") * RUN, last)))
    rank = F.col("_first") + F.col("_at")
    return each.select(*columns, F.when(rank <= wanted, rank).alias("rank"))


def resample(
    docs: DataFrame, target: DataFrame, scratch: Scratch, longest: int, buckets: int, seed: int, least_words: int, percent: int
) -> DataFrame:
    """`docs` (doc_id, text) as doc_id, n_words, n_features, weight, score and rank, one row each.

    `target` (text) is what the sample is to be like. Without documents or target texts all gains are
    those of the smoothing, and a document without features has weight 0.
    """
    found = scratch.keep(features(docs, longest, buckets), "features")
    wanted = target.select(F.lit(None).cast("long").alias("doc_id"), "text")
    wanted = scratch.keep(features(wanted, longest, buckets), "target")
    gain = gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets))
    scored = scratch.keep(scores(found, gain, seed), "scored")
    return draw(scored, scratch, least_words, percent)
