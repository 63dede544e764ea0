"""Similarity join of documents on their sets of word n-grams, exact, by Jaccard similarity.

Method. Sets whose similarity reaches the threshold differ in at most
H = (size + size) * (1 - t) / (1 + t) n-grams. Sizes fall into bands such that partners are in one
band or in neighbouring ones. For each band a hash cuts the universe of n-grams into segments, and each
segment has an allocation: 1 if partners are found by equal subsets in it, 2 if also by subsets that differ
by one n-gram (found by the one-deletion neighbourhood). If the allocations of the segments that two
sets both list add up to H + 1, sets that differ more than allowed by in every one of them cannot be
partners; so each set lists signatures of only as many segments as its own size calls for. Subsets
of few n-grams, which unrelated sets share by chance, get the allocation 0: a band has more segments than
H + 1, and a set lists the first of its larger subsets until they add up. Equal subsets are small or
not in both sets, so of the segments that agree two partners leave out the same, and at least one
is left; a set with too few larger subsets lists all. How a band is allocated follows from a cost model
(`allocate`): signatures to store against comparisons of documents that share one by chance, which
grow faster than the band's documents.

A signature's documents are not paired with each other. Each is compared with one of them, the
center, by exact sets, which also gives its difference to the center. Only those not linked to the
center are then compared with the others of that center, in blocks of bounded size and from the differences
alone: A and B differ in exactly what their differences to a common center differ in. So copies of a
text cost one comparison each, whatever their number, and no link between different sets is lost.

Equal sets are joined before all this. N-grams are held as 64-bit hashes: sets are equal up to a chance of
about 1e-12 per pair of long documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm import words
from starloom.llm.common import Scratch
from starloom.llm.components import components

_PLACE = 0x9E3779B97F4A7C15
_OTHER = np.uint64(0xD6E8FEB86659FD93)

#: Cost model, in signatures stored: comparing a document with a center (per n-gram), and with another of the
#: center's documents; and the share of the n-grams of unrelated documents that is common to them.
CENTER_COST, MEMBER_COST, COMMON = 1.2, 0.1, 0.02
#: Members of one center compared with each other at once.
BLOCK = 512
#: One document in so many shows which signatures are very frequent. It decides how these are
#: processed, not what is found.
SHOWN, FREQUENT, MOST_FREQUENT = 64, 8, 10_000
DOCS_AT_ONCE = 500


@dataclass(frozen=True)
class Similarity:
    """Sets of `width`-word n-grams are linked if over * intersection >= under * union."""

    width: int
    under: int
    over: int

    def most_difference(self, sizes: int) -> int:
        """N-grams that linked sets with so many n-grams together can differ in."""
        return sizes * (self.over - self.under) // (self.over + self.under)


@dataclass(frozen=True)
class Band:
    """Sizes first..last. Exact segments come first, then those with one deletion; subsets of fewer than
    `smallest` n-grams are left out where the others suffice."""

    first: int
    last: int
    exact: int
    deletion: int
    smallest: int


def bands(counts: dict[int, int], similarity: Similarity) -> list[Band]:
    """Bands for sets of the given sizes (size -> documents), allocated."""
    out, first, largest = [], 1, max(counts, default=0)
    sizes = sorted(counts)
    while first <= largest:
        last = first * similarity.over // similarity.under
        documents = sum(counts[s] for s in sizes if first <= s <= last)
        need = similarity.most_difference(last + last * similarity.over // similarity.under) + 1
        out.append(Band(first, last, *allocate((first + last) / 2, documents, need)))
        first = last + 1
    return out


def allocate(size: float, documents: int, need: int) -> tuple[int, int, int]:
    """Exact segments, segments with one deletion and the smallest subset listed that cost least, for
    allocations that add up to `need`.

    Segments get a share of the universe in proportion to their allocation, so the size of a subset is about
    a Poisson number. By chance a document shares an exact segment with others if it holds only common n-grams
    there; it is then compared with their center, and with them. With one deletion, one other n-gram may be
    there too.
    """
    best = (math.inf, need, 0, 0)

    def cost(signatures: float, segments: float, chance: float) -> float:
        compared = CENTER_COST * size * segments * chance * min(1.0, documents * chance)
        return signatures + compared + MEMBER_COST * segments * documents * chance**2 / 2

    smallest = 0
    while True:
        exact = need
        while smallest and exact <= 4 * need:
            larger = 1 - _poisson_below(smallest, size / exact)
            # few documents have fewer larger subsets than they need
            if exact * larger - 2 * math.sqrt(exact * larger * (1 - larger)) >= need:
                break
            exact += 1 + exact // 50
        if exact > 4 * need:
            break
        held = size / exact
        larger = 1 - _poisson_below(smallest, held)
        # sum of COMMON ** k over the sizes k of a listed subset
        common = math.exp(held * (COMMON - 1)) * (1 - _poisson_below(smallest, held * COMMON)) / max(larger, 1e-9)
        best = min(best, (cost(need, need, common), exact, 0, smallest))
        smallest += 1
    for deletion in range(1, need // 2 + need % 2 + 1):
        exact = max(0, need - 2 * deletion)
        held = size / (exact + 2 * deletion)
        other = held * (1 - COMMON)
        total = cost(exact, exact, math.exp(-other))
        total += cost(deletion * (1 + 2 * held), deletion, math.exp(-2 * other) * (1 + 2 * other))
        best = min(best, (total, exact, deletion, 0))
    return best[1:]


def _poisson_below(k: int, mean: float) -> float:
    """The chance that a Poisson number is below k."""
    term, total = math.exp(-mean), 0.0
    for i in range(k):
        total += term
        term *= mean / (i + 1)
    return total


def ngrams(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, sorted, one text after the other, and n + 1 offsets.

    A-Z count as a-z. A text with fewer words than `width` has one n-gram of all its words, one without
    words none.
    """
    data, offsets = words.text_bytes(column)
    data = words.lower_ascii(data)
    start, end, at = words.word_spans(data, offsets)
    hashed = words.span_hashes(data, start, end)
    n = np.diff(at)
    out = np.zeros(len(hashed), np.uint64)
    for k in range(width):
        part = words.mix(hashed[k:] + np.uint64(_PLACE * (k + 1) % (1 << 64)))
        out[: len(part)] += part
    out = words.mix(out)
    each = []
    for first, count in zip(at[:-1].tolist(), n.tolist(), strict=True):
        if count >= width:
            each.append(np.unique(out[first : first + count - width + 1]))
        elif count:
            whole = hashed[first : first + count] * (np.arange(count, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
            each.append(words.mix(whole.sum(dtype=np.uint64, keepdims=True) + np.uint64(count)))
        else:
            each.append(out[:0])
    return np.concatenate([out[:0], *each]), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)


def _sums(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Sums modulo 2 ** 64 per group. Half the bits at a time, so that doubles hold them exactly."""
    low = np.bincount(group, (values & np.uint64(0xFFFFFFFF)).astype(float), groups).astype(np.uint64)
    high = np.bincount(group, (values >> np.uint64(32)).astype(float), groups).astype(np.uint64)
    return low + (high << np.uint64(32))


def fingerprints(grams: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, in two numbers."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return tuple(
        words.mix(_sums(words.mix(grams ^ salt), doc, len(at) - 1)).view(np.int64) for salt in (np.uint64(0), _OTHER)
    )


def signatures(
    grams: np.ndarray, at: np.ndarray, plan: list[Band], similarity: Similarity
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signature, number of the set, and flags (1: set of the band itself, 2: of a whole subset)
    of all sets. A set is listed in its own band and, for smaller partners, in the band below."""
    size = np.diff(at)
    firsts = np.array([b.first for b in plan] or [1])
    exact, deletion, smallest = (
        np.array([getattr(b, x) for b in plan] or [0]) for x in ("exact", "deletion", "smallest")
    )
    own = np.searchsorted(firsts, size, "right") - 1
    mixed = words.mix(grams ^ _OTHER)
    out = []
    for below in (0, 1):
        band = own - below
        # own band: also larger partners; band below: partners up to the band's last size
        other = size * similarity.over // similarity.under if not below else np.minimum(size, firsts[own] - 1)
        need = similarity.most_difference(size + other) + 1
        doc = np.flatnonzero((size > 0) & (band >= 0) & (need > 1))
        if not len(doc):
            continue
        band, need = band[doc], need[doc]
        one, two = exact[band], deletion[band]
        index = words.ragged(at[doc], size[doc])
        row = np.repeat(np.arange(len(doc)), size[doc])
        gram = mixed[index]
        unit = ((words.mix(gram) >> np.uint64(32)) * (one + 2 * two)[row].astype(np.uint64)) >> np.uint64(32)
        unit = unit.astype(np.int64)
        segment = np.where(unit < one[row], unit, one[row] + (unit - one[row]) // 2)
        segments = one + two
        first = np.cumsum(segments) - segments
        place = first[row] + segment
        of = np.repeat(np.arange(len(doc)), segments)
        number = np.arange(len(of)) - first[of]
        held = np.bincount(place, minlength=len(of))
        sums = _sums(gram, place, len(of))
        # the first of the larger subsets, until their allocations add up; all if they don't
        allocation = np.where(number < one[of], 1, 2) * (held >= smallest[band][of])
        before = np.cumsum(allocation) - allocation
        before -= before[first][of]
        enough = np.bincount(of, allocation, len(doc)) >= need
        listed = np.where(enough[of], (allocation > 0) & (before < need[of]), True)
        salt = words.mix((band[of].astype(np.uint64) << np.uint64(32)) + number.astype(np.uint64) + np.uint64(1))
        whole = np.flatnonzero(listed)
        out.append((words.mix(sums + salt)[whole], doc[of[whole]], np.full(len(whole), 2 + (1 - below), np.int8)))
        near = np.flatnonzero((segment >= one[row]) & listed[place])
        if len(near):
            p = place[near]
            out.append((words.mix(sums[p] - gram[near] + salt[p]), doc[row[near]], np.full(len(p), 1 - below, np.int8)))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int8)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def group_similar(docs: DataFrame, scratch: Scratch, similarity: Similarity) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles (size of its set) and component_id
    (the smallest doc_id that links reach from it, its own included).

    Texts without words, null ones too, are linked with nothing. Rows that share a doc_id are one
    document. Rows without a doc_id are linked with nothing and have no component_id.
    """
    spark = scratch.spark
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    width = similarity.width

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, DOCS_AT_ONCE):
            grams, at = ngrams(batch.column("text"), width)
            f1, f2 = fingerprints(grams, at)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(np.diff(at)), pa.array(f1), pa.array(f2)],
                names=["doc_id", "n_shingles", "f1", "f2"],
            )

    sets = texts.mapInArrow(measure, "doc_id long, n_shingles long, f1 long, f2 long")
    sets = scratch.keep(sets, "sets")
    named = sets.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    same = named.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    same = scratch.keep(same, "same")

    counts = {r["n_shingles"]: r["n"] for r in same.groupBy("n_shingles").agg(F.count("*").alias("n")).collect()}
    plan = bands(counts, similarity)
    total = same.agg(F.sum("copies")).first()[0] or 0
    # at most 1 / 1e-4 sets have more copies than this: all but one of each are left out at once
    hot = same.filter(F.col("copies") > max(1, 1e-4 * total)).select("f1", "f2", "rep").collect()
    hot_rep = {(r["f1"], r["f2"]): r["rep"] for r in hot}

    def listing(frequent: tuple[np.ndarray, np.ndarray]):
        """Rows (sig, doc, flags, center). A frequent signature's rows get its center at once and a
        signature of their own, so that they are dealt evenly."""
        frequent_sig, frequent_center = frequent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in words.slices(batches, DOCS_AT_ONCE):
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                grams, at = ngrams(batch.column("text"), width)
                if hot_rep:
                    f1, f2 = fingerprints(grams, at)
                    keys = zip(f1.tolist(), f2.tolist(), ids.tolist(), strict=True)
                    keep = np.array([hot_rep.get((a, b), d) == d for a, b, d in keys], bool)
                    size = np.diff(at) * keep
                    grams = grams[np.repeat(keep, np.diff(at))]
                    at = np.concatenate([[0], np.cumsum(size)])
                sig, doc, flags = signatures(grams, at, plan, similarity)
                doc = ids[doc].astype(np.int64)
                center = np.full(len(sig), -1, np.int64)
                known = np.zeros(len(sig), bool)
                if len(frequent_sig):
                    place = np.minimum(np.searchsorted(frequent_sig, sig), len(frequent_sig) - 1)
                    known = frequent_sig[place] == sig
                    center[known] = frequent_center[place[known]]
                    sig = np.where(known, words.mix(sig ^ words.mix(doc.view(np.uint64))), sig)
                    flags = np.where(known, np.int8(3), flags)
                yield pa.record_batch(
                    [
                        pa.array(sig.view(np.int64)),
                        pa.array(doc),
                        pa.array(flags, pa.int8()),
                        pa.array(center, mask=~known),
                    ],
                    names=["sig", "doc", "flags", "center"],
                )

        return run

    listed = "sig long, doc long, flags tinyint, center long"
    usable = texts.filter("doc_id IS NOT NULL")
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    shown = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SHOWN)) == 0).mapInArrow(listing(none), listed)
    often = shown.groupBy("sig").agg(F.min("doc").alias("center"), F.countDistinct("doc").alias("n"))
    often = often.filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "sig").limit(MOST_FREQUENT).collect()
    by_sig = sorted((r["sig"] % (1 << 64), r["center"]) for r in often)
    frequent = (np.array([s for s, _ in by_sig], np.uint64), np.array([c for _, c in by_sig], np.int64))

    rows = usable.mapInArrow(listing(frequent), listed)
    bucket = Window.partitionBy("sig")
    rows = rows.withColumns(
        {
            "least": F.min("doc").over(bucket),
            "of_band": F.max(F.col("flags").bitwiseAND(1)).over(bucket),
            "whole": F.max(F.col("flags").bitwiseAND(2)).over(bucket),
        }
    )
    stars = rows.filter("of_band > 0 AND whole > 0").select(F.coalesce("center", "least").alias("center"), "doc")
    stars = scratch.keep(stars.filter("center != doc").distinct(), "listed")
    # each set by its first document alone
    rep_of = named.join(same, ["f1", "f2", "n_shingles"]).select("doc_id", "rep")
    stars = (
        stars.join(rep_of.filter("doc_id = rep").select(F.col("doc_id").alias("doc")).distinct(), "doc")
        .join(rep_of.withColumnRenamed("doc_id", "center").distinct(), "center")
        .select(F.col("rep").alias("center"), "doc")
        .filter("center != doc")
    )
    stars = scratch.keep(stars.distinct(), "stars")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, DOCS_AT_ONCE):
            grams, at = ngrams(batch.column("text"), width)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(grams.view(np.int64)))
            yield pa.record_batch([batch.column("doc_id"), lists], names=["doc_id", "grams"])

    needed = stars.select(F.explode(F.array("center", "doc")).alias("doc_id")).distinct()
    # joined by shuffles whatever the sizes, so that the plan is the one of large inputs on small ones too
    spelled = usable.join(needed.hint("merge"), "doc_id").mapInArrow(spell, "doc_id long, grams array<long>")
    spelled = scratch.keep(spelled.dropDuplicates(["doc_id"]), "spelled")
    compared = (
        stars.join(spelled.select(F.col("doc_id").alias("doc"), F.col("grams").alias("mine")).hint("merge"), "doc")
        .join(spelled.select(F.col("doc_id").alias("center"), F.col("grams").alias("theirs")).hint("merge"), "center")
        .select(
            "center",
            "doc",
            F.size("mine").cast("long").alias("n"),
            F.size("theirs").cast("long").alias("m"),
            F.concat(F.array_except("mine", "theirs"), F.array_except("theirs", "mine")).alias("difference"),
        )
    )
    d, both = F.size("difference"), F.col("n") + F.col("m")
    linked = F.lit(similarity.over) * (both - d) >= F.lit(similarity.under) * (both + d)
    compared = scratch.keep(compared.withColumn("linked", linked), "compared")

    links = compared.filter("linked").select(F.col("center").alias("a"), F.col("doc").alias("b"))
    links = links.union(_among_members(compared, similarity))
    found = components(links, scratch, "components").select(F.col("node").alias("rep"), "component")
    whole = sets.join(same.drop("copies"), ["f1", "f2", "n_shingles"], "left").join(found, "rep", "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.coalesce("component", "rep"))
    return whole.select("doc_id", "n_shingles", component.alias("component_id"))


def _among_members(compared: DataFrame, similarity: Similarity) -> DataFrame:
    """Links among the documents of a center of which at least one is not linked to the center, as
    pairs (a, b) that connect what links connect.

    Each such document meets each document of its center in one group of at most about 2 * BLOCK.
    """
    per_center = compared.groupBy("center").agg(
        F.count("*").alias("members"), F.count(F.when(~F.col("linked"), 1)).alias("open")
    )
    per_center = per_center.filter("members > 1 AND open > 0").select(
        "center",
        F.ceil(F.col("open") / BLOCK).alias("rows"),
        F.ceil(F.col("members") / BLOCK).alias("columns"),
    )
    members = compared.join(per_center, "center")
    part = lambda n: F.pmod(F.xxhash64("doc"), n)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    kept = ["center", "doc", "n", "difference"]
    left = members.filter(~F.col("linked")).select(
        *kept, part(F.col("rows")).alias("i"), upto("columns").alias("j"), F.lit(True).alias("row")
    )
    right = members.select(*kept, upto("rows").alias("i"), part(F.col("columns")).alias("j"), F.lit(False).alias("row"))
    right = right.select(left.columns)

    def compare(group: pa.Table) -> pa.Table:
        is_row = group.column("row").to_numpy()
        doc, n = group.column("doc").to_numpy(), group.column("n").to_numpy()
        lists = group.column("difference").combine_chunks()
        at = np.asarray(lists.offsets, np.int64)
        values = np.asarray(lists.values)
        count = np.diff(at)
        rows, columns = np.flatnonzero(is_row), np.flatnonzero(~is_row)

        def gathered(of):
            return values[words.ragged(at[of], count[of])], np.repeat(np.arange(len(of)), count[of])

        left_value, left_row = gathered(rows)
        right_value, right_row = gathered(columns)
        common = np.intersect1d(left_value, right_value)
        shared = np.zeros((len(rows), len(columns)), np.float32)
        for k in range(0, len(common), 4096):
            part = common[k : k + 4096]
            a, b = np.zeros((len(rows), len(part)), np.float32), np.zeros((len(columns), len(part)), np.float32)
            for matrix, value, row in ((a, left_value, left_row), (b, right_value, right_row)):
                place = np.minimum(np.searchsorted(part, value), len(part) - 1)
                here = part[place] == value
                matrix[row[here], place[here]] = 1
            shared += a @ b.T
        differ = count[rows][:, None] + count[columns][None, :] - 2 * shared
        sizes = n[rows][:, None] + n[columns][None, :]
        linked = similarity.over * (sizes - differ) >= similarity.under * (sizes + differ)
        linked &= doc[rows][:, None] != doc[columns][None, :]
        return pa.table(dict(zip(("a", "b"), connected(linked, doc[rows], doc[columns]), strict=True)))

    return left.union(right).groupBy("center", "i", "j").applyInArrow(compare, "a long, b long")


def connected(linked: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) that connect the rows and columns of a matrix of links just as its links do, one
    per row and column that has a link."""
    r, c = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    linked, rows, columns = linked[np.ix_(r, c)], rows[r], columns[c]
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    most = np.iinfo(np.int64).max
    of_row, of_column = rows.astype(np.int64), columns.astype(np.int64)
    while True:
        new_column = np.minimum(of_column, np.where(linked, of_row[:, None], most).min(0))
        new_row = np.minimum(of_row, np.where(linked, new_column[None, :], most).min(1))
        if np.array_equal(new_row, of_row) and np.array_equal(new_column, of_column):
            break
        of_row, of_column = new_row, new_column
    a, b = np.concatenate([rows, columns]), np.concatenate([of_row, of_column])
    return a[a != b], b[a != b]
