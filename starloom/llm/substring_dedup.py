"""Remove passages of words that occurred before, by fixed-block anchors.

A passage repeats if a window of `width` words also starts earlier: in a document of smaller id or
earlier in the same one. Every window of a repeat contains a whole block of the earlier document, if that is
cut into blocks of (width + 1) // 2 words from its first word on. So

1. the blocks of all documents are indexed by their hashes, and all rolling windows of a block's
   length look theirs up. A window that meets a block elsewhere is a hit, and so is the block.
2. Hits are extended to windows of full width, which are looked up in turn: one whose first holder is an
   earlier document repeats. Their union are the maximal repeats, whose words go.

Documents are sorted by (doc_id, text) and cut, in this order, into groups bounded by rows and by bytes of
text, however the ids lie. A group lists a hash once, sorted and packed, and answers come back to the
group, so a passage that a third of all documents hold costs an entry per group and task that holds it, and
copies are never paired. What repeats inside a group it finds itself.

Hashes: 64 bits for windows of full width, which are thus told apart up to a chance of 2 ** -64 per pair; for
the anchors 32 bits within one of many parts, where a false hit only adds a window to look up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm import words
from starloom.llm.common import Scratch

#: Most documents of a group, most bytes of its texts (one longer text is a group of its own), and
#: bytes of text whose hashes go to one part.
GROUP, GROUP_BYTES, PART_BYTES = 256, 8 << 20, 8 << 20
#: Parts of the sort by (doc_id, text) have about so many times PART_BYTES, and their borders so many signs of a
#: text: borders are held by the driver. Rows equal in id and these signs are sorted in one task, on disk if need be.
SORT_PARTS, BORDER_SIGNS = 4, 256
_BASE = 0xBF58476D1CE4E5B9


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` hashes; run i starts at i. A polynomial modulo 2 ** 64, mixed."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    size = 1 << max(16, n.bit_length())
    up, down = words._powers(size, _BASE), words._powers(size, pow(_BASE, -1, 1 << 64))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=sums[1:])
    return words.mix((sums[width:] - sums[:-width]) * down[: n - width + 1] + np.uint64(width))


class Texts:
    """Words of some documents, one after the other."""

    def __init__(self, column: pa.Array):
        self.data, offsets = words.text_bytes(column)
        self.start, self.end, self.at = words.word_spans(self.data, offsets)
        self.hashes = words.span_hashes(self.data, self.start, self.end)
        self.n = np.diff(self.at)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first word and document of every window that lies in one document."""
        count = np.maximum(self.n - width + 1, 0)
        first = words.ragged(self.at[:-1], count)
        return window_hashes(self.hashes, width)[first], first, np.repeat(np.arange(len(count)), count)

    def kept(self, doc: int, keep: np.ndarray | None = None) -> str:
        """SHA-256 of a document's words, or those kept, joined by one space."""
        span = slice(self.at[doc], self.at[doc + 1])
        start, end = self.start[span], self.end[span]
        if keep is not None:
            start, end = start[keep], end[keep]
        raw = self.data[start[0] : end[-1]].tobytes() if len(start) else b""
        first = int(start[0]) if len(start) else 0
        parts = [raw[s - first : e - first] for s, e in zip(start.tolist(), end.tolist(), strict=True)]
        return hashlib.sha256(b" ".join(parts)).hexdigest()


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned 32-bit numbers in about 3 bytes each: their low halves, then how much each high half
    is above the one before, in one byte, or 255 and later two bytes."""
    low = (values & np.uint32(0xFFFF)).astype("<u2")
    rise = np.diff((values >> np.uint32(16)).astype(np.int64), prepend=0)
    wide = rise[rise >= 255].astype("<u2")
    return np.uint32(len(values)).tobytes() + low.tobytes() + np.minimum(rise, 255).astype("u1").tobytes() + wide.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    low = np.frombuffer(data, "<u2", n, 4).astype(np.uint32)
    rise = np.frombuffer(data, "u1", n, 4 + 2 * n).astype(np.uint32)
    rise[rise == 255] = np.frombuffer(data, "<u2", offset=4 + 3 * n)
    return (np.cumsum(rise, dtype=np.uint32) << np.uint32(16)) | low


def _parts(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _anchor_keys(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Part and low 32 bits, as one number."""
    return (_parts(hashes, parts).astype(np.uint64) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each run of equal numbers, and the run of each position."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def dedupe_passages(docs: DataFrame, scratch: Scratch, width: int) -> DataFrame:
    """`docs` (doc_id, text) as doc_id, n_words, n_removed, removed (ranges [start, end) of removed words,
    each a maximal run of words that repeats cover) and kept_sha256.

    Words are unchanged runs of other than ASCII white space. A null or empty text has none. Texts of
    fewer than `width` words lose nothing. All windows are judged on the input. Rows without a doc_id come
    last; rows of equal doc_id come in the order of their texts.
    """
    if width < 2:
        raise ValueError("a window needs two words")
    block = (width + 1) // 2
    ids = F.col("doc_id").cast("long")
    texts = docs.select(ids.alias("doc_id"), "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(size // PART_BYTES) + 1
    texts = scratch.keep(_grouped(texts, int(size // (SORT_PARTS * PART_BYTES)) + 1), "groups")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per group and part: the sorted hashes of all windows of a block's length, and which of
        them are blocks."""
        for batch in _by_group(batches):
            group = batch.column("g").to_numpy()
            for g in np.unique(group):
                t = Texts(batch.column("text").take(pa.array(np.flatnonzero(group == g))))
                hashes, first, doc = t.windows(block)
                keys = _anchor_keys(hashes, parts)
                is_block = (first - t.at[doc]) % block == 0
                order = np.argsort(keys)
                starts, _ = _runs(keys[order])
                if not len(starts):
                    continue
                keys, is_block = keys[order][starts], np.logical_or.reduceat(is_block[order], starts)
                part_at, _ = _runs(keys >> np.uint64(32))
                part = (keys[part_at] >> np.uint64(32)).astype(np.int32)
                low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                yield pa.record_batch(
                    [
                        pa.array(part),
                        pa.array(np.full(len(part), g)),
                        pa.array([pack_sorted(x) for x in np.split(low, part_at[1:])], pa.binary()),
                        pa.array([np.packbits(x).tobytes() for x in np.split(is_block, part_at[1:])], pa.binary()),
                    ],
                    names=["part", "g", "hashes", "blocks"],
                )

    def meet(rows: pa.Table) -> pa.Table:
        """Hits of a part, by group: hashes that two groups or tasks list and of which one is a block."""
        lists = [unpack_sorted(x) for x in rows.column("hashes").to_pylist()]
        flags = [
            np.unpackbits(np.frombuffer(x, "u1"), count=len(v)).astype(bool)
            for x, v in zip(rows.column("blocks").to_pylist(), lists, strict=True)
        ]
        value, is_block = np.concatenate(lists), np.concatenate(flags)
        group = np.repeat(rows.column("g").to_numpy(), [len(x) for x in lists])
        order = np.argsort(value, kind="stable")
        value, is_block, group = value[order], is_block[order], group[order]
        starts, run = _runs(value)
        hit = (np.diff(starts, append=len(value)) > 1) & np.logical_or.reduceat(is_block, starts)
        value, group = value[hit[run]], group[hit[run]]
        order = np.lexsort((value, group))
        value, group = value[order], group[order]
        at, _ = _runs(group)
        part = rows.column("part")[0].as_py()
        return pa.table(
            {
                "g": group[at],
                "part": pa.array([part] * len(at), pa.int32()),
                "hashes": pa.array([pack_sorted(np.unique(x)) for x in np.split(value, at[1:])] if len(at) else [], pa.binary()),
            }
        )

    listed = texts.select("g", "text").mapInArrow(anchors, "part int, g long, hashes binary, blocks binary")
    hits = listed.groupBy("part").applyInArrow(meet, "g long, part int, hashes binary")
    hits = scratch.keep(hits, "hits")

    def extend(documents: pa.Table, found: pa.Table) -> pa.Table:
        """Documents without any window to look up are done. Of the others the texts, and the windows."""
        documents = _ordered(documents)
        t = Texts(documents.column("text").combine_chunks())
        known = [
            unpack_sorted(h).astype(np.uint64) | (np.uint64(p) << np.uint64(32))
            for p, h in zip(found.column("part").to_pylist(), found.column("hashes").to_pylist(), strict=True)
        ]
        known = np.sort(np.concatenate([np.zeros(0, np.uint64), *known]))
        hashes, first, doc = t.windows(block)
        hit = np.zeros(len(t.hashes) + 1, np.int64)
        hit[first[_among(_anchor_keys(hashes, parts), known)] + 1] = 1
        hit = np.cumsum(hit)
        hashes, first, doc = t.windows(width)
        # starts of the block-long windows inside: first ... first + width - block
        wanted = hit[first + width - block + 1] > hit[first]
        order = np.argsort(hashes, kind="stable")
        starts, run = _runs(hashes[order])
        repeated = np.diff(starts, append=len(hashes)) > 1
        wanted[order[repeated[run]]] = True
        open_docs = np.unique(doc[wanted])
        done = np.setdiff1d(np.arange(len(t.n)), open_docs)
        lookup = np.unique(hashes[wanted])
        part = _parts(lookup, parts)
        at, _ = _runs(part)
        blobs = [x.tobytes() for x in np.split(lookup, at[1:])] if len(at) else []
        g = documents.column("g")[0].as_py() if documents.num_rows else None
        n_done, n_open, n_blobs = len(done), len(open_docs), len(blobs)
        nulls = lambda n, kind: pa.nulls(n, kind)
        pick = lambda name, rows: documents.column(name).take(pa.array(rows, pa.int64())).combine_chunks()
        join = pa.concat_arrays
        return pa.table(
            {
                "g": pa.array([g] * (n_done + n_open + n_blobs), pa.int64()),
                "part": join([nulls(n_done + n_open, pa.int32()), pa.array(part[at], pa.int32())]),
                "hashes": join([nulls(n_done + n_open, pa.binary()), pa.array(blobs, pa.binary())]),
                "doc_id": join([pick("doc_id", done), pick("doc_id", open_docs), nulls(n_blobs, pa.int64())]),
                "text": join([nulls(n_done, pa.string()), pick("text", open_docs), nulls(n_blobs, pa.string())]),
                "n_words": join([pa.array(t.n[done], pa.int64()), nulls(n_open + n_blobs, pa.int64())]),
                "kept_sha256": join([pa.array([t.kept(i) for i in done], pa.string()), nulls(n_open + n_blobs, pa.string())]),
            }
        )

    extended = texts.groupBy("g").cogroup(hits.groupBy("g")).applyInArrow(
        extend, "g long, part int, hashes binary, doc_id long, text string, n_words long, kept_sha256 string"
    )
    extended = scratch.keep(extended, "extended")

    def first_holders(rows: pa.Table) -> pa.Table:
        """Per group: the windows that an earlier group holds too."""
        lists = [np.frombuffer(x, np.uint64) for x in rows.column("hashes").to_pylist()]
        value = np.concatenate(lists)
        group = np.repeat(rows.column("g").to_numpy(), [len(x) for x in lists])
        order = np.lexsort((group, value))
        value, group = value[order], group[order]
        starts, run = _runs(value)
        later = group > group[starts][run]
        value, group = value[later], group[later]
        order = np.lexsort((value, group))
        value, group = value[order], group[order]
        at, _ = _runs(group)
        blobs = [x.tobytes() for x in np.split(value, at[1:])] if len(at) else []
        return pa.table({"g": group[at], "hashes": pa.array(blobs, pa.binary())})

    asked = extended.filter("hashes IS NOT NULL").select("part", "g", "hashes")
    repeats = asked.groupBy("part").applyInArrow(first_holders, "g long, hashes binary")

    def remove(documents: pa.Table, found: pa.Table) -> pa.Table:
        documents = _ordered(documents)
        t = Texts(documents.column("text").combine_chunks())
        known = [np.frombuffer(x, np.uint64) for x in found.column("hashes").to_pylist()]
        known = np.sort(np.concatenate([np.zeros(0, np.uint64), *known]))
        hashes, first, _ = t.windows(width)
        repeated = _among(hashes, known)
        order = np.argsort(hashes, kind="stable")  # equal ones stay in the order of documents
        starts, run = _runs(hashes[order])
        again = np.ones(len(hashes), bool)
        again[starts] = False
        repeated[order[again]] = True
        cover = np.zeros(len(t.hashes) + 1, np.int64)
        np.add.at(cover, first[repeated], 1)
        np.add.at(cover, first[repeated] + width, -1)
        gone = np.cumsum(cover)[:-1] > 0
        removed, sha = [], []
        for i in range(len(t.n)):
            own = gone[t.at[i] : t.at[i + 1]]
            edges = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0))
            removed.append(edges.reshape(-1, 2).tolist())
            sha.append(t.kept(i, ~own))
        n_gone = np.concatenate([[0], np.cumsum(gone)])
        return pa.table(
            {
                "doc_id": documents.column("doc_id"),
                "n_words": pa.array(t.n, pa.int64()),
                "n_removed": pa.array(n_gone[t.at[1:]] - n_gone[t.at[:-1]], pa.int64()),
                "removed": pa.array(removed, pa.list_(pa.list_(pa.int64()))),
                "kept_sha256": pa.array(sha, pa.string()),
            }
        )

    open_docs = extended.filter("hashes IS NULL AND kept_sha256 IS NULL").select("g", "doc_id", "text")
    changed = open_docs.groupBy("g").cogroup(repeats.groupBy("g")).applyInArrow(
        remove, "doc_id long, n_words long, n_removed long, removed array<array<long>>, kept_sha256 string"
    )
    unchanged = extended.filter("kept_sha256 IS NOT NULL").select(
        "doc_id",
        "n_words",
        F.lit(0).cast("long").alias("n_removed"),
        F.array().cast("array<array<long>>").alias("removed"),
        "kept_sha256",
    )
    return changed.union(unchanged)


def _grouped(texts: DataFrame, parts: int) -> DataFrame:
    """`texts` (doc_id, text) with `g`, which ascends in the order of (doc_id, text), null ids last. To be
    written: the borders between the sorted parts are sampled anew each time."""
    most_rows, most_bytes = GROUP, GROUP_BYTES

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, rows, size = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            groups = np.empty(batch.num_rows, np.int64)
            for i, n in enumerate(pc.binary_length(batch.column("text")).fill_null(0).to_pylist()):
                if rows and (rows >= most_rows or size + n > most_bytes):
                    g, rows, size = g + 1, 0, 0
                groups[i], rows, size = g, rows + 1, size + n
            yield pa.record_batch([*batch.columns, pa.array(groups)], names=["doc_id", "text", "g"])

    by_id = F.asc_nulls_last("doc_id")
    ordered = texts.repartitionByRange(parts, by_id, F.substring("text", 1, BORDER_SIGNS))
    return ordered.sortWithinPartitions(by_id, "text").mapInArrow(cut, "doc_id long, text string, g long")


def _by_group(batches: Iterator[pa.RecordBatch], most: int = 2048) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, sorted by group so that a group's rows are together."""

    def ordered() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.take(pc.sort_indices(batch, sort_keys=[("g", "ascending")]))

    return words.slices(ordered(), most)


def _ordered(documents: pa.Table) -> pa.Table:
    """By id, null last, then text."""
    keys = [("doc_id", "ascending"), ("text", "ascending")]
    return documents.take(pc.sort_indices(documents, sort_keys=keys, null_placement="at_end"))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is in `known` (sorted)."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values
