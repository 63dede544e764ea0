"""Records of CSV files with quoted line breaks, read by many tasks per file.

Spark's text source cuts a file into byte ranges, each of whole lines. Whether a range begins inside a quoted
field depends on all before it, so each is first scanned once with either answer: where it ends then (inside
quotes or not), and the pieces of records that cross its borders. Going through these answers from a file's
start tells which one holds for each range. In a second scan every range gives the records that lie within it;
those that cross borders are put together from the pieces.

A quote opens a field only where the field begins, as Spark's CSV reader has it: a quote inside an unquoted field is
a sign like others, a closing quote followed by other signs ends the quoting, and two quotes within quotes are
one. Lines end with \\n or \\r\\n; a file in which neither occurs is one record. Empty lines between records
are no records. A quote that is never closed reaches to the end of the file, whose last line end is not part of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.session import scratch_dir

QUOTE = '"'
#: A piece of a record that crosses a border is kept by the first pass up to so many signs. Under the wrong
#: answer a whole range may seem to be one. Longer ones, if they turn out to be needed, are read again.
PIECE_SIGNS = 1 << 20

_FILE = [("file", pa.int64()), ("salted", pa.int64()), ("start", pa.int64())]
PIECES = pa.schema(
    [*_FILE, ("header", pa.string()), ("out_after_out", pa.bool_()), ("out_after_in", pa.bool_()), ("ends_in", pa.bool_())]
    + [("head_in", pa.string()), ("tail_out", pa.string()), ("tail_in", pa.string())]
)
PIECES_SCHEMA = (
    "file long, salted long, start long, header string, out_after_out boolean, out_after_in boolean, ends_in boolean,"
    " head_in string, tail_out string, tail_in string"
)
_LONG = pa.struct([("record", pa.int32()), ("place", pa.int32()), ("head", pa.bool_())])
BORDERS = pa.schema([*_FILE, ("inside", pa.bool_()), ("records", pa.list_(pa.string())), ("long", pa.list_(_LONG))])
BORDERS_SCHEMA = (
    "file long, salted long, start long, inside boolean, records array<string>,"
    " long array<struct<record: int, place: int, head: boolean>>"
)

#: A range: its file, by two hashes of the path, and where it starts.
Place = tuple[int, int, int]
Batches = Iterator[pa.RecordBatch]


def _closing(line: str, at: int) -> int:
    """Where the quoted field that goes on at `at` closes; -1 if not in this line."""
    at = line.find(QUOTE, at)
    while at >= 0 and line[at + 1 : at + 2] == QUOTE:
        at = line.find(QUOTE, at + 2)
    return at


def stays_open(line: str, inside: bool, delimiter: str = ",") -> bool:
    """Whether a line that begins at the start of a record, or inside quotes, ends inside quotes."""
    if QUOTE not in line:
        return inside
    at = 0
    opening = delimiter + QUOTE
    if not inside:
        if not line.startswith(QUOTE):
            at = line.find(opening)
            if at < 0:
                return False
            at += len(delimiter)
        at += 1
    while True:
        at = _closing(line, at)
        if at < 0:
            return True
        # the signs up to the next delimiter belong to the field, unquoted
        at = line.find(delimiter, at + 1)
        if at < 0:
            return False
        at = line.find(opening, at)
        if at < 0:
            return False
        at += len(delimiter) + 1


class _Reading:
    """A range under one of the two answers, line after line. A record of more than `most` signs is not kept."""

    def __init__(self, inside: bool, most: int | None = None):
        self.inside = inside
        self.most = most
        self.lines: list[str] = []
        self.signs = 0

    def ends(self, line: str, delimiter: str) -> bool:
        """Whether a record ends with this line. Then `take` gives it."""
        self.inside = stays_open(line, self.inside, delimiter)
        self.signs += len(line) + 1
        if self.most is None or self.signs <= self.most:
            self.lines.append(line)
        else:
            self.lines.clear()
        return not self.inside

    def take(self) -> str | None:
        """What there is of the record; None if nothing, or too much."""
        text = "\n".join(self.lines) if self.lines else None
        self.lines.clear()
        self.signs = 0
        return text


def _ranges(batches: Batches) -> Iterator[tuple[Place, list[str]]]:
    """The lines of a range in each batch. A range's lines stand together, over one or more batches."""
    for batch in batches:
        lines = batch.column(0).to_pylist()
        places = np.stack([batch.column(k).to_numpy() for k in (1, 2, 3)], axis=1)
        cuts = [0, *(np.flatnonzero((places[1:] != places[:-1]).any(axis=1)) + 1).tolist(), len(lines)]
        for a, b in pairwise(cuts):
            if a < b:
                yield tuple(places[a].tolist()), lines[a:b]


def _scan(delimiter: str) -> Callable[[Batches], Batches]:
    """First pass: one row per range, with what holds for either answer."""
    most = PIECE_SIGNS

    def run(batches: Batches) -> Batches:
        for place, parts in groupby(_ranges(batches), key=lambda r: r[0]):
            out, inner = _Reading(False, most), _Reading(True, most)
            header, head, ends_out, ends_in = None, None, False, False
            for _, lines in parts:
                for line in lines:
                    if out.ends(line, delimiter):
                        record = out.take()
                        if not ends_out:
                            header, ends_out = record, True
                    if place[2] and inner.ends(line, delimiter):
                        record = inner.take()
                        if not ends_in:
                            head, ends_in = record, True
            row = {
                "file": place[0],
                "salted": place[1],
                "start": place[2],
                # one that is too long to keep is empty here
                "header": (header or "").removesuffix("\r") if ends_out and not place[2] else None,
                "out_after_out": not out.inside,
                "out_after_in": not inner.inside,
                "ends_in": ends_in,
                "head_in": head,
                "tail_out": out.take() if out.inside else None,
                "tail_in": inner.take() if inner.inside else None,
            }
            yield pa.RecordBatch.from_pylist([row], PIECES)

    return run


def _walk(file: pa.Table) -> pa.Table:
    """The ranges of a file in order: which begin inside quotes, and the records that cross borders, each
    with the range in which it ends. Of records with pieces that were not kept, which pieces they have: their
    number, the piece's place in it, and whether it is the head of its range."""
    rows = sorted(file.to_pylist(), key=lambda r: r["start"])
    out = [{k: r[k] for k in ("file", "salted", "start")} | {"inside": False, "records": [], "long": []} for r in rows]
    inside, parts, number = False, [], 0  # parts: (row, whether its head, text)

    def close(last: int) -> None:
        if not number and not parts[0][0] and rows[0]["header"] is None:
            pass  # the header itself
        elif any(text is None for _, _, text in parts):
            for place, (at, head, _) in enumerate(parts):
                out[at]["long"].append({"record": number, "place": place, "head": head})
        else:
            out[last]["records"].append("\n".join(text for _, _, text in parts).removesuffix("\r"))
        parts.clear()

    for k, r in enumerate(rows):
        out[k]["inside"] = inside
        if inside and r["ends_in"]:
            parts.append((k, True, r["head_in"]))
            close(k)
            number += 1
        ends_inside = not (r["out_after_in"] if inside else r["out_after_out"])
        if ends_inside:
            parts.append((k, False, r["tail_in"] if inside else r["tail_out"]))
        inside = ends_inside
    if parts:  # the file ends within quotes, and with it the record
        close(len(rows) - 1)
    return pa.Table.from_pylist(out, BORDERS)


@dataclass(frozen=True)
class _Ranges:
    """Of the files of several ranges, where these start, and where those that begin inside quotes do."""

    starts: dict[tuple[int, int], np.ndarray]
    inside: dict[tuple[int, int], np.ndarray]

    @staticmethod
    def _has(some: np.ndarray | None, start: int) -> bool:
        k = 0 if some is None else int(np.searchsorted(some, start))
        return some is not None and k < len(some) and some[k] == start

    def begins_inside(self, place: Place) -> bool:
        if place[2] and not self._has(self.starts.get(place[:2]), place[2]):
            raise ValueError("the files have changed, or been cut otherwise, since the first pass: read them again")
        return self._has(self.inside.get(place[:2]), place[2])


def _within(ranges: _Ranges, delimiter: str) -> Callable[[Batches], Batches]:
    """Second pass: the records that lie within a range, but for headers."""

    def run(batches: Batches) -> Batches:
        for place, parts in groupby(_ranges(batches), key=lambda r: r[0]):
            inside = ranges.begins_inside(place)
            reading = _Reading(inside)
            # not of this pass: the header, and the end of a record that crosses the border
            skip = inside or not place[2]
            for _, lines in parts:
                records = []
                for line in lines:
                    if reading.ends(line, delimiter):
                        record = reading.take()
                        if not skip:
                            records.append(record.removesuffix("\r"))
                        skip = False
                yield pa.record_batch([pa.array(records, pa.string())], names=["record"])

    return run


def _again(ranges: _Ranges, wanted: dict[Place, list[dict]], delimiter: str) -> Callable[[Batches], Batches]:
    """The wanted pieces, in full: the file, the record's number, the place in it, the text."""

    def run(batches: Batches) -> Batches:
        for place, parts in groupby(_ranges(batches), key=lambda r: r[0]):
            if place not in wanted:
                continue
            reading = _Reading(ranges.begins_inside(place))
            head, ended = None, False
            for _, lines in parts:
                for line in lines:
                    if reading.ends(line, delimiter):
                        record = reading.take()
                        head, ended = (head if ended else record), True
            tail = reading.take()
            rows = [
                {"file": place[0], "salted": place[1], "record": w["record"], "place": w["place"], "text": head if w["head"] else tail}
                for w in wanted[place]
            ]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([*_FILE[:2], ("record", pa.int32()), ("place", pa.int32()), ("text", pa.string())]))

    return run


def _fixed_ranges(spark: SparkSession, range_bytes: int | None) -> SparkSession:
    """A session of this one's settings in which files are cut alike whenever a plan runs; else the ranges
    follow the number of cores that happen to be there."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        own.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    if range_bytes:
        own.conf.set("spark.sql.files.maxPartitionBytes", str(range_bytes))
        own.conf.set("spark.sql.files.openCostInBytes", str(range_bytes))
    return own


def read_records(
    spark: SparkSession, path: str | Sequence[str], delimiter: str = ",", range_bytes: int | None = None
) -> tuple[list[str], DataFrame]:
    """The different headers of the file(s), two at most, and their other records as text: `record`. `range_bytes`:
    the size of the ranges, if not by the session's `spark.sql.files.maxPartitionBytes`.

    The first pass runs at once. One row per range is written to the scratch folder; to the driver and the tasks
    go the starts of the ranges of files of several ranges, 8 bytes for some 128 MB of data.
    """
    name = F.col("_metadata.file_path")
    lines = _fixed_ranges(spark, range_bytes).read.text(path, lineSep="\n").select(
        F.expr("make_valid_utf8(value)").alias("value"),
        F.xxhash64(name).alias("file"),
        F.xxhash64(F.lit(1), name).alias("salted"),
        F.col("_metadata.file_block_start").alias("start"),
    )
    scratch = f"{scratch_dir(spark)}-csv"
    lines.mapInArrow(_scan(delimiter), PIECES_SCHEMA).write.parquet(f"{scratch}/pieces")
    pieces = spark.read.schema(PIECES_SCHEMA).parquet(f"{scratch}/pieces")
    headers = pieces.filter("start = 0").select("header").distinct().limit(2).collect()

    cut = pieces.filter("start > 0").select("file", "salted").distinct()
    walked = pieces.join(cut, ["file", "salted"], "left_semi").groupBy("file", "salted").applyInArrow(_walk, BORDERS_SCHEMA)
    # of the files of one range, those that end within quotes
    alone = pieces.join(cut, ["file", "salted"], "left_anti").filter("NOT out_after_out")
    walked = walked.unionByName(alone.groupBy("file", "salted").applyInArrow(_walk, BORDERS_SCHEMA))
    walked.write.parquet(f"{scratch}/borders")
    borders = spark.read.schema(BORDERS_SCHEMA).parquet(f"{scratch}/borders")

    starts: dict[tuple, list[int]] = {}
    inside: dict[tuple, list[int]] = {}
    for r in borders.filter("start > 0").select("file", "salted", "start", "inside").toArrow().to_pylist():
        starts.setdefault((r["file"], r["salted"]), []).append(r["start"])
        if r["inside"]:
            inside.setdefault((r["file"], r["salted"]), []).append(r["start"])
    ranges = _Ranges(*[{k: np.array(sorted(v), np.int64) for k, v in d.items()} for d in (starts, inside)])
    found = lines.mapInArrow(_within(ranges, delimiter), "record string")
    found = found.unionByName(borders.select(F.explode("records").alias("record")))
    long = borders.filter("size(long) > 0").select("file", "salted", "start", "long").toArrow().to_pylist()
    if long:
        wanted = {(r["file"], r["salted"], r["start"]): r["long"] for r in long}
        of_files = lines.join(F.broadcast(borders.filter("size(long) > 0").select("file", "salted").distinct()), ["file", "salted"], "left_semi")
        again = of_files.select("value", "file", "salted", "start").mapInArrow(
            _again(ranges, wanted, delimiter), "file long, salted long, record int, place int, text string"
        )
        texts = F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"])
        joined = again.groupBy("file", "salted", F.col("record").alias("_n")).agg(F.array_join(texts, "\n").alias("record"))
        found = found.unionByName(joined.select(F.regexp_replace("record", r"\r\z", "").alias("record")))
    return [h.header for h in headers if h.header], found.filter("record != ''")


def multiline_csv(
    spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], delimiter: str = ",", range_bytes: int | None = None
) -> DataFrame:
    """CSV file(s) with a header, as text columns of these names; the headers must agree."""
    headers, records = read_records(spark, path, delimiter, range_bytes)
    if len(headers) > 1:
        raise ValueError(f"files of {path} have different headers: {headers}")
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    options = {"multiLine": "true", "escape": QUOTE, "sep": delimiter}
    return records.select(F.from_csv("record", schema, options).alias("r")).select("r.*")
