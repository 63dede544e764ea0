"""Token ids as files of length-delimited binary records, with a separate offset index.

File format. A record is

    length of the payload   8 bytes, little-endian unsigned
    masked checksum of those 8 bytes, 4 bytes
    payload
    masked checksum of the payload, 4 bytes
    one byte 0x0A

and the payload is one byte (1 if the document has an id, else 0), the id as 8 bytes signed, one byte
with the width of a token id (2 or 4), and the token ids, all little-endian. A checksum is a CRC-32,
rotated right by 15 bits plus a constant, so that checksums of data that hold checksums
stay meaningful. Files are written by Spark's text writer (the byte 0x0A is its line end), so they
reach any store that Spark writes, and a lost task leaves no half file. Their names are in
document order.

The index is a table of one row per record: file, offset, length, doc_id, n_tokens, start (ids in all
records before it) and the CRC-32 of the ids. `read_records` fetches any records in any order by it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.llm import tokens, words

#: Bytes of text whose ids make up one file.
FILE_TEXT_BYTES = 24 << 20
_MASK = 0xA282EAD8


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    head = struct.pack("<I", masked(length))
    return b"".join([length, head, payload, struct.pack("<I", masked(payload)), b"\n"])


def unframe(data: bytes, offset: int) -> bytes:
    """The payload of the record at `offset`; ValueError if a checksum does not hold."""
    length = data[offset : offset + 8]
    (n,) = struct.unpack("<Q", length)
    (head,) = struct.unpack_from("<I", data, offset + 8)
    if masked(length) != head:
        raise ValueError(f"wrong checksum of the length at byte {offset}")
    payload = data[offset + 12 : offset + 12 + n]
    if len(payload) < n or masked(payload) != struct.unpack_from("<I", data, offset + 12 + n)[0]:
        raise ValueError(f"wrong checksum of the record at byte {offset}")
    return payload


def pack_ids(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    head = struct.pack("<BqB", doc_id is not None, doc_id or 0, width)
    return head + ids.astype(f"<u{width}").tobytes()


def unpack_ids(payload: bytes) -> tuple[int | None, np.ndarray]:
    known, doc_id, width = struct.unpack_from("<BqB", payload)
    return (doc_id if known else None), np.frombuffer(payload, f"<u{width}", offset=10).astype("<u4")


def write_records(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int) -> None:
    """Encode `docs` (doc_id, text), put `end_id` behind each, and write files in ascending doc_id.

    A null text is empty, so its record holds the end id alone. A null doc_id comes first. Rows of equal
    doc_id each get a record, in the order of a hash of their texts; however many they are, they are dealt to files as
    evenly as others. Without rows there are no records.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = int(size // FILE_TEXT_BYTES) + 1

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer_path)
        for batch in words.slices(batches, 1000):
            ids, at = encoder.encode(batch.column("text"))
            end = np.array([end_id], np.uint32)
            records = [
                # without the last byte, which the text writer adds
                frame(pack_ids(doc_id, np.concatenate([ids[at[i] : at[i + 1]], end])))[:-1]
                for i, doc_id in enumerate(batch.column("doc_id").to_pylist())
            ]
            yield pa.record_batch([pa.array(records, pa.binary())], names=["record"])

    # ranges of ids; rows of one id are told apart by their texts, equal ones by their places
    order = ["doc_id", "_text_hash", "_place"]
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns(
        {"_text_hash": F.xxhash64("text"), "_place": F.monotonically_increasing_id()}
    )
    ordered = placed.repartitionByRange(files, *order).sortWithinPartitions(*order)
    records = ordered.select("doc_id", "text").mapInArrow(encode, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.text(folder)


def scan_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of all files, in any order: file, offset, length, doc_id, n_tokens,
    `before` (ids in the records before it in its file) and ids_crc32. Checks all checksums."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                data = memoryview(content.as_buffer())
                rows, offset, before = [], 0, 0
                while offset < len(data):
                    payload = unframe(data, offset)
                    doc_id, ids = unpack_ids(payload)
                    length = len(payload) + 17
                    rows.append((offset, length, doc_id, len(ids), before, zlib.crc32(ids.tobytes())))
                    offset, before = offset + length, before + len(ids)
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                arrays = [pa.array([name.as_py().rsplit("/", 1)[1]] * len(rows), pa.string())]
                arrays += [pa.array(c, pa.int64()) for c in columns]
                yield pa.record_batch(
                    arrays, names=["file", "offset", "length", "doc_id", "n_tokens", "before", "ids_crc32"]
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("path", "content").mapInArrow(
        scan,
        "file string, offset long, length long, doc_id long, n_tokens long, before long, ids_crc32 long",
    )


def file_number(file: str) -> Column:
    """The number in a file's name. Spark writes it with five digits, or more from 100,000 on."""
    return F.regexp_extract(file, r"part-(\d+)", 1).cast("long")


def write_index(spark: SparkSession, folder: str, index_folder: str) -> DataFrame:
    """Scan the record files, write their index and return it.

    `start` needs the ids of all files before one: one row per file, summed in the order of the files' numbers.
    """
    rows = scan_records(spark, folder)
    rows.write.parquet(f"{index_folder}/records")
    records = spark.read.schema(rows.schema).parquet(f"{index_folder}/records")
    by_file = records.groupBy("file").agg(F.sum("n_tokens").alias("ids"))
    earlier = Window.orderBy(file_number("file"), "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_file.select("file", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("_start"))
    index = records.join(starts, "file").withColumn("start", F.col("_start") + F.col("before"))
    index.drop("_start", "before").write.parquet(f"{index_folder}/index")
    return spark.read.parquet(f"{index_folder}/index")


def read_records(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """The records that `wanted` (rows of the index: file, offset, and any other columns but
    `content`) points to, with their `doc_id` and `ids`, for reads in a shuffled order: files are
    read where records of them are wanted and the rest of each is skipped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    offsets = wanted.groupBy("file").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data = memoryview(batch.column("content")[row].as_buffer())
                offsets = batch.column("offsets")[row].as_py()
                found = [unpack_ids(unframe(data, o)) for o in offsets]
                yield pa.record_batch(
                    [
                        pa.array([batch.column("file")[row].as_py()] * len(found), pa.string()),
                        pa.array(offsets, pa.int64()),
                        pa.array([d for d, _ in found], pa.int64()),
                        pa.array([i.astype(np.int32) for _, i in found], pa.list_(pa.int32())),
                    ],
                    names=["file", "offset", "doc_id", "ids"],
                )

    schema = "file string, offset long, doc_id long, ids array<int>"
    return files.join(offsets, "file").mapInArrow(fetch, schema)
