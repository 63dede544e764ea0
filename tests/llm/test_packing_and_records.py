"""Token records and packing: exact round trips through tokens, files and sequences."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from starloom.llm import packing, token_records
from starloom.llm.queries import tokenizer_path
from starloom.llm.tokens import WordEncoder

TEXTS = [
    "The bleat wh. Orrean it en erat, outi", None, "", "  ", "a|b | c", "Elle's it's. X, <|endoftext|> <|ENDOFTEXT|> a.",
    "É. ÉE, \x85a\xa0b ́x.", "İ ΣΑΣ. '.", "don't.' u.s.a. 3.14, 12,", "|", "a\x1cb", "word " * 5000, "x" * 20_000,
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder(tokenizer_path())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_gives_the_tokenizer_s_ids(tokenizer, encoder):
    for _ in range(2):  # the second time from what it has kept
        ids, at = encoder.encode(pa.array(TEXTS))
        for i, text in enumerate(TEXTS):
            assert ids[at[i] : at[i + 1]].tolist() == ids_of(tokenizer, text), text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aAzÉß.,'|<>!0 \n\t\x85́Σst")), max_size=30), max_size=5))
def test_encoder_on_any_text(tokenizer, encoder, texts):
    ids, at = encoder.encode(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == ids_of(tokenizer, text)


def test_records_round_trip(spark, documents, scratch, tokenizer, monkeypatch):
    monkeypatch.setattr(token_records, "FILE_TEXT_BYTES", 20_000)
    rows = [(i * 3, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[0]), (None, "no id"), (10**12, "last")]
    s = scratch()
    token_records.write_records(documents(rows), s.path("records"), tokenizer_path(), end_id=1)
    index = token_records.write_index(spark, s.path("records"), s.path("index"))
    found = index.orderBy("start").collect()
    start = 0
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert len({r.file for r in found}) > 1
    for row, (doc_id, text) in zip(found, ordered, strict=True):
        ids = np.array([*ids_of(tokenizer, text), 1], "<u4")
        want = (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == want
        start += len(ids)
    wanted = index.filter("n_tokens > 5")
    fetched = token_records.read_records(spark, s.path("records"), wanted).collect()
    assert {(r.file, r.offset) for r in fetched} == {(r.file, r.offset) for r in found if r.n_tokens > 5}
    crc = {(r.file, r.offset): r.ids_crc32 for r in found}
    for r in fetched:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == crc[r.file, r.offset]


def test_records_of_nothing(spark, documents, scratch):
    s = scratch()
    token_records.write_records(documents([]), s.path("records"), tokenizer_path(), end_id=1)
    assert token_records.write_index(spark, s.path("records"), s.path("index")).collect() == []


def test_many_rows_of_one_id(spark, documents, scratch, monkeypatch):
    """They are dealt to several files, and `start` runs on over these."""
    monkeypatch.setattr(token_records, "FILE_TEXT_BYTES", 2000)
    s = scratch()
    rows = [(None, f"word {i % 3}") for i in range(900)] + [(7, "the same")] * 900 + [(9, "last")]
    token_records.write_records(documents(rows), s.path("records"), tokenizer_path(), end_id=1)
    index = token_records.write_index(spark, s.path("records"), s.path("index")).collect()
    assert len(index) == len(rows)
    files = {}
    for r in index:
        files[r.file] = files.get(r.file, 0) + 1
    assert len(files) >= 5 and max(files.values()) < 700
    ends = sorted((r.start, r.start + r.n_tokens, r.doc_id) for r in index)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert [e[2] for e in ends] == [None] * 900 + [7] * 900 + [9]


def test_files_go_by_number(spark):
    names = [f"part-{n:05d}-x-c000.txt" for n in (99_999, 100_000, 7, 1_000_001)]
    frame = spark.createDataFrame([(n,) for n in names], "file string")
    ordered = [r.file for r in frame.orderBy(token_records.file_number("file")).collect()]
    assert ordered == [names[2], names[0], names[1], names[3]]


def test_damage_is_found():
    record = token_records.frame(token_records.pack_ids(7, np.array([1, 2, 70_000], np.uint32)))
    doc_id, ids = token_records.unpack_ids(token_records.unframe(record, 0))
    assert (doc_id, ids.tolist()) == (7, [1, 2, 70_000])
    for i in range(len(record) - 1):
        broken = bytearray(record)
        broken[i] ^= 4
        with pytest.raises(ValueError):
            token_records.unframe(bytes(broken), 0)


def packed(spark, frame, scratch, capacity):
    s = scratch()
    cut = s.keep(packing.pieces(frame, tokenizer_path(), end_id=0, capacity=capacity, with_ids=True), "pieces")
    return packing.pack(spark, cut, capacity)


def check_sequences(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for parts in by_sequence.values():
        end = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing(spark, documents, scratch, tokenizer, capacity):
    texts = dict(enumerate(TEXTS)) | {100 + i: "one two three four five six"[: i % 28] for i in range(200)}
    frame = packed(spark, documents(list(texts.items())), scratch, capacity)
    rows = frame.collect()
    of_doc = {}
    for r in rows:
        of_doc.setdefault(r.doc_id, []).append(r)
    assert set(of_doc) == set(texts)
    for doc_id, parts in of_doc.items():
        ids = np.array([*ids_of(tokenizer, texts[doc_id]), 0], "<u4")
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts)))
        assert [r.start for r in parts] == [k * capacity for k in range(len(parts))]
        assert sum(r.length for r in parts) == len(ids)
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    used = check_sequences(rows, capacity)
    assert used <= -(-sum(r.length for r in rows) // capacity) * 1.1 + 1
    joined = packing.sequences(frame).collect()
    assert len(joined) == used
    assert sum(len(r.ids) for r in joined) == sum(r.length for r in rows)


def test_packing_repeated_and_no_rows(spark, documents, scratch):
    rows = packed(spark, documents([(1, "a b")] * 50 + [(None, None)] * 3), scratch, 8).collect()
    assert len(rows) == 53
    check_sequences(rows, 8)
    assert packed(spark, documents([]), scratch, 8).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.integers(3, 40).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 30)))))
def test_plan_places_every_piece_once(case):
    capacity, counts = case
    kinds = packing.plan(counts, capacity)
    placed = {}
    for n, content in kinds:
        assert n > 0
        assert sum(z * k for z, k in content) <= capacity
        assert sum(k for z, k in content if 3 * z > capacity) <= 2
        for z, k in content:
            placed[z] = placed.get(z, 0) + n * k
    assert placed == counts


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(0)
    sizes, n = np.unique(np.minimum(rng.lognormal(5.5, 1, 100_000).astype(int) + 1, 2048), return_counts=True)
    counts = dict(zip(sizes.tolist(), n.tolist(), strict=True))
    kinds = packing.plan(counts, 2048)
    bound = sum(z * k for z, k in counts.items()) / 2048
    assert sum(n for n, _ in kinds) <= bound * 1.001 + 1
    assert len(packing.places(kinds)) < 30_000
