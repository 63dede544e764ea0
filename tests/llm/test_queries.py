"""The registered queries over the given tables: against DuckDB where SQL says it, else brute force."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from starloom.llm import language_id, queries
from tests.conftest import TESTDATA
from tests.llm import test_credentials, test_jaccard_join, test_pii, test_substring_dedup
from tests.test_oracle import rows_of

SF_DIR = f"{TESTDATA}/sf0.01"


@pytest.fixture(scope="module")
def documents_rows():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet' ORDER BY doc_id").fetchall()


def test_all_are_registered():
    numbers = sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries())
    assert set(queries.ORACLE_SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_like_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    expected = duck("0.01").execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in expected.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, expected.fetchall())


def test_op1(spark, documents_rows):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op1_jaccard_join(spark, SF_DIR).collect()}
    assert found == test_jaccard_join.brute_force(documents_rows, queries.SIMILAR)


def test_op5_exact_repeats(spark, documents_rows):
    """Every line removed has an earlier equal or near one; all equal ones are removed."""
    rows = {r.doc_id: r for r in queries.op5_line_dedup(spark, SF_DIR).collect()}
    seen = set()
    for doc_id, text in documents_rows:
        again = 0
        for line in text.split("\n"):
            again += len(line) >= queries.LINE_CHARS and line in seen
            seen.add(line)
        assert rows[doc_id].n_lines == text.count("\n") + 1
        assert again <= rows[doc_id].n_removed <= rows[doc_id].n_lines


def test_op5_short_repeats(spark, documents_rows):
    """Exact repeats of all lines but blank ones are removed, however short."""
    rows = {r.doc_id: r for r in queries.op5_line_dedup(spark, SF_DIR).collect()}
    seen = set()
    for doc_id, text in documents_rows:
        again = 0
        for line in text.split("\n"):
            again += bool(line.strip()) and line in seen
            seen.add(line)
        assert again <= rows[doc_id].n_removed


def test_op8(spark, documents_rows):
    found = {r.doc_id: r for r in queries.op8_personal_data(spark, SF_DIR).collect()}
    for doc_id, text in documents_rows:
        spans = test_pii.plain(text)
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        r = found[doc_id]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in test_pii.PLAIN]
        assert set(listed.split(",")) <= set(r.spans.split(","))


def test_op9(spark, documents_rows):
    found = queries.op9_substring_dedup(spark, SF_DIR).collect()
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found]
    assert sorted(got, key=str) == test_substring_dedup.brute_force(documents_rows, queries.PASSAGE_WORDS)


def test_op11(spark, documents_rows):
    found = {r.doc_id: r for r in queries.op11_secret_scan(spark, SF_DIR).collect()}
    assert len(found) == len(documents_rows)
    for doc_id, text in documents_rows:
        spans = test_credentials.plain(text)
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        r = found[doc_id]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")]
        # these texts hold no credentials but those of the base kinds
        assert r.spans == listed


@pytest.fixture(scope="module")
def document_ids(documents_rows):
    """doc_id -> token ids of the whole text, by the tokenizer itself."""
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    return {d: tokenizer.encode(t or "", add_special_tokens=False).ids for d, t in documents_rows}


def crc32_of(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op2(spark, document_ids):
    want, start = [], 0
    for doc_id, ids in sorted(document_ids.items()):
        want.append((doc_id, start, len(ids) + 1, crc32_of([*ids, 1])))
        start += len(ids) + 1
    found = queries.op2_token_records(spark, SF_DIR).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found) == want


def test_op7(spark, document_ids):
    want = []
    for doc_id, ids in document_ids.items():
        whole = [*ids, 0]
        for k in range(0, len(whole), queries.CAPACITY):
            part = whole[k : k + queries.CAPACITY]
            want.append((doc_id, k // queries.CAPACITY, k, len(part), crc32_of(part)))
    rows = queries.op7_best_fit_packing(spark, SF_DIR).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= queries.CAPACITY
    assert len(ends) <= -(-sum(ends.values()) // queries.CAPACITY) * 1.02 + 1


def test_op10(spark, documents_rows):
    """Predictions against a loop over each text's positions."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = language_id.train(docs.filter(~language_id.held_out("doc_id")))
    rows = {r.doc_id: r for r in queries.op10_language_id(spark, SF_DIR).collect()}
    for doc_id, text in documents_rows[::25]:
        raw = [b if 97 <= b <= 122 or b >= 128 else 0 for b in (" " + text.lower()).encode()] + [0] * 4
        total, n = np.zeros(len(model.languages)), 0
        for at in range(len(raw) - 4):
            for size in language_id.SIZES:
                gram = raw[at : at + size]
                if 0 in gram[1:-1] or not (gram[0] or gram[-1]):
                    continue
                value = int.from_bytes(bytes(gram), "big")
                hashed = (value * 0x9E3779B1 + size) * 0x85EBCA6B & 0xFFFFFFFF
                total += model.weights[hashed >> 17]
                n += 1
        logits = (total / max(n, 1) + model.bias) / model.temperature
        p = np.exp(logits - logits.max())
        p /= p.sum()
        assert rows[doc_id].lang_pred == model.languages[int(p.argmax())]
        assert rows[doc_id].score == pytest.approx(p.max(), abs=1e-6)
