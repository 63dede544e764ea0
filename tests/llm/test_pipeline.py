"""Each stage of the pipeline on all that the stage before kept, against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from starloom.llm import language_id
from starloom.llm.queries import LINE_CHARS, LINE_EDITS, tokenizer_path
from tests.conftest import TESTDATA
from tests.llm.test_jaccard_join import brute_force as similar
from tests.llm.test_line_dedup import brute_force_all as without_repeated_lines
from tests.llm.test_mixing import filled_step_by_step

SF_DIR = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents and every stage's result, as written."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append(docs)
    return out


def test_order_and_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "line_dedup", "ngram_jaccard_join", "mixing", "best_fit_packing",
    ]
    for frame in stages[1:5]:
        assert frame.dtypes == stages[0].dtypes
        assert 0 < frame.count()


def test_language_id(stages):
    model = language_id.train(stages[0])
    rows = stages[0].collect()
    langs, scores = language_id.predict_texts([r.text for r in rows], model)
    want = {r for r, x, s in zip(rows, langs, scores, strict=True) if x != "und" and s >= model.threshold}
    assert set(stages[1].collect()) == want
    right = [x == r.lang for r, x in zip(rows, langs, strict=True)]
    assert sum(right) > 0.95 * len(right)


def test_line_dedup(stages):
    """Whole texts, against all pairs of lines within two edits and exact repeats of short lines."""
    rows = {r.doc_id: r for r in stages[1].collect()}
    want = without_repeated_lines([(r.doc_id, r.text) for r in rows.values()], LINE_EDITS, LINE_CHARS)
    kept = {i: text for i, (text, n, gone) in want.items() if gone == 0 or gone < n}
    got = {r.doc_id: r for r in stages[2].collect()}
    assert {i: r.text for i, r in got.items()} == kept
    for i, r in got.items():
        assert (r.n_chars, r.lang, r.source) == (len(r.text), rows[i].lang, rows[i].source)


def test_near_duplicates(stages):
    rows = stages[2].collect()
    groups = similar([(r.doc_id, r.text) for r in rows], corpus_pipeline.NEAR)
    want = {r for r in rows if groups[r.doc_id][1] == r.doc_id}
    assert set(stages[3].collect()) == want


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mixing(stages):
    rows, mixed = stages[3].collect(), Counter(stages[4].collect())
    assert set(mixed) <= set(rows)
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in rows:
        sizes[r.source] += n_words(r.text)
        taken[r.source] += n_words(r.text) * mixed[r]
        largest[r.source] = max(largest[r.source], n_words(r.text))
    for source, target in filled_step_by_step(sizes, (5, 2, 1), 1.5, 2).items():
        assert abs(taken[source] - target) <= largest[source] / 2 + 1
    assert max(mixed.values()) <= 2


def test_packing(stages):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = {
        r.doc_id: np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for r in stages[3].collect()
    }
    repeats = Counter(r.doc_id for r in stages[4].select("doc_id").collect())
    rows = stages[5].collect()
    whole = Counter()
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert (len(part), zlib.crc32(part.tobytes())) == (r.length, r.ids_crc32)
        whole[r.doc_id] += r.length
    assert whole == {d: n * len(ids[d]) for d, n in repeats.items()}
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048
    assert len(ends) <= -(-sum(whole.values()) // 2048) * 1.05 + 1


def test_odd_rows(spark, tmp_path):
    """Nulls in every column, empty texts, repeated rows, more columns of clashing names, a long text."""
    words = " ".join(f"the{i} other{i}" for i in range(60))
    rows = [
        (1, words, "en", "a", 5, "x", 1), (1, words, "en", "a", 5, "x", 1), (2, words + " end", "en", "a", 5, "x", 1),
        (3, None, "en", "a", 0, "x", 1), (4, "", None, None, 0, None, None), (None, "und der die das " * 9, "de", None, None, None, 2),
        (6, "der und die " * 30_000, "de", "b", 1, "x", 1), (7, None, None, None, None, None, None), (8, "123 456", "en", "b", 1, "x", 3),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, copies int"
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{len(given)}{name}")
            stage(spark, docs, SF_DIR).write.parquet(path)
            if k < 4:
                assert spark.read.parquet(path).dtypes == docs.dtypes
                docs = spark.read.parquet(path)
        ids = {r.doc_id for r in docs.collect()}
        assert ids <= {1, None, 6}


def test_texts_that_share_a_doc_id(spark):
    """Different texts of one id stay, each as a document of its own; copies and near copies of any go."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(5, text(1)), (5, text(2)), (5, text(2)), (5, text(3)), (6, text(3) + " end"), (3, text(2) + " end"), (9, text(4)), (None, text(4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF_DIR)
    assert got.columns == ["doc_id", "text"]
    found = sorted(map(tuple, got.collect()), key=str)
    assert found == sorted([(5, text(1)), (5, text(3)), (3, text(2) + " end"), (9, text(4)), (None, text(4))], key=str)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF_DIR).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None
