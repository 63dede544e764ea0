"""Language identification: accuracy on held-out rows, and odd inputs."""

import random
import zlib

import pytest

from starloom.llm import language_id
from tests.conftest import TESTDATA

SYLLABLES = {"aa": "ka lo mi tu ne", "bb": "schr eng ung pfl tze", "cc": "éau oi ç où è"}


def text(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(3)) for _ in range(words)).capitalize()


def labelled(spark, n=300, seed=1):
    rng = random.Random(seed)
    rows = [(i, text(rng, lang := rng.choice("aa bb cc".split()), rng.randint(3, 60)), lang) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_learns_and_scores(spark):
    rows, frame = labelled(spark)
    model = language_id.train(frame.filter(~language_id.held_out("doc_id")))
    assert model.languages == ("aa", "bb", "cc")
    found = {r.doc_id: r for r in language_id.predict(frame.drop("lang"), model).collect()}
    held_out = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(held_out) > 50
    assert sum(found[i].lang_pred == lang for i, _, lang in held_out) >= 0.98 * len(held_out)
    assert all(0 <= r.score <= 1 for r in found.values())
    again = {r.doc_id: r for r in language_id.predict(frame.drop("lang"), model).collect()}
    assert again == found


def test_odd_texts(spark):
    _, frame = labelled(spark, 60)
    model = language_id.train(frame)
    odd = [(1, None, "x"), (2, "", "x"), (3, "12 :-) _ \u00bd \u2167", "x"), (4, "a", "x"), (None, "kalomi " * 50_000, None)]
    rows = spark.createDataFrame(odd, "doc_id long, text string, score string")
    found = {r.doc_id: r for r in language_id.predict(rows, model).collect()}
    for i in (1, 2, 3):
        assert (found[i].lang_pred, found[i].score, found[i].accepted) == ("und", 0.0, False)
    assert found[4].lang_pred in model.languages
    assert found[None].lang_pred == "aa"


def test_nothing_to_learn_from(spark):
    rows = spark.createDataFrame([(1, "kalo", None), (2, None, "aa"), (3, "1", "aa")], "doc_id long, text string, lang string")
    model = language_id.train(rows)
    assert model.languages == ()
    assert [r.lang_pred for r in language_id.predict(rows, model).collect()] == ["und"] * 3
    assert language_id.train(rows.limit(0)).languages == ()


def test_rows_without_an_id_and_of_one_id(spark, monkeypatch):
    """They are learned from like others, one of equal rows, and never more of a language than the bound."""
    rows, _ = labelled(spark, 240)
    given = [(None if i % 2 else 7, t, lang) for i, t, lang in rows] + [(7, "kalomi tunene", "aa")] * 3000
    frame = spark.createDataFrame(given, "doc_id long, text string, lang string")
    sizes = []
    fit = language_id.fit
    monkeypatch.setattr(language_id, "fit", lambda rows, labels, settings: sizes.append(len(rows)) or fit(rows, labels, settings))
    model = language_id.train(frame, language_id.Settings(rows_per_language=50))
    assert sizes[0] <= 150 and model.languages == ("aa", "bb", "cc")
    langs, _ = language_id.predict_texts([t for _, t, _ in rows], model)
    assert sum(x == lang for x, (_, _, lang) in zip(langs, rows, strict=True)) > 0.9 * len(rows)


def test_a_text_scores_alike_in_any_company(spark):
    _, frame = labelled(spark, 60)
    model = language_id.train(frame)
    texts = ["kalomi tune", "schrengung", "éauoi ç"]
    together = language_id.predict_texts(texts, model)
    for i, t in enumerate(texts):
        alone = language_id.predict_texts([t], model)
        assert (alone[0][0], alone[1][0]) == (together[0][i], together[1][i])


def test_held_out_rows_are_a_quarter_by_crc(spark):
    frame = spark.range(1000).selectExpr("id AS doc_id").select("doc_id", language_id.held_out("doc_id").alias("h"))
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in frame.collect())


def test_accuracy_on_the_given_documents(spark):
    from starloom.llm.queries import op10_language_id

    sf_dir = f"{TESTDATA}/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op10_language_id(spark, sf_dir).collect()
    held_out = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held_out) / len(held_out) > 0.97
