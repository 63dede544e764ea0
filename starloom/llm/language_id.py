"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is lower-cased, and every byte that is no ASCII letter and not above 0x7F ends a word. Its
features are the runs of 2 to 4 bytes that hold no word end but at their own ends, hashed into buckets.
Each bucket has an embedding; a text is the mean of its features' embeddings, and a linear softmax on
that gives the languages' probabilities. Both are trained together by stochastic gradient descent in
numpy on the driver, from a bounded sample of labelled rows. The softmax is calibrated by a temperature
on rows of the sample that training leaves out; a text is rejected where its score is below what
nearly all rightly predicted ones of these reach.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm import words

UNDETERMINED = "und"
BUCKETS = 1 << 15
SIZES = (2, 3, 4)
#: Up to so many languages, their counts and sampled ids (some 30 bytes each) are broadcast; beyond, joined.
MOST_LANGUAGES = 500
LETTER = re.compile(r"[^\W\d_]")  # letters, and signs like a half or a Roman number

_KEEP = np.zeros(256, np.uint32)
_KEEP[0x80:] = np.arange(0x80, 0x100)
_KEEP[0x61:0x7B] = np.arange(0x61, 0x7B)


@dataclass(frozen=True)
class Settings:
    """`rows_per_language` bounds the sample: of each language the labelled rows that come first in
    a seeded random order."""

    rows_per_language: int = 1000
    dimensions: int = 16
    epochs: int = 5
    rate: float = 0.5
    seed: int = 7
    calibration_share: float = 0.2
    reject_right: float = 0.002


@dataclass(frozen=True)
class Model:
    """`weights`: a score per bucket and language (embeddings times softmax matrix); the row after
    the last bucket is zero, for what is no feature."""

    languages: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every position of all texts and feature size (BUCKETS where there is no
    feature), of shape (sizes, positions), and where each text starts."""
    parts = [b" " + t.lower().encode("utf-8", "replace") for t in texts]
    starts = np.cumsum([0, *map(len, parts)])[:-1]
    codes = _KEEP[np.frombuffer(b"".join(parts) + b" " * max(SIZES), np.uint8)]
    n = len(codes) - max(SIZES)
    end = codes == 0
    out = np.empty((len(SIZES), n), np.int64)
    value = codes[:n].copy()
    inner = np.zeros(n, bool)  # a word end among the bytes between the first and the last
    for k in range(1, max(SIZES)):
        value = (value << np.uint32(8)) | codes[k : n + k]
        size = k + 1
        if size in SIZES:
            hashed = (value * np.uint32(0x9E3779B1) + np.uint32(size)) * np.uint32(0x85EBCA6B)
            row = (hashed >> np.uint32(32 - 15)).astype(np.int64)
            row[inner | (end[:n] & end[k : n + k])] = BUCKETS
            out[SIZES.index(size)] = row
        inner |= end[k : n + k]
    return out, starts


def held_out(doc_id: Column | str) -> Column:
    """A quarter of all documents, by the CRC-32 of the id as text; no id: false."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit a model to `docs` (doc_id, text, lang). Rows without text, letters or lang don't count.

    The sample's features reach the driver as counts per bucket, so a row is small however long its text is.
    Without any labelled row the model has no language and rejects everything.
    """
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    labelled = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").withColumn("_t", F.xxhash64("text"))
    # rows that share an id, or have none, go by their texts; equal rows count as one
    ids = labelled.select("doc_id", "lang", "_t").distinct()
    ids = ids.withColumn("_h", F.xxhash64(F.lit(settings.seed), "doc_id", "_t"))
    # about twice the rows wanted come below a level of the hash, so few rows are ranked
    per_language = ids.groupBy("lang").agg(F.count("*").alias("_rows"))
    few = F.broadcast if per_language.limit(MOST_LANGUAGES + 1).count() <= MOST_LANGUAGES else lambda df: df
    ids = ids.join(few(per_language), "lang")
    share = F.pmod("_h", F.lit(1 << 30)) / (1 << 30)
    ids = ids.filter(share * F.col("_rows") <= 2 * settings.rows_per_language)
    order = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id", "_t"))
    chosen = ids.withColumn("_n", order).filter(F.col("_n") <= settings.rows_per_language)
    chosen = few(chosen.select("doc_id", "lang", "_t")).alias("c")
    same = F.col("l.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("l.lang") == F.col("c.lang")) & (F.col("l._t") == F.col("c._t"))
    # one of equal rows, however many there are
    sample = labelled.alias("l").join(chosen, same, "left_semi").dropDuplicates(["doc_id", "lang", "_t"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, 250):
            rows = []
            for text in batch.column("text").to_pylist():
                buckets, n = np.unique(features([text])[0], return_counts=True)
                inside = buckets < BUCKETS
                rows.append((buckets[inside].astype(np.int32), n[inside].astype(np.int32)))
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    batch.column("_t"),
                    batch.column("lang"),
                    pa.array([r[0] for r in rows], pa.list_(pa.int32())),
                    pa.array([r[1] for r in rows], pa.list_(pa.int32())),
                ],
                names=["doc_id", "_t", "lang", "buckets", "counts"],
            )

    counted = sample.filter(F.col("text").rlike(r"\p{L}")).mapInArrow(
        count, "doc_id long, _t long, lang string, buckets array<int>, counts array<int>"
    )
    rows = []
    for batch in counted.toArrow().to_batches():
        buckets, counts = batch.column("buckets"), batch.column("counts")
        at, values, numbers = buckets.offsets.to_numpy(), buckets.values.to_numpy(), counts.values.to_numpy()
        for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lang", "doc_id", "_t")), strict=True)):
            a, b = at[i], at[i + 1]
            if b > a:
                row = (values[a:b].astype(np.uint16), (numbers[a:b] / numbers[a:b].sum()).astype(np.float32))
                rows.append(((key[0], key[1] is None, key[1] or 0, key[2]), row))
        del batch, buckets, counts, values, numbers
    words.give_back_memory()
    rows.sort(key=lambda r: r[0])
    model = fit([r[1] for r in rows], [r[0][0] for r in rows], settings)
    del rows
    words.give_back_memory()
    return model


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], settings: Settings = Settings()) -> Model:
    """Stochastic gradient descent on rows of buckets and each one's share of the features, then calibration."""
    languages = tuple(sorted(set(labels)))
    if not languages:
        return Model((), np.zeros((BUCKETS + 1, 0)), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(settings.seed)
    y = np.array([languages.index(x) for x in labels])
    shares = rows
    aside = rng.random(len(rows)) < settings.calibration_share
    if len(rows) < 20 or len(set(y[~aside])) < len(languages):
        aside[:] = False
    train_on = np.flatnonzero(~aside)
    d = settings.dimensions
    embedding = rng.uniform(-1 / d, 1 / d, (BUCKETS, d))
    matrix, bias = np.zeros((d, len(languages))), np.zeros(len(languages))
    steps, step = settings.epochs * len(train_on), 0
    for _ in range(settings.epochs):
        for i in rng.permutation(train_on):
            rate = settings.rate * (1 - step / steps)
            buckets, share = shares[i]
            mean = share @ embedding[buckets]
            error = _softmax(mean @ matrix + bias)
            error[y[i]] -= 1
            back = matrix @ error
            matrix -= rate * np.outer(mean, error)
            bias -= rate * error
            # a feature's step is by its share of the text, times the number of features, at most 1
            embedding[buckets] -= rate * np.minimum(share * len(share), 1)[:, None] * back
            step += 1
    weights = np.vstack([embedding @ matrix, np.zeros((1, len(languages)))])
    check = np.flatnonzero(aside) if aside.any() else train_on
    logits = np.array([shares[i][1] @ weights[shares[i][0]] + bias for i in check])
    temperatures = np.geomspace(0.05, 20, 61)
    losses = [-np.log(_softmax(logits / t)[np.arange(len(check)), y[check]] + 1e-12).mean() for t in temperatures]
    temperature = float(temperatures[int(np.argmin(losses))])
    p = _softmax(logits / temperature)
    right = p.argmax(1) == y[check]
    top = p.max(1)[right]
    threshold = float(np.quantile(top, settings.reject_right, method="lower")) if right.any() else 1.0
    # never so high that a text is rejected whose language is likelier than all others together
    return Model(languages, weights, bias, temperature, min(threshold, 0.5))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text))


def predict_texts(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and score of each text. UNDETERMINED with score 0: no text, no letter, no language
    learnt."""
    known = [i for i, t in enumerate(texts) if t and has_letter(t)] if model.languages else []
    found, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    if known:
        buckets, starts = features([texts[i] for i in known])
        total = np.zeros((len(known), len(model.languages)))
        n = np.zeros(len(known))
        for row in buckets:
            n += np.add.reduceat((row < BUCKETS).astype(np.int64), starts)
            for k in range(len(model.languages)):
                total[:, k] += np.add.reduceat(np.ascontiguousarray(model.weights[:, k])[row], starts)
        p = _softmax((total / np.maximum(n, 1)[:, None] + model.bias) / model.temperature)
        for i, k, s in zip(known, p.argmax(1), p.max(1), strict=True):
            found[i], score[i] = model.languages[k], s
    return found, score


def predict(
    docs: DataFrame, model: Model, names: tuple[str, str, str] = ("lang_pred", "score", "accepted")
) -> DataFrame:
    """`docs` with lang_pred, score (0 to 1) and accepted: whether the model is sure enough of it.

    They take the place of columns of these `names`. Only the text counts. A null or letterless text is UNDETERMINED, with score 0, and not accepted.
    """
    keep = [c for c in docs.columns if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, 250):
            found, score = predict_texts(batch.column("text").to_pylist(), model)
            accepted = [x != UNDETERMINED and s >= model.threshold for x, s in zip(found, score, strict=True)]
            yield pa.record_batch(
                [*batch.columns, pa.array(found), pa.array(score), pa.array(accepted, pa.bool_())],
                names=[*keep, *names],
            )

    frame = docs.select(*keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
    language, score, accepted = names
    return frame.mapInArrow(run, f"{fields}, `{language}` string, `{score}` double, `{accepted}` boolean")
