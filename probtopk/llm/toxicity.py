"""Toxicity by multiple-instance learning.

A document is a bag of sentences, and only documents are labelled. A sentence's
score is a logistic function of its words' features; the document's score is the
noisy-or of its sentences, 1 - prod(1 - p). The weights are trained from the document labels through
that noisy-or, which sends the blame for a toxic label to the sentences that explain it; so the
same weights locate the offending sentences.

The sentence bias is a fixed small leak, and scoring leaves the leak's own share
out: a sentence without any weight adds nothing, so that a long clean text does
not add up to a toxic one. Training uses a bounded sample of labelled rows on the
driver; scoring is one pass over all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The bound of the training sample: rows per label, and code points per text.
TRAIN_ROWS, TRAIN_CHARS = 2500, 20_000
N_FOLDS = 5
LEAK = -12.0
#: What the leak alone would take from the log of a sentence's chance to be clean.
LEAK_SHARE = float(np.logaddexp(0, LEAK))
STEPS, RATE, L2, MIN_DOCS, MAX_FEATURES, LEAST_G = 150, 0.2, 1e-5, 4, 5000, 15.0
PREFIXES = (3, 4, 5, 6)
CACHE = 100_000
#: Rows of an Arrow batch; rows carry whole texts.
BATCH_ROWS = 1000

SENTENCE = re.compile(r"[^.!?\n]+")
SCORE_SCHEMA = "id long, score double, sentences array<struct<start:int,end:int,score:double>>"


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo N_FOLDS; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % N_FOLDS


def features(word: str) -> list[str]:
    """The word in lower case without marks around it, and its beginnings."""
    w = word.lower().strip("'\"()[]{},;:-|*#%$&<>_=")
    return [w, *(f"^{w[:n]}" for n in PREFIXES if len(w) >= n)] if w else []


def sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    for m in SENTENCE.finditer(text):
        if words := m[0].split():
            yield m.start(), m.end(), words


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> pd.DataFrame:
    """Columns text and toxic of at most 2 * TRAIN_ROWS rows outside fold 0: per label those with the smallest hashes."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold("doc_id") != 0))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [common.smallest_hashes(marks.where(F.col("toxic") == y), TRAIN_ROWS, "doc_id") for y in (0, 1)]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.length("text") <= TRAIN_CHARS)
    picked = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")  # at most 2 * TRAIN_ROWS ids
    return picked.orderBy("doc_id", F.xxhash64("text")).limit(2 * TRAIN_ROWS).select("text", "toxic").toPandas()


def telling(texts: list[str], y: np.ndarray) -> list[str]:
    """At most MAX_FEATURES features that toxic rows have more often than others, by the G statistic of their document counts."""
    counts: dict[str, list[int]] = {}
    for text, label in zip(texts, y, strict=True):
        for f in {f for _, _, words in sentences(text) for w in words for f in features(w)}:
            counts.setdefault(f, [0, 0])[int(label)] += 1
    names = sorted(f for f, n in counts.items() if n[1] >= MIN_DOCS)
    n = np.array([counts[f] for f in names], np.float64).reshape(-1, 2)
    size = np.array([(y == 0).sum(), (y == 1).sum()], np.float64)
    rate = n.sum(1, keepdims=True) / size.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(n > 0, n * np.log(n / (rate * size)), 0) + np.where(n < size, (size - n) * np.log((size - n) / ((1 - rate) * size)), 0)).sum(1)
    more = n[:, 1] / size[1] > n[:, 0] / size[0]
    order = np.argsort(-np.where(more, g, -1.0), kind="stable")[:MAX_FEATURES]
    return [names[i] for i in order if more[i] and g[i] >= LEAST_G]


def train(texts: list[str], labels: list[int]) -> dict[str, float]:
    """Feature weights, none below 0, by projected gradient steps (Adam) on the noisy-or log loss with an L2 penalty; both labels weigh the same."""
    y = np.asarray(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return {}
    index = {f: i for i, f in enumerate(telling(texts, y))}
    of_sentence, of_feature, of_bag, n = [], [], [], 0
    for d, text in enumerate(texts):  # features are made again here: to keep them all would take a GB
        for _, _, words in sentences(text):
            if ids := [index[f] for w in sorted(set(words)) for f in features(w) if f in index]:
                of_sentence += [n] * len(ids)
                of_feature += ids
                of_bag.append(d)
                n += 1
    rows, cols, owner = np.array(of_sentence, np.int64), np.array(of_feature, np.int64), np.array(of_bag, np.int64)
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, m, v = np.full(len(index), 4.0), np.zeros(len(index)), np.zeros(len(index))  # a start where the leak does not hide the gradient
    for step in range(1, STEPS + 1):
        z = np.clip(LEAK + np.bincount(rows, w[cols], n), -40, 40)
        clean = np.bincount(owner, -np.logaddexp(0, z), len(y))  # log of the chance that no sentence is toxic
        p = -np.expm1(clean)
        blame = np.where(y == 1, -np.exp(clean) / np.maximum(p, 1e-6), 1.0) * share
        dz = blame[owner] / (1 + np.exp(-z))
        g = np.bincount(cols, dz[rows], len(index)) + L2 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w = np.maximum(w, 0)
    return {f: float(w[i]) for f, i in index.items() if w[i] > 1e-3}


class _Weights(dict):
    """Word to weight; kept for CACHE words at most."""

    def __init__(self, model: dict[str, float]):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        found = self[word] = sum(self.model.get(f, 0.0) for f in features(word))
        return found


def score_text(weights: _Weights, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
    """The noisy-or of the sentences, and the sentences that are toxic by themselves (start, end, score)."""
    log_clean, found = 0.0, []
    for start, end, words in sentences(text or ""):
        weight = sum(map(weights.__getitem__, set(words)))
        z = LEAK + weight
        if weight > 0:
            log_clean -= np.logaddexp(0, z) - LEAK_SHARE
        if z >= 0:
            found.append((start, end, 1 / (1 + float(np.exp(-min(z, 40))))))
    return float(-np.expm1(log_clean)), found


def _scorer(held):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = _Weights(held.value)
        for pdf in batches:
            rows = [(i, *score_text(weights, t)) for i, t in zip(pdf["id"], pdf["text"], strict=True)]
            yield pd.DataFrame(rows, columns=["id", "score", "sentences"]).astype({"id": "Int64"})

    return run


def score(docs: DataFrame, model: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, sentences) of every whole text, very long ones too.

    Null and empty texts score 0, repeated rows and null ids each get a row, an empty table gives none; other columns are ignored.
    """
    common.bound_batches(docs.sparkSession, BATCH_ROWS)
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInPandas(_scorer(held), SCORE_SCHEMA).withColumnRenamed("id", id_col)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[str, float]:
    """The model from a bounded sample; without rows of both labels it is empty and every score is near 0."""
    rows = training_rows(docs, labels, id_col, text_col)
    return train(rows["text"].tolist(), rows["toxic"].tolist())


def keep_clean(docs: DataFrame, model: dict[str, float], text_col: str = "text") -> DataFrame:
    """The rows and columns of `docs` whose whole text scores below 0.5.

    Null and empty texts score 0 and stay, very long texts are read whole, repeated rows and null ids are judged by their
    text alone, an empty table gives no rows. A score of exactly 0.5 goes.
    """
    common.bound_batches(docs.sparkSession, BATCH_ROWS)
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    @F.pandas_udf("double")
    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = _Weights(held.value)
        for batch in texts:
            yield pd.Series([score_text(weights, t)[0] for t in batch], dtype="float64")

    return docs.where(scores(F.col(text_col)) < 0.5)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents. Null and empty texts score 0; a null id is not held out; equal texts have equal scores; 0.5 counts as toxic."""
    docs = common.documents(spark, sf_dir)
    scored = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select(
        "doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("sentences").alias("n_toxic_sentences"),
    )
