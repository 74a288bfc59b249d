"""Quality rules with an isolation forest over rule statistics.

Each text is measured by a few rule statistics. An isolation forest, trees of
random splits over small random samples, gives every text an anomaly score from its
mean path length: unusual texts are isolated after few splits. The score above
which a text is dropped is calibrated on all labelled rows: the score that parts
the labels best among those that keep nearly all rows labelled good. Texts
that fail the base rules are dropped before that.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Symbols that count, and the base rules' limits.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5

N_TREES, TREE_ROWS, FOREST_ROWS, SEED = 100, 256, 8192, 7
#: Bins of the calibration histogram, and the most rows labelled good that may be lost.
N_BINS, MAX_GOOD_LOST = 1000, 0.005

#: Capital letters of the Latin and the Latin-1 alphabets.
UPPER = re.compile("[A-ZÀ-ÖØ-Þ]")

STATS_SCHEMA = (
    "id long, th long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, features array<double>"
)


def repeat_words(words: list[bytes]) -> int:
    """Words inside 5-word windows that are found twice or more, the first time included."""
    n = len(words)
    if n <= WINDOW:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    w = np.zeros(n - WINDOW + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(WINDOW):
            w = w * np.uint64(0x9E3779B97F4A7C15) + h[i : n - WINDOW + 1 + i]
            w ^= w >> np.uint64(29)
    _, at, counts = np.unique(w, return_inverse=True, return_counts=True)
    if len(counts) == len(w):
        return 0
    starts = np.flatnonzero(counts[at] > 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, list[float]]:
    """The base statistics of a text and the forest's features; null has no words."""
    text = text or ""
    words = text.encode().split()  # bytes split at the six ASCII white-space characters only
    n, n_chars = len(words), len(text)
    word_chars = n_chars - sum(map(text.count, common.WS_CHARS))
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(common.WS_CHARS)]
    n_dup = len(lines) - len(set(lines))
    n_repeat = repeat_words(words)
    upper = len(UPPER.findall(text))
    chars, count = max(word_chars, 1), max(n, 1)
    features = [
        n_symbols / chars, text.count("!") / chars, text.count("|") / count, upper / chars, n_dup / max(len(lines), 1), n_repeat / count,
        word_chars / count, len(set(words)) / count**0.9, sum(map(text.count, "0123456789")) / chars, sum(map(text.count, ".,;:?")) / chars,
    ]
    return n, word_chars, n_symbols, n_dup, n_repeat, features


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split(" ")[0] for x in STATS_SCHEMA.split(", ")]
    for pdf in batches:
        rows = [(i, t, *measure(x)) for i, t, x in zip(pdf["id"], pdf["th"], pdf["text"], strict=True)]
        yield pd.DataFrame(rows, columns=names).astype({"id": "Int64"})


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, the base statistics, features) of every whole text."""
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    return narrow.mapInPandas(_measured, STATS_SCHEMA)


def _tree(rows: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Arrays (feature, threshold, left child, path length at a leaf) of one isolation tree."""
    limit = int(np.ceil(np.log2(max(len(rows), 2))))
    nodes: list[list] = []

    def grow(part: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, -1, -1, depth + _mean_path(len(part))])
        low, high = (part.min(0), part.max(0)) if len(part) else (0, 0)
        open_ = np.flatnonzero(high > low) if len(part) > 1 and depth < limit else []
        if len(open_):
            f = int(rng.choice(open_))
            cut = rng.uniform(low[f], high[f])
            left = part[:, f] < cut
            nodes[at][:2] = f, cut
            nodes[at][2] = grow(part[left], depth + 1)
            nodes[at][3] = grow(part[~left], depth + 1)
        return at

    grow(rows, 0)
    kinds = np.int64, np.float64, np.int64, np.int64, np.float64
    return [np.array(x, k) for x, k in zip(zip(*nodes, strict=True), kinds, strict=True)]


def _mean_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def fit_forest(sample: np.ndarray, n_trees: int = N_TREES, tree_rows: int = TREE_ROWS, seed: int = SEED) -> dict:
    rng = np.random.default_rng(seed)
    size = min(tree_rows, len(sample))
    trees = [_tree(sample[rng.choice(len(sample), size, replace=False)], rng) for _ in range(n_trees)] if len(sample) else []
    return {"trees": trees, "scale": max(_mean_path(size), 1e-9)}


def anomaly(forest: dict, rows: np.ndarray) -> np.ndarray:
    """0 to 1; higher is more unusual. 0.5 where there is no tree."""
    if not forest["trees"]:
        return np.full(len(rows), 0.5)
    total = np.zeros(len(rows))
    every = np.arange(len(rows))
    for feature, cut, left, right, path in forest["trees"]:
        at = np.zeros(len(rows), np.int64)
        while (inner := feature[at] >= 0).any():
            i = every[inner]
            node = at[i]
            at[i] = np.where(rows[i, feature[node]] < cut[node], left[node], right[node])
        total += path[at]
    return 2.0 ** (-total / len(forest["trees"]) / forest["scale"])


def with_scores(stats: DataFrame, forest: dict) -> DataFrame:
    held = stats.sparkSession.sparkContext.broadcast(forest)  # bounded: trees times rows of a tree

    @F.pandas_udf("double")
    def score(features: pd.Series) -> pd.Series:
        return pd.Series(anomaly(held.value, np.stack(features.to_numpy()) if len(features) else np.zeros((0, 1))))

    return stats.withColumn("score", score("features"))


def calibrate(scored: DataFrame, labels: DataFrame) -> float:
    """The score from which on a text is dropped, from a histogram of all labelled rows.

    It parts the labels best (share of bad rows caught less share of good rows lost)
    among the scores that lose at most MAX_GOOD_LOST of the good rows; 2 (drop
    nothing) where there are no labels of both kinds.
    """
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    binned = scored.join(marks, scored["id"] == marks["doc_id"]).groupBy(
        F.least(F.floor(F.col("score") * N_BINS), F.lit(N_BINS - 1)).cast("int").alias("bin"), (F.col("quality") > 0).alias("good")
    )
    counts = np.zeros((2, N_BINS))
    for row in binned.count().collect():  # at most 2 * N_BINS rows
        counts[int(row["good"]), row["bin"]] = row["count"]
    bad, good = (x[::-1].cumsum()[::-1] / max(x.sum(), 1) for x in counts)
    if not counts.sum(1).all():
        return 2.0
    gain = np.where(good <= MAX_GOOD_LOST, bad - good, -1.0)
    best = int(N_BINS - 1 - gain[::-1].argmax())
    return best / N_BINS if gain[best] > 0 else 2.0


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, th, base statistics, base_failed, score, kept.

    The forest is grown on FOREST_ROWS rows (those with the smallest hashes) that
    pass the base rules; every row is scored. Null text has no words and fails.
    Very long texts are measured whole; repeated rows and ids are judged each, null ids too. An empty table gives no rows; without
    labels the base rules alone decide. Columns other than id and text are ignored.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    common.bound_batches(docs.sparkSession)
    stats = common.materialize(statistics(docs, id_col, text_col), "quality-stats").withColumn("base_failed", failed)
    passed = stats.where(~F.col("base_failed"))
    sample = common.smallest_hashes(passed, FOREST_ROWS, "id", "th").select("features").toPandas()["features"]
    scored = with_scores(stats, fit_forest(np.stack(sample.to_numpy()) if len(sample) else np.zeros((0, 1))))
    limit = calibrate(scored.where(~F.col("base_failed")), labels)
    return scored.select(
        F.col("id").alias(id_col), "th", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score",
        (~F.col("base_failed") & (F.col("score") < limit)).alias("kept"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdicts of all documents. Null and empty texts have no words and fail the base rules; equal rows have equal results."""
    judged = judge(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.drop("th")
