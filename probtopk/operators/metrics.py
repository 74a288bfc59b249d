"""Quality of an answer against the exact one, and of a detector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import scratch, written
from .ordinals import SPAN, range_dealt
from .sampling import multiset_overlap
from .topk import BEST_FIRST, exact_topk


def precision_at_k(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """(precision): by score, so that ties count as right."""
    k = approx.agg(F.count(F.lit(1)).alias("k"))
    return multiset_overlap(approx, exact, "score").crossJoin(k).select((F.col("overlap") / F.col("k")).alias("precision"))


def rank_distance(approx: DataFrame, scores: DataFrame) -> DataFrame:
    """(rank_distance): mean distance of the rank in the answer (ties share the first) and the number of all scores above.

    Ranks among all scores are running sums over a histogram of the scores above the answer's last one, which
    are about as many as the answer has; the answer looks its scores up there.
    """
    given = approx.select("score", (F.rank().over(Window.orderBy(F.desc("score"))) - 1).alias("given"))
    last = approx.agg(F.min("score").alias("last"))  # one row
    counts = scores.join(F.broadcast(last), F.col("score") > F.col("last")).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    places = counts.unionByName(approx.select("score", F.lit(0).cast("long").alias("n"))).groupBy("score").agg(F.sum("n").alias("n"))
    higher = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    above = places.select("score", F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("above"))
    return given.join(above, "score").agg(F.avg(F.abs(F.col("above") - F.col("given"))).alias("rank_distance"))


def by_rank(topk: DataFrame) -> DataFrame:
    """(r, score) of an answer of k rows."""
    return topk.select(F.row_number().over(Window.orderBy(*[F.desc(c) for c in BEST_FIRST])).alias("r"), "score")


def score_error(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """(score_error): mean difference of scores, place by place."""
    pairs = by_rank(approx).join(by_rank(exact).withColumnRenamed("score", "true"), "r")
    return pairs.agg(F.avg(F.abs(F.col("score") - F.col("true"))).alias("score_error"))


def evaluate_topk(topk: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row with precision, rank_distance and score_error; truth has every frame's, or clip's, score."""
    exact = exact_topk(truth, k)
    return precision_at_k(topk, exact).crossJoin(rank_distance(topk, truth)).crossJoin(score_error(topk, exact))


def _by_class(cols: list[Column]) -> Window:
    return Window.partitionBy("cls").orderBy(*cols)


def pr_curve(matches: DataFrame, truth: DataFrame) -> DataFrame:
    """`matches` (frame_id, det_id, cls, conf, tp) with tp and fp so far, recall and precision, per class by descending confidence.

    Rows are dealt by ranges of (class, confidence, frame, detection), so neither a common class nor equal confidences are one
    task. A pass over the sorted ranges counts inside them and is written once; a row of totals per range and class
    gives the counts at which it starts.
    """
    cols = ["frame_id", "det_id", "cls", "conf", "tp"]
    dealt = range_dealt(matches.select(*cols), "cls", F.desc("conf"), "frame_id", "det_id").withColumn("__range", F.spark_partition_id())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, n, tp = None, 0, 0  # the class that a batch before has ended in, and its rows so far
        for pdf in batches:
            if not len(pdf):
                continue
            cls, right = pdf["cls"].to_numpy(), pdf["tp"].to_numpy(np.int64)
            starts = np.flatnonzero(np.append(True, cls[1:] != cls[:-1]))
            sizes = np.diff(np.append(starts, len(cls)))
            sums = np.cumsum(right)
            seen = np.arange(1, len(cls) + 1) - np.repeat(starts, sizes)
            hits = sums - np.repeat(sums[starts] - right[starts], sizes)
            if cls[0] == of:
                seen[: sizes[0]] += n
                hits[: sizes[0]] += tp
            of, n, tp = cls[-1], seen[-1], hits[-1]
            yield pdf.assign(__n=seen, __tp=hits)

    kinds = ", ".join(f"{c} {dealt.schema[c].dataType.simpleString()}" for c in cols)
    counted = written(dealt.mapInPandas(run, f"{kinds}, __range int, __n long, __tp long"), scratch(matches.sparkSession, "curve"))
    before = Window.partitionBy("cls").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counted.groupBy("cls", "__range").agg(F.max("__n").alias("n"), F.max("__tp").alias("tp"))
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    starts = ranges.select("cls", "__range", zero("n").alias("__n0"), zero("tp").alias("__tp0"))
    totals = truth.groupBy("cls").agg(F.count(F.lit(1)).alias("n_truth"))
    starts = F.broadcast(starts.join(totals, "cls"))  # a row per range and one more per class
    tp, n = F.col("__tp") + F.col("__tp0"), F.col("__n") + F.col("__n0")
    return counted.join(starts, ["cls", "__range"]).select(
        *cols, n.alias("rank"), tp.alias("tpc"), (n - tp).alias("fpc"), (tp / F.col("n_truth")).alias("recall"), (tp / n).alias("precision")
    )


def average_precision(curve: DataFrame, truth: DataFrame, span: int = SPAN) -> DataFrame:
    """(cls, ap, precision, recall, f1) of each class of the truth; 0 without predictions.

    Only the last row of each recall step matters: the envelope is the greatest precision from there on.
    It runs from the last step down, in two levels: spans of steps first, steps inside their span after that.
    """
    steps = curve.groupBy("cls", "tpc").agg(F.max("precision").alias("precision"), F.max("recall").alias("recall")).withColumn("span", F.floor(F.col("tpc") / span))
    spans = steps.groupBy("cls", "span").agg(F.max("precision").alias("top"), F.max("recall").alias("end"))
    later = Window.partitionBy("cls").orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    ends = spans.select("cls", "span", F.max("top").over(later).alias("ahead"), F.lag("end").over(_by_class([F.col("span")])).alias("behind"))
    inside = Window.partitionBy("cls", "span")
    top = F.max("precision").over(inside.orderBy(F.desc("tpc")).rowsBetween(Window.unboundedPreceding, 0))
    placed = steps.withColumn("top", top).withColumn("before", F.lag("recall").over(inside.orderBy("tpc"))).join(ends, ["cls", "span"])
    width = F.col("recall") - F.coalesce("before", "behind", F.lit(0.0))
    area = placed.groupBy("cls").agg(F.sum(width * F.greatest("top", "ahead")).alias("ap"))
    last = curve.groupBy("cls").agg(F.max_by("precision", "rank").alias("precision"), F.max_by("recall", "rank").alias("recall"))
    classes = truth.select("cls").distinct()
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    joined = classes.join(area, "cls", "left").join(last, "cls", "left").select("cls", zero("ap"), zero("precision"), zero("recall"))
    return joined.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-16))
