"""The search for the k best frames: thresholds, confidence, and which frames to score next.

F is the CDF of an uncertain frame; lam is the k-th best known score and mu the
one before it. The answer stands with probability prod F(lam) over all
uncertain frames; its logarithm is kept as a finite sum and a count of minus infinities.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distribution import NEG_INF, logsumexp, mixture_cdf_columns, safe_ln
from ..sources.shared import scratch, written
from .ordinals import low_end, lowest

BEST_FIRST = ("score", "frame_id")
#: Bins of F(lam) per unit of -ln(1 - F).
N_BINS = 2000


def exact_topk(scores: DataFrame, k: int) -> DataFrame:
    """The k highest scores; ties go to the larger frame id. A top-n, not a sort."""
    return scores.orderBy(*[F.desc(c) for c in BEST_FIRST]).limit(k)


def merge_topk(current: DataFrame, new: DataFrame, k: int) -> DataFrame:
    return exact_topk(current.unionByName(new), k)


def thresholds(topk: DataFrame) -> DataFrame:
    """(lam, mu): the last score of the answer and the one before it (lam if there is none)."""
    ranked = topk.withColumn("r", F.row_number().over(Window.orderBy(*[F.desc(c) for c in BEST_FIRST])))
    n = F.max("r").over(Window.partitionBy())
    ends = ranked.withColumn("n", n).where(F.col("r") >= F.col("n") - 1)
    return ends.agg(F.min_by("score", -F.col("r")).alias("lam"), F.min_by("score", "r").alias("mu"))


def log_sum(log_f: Column) -> list[Column]:
    """Aggregates finite (sum of finite logs) and n_inf (how many are minus infinity)."""
    return [F.coalesce(F.sum(F.when(log_f != NEG_INF, log_f)), F.lit(0.0)).alias("finite"), F.count_if(log_f == NEG_INF).alias("n_inf")]


def column_log_sums(uncertain: DataFrame, max_score: int, first: int = 0) -> DataFrame:
    """(s, finite, n_inf) per score from `first` on, the first of log_cdf: sums over all frames, in one pass without exploding rows."""
    parts = []
    for s in range(first, max_score):
        finite, n_inf = log_sum(F.get("log_cdf", F.lit(s - first)))
        parts.append(F.struct(F.lit(s).alias("s"), finite, n_inf))
    return uncertain.agg(F.array(*parts).alias("h")).select(F.explode("h").alias("h")).select("h.*")


@dataclass
class LogSums:
    """column_log_sums from the tick `first` on, kept up while frames are scored; sums[s] is (finite, n_inf).

    One pass over the open frames begins it. After that, what scored frames have added is taken off again, so no round
    passes over the open frames for their sums. n_open counts frames whose CDF is below 1.
    """

    first: int
    finite: list[float]
    n_inf: list[int]
    n_open: list[int]

    @classmethod
    def of(cls, frames: DataFrame, first: int, last: int) -> LogSums:
        """Of all frames with pi, mu, sigma, at the ticks from first to last."""
        logs = frames.select(F.transform(mixture_cdf_columns(last + 1, first=first), safe_ln).alias("log_cdf"))
        parts = []
        for i in range(last - first + 1):
            log_f = F.get("log_cdf", F.lit(i))
            parts.append(F.struct(*log_sum(log_f), F.count_if(log_f < 0).alias("n_open")))
        row = logs.agg(F.array(*parts).alias("h")).first()["h"]
        return cls(first, *[[r[c] for r in row] for c in ("finite", "n_inf", "n_open")])

    def __getitem__(self, s: int) -> tuple[float, int]:
        return self.finite[s - self.first], self.n_inf[s - self.first]

    @property
    def last(self) -> int:
        return self.first + len(self.finite) - 1

    def minus(self, frames: DataFrame) -> LogSums:
        """Without frames that were among those summed."""
        other = LogSums.of(frames, self.first, self.last)
        parts = [[x - y for x, y in zip(getattr(self, c), getattr(other, c), strict=True)] for c in ("finite", "n_inf", "n_open")]
        return LogSums(self.first, *parts)

    def log_confidence(self, s: int) -> float:
        finite, n_inf = self[s]
        return NEG_INF if n_inf else min(finite, 0.0)


def topk_confidence(uncertain: DataFrame, lam: int) -> DataFrame:
    """(log_confidence) of the answer: minus infinity while any frame surely beats it."""
    sums = uncertain.agg(*log_sum(F.get("log_cdf", F.lit(lam))))
    return sums.select(F.when(F.col("n_inf") > 0, F.lit(NEG_INF)).otherwise(F.col("finite")).alias("log_confidence"))


def bootstrap_candidates(uncertain: DataFrame, n: int) -> DataFrame:
    """The n frames least likely to score 0."""
    return uncertain.orderBy(F.get("log_cdf", F.lit(0)), "frame_id").limit(n)


Sums = list[tuple[float, int]] | LogSums


def _log_f(s: int, first: int) -> Column:
    return F.get("log_cdf", F.lit(s - first))


def _without(h: Sums, s: int, first: int) -> Column:
    """The log confidence at threshold s of all frames but this one; h[s] is (finite, n_inf)."""
    finite, n_inf = h[s]
    log_f = _log_f(s, first)
    is_inf = log_f == NEG_INF
    left = F.lit(int(n_inf)) - F.when(is_inf, 1).otherwise(0)
    return F.when(left > 0, F.lit(NEG_INF)).otherwise(F.lit(float(finite)) - F.when(is_inf, 0.0).otherwise(log_f))


def _total(h: Sums, s: int) -> float:
    return NEG_INF if h[s][1] else float(h[s][0])


def _above(s: int, first: int) -> Column:
    """ln P(score > s)."""
    return safe_ln(1.0 - F.exp(_log_f(s, first)))


def expected_confidence(uncertain: DataFrame, h: Sums, lam: int, mu: int, first: int = 0) -> DataFrame:
    """`uncertain` with expected: the log of the confidence to expect after scoring the frame.

    A score up to lam leaves the answer as it is; a score s up to mu becomes the
    k-th; a higher one makes mu the k-th. Of the log tables, which begin at the tick `first`, only lam to mu are read.
    """
    terms = [F.lit(_total(h, lam))]
    terms += [_without(h, s, first) + F.get("log_pdf", F.lit(s - first)) for s in range(lam + 1, mu + 1)]
    terms.append(_without(h, mu, first) + _above(mu, first))
    return uncertain.withColumn("expected", logsumexp(F.array(*terms)))


def upper_bound(uncertain: DataFrame, h: Sums, lam: int, mu: int, first: int = 0) -> DataFrame:
    """`uncertain` with bound, never below what expected_confidence gives; reads the ticks lam and mu only."""
    return uncertain.withColumn("bound", logsumexp(F.array(F.lit(_total(h, lam)), _above(lam, first) + _without(h, mu, first))))


#: Frames of the first block, per frame wanted; a bound may be below what it bounds by rounding only.
BLOCK, SLACK = 4, 1e-9


def best_by_bound(bounded: DataFrame, evaluate: Callable[[DataFrame], DataFrame], b: int) -> tuple[DataFrame, int]:
    """The b rows with the largest expected, and for how many rows it was computed.

    `bounded` has a bound of every row (never below its expected) and can be read again; `evaluate` adds expected. Rows are evaluated in
    blocks by falling bound, each twice as large, until the b-th best so far beats every bound that is left. Equal rows go by frame id.
    """
    spark, order = bounded.sparkSession, [F.desc("bound"), "frame_id", "video_id"]
    place = F.struct((-F.col("bound")).alias("b"), "frame_id", "video_id")
    best_first = [F.desc("expected"), "frame_id", "video_id"]
    blocks, n, size, rest = [], 0, BLOCK * b, bounded
    while True:
        blocks.append(written(evaluate(rest.orderBy(*order).limit(size)), scratch(spark, "evaluated")))
        edge = blocks[-1].agg(F.count(F.lit(1)).alias("n"), F.max(place).alias("last")).first()
        n += edge["n"]
        found = reduce(DataFrame.unionByName, blocks).orderBy(*best_first).limit(b)
        if edge["n"] < size:
            return found, n
        after = edge["last"]
        here = F.struct(F.lit(after["b"]).alias("b"), F.lit(after["frame_id"]).alias("frame_id"), F.lit(after["video_id"]).alias("video_id"))
        rest = bounded.where(place > here)
        least = found.agg(F.min("expected")).first()[0]
        top = rest.agg(F.max("bound")).first()[0]
        if top is None or top < least - SLACK * abs(least):
            return found, n
        if top == NEG_INF:  # nothing is to be gained by any row that is left
            return reduce(DataFrame.unionByName, [*blocks, rest.withColumn("expected", F.lit(NEG_INF)).select(blocks[0].columns)]).orderBy(*best_first).limit(b), n
        size *= 2


def select_candidates(uncertain: DataFrame, h: Sums, lam: int, mu: int, b: int, first: int = 0) -> DataFrame:
    """The b frames with the largest expected confidence, which is computed only where the bound asks for it."""
    return best_by_bound(upper_bound(uncertain, h, lam, mu, first), lambda rows: expected_confidence(rows, h, lam, mu, first), b)[0]


def cutoff_candidates(candidates: DataFrame, conf: float, cap: int | None = None, f: str = "f") -> DataFrame:
    """The smallest set of frames, by ascending F(lam), without which the rest reaches the wanted confidence.

    `candidates` has f = F(lam) of each uncertain frame. Scoring the set in one go
    suffices, as lam never falls. Frames with F(lam) = 0 are in the set without being ordered; of the others,
    logs are summed per bin, which are finer near 1, and only rows of the bin where the set ends are ordered.
    """
    above = candidates.where(F.col(f) > 0)
    bin_of = F.floor(-F.log1p(-F.col(f)) * N_BINS)
    chosen = candidates.where(F.col(f) <= 0).unionByName(low_end(above, F.ln(f), bin_of, [f, "frame_id"], math.log(conf)))
    return chosen if cap is None else lowest(chosen, bin_of, [f, "frame_id"], cap)


def result_summary(topk: DataFrame) -> DataFrame:
    return topk.agg(F.min("score").alias("low"), F.max("score").alias("high"), F.avg("score").alias("mean"))
