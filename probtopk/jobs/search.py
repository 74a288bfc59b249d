"""Top-k frames and top-k clips with a stated confidence.

Both run a few large rounds. A round takes thresholds from the running answer (k
rows, on the driver) and stops when the confidence, ln F(lam) summed over the uncertain rows, suffices; else it scores the smallest
set of rows that makes it suffice (at most `cap`) and merges them. Only the ticks of a distribution from lam on are needed, so no
CDF arrays are built, and sums are kept up (jobs.uncertain), so that a round does not pass over all open rows for them. A search that needs
more than FEW_ROUNDS doubles its cap with every further round, so it ends after few rounds however many rows it has to score. The ids
scored in the first rounds are sent out as a table of at most FEW_ROUNDS * cap rows, those of later rounds are
written and never on the driver; the uncertain rows are never rewritten.

The scorer is a table of scores or a ScoringUDF; a UDF runs on the labelled and the chosen frames only, once each.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distribution import NEG_INF
from ..operators import difference, sampling, scoring, topk, windows
from ..operators.scoring import ScoringUDF
from ..sources.shared import scratch, written
from .uncertain import IDS, BinnedFrames, MixtureFrames

#: Rounds of at most cap rows; later ones may take twice as many as the one before.
FEW_ROUNDS = 8

#: Gives (video_id, frame_id, score) of chosen rows.
Scorer = Callable[[DataFrame], DataFrame]


@dataclass
class Answer:
    """The k best rows as a DataFrame (video_id, frame_id, score), and what the search took; reached is False only if max_rounds ended it."""

    topk: DataFrame
    rounds: int
    scored: int
    log_confidence: float
    reached: bool = True
    evaluated: int = 0  # rows whose expected confidence was computed


def scorer(oracle: DataFrame | ScoringUDF, frames: DataFrame | None = None, max_score: int | None = None, batch: int | None = None) -> Scorer:
    """Looks chosen frames up in a table, or runs a ScoringUDF on the rows of `frames` that were chosen; these scores are written, so that no frame is scored twice."""
    if isinstance(oracle, DataFrame):
        return lambda ids: scoring.lookup_scores(ids, oracle)
    if frames is None:
        raise ValueError("a ScoringUDF needs the frames")

    def run(ids: DataFrame) -> DataFrame:
        chosen = frames.join(ids.select(*IDS).distinct(), IDS)
        return written(scoring.apply_oracle(chosen, oracle, max_score, batch).select(*IDS, "score"), scratch(frames.sparkSession, "scored"))

    return run


def _rounds(
    certain: DataFrame | None, uncertain: DataFrame, score_of: Scorer, k: int, conf: float, cap: int,
    max_rounds: int | None = None, rule: str = "cutoff", max_score: int = 50, proxy: DataFrame | None = None,
) -> Answer:
    """Rows have video_id, frame_id; uncertain ones pi, mu, sigma besides, or the bin of a proxy (bin, pi, mu, sigma). score_of gives scores of chosen rows and their mirrors.

    Rows that come with a score but were not chosen (mirrors) enter the answer only. While fewer than k rows are known, the
    missing ones are scored, those least likely to score 0 first.
    """
    spark = uncertain.sparkSession
    schema = "video_id string, frame_id long, score int"
    keep = lambda df: [tuple(r) for r in topk.exact_topk(df.select(*IDS, "score"), k).collect()]  # noqa: E731  k rows
    best = keep(certain) if certain is not None else []
    frames = MixtureFrames(uncertain, max_score) if proxy is None else BinnedFrames(uncertain, proxy, max_score)
    rounds, n_scored, log_conf, reached = 0, 0, NEG_INF, True
    while True:
        known = len(best) >= k
        if known:
            lam, mu, top = best[-1][2], best[-2][2] if len(best) > 1 else best[-1][2], best[0][2]
            log_conf, n_open = frames.at(lam, top, rule)
            if log_conf >= math.log(conf) or not n_open:
                break
        if rounds == max_rounds:
            reached = False
            break
        most = min(cap << max(0, rounds + 1 - FEW_ROUNDS), 2**31 - 1)
        if not known:
            chosen = frames.first_candidates(k - len(best))
        elif rule == "cutoff":
            chosen = frames.cutoff(lam, conf, most)
        else:
            chosen = frames.expected(lam, min(mu, max(lam, max_score - 1)), most)
        chosen, ids, n = _settled(chosen.select(*frames.columns), rounds)
        if not n and not known:
            log_conf = 0.0  # all rows are known
            break
        if not n:  # sums and choice differ by rounding
            chosen, ids, n = _settled(frames.lowest_one(lam).select(*frames.columns), rounds)
        rounds, n_scored = rounds + 1, n_scored + n
        frames.scored(chosen, ids)
        merged = score_of(chosen.select(*IDS)).select(*IDS, F.col("score").cast("int").alias("score"))
        best = keep(merged.unionByName(spark.createDataFrame(best, schema)).dropDuplicates(IDS))
    frames.close()
    return Answer(spark.createDataFrame(best, schema), rounds, n_scored, log_conf, reached, getattr(frames, "evaluated", 0))


def _settled(chosen: DataFrame, rounds: int) -> tuple[DataFrame, list[tuple] | None, int]:
    """Chosen rows, computed once: those of the first rounds (at most max(cap, k)) as a local table and a list of ids, more as a written table."""
    spark = chosen.sparkSession
    if rounds < FEW_ROUNDS:
        rows = chosen.collect()
        return F.broadcast(spark.createDataFrame(rows, chosen.schema)), [(r["video_id"], r["frame_id"]) for r in rows], len(rows)
    table = written(chosen, scratch(spark, "chosen"))
    return table, None, table.count()


def _with_mirrors(score_of: Scorer, mirrors: DataFrame | None) -> Scorer:
    """Discarded frames take the score that their reference gets."""
    if mirrors is None:
        return score_of

    def run(ids: DataFrame) -> DataFrame:
        cleaned = score_of(ids)
        return cleaned.unionByName(windows.propagate_mirrors(cleaned, mirrors))

    return run


def topk_frames(
    oracle: DataFrame | ScoringUDF, mixtures: DataFrame, k: int = 100, conf_thres: float = 0.9, num_train: float = 0.005, num_valid: float = 3000,
    cap: int = 256, mirrors: DataFrame | None = None, seed: int = 0, frames: DataFrame | None = None, max_rounds: int | None = None, rule: str = "cutoff",
) -> Answer:
    """The k frames with the highest scores, right with probability conf_thres or more.

    The oracle, a table (video_id, frame_id, score) or a ScoringUDF over `frames`, is asked only for labelled and chosen
    frames. `mixtures` holds the proxy's distribution of every frame, as a stored table: rounds read it
    again. Discarded frames (`mirrors`: frame_id, ref_id), which have to be test frames, are not searched and take their reference's score.
    `rule` is "cutoff", or "expected" for the frames with the largest expected confidence (give a small cap then).
    """
    ids = (mixtures if frames is None else frames).select(*IDS)
    n_train, n_valid = sampling.split_sizes(ids.count(), num_train, num_valid)
    labelled = sampling.split_frames(ids, n_train, n_valid, seed).where("split != 'test'")
    score_of = scorer(oracle, frames)
    uncertain = sampling.complement(mixtures, labelled)
    if mirrors is not None:
        uncertain = sampling.complement(uncertain, mirrors)
    return _rounds(score_of(labelled), uncertain, _with_mirrors(score_of, mirrors), k, conf_thres, cap, max_rounds, rule)


def topk_windows(
    oracle: DataFrame | ScoringUDF, mixtures: DataFrame, window: int, window_samples: float = 0.1, k: int = 100, conf_thres: float = 0.9, cap: int = 256,
    seed: int = 0, frames: DataFrame | None = None, max_rounds: int | None = None, rule: str = "cutoff",
) -> Answer:
    """The k clips of `window` frames with the highest mean scores; frame_id is the clip's number.

    `mixtures` has one row for every frame (complete_mixtures). A clip is scored by window * window_samples of its frames, at least one.
    """
    clips = written(windows.window_distribution(mixtures, window), scratch(mixtures.sparkSession, "clips"))
    return search_clips(scorer(oracle, frames), clips, mixtures, window, window_samples, k, conf_thres, cap, seed, max_rounds, rule)


def search_clips(
    score_of: Scorer, clips: DataFrame, frames: DataFrame, window: int, window_samples: float, k: int, conf_thres: float, cap: int, seed: int = 0,
    max_rounds: int | None = None, rule: str = "cutoff", max_score: int = 50,
) -> Answer:
    """topk_windows over a written table of clips (video_id, window_id, pi, mu, sigma); `frames` says which frames a clip has."""
    n = max(1, int(window * window_samples))

    def score_clips(ids: DataFrame) -> DataFrame:
        sampled = windows.sampled_frames(ids.withColumnRenamed("frame_id", "window_id"), frames, window, n, seed)
        return windows.window_truth(score_of(sampled), window).withColumnRenamed("window_id", "frame_id")

    return _rounds(None, clips.withColumnRenamed("window_id", "frame_id"), score_clips, k, conf_thres, cap, max_rounds, rule, max_score)


def detect_and_search(frames: DataFrame, oracle: DataFrame | ScoringUDF, mixtures: DataFrame, diff_thres: float, ref_dist: int, num_train: float = 0.005, num_valid: float = 3000, seed: int = 0, **kw) -> Answer:
    """topk_frames after the difference detector has set near-duplicate test frames aside; labelled frames keep their own scores."""
    n_train, n_valid = sampling.split_sizes(frames.count(), num_train, num_valid)
    test = sampling.split_frames(frames, n_train, n_valid, seed).where("split = 'test'")
    found = difference.difference_detect(frames.join(test.select(*IDS), IDS), diff_thres, ref_dist)
    mirrors = written(difference.mirrors_of(found), scratch(frames.sparkSession, "mirrors"))
    given = frames if isinstance(oracle, ScoringUDF) else None
    return topk_frames(oracle, mixtures, mirrors=mirrors, num_train=num_train, num_valid=num_valid, seed=seed, frames=given, **kw)
