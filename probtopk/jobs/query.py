"""A whole query: labels of a sample, a proxy fitted on them, near-duplicates set aside, the proxy's scan, the search, the report.

Every step's table is a stage in a folder. A run that finds a stage there starts
from it, so a search can be repeated with other parameters, or go on after a failure,
without scoring or scanning again. Beside a stage stands what it was made from, the
options and the frames' ids; a stage made from anything else is refused.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distribution import mixture_moments, mixture_nll
from ..operators import difference, metrics, sampling, scoring, windows
from ..operators.scoring import ProxyModel, ScoringUDF
from ..sources.frames import has_stage, load_stage, mark_stage, save_stage, stage_mark
from ..sources.shared import scratch, written
from . import search
from .search import IDS, Answer

PROXY = ["bin", "pi", "mu", "sigma"]


@dataclass(frozen=True)
class Options:
    """What a query may choose; the built-in proxy bins one numeric column, `feature`, from low to high.

    `models` are proxies of the user's own, which see `columns` besides; the one with the least validation loss of all is taken.
    """

    feature: str = "feature"
    low: float = 0.0
    high: float = 1.0
    bins: tuple[int, ...] = (20, 40)
    sigmas: tuple[float, ...] = (0.1, 0.3, 0.6, 1.2)
    smooths: tuple[float, ...] = (0.1, 0.01, 0.001)
    max_score: int = 50
    num_train: float = 0.005
    num_valid: float = 3000
    diff_thres: float | None = None
    ref_dist: int = 30
    seed: int = 0
    models: tuple[ProxyModel, ...] = ()
    columns: tuple[str, ...] = ()
    udf_batch: int | None = None

    def inputs(self) -> list[str]:
        """The columns that a proxy may see."""
        return [self.feature, *[c for c in self.columns if c != self.feature]]

    def noted(self) -> dict:
        """What stages depend on; a model counts by its class."""
        return asdict(self) | {"models": [type(m).__qualname__ for m in self.models], "udf_batch": None}


@dataclass
class Scanned:
    """Stored tables: labelled (score, split), mirrors (ref_id), and of each frame that remains the bin of the built-in proxy (bin, pi, mu, sigma).

    A frame has the mixture of its bin, so mixtures are never stored a frame and their CDFs are computed once a bin. Where a user's model has
    won, `binned` has the M components of each frame instead (pi, mu, sigma) and there is no proxy. `signature` is that of all frames.
    """

    labelled: DataFrame
    mirrors: DataFrame
    binned: DataFrame
    proxy: DataFrame | None
    signature: tuple[int, int]

    def mixtures(self) -> DataFrame:
        return self.binned if self.proxy is None else self.binned.join(F.broadcast(self.proxy), "bin").select(*IDS, *PROXY[1:])

    def moments(self) -> DataFrame:
        """(video_id, frame_id, mean, var) of the frames that remain; those of a bin are computed once."""
        if self.proxy is None:
            return mixture_moments(self.binned).select(*IDS, "mean", "var")
        return self.binned.join(F.broadcast(mixture_moments(self.proxy).select("bin", "mean", "var")), "bin").select(*IDS, "mean", "var")


def _stage(folder: str, name: str, made: Callable[[], DataFrame], like: DataFrame, made_from: str = "") -> DataFrame:
    """The stage of that name, made first if the folder has none; one that was made from other options or frames is an error."""
    spark = like.sparkSession
    if not has_stage(spark, folder, name):
        save_stage(made(), folder, name)
        mark_stage(spark, folder, name, made_from)
    elif (found := stage_mark(spark, folder, name)) != made_from:
        raise ValueError(f"stage {name} of {folder} was made from {found}, not from {made_from}; take another folder")
    return load_stage(spark, folder, name)


def fit_proxy(labelled: DataFrame, options: Options) -> DataFrame:
    """(bin, pi, mu, sigma, n_bins, nll) of the model with the least mean NLL over the valid split.

    A model is a binned proxy (fit_binned_proxy); the grid is all numbers of bins, deviations and smoothings, and is
    fitted on the train split in one pass. Scores weigh by how rare they are.
    """
    spark, top = labelled.sparkSession, options.max_score
    grid = scoring.model_grid(spark, {"n_bins": options.bins, "width": options.sigmas, "smooth": options.smooths})  # a handful of rows
    bin_of = scoring.feature_bin(F.col(options.feature), options.low, options.high, F.col("n_bins"))
    binned = labelled.crossJoin(F.broadcast(grid)).select("split", "score", "model_id", bin_of.alias("bin"))
    counts = binned.where("split = 'train'").groupBy("model_id", "bin", "score").agg(F.count(F.lit(1)).alias("n"))
    cell = grid.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("n_bins") * top - 1)))
    cells = cell.select("model_id", "n_bins", "width", "smooth", F.floor(F.col("cell") / top).cast("int").alias("bin"), (F.col("cell") % top).cast("int").alias("score"))
    filled = cells.join(counts, ["model_id", "bin", "score"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + F.col("smooth"))
    listed = filled.groupBy("model_id", "bin", "n_bins", "width").agg(F.array_sort(F.collect_list(F.struct("score", "n"))).alias("c"), F.sum("n").alias("total"))
    models = listed.select(
        "model_id", "bin", F.transform("c.n", lambda n: n / F.col("total")).alias("pi"), F.transform("c.score", lambda s: s.cast("double")).alias("mu"),
        F.transform("c.score", lambda s: F.col("width")).alias("sigma"), "n_bins",
    )
    weights = scoring.score_weights(labelled, top).select("score", "weight")
    valid = binned.where("split = 'valid'").join(F.broadcast(weights), "score").join(models, ["model_id", "bin"])
    best = scoring.select_model(valid.select("model_id", mixture_nll(F.col("score"), weight=F.col("weight")).alias("nll")))
    return models.join(F.broadcast(best), "model_id").drop("model_id")  # one row


def user_model(labelled: DataFrame, options: Options) -> tuple[ProxyModel, float] | None:
    """The fitted model of the user's with the least mean weighted NLL over the valid split, and that loss; None if there is no model."""
    weights = scoring.score_weights(labelled, options.max_score).select("score", "weight")
    train, valid = (labelled.where(F.col("split") == split) for split in ("train", "valid"))
    tried = []
    for model in options.models:  # a handful
        fitted = model.fit(train.select("score", *options.inputs()))
        predicted = scoring.apply_proxy(valid.select("score", *options.inputs()), fitted, keep=["score"])
        rows = predicted.join(F.broadcast(weights), "score").select(F.lit(0).alias("model_id"), mixture_nll(F.col("score"), weight=F.col("weight")).alias("nll"))
        nll = scoring.select_model(rows).first()["nll"]
        tried.append((float("inf") if nll is None else nll, len(tried), fitted))
    if not tried:
        return None
    nll, _, fitted = min(tried, key=lambda t: t[:2])
    return fitted, nll


def scan(frames: DataFrame, oracle: DataFrame | ScoringUDF, options: Options, folder: str) -> Scanned:
    """Everything before the search, each table written once: labels by the oracle, the proxy, mirrors among the test frames, the rest by the proxy's bins or the model.

    `frames` has video_id, frame_id, the feature column (and `columns`), and features (an array) if a difference threshold is given.
    """
    ids = frames.select(*IDS)
    score_of = search.scorer(oracle, frames, options.max_score, options.udf_batch)
    signature = windows.signature(ids)
    made_from = json.dumps({"options": options.noted(), "frames": signature}, sort_keys=True)

    def labels() -> DataFrame:
        n_train, n_valid = sampling.split_sizes(signature[0], options.num_train, options.num_valid)
        split = sampling.split_frames(ids, n_train, n_valid, options.seed).where("split != 'test'")
        return score_of(split).join(split, IDS).join(frames.select(*IDS, *options.inputs()), IDS)

    labelled = _stage(folder, "labelled", labels, frames, made_from)
    test = sampling.complement(frames, labelled)

    def near() -> DataFrame:
        if options.diff_thres is None:
            return ids.where("false").select(*IDS, F.lit(0).cast("long").alias("ref_id"))
        found = difference.difference_detect(test.select(*IDS, "features"), options.diff_thres, options.ref_dist)
        return difference.mirrors_of(found).select(*IDS, "ref_id")

    mirrors = _stage(folder, "mirrors", near, frames, made_from)
    proxy = _stage(folder, "proxy", lambda: fit_proxy(labelled, options), frames, made_from)
    rest = sampling.complement(test.select(*IDS, *options.inputs()), mirrors)

    def binned() -> DataFrame:
        n_bins = proxy.agg(F.max("n_bins").alias("n_bins"))  # one row
        at = scoring.feature_bin(F.col(options.feature), options.low, options.high, F.col("n_bins"))
        return rest.crossJoin(F.broadcast(n_bins)).select(*IDS, at.alias("bin"))

    def remaining() -> DataFrame:
        """By the proxy with the least loss; a tie goes to the built-in one."""
        user = user_model(labelled, options)
        loss = proxy.agg(F.max("nll")).first()[0]
        return binned() if user is None or (loss is not None and loss <= user[1]) else scoring.apply_proxy(rest, user[0])

    found = _stage(folder, "binned", remaining, frames, made_from)
    return Scanned(labelled, mirrors, found, proxy.select(*PROXY) if "bin" in found.columns else None, signature)


def query_frames(
    frames: DataFrame, oracle: DataFrame | ScoringUDF, options: Options, k: int = 100, conf_thres: float = 0.9, cap: int = 256,
    folder: str | None = None, max_rounds: int | None = None, rule: str = "cutoff",
) -> Answer:
    """The k best frames from nothing but frames and a scorer. Stages of `folder`, if it has any, are not made again."""
    s = scan(frames, oracle, options, folder or scratch(frames.sparkSession, "query"))
    score_of = search._with_mirrors(search.scorer(oracle, frames, options.max_score, options.udf_batch), s.mirrors)
    return search._rounds(s.labelled.select(*IDS, "score"), s.binned, score_of, k, conf_thres, cap, max_rounds, rule, options.max_score, s.proxy)


def query_windows(
    frames: DataFrame, oracle: DataFrame | ScoringUDF, options: Options, window: int, window_samples: float = 0.1, k: int = 100, conf_thres: float = 0.9,
    cap: int = 256, folder: str | None = None, max_rounds: int | None = None, rule: str = "cutoff",
) -> Answer:
    """The k best clips. Labelled frames count with their known score and discarded ones as their reference; every frame has to be covered.

    Clips are made of two numbers a frame, its mean and variance; coverage is checked by what the same aggregation has counted.
    """
    folder = folder or scratch(frames.sparkSession, "query")
    s = scan(frames, oracle, options, folder)
    clips = written(windows.moment_windows(windows.complete_moments(s.labelled, s.moments(), s.mirrors), window), scratch(frames.sparkSession, "clips"))
    clips = windows.checked_windows(clips, s.signature)
    score_of = search.scorer(oracle, frames, options.max_score, options.udf_batch)
    return search.search_clips(score_of, clips, frames.select(*IDS), window, window_samples, k, conf_thres, cap, options.seed, max_rounds, rule, options.max_score)


def query(frames: DataFrame, oracle: DataFrame | ScoringUDF, options: Options, window: int = 1, window_samples: float = 0.1, **kw) -> Answer:
    """query_frames, or query_windows for clips of two frames or more."""
    return query_windows(frames, oracle, options, window, window_samples, **kw) if window >= 2 else query_frames(frames, oracle, options, **kw)


def report(answer: Answer, truth: DataFrame, k: int) -> DataFrame:
    """One row: precision, rank_distance, score_error against all scores, and what the search took."""
    took = [F.lit(answer.rounds).alias("rounds"), F.lit(answer.scored).alias("scored"), F.lit(answer.log_confidence).alias("log_confidence"), F.lit(answer.reached).alias("reached")]
    return metrics.evaluate_topk(answer.topk, truth, k).select("*", *took)
