"""The expensive scorer, its cached answers, and the cheap proxy."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ordinals import SPAN

#: Deviation given to a frame whose score is known.
KNOWN_SIGMA = 0.1


#: What initialize() of the latest scorers has made in this Python worker, by scorer, and how many are kept.
_READY: dict[str, dict] = {}
READY_MOST = 2


class ScoringUDF:
    """A user's scorer: initialize() runs once in every Python worker, whose tasks share what it sets on the object; score() takes a batch and returns integers."""

    def initialize(self) -> None:
        pass

    def score(self, batch: pd.DataFrame) -> Sequence[int]:
        raise NotImplementedError

    def key(self) -> str:
        """Names the scorer in all workers; drawn at its first use."""
        return self.__dict__.setdefault("_key", uuid.uuid4().hex)


def ready(udf: ScoringUDF) -> ScoringUDF:
    """The scorer, initialized if this worker has not seen it yet; else with what it has made then (a model, a connection)."""
    made = _READY.pop(udf.key(), None)
    if made is None:
        before = dict(udf.__dict__)
        udf.initialize()
        made = {k: v for k, v in udf.__dict__.items() if k not in before or before[k] is not v}
        while len(_READY) >= READY_MOST:
            _READY.pop(next(iter(_READY)))
    udf.__dict__.update(made)
    _READY[udf.key()] = made
    return udf


def sliced(batches: Iterator[pd.DataFrame], size: int | None) -> Iterator[pd.DataFrame]:
    """The same rows in batches of exactly `size`, but for the last one of a task; as they come if no size is given."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if size is None:
            yield pdf
            continue
        held.append(pdf)
        if sum(map(len, held)) >= size:
            rows = pd.concat(held, ignore_index=True)
            whole = len(rows) // size * size
            for at in range(0, whole, size):
                yield rows.iloc[at : at + size].reset_index(drop=True)
            held = [rows.iloc[whole:]]
    rest = pd.concat(held, ignore_index=True) if held else ()
    if len(rest):
        yield rest


def apply_oracle(frames: DataFrame, udf: ScoringUDF, max_score: int | None = None, batch: int | None = None) -> DataFrame:
    """`frames` with score; every frame is scored, `batch` rows at a time (as Arrow sends them if none is given), clipped to max_score - 1 if one is given."""
    udf.key()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from probtopk.operators import scoring  # the worker's module, which outlives the task

        scorer = scoring.ready(udf)
        for pdf in scoring.sliced(batches, batch):
            scores = pd.Series(scorer.score(pdf), index=pdf.index, dtype="int32")
            yield pdf.assign(score=scores if max_score is None else scores.clip(upper=max_score - 1))

    return frames.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema) + ", score int")


class ProxyModel:
    """A user's proxy: fit() learns from labelled train frames (score and the query's columns), predict() gives (pi, mu, sigma) of a batch, each n x M."""

    def fit(self, train: DataFrame) -> ProxyModel:
        return self

    def predict(self, batch: pd.DataFrame):
        raise NotImplementedError


def apply_proxy(frames: DataFrame, model, keep: Sequence[str] = ("video_id", "frame_id")) -> DataFrame:
    """(keep, pi, mu, sigma) from a model object with predict(batch) -> (pi, mu, sigma), each of shape n x M."""
    schema = ", ".join(f"`{c}` {frames.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[list(keep)].copy()
            for name, part in zip(("pi", "mu", "sigma"), model.predict(pdf), strict=True):
                out[name] = list(part)
            yield out

    return frames.mapInPandas(run, f"{schema}, pi array<double>, mu array<double>, sigma array<double>")


def lookup_scores(ids: DataFrame, oracle: DataFrame) -> DataFrame:
    """(video_id, frame_id, score) of a set of frames, from the cached table; Spark sends the ids to the table when they are few."""
    return oracle.select("video_id", "frame_id", "score").join(ids.select("video_id", "frame_id"), ["video_id", "frame_id"])


def object_count(boxes: DataFrame, frames: DataFrame, cls: int, obj_thres: float = 0.5, cls_thres: float = 0.0) -> DataFrame:
    """(frame_id, score): boxes of a class with both confidences high enough; 0 for frames without any."""
    counted = boxes.where((F.col("cls") == cls) & (F.col("obj_conf") >= obj_thres) & (F.col("cls_conf") >= cls_thres)).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"))
    return frames.select("frame_id").join(counted, "frame_id", "left").select("frame_id", F.coalesce("n", F.lit(0)).cast("int").alias("score"))


def smooth_labels(labels: DataFrame, kernel: int, fn=F.avg, span: int = SPAN, of_list=None) -> DataFrame:
    """`labels` with smoothed: a filter over the frames at most kernel div 2 away, cut at the ends.

    `fn` is an aggregate (F.avg, F.max); `of_list` in its place is a function of the array of these scores (median_of), for filters that no
    window has.

    Frames are dealt by spans; those near a border are copied to the spans that they reach, so a long video is not one task.
    """
    half = kernel // 2
    at = lambda frame: F.floor(frame / span)
    dealt = labels.withColumn("__span", F.explode(F.sequence(at(F.col("frame_id") - half), at(F.col("frame_id") + half))))
    around = Window.partitionBy("video_id", "__span").orderBy("frame_id").rangeBetween(-half, half)
    filtered = fn("score").over(around) if of_list is None else of_list(F.collect_list("score").over(around))
    return dealt.withColumn("smoothed", filtered).where(F.col("__span") == at(F.col("frame_id"))).drop("__span")


def median_of(values: Column) -> Column:
    """The median of an array of numbers; the mean of the two in the middle of an even number."""
    half = F.floor(F.size(values) / 2).cast("int")
    ordered = F.array_sort(values)
    return F.when(F.size(values) % 2 == 1, F.get(ordered, half).cast("double")).otherwise((F.get(ordered, half - 1) + F.get(ordered, half)) / 2.0)


def score_weights(labels: DataFrame, max_score: int, smooth: int = 10) -> DataFrame:
    """(score, n, weight) for every score: n is smoothed, weight is the largest n over n."""
    counts = labels.groupBy("score").agg(F.count(F.lit(1)).alias("found"))
    scores = labels.sparkSession.range(max_score).select(F.col("id").cast("int").alias("score"))
    n = scores.join(counts, "score", "left").select("score", (F.coalesce("found", F.lit(0)) + smooth).alias("n"))
    return n.withColumn("weight", F.max("n").over(Window.partitionBy()) / F.col("n"))


def feature_bin(feature: Column, low: float, high: float, n_bins: int | Column) -> Column:
    """Equal-width bin from 0 to n_bins - 1; values beyond the ends go to the end bins."""
    n = F.lit(n_bins) if isinstance(n_bins, int) else n_bins
    at = F.floor((feature - low) / (F.lit(high - low) / n))
    return F.least(F.greatest(at, F.lit(0)), n - 1).cast("int")


def fit_binned_proxy(train: DataFrame, n_bins: int, sigma: float, max_score: int, smooth: float = 0.1) -> DataFrame:
    """(bin, pi, mu, sigma) from (bin, score): a mixture with the means 0 to max_score - 1, one deviation, and the smoothed shares of each bin."""
    spark = train.sparkSession
    grid = spark.range(n_bins * max_score).select((F.col("id") / max_score).cast("int").alias("bin"), (F.col("id") % max_score).cast("int").alias("score"))
    counts = train.groupBy("bin", "score").agg(F.count(F.lit(1)).alias("n"))
    filled = grid.join(counts, ["bin", "score"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + F.lit(smooth))
    shares = filled.withColumn("pi", F.col("n") / F.sum("n").over(Window.partitionBy("bin")))
    listed = shares.groupBy("bin").agg(F.array_sort(F.collect_list(F.struct("score", "pi"))).alias("c"))
    return listed.select("bin", F.col("c.pi").alias("pi"), F.transform("c.score", lambda s: s.cast("double")).alias("mu"), F.transform("c.score", lambda s: F.lit(float(sigma))).alias("sigma"))


def model_grid(spark: SparkSession, lists: Mapping[str, Sequence]) -> DataFrame:
    """All combinations of values, with model_id in order of the lists; as many rows as the lists' lengths multiply to."""
    grid, turn = spark.range(0, 1, 1, 1), F.lit(0)
    for name, values in lists.items():
        each = [F.lit(v).cast("long") if isinstance(v, int) else F.lit(v) for v in values]
        grid = grid.select("*", F.posexplode(F.array(*each)).alias(f"__{name}", name))
        turn = turn * len(values) + F.col(f"__{name}")
    return grid.select(turn.cast("int").alias("model_id"), *lists)


def select_model(nll_by_row: DataFrame) -> DataFrame:
    """(model_id, nll) of the model with the least mean nll over its rows; the smaller id on a tie."""
    means = nll_by_row.groupBy("model_id").agg(F.avg("nll").alias("nll"))
    return means.agg(F.min(F.struct("nll", "model_id")).alias("best")).select("best.model_id", "best.nll")


def calibration_profile(predicted: DataFrame) -> DataFrame:
    """(score, n, mean, var, mse) per true score from (score, mean, var), and one row with null score for all."""
    error = (F.col("mean") - F.col("score")) * (F.col("mean") - F.col("score"))
    rows = predicted.withColumn("error", error)
    return rows.rollup("score").agg(F.count(F.lit(1)).alias("n"), F.avg("mean").alias("mean"), F.avg("var").alias("var"), F.avg("error").alias("mse"))
