"""Clips of a fixed number of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distribution import mixture_moments, round_half_even
from .sampling import sample_per_window
from .scoring import KNOWN_SIGMA, lookup_scores

MIX = ("pi", "mu", "sigma")


def window_id(window: int) -> Column:
    return F.floor(F.col("frame_id") / window).cast("long")


def known_mixture(labelled: DataFrame) -> DataFrame:
    """A frame with a known score as a mixture of one narrow component."""
    one = lambda c: F.array(c.cast("double"))
    return labelled.select("video_id", "frame_id", one(F.lit(1.0)).alias("pi"), one(F.col("score")).alias("mu"), one(F.lit(KNOWN_SIGMA)).alias("sigma"))


def complete_mixtures(labelled: DataFrame, mix: DataFrame, mirrors: DataFrame) -> DataFrame:
    """A mixture for every frame: known scores, the proxy's for remaining frames, and for discarded ones that of their reference, whichever it has."""
    own = known_mixture(labelled).unionByName(mix.select("video_id", "frame_id", *MIX))
    copies = mirrors.join(own.withColumnRenamed("frame_id", "ref_id"), ["video_id", "ref_id"]).select("video_id", "frame_id", *MIX)
    return own.unionByName(copies)


def complete_moments(labelled: DataFrame, moments: DataFrame, mirrors: DataFrame) -> DataFrame:
    """(video_id, frame_id, mean, var) of every frame: what complete_mixtures gives, as two numbers a frame. `moments` are those of the remaining frames."""
    known = labelled.select("video_id", "frame_id", F.col("score").cast("double").alias("mean"), F.lit(KNOWN_SIGMA * KNOWN_SIGMA).alias("var"))
    own = known.unionByName(moments.select("video_id", "frame_id", "mean", "var"))
    copies = mirrors.select("video_id", "frame_id", "ref_id").join(own.withColumnRenamed("frame_id", "ref_id"), ["video_id", "ref_id"])
    return own.unionByName(copies.select("video_id", "frame_id", "mean", "var"))


def sign() -> list[Column]:
    """Aggregates n and sign: the number of frames and an order-free hash of their ids."""
    return [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("video_id", "frame_id")).alias("sign")]


def signature(frames: DataFrame) -> tuple[int, int]:
    row = frames.agg(*sign()).first()
    return row["n"], row["sign"] or 0


def _checked(found: tuple[int, int], wanted: tuple[int, int]) -> None:
    if found != wanted:
        raise ValueError(f"{found[0]} mixtures for {wanted[0]} frames, or other frames")


def checked_coverage(full_mix: DataFrame, frames: DataFrame) -> DataFrame:
    """`full_mix`, if it has one mixture for every frame and none besides; else an error."""
    _checked(signature(full_mix), signature(frames))
    return full_mix


def moment_windows(moments: DataFrame, window: int) -> DataFrame:
    """(video_id, window_id, pi, mu, sigma, n, sign): window_distribution from moments, and what coverage is checked by, in one aggregation."""
    clips = moments.groupBy("video_id", window_id(window).alias("window_id")).agg(F.avg("mean").alias("mean"), F.avg("var").alias("var"), *sign())
    return clips.select("video_id", "window_id", F.array(F.lit(1.0)).alias("pi"), F.array("mean").alias("mu"), F.array(F.sqrt("var")).alias("sigma"), "n", "sign")


def checked_windows(clips: DataFrame, wanted: tuple[int, int]) -> DataFrame:
    """Clips as of moment_windows, a written table, if they cover exactly the frames of a signature; else an error."""
    row = clips.agg(F.sum("n").alias("n"), F.bit_xor("sign").alias("sign")).first()
    _checked((row["n"] or 0, row["sign"] or 0), wanted)
    return clips.drop("n", "sign")


def propagate_mirrors(cleaned: DataFrame, mirrors: DataFrame) -> DataFrame:
    """(video_id, frame_id, score): discarded frames take the score of their reference."""
    refs = cleaned.select("video_id", F.col("frame_id").alias("ref_id"), "score")
    return mirrors.join(refs, ["video_id", "ref_id"]).select("video_id", "frame_id", "score")


def window_distribution(full_mix: DataFrame, window: int) -> DataFrame:
    """A mixture of one component per clip: the mean of its frames' means, and the root of the mean of their variances."""
    moments = mixture_moments(full_mix).groupBy("video_id", window_id(window).alias("window_id")).agg(F.avg("mean").alias("mean"), F.avg("var").alias("var"))
    return moments.select("video_id", "window_id", F.array(F.lit(1.0)).alias("pi"), F.array("mean").alias("mu"), F.array(F.sqrt("var")).alias("sigma"))


def window_truth(oracle: DataFrame, window: int) -> DataFrame:
    """(video_id, window_id, score): the rounded mean of all frame scores of a clip."""
    return oracle.groupBy("video_id", window_id(window).alias("window_id")).agg(round_half_even(F.avg("score")).alias("score"))


def frames_of(windows: DataFrame, window: int) -> DataFrame:
    """(video_id, window_id, frame_id) of every frame that a clip may have."""
    clips = windows.select("video_id", "window_id").distinct()
    return clips.withColumn("frame_id", F.explode(F.sequence(F.col("window_id") * window, (F.col("window_id") + 1) * window - 1)))


def sampled_frames(windows: DataFrame, frames: DataFrame, window: int, n: int, seed: int = 0) -> DataFrame:
    """(video_id, frame_id): n frames of each given clip, or all that it has."""
    present = frames.select("video_id", "frame_id").join(frames_of(windows, window).select("video_id", "frame_id"), ["video_id", "frame_id"])
    return sample_per_window(present, window, n, seed).select("video_id", "frame_id")


def sampled_window_scores(windows: DataFrame, oracle: DataFrame, window: int, n: int, seed: int = 0) -> DataFrame:
    """(video_id, window_id, score): the rounded mean over n sampled frames of each given clip."""
    present = lookup_scores(frames_of(windows, window), oracle)
    return window_truth(sample_per_window(present, window, n, seed), window)
