"""Difference detector: frames that are near the reference frame of their segment.

Test frames of a video are cut into segments of ref_dist frames by their rank;
the frame in the middle is the reference. A frame whose mean squared
difference to it is below a threshold is discarded and later takes the reference's score.

Ranks are computed from ids alone, so features are dealt once, by blocks of whole segments. Frames that are
stored by segment (store_segments) are compared as they are read, and not dealt at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import scratch, sized_join, written
from .ordinals import SPAN, with_ordinal

#: Segments of a block, the frames that are dealt to one task together.
BLOCK = 64


def block_table(ids: DataFrame, ref_dist: int, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """(video_id, span, first, base, starts, n) per span of frame ids that has test frames, from (video_id, frame_id) alone.

    `base` is the block of the span's first frame, `starts` the frames at which later blocks begin, and n the video's number of test frames.
    """
    placed = with_ordinal(ids.select("video_id", "frame_id"), "video_id", "frame_id", "pos", span)
    begins = F.when(F.col("pos") % (block * ref_dist) == 0, F.col("frame_id"))
    spans = placed.groupBy("video_id", F.floor(F.col("frame_id") / span).alias("span")).agg(
        F.min("frame_id").alias("first"), F.floor(F.min("pos") / (block * ref_dist)).alias("base"), F.sort_array(F.collect_list(begins)).alias("begins"), F.count(F.lit(1)).alias("frames")
    )
    n = F.sum("frames").over(Window.partitionBy("video_id"))
    return spans.select("video_id", "span", "first", "base", F.filter("begins", lambda x: x > F.col("first")).alias("starts"), n.alias("n"))


def _blocked(test: DataFrame, ref_dist: int, block: int, span: int) -> DataFrame:
    """`test` with __block, pos, seg, pos_in_seg and seg_len; rows are dealt by block, which is the only exchange that they go through."""
    table = written(block_table(test, ref_dist, block, span), scratch(test.sparkSession, "blocks"))  # a row per span of frame ids
    names = {c: f"__{c}" for c in ("span", "first", "base", "starts", "n")}
    table = table.select("video_id", *[F.col(c).alias(n) for c, n in names.items()])
    found = sized_join(test.withColumn("__span", F.floor(F.col("frame_id") / span)), table, ["video_id", "__span"])
    at = F.col("__base") + F.size(F.filter("__starts", lambda x: x <= F.col("frame_id")))
    inside = F.row_number().over(Window.partitionBy("video_id", "__block").orderBy("frame_id")) - 1
    placed = found.withColumn("__block", at.cast("long")).withColumn("pos", F.col("__block") * block * ref_dist + inside)
    cut = placed.withColumn("seg", F.floor(F.col("pos") / ref_dist).cast("long")).withColumn("pos_in_seg", (F.col("pos") % ref_dist).cast("int"))
    length = F.least(F.lit(ref_dist), F.col("__n") - F.col("seg") * ref_dist).cast("int")
    return cut.withColumn("seg_len", length).select(*test.columns, "__block", "pos", "seg", "pos_in_seg", "seg_len")


def segment(test: DataFrame, ref_dist: int, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """`test` with pos, seg, pos_in_seg and seg_len."""
    return _blocked(test, ref_dist, block, span).drop("__block")


def is_reference() -> Column:
    return F.col("pos_in_seg") == F.floor(F.col("seg_len") / 2)


def pick_reference(segmented: DataFrame) -> DataFrame:
    """(video_id, seg, ref_id, ref_features) per segment."""
    return segmented.where(is_reference()).select("video_id", "seg", F.col("frame_id").alias("ref_id"), F.col("features").alias("ref_features"))


def mse_diff(a: Column | str, b: Column | str) -> Column:
    """Mean squared difference of two arrays of one length, in double precision."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x) / F.size(a)


def difference_detect(test: DataFrame, diff_thres: float, ref_dist: int, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """(video_id, frame_id, ref_id, diff, discarded) of every test frame.

    Blocks hold whole segments, so the reference's features reach its segment by a window inside the block; features are dealt once.
    """
    segmented = _blocked(test.select("video_id", "frame_id", "features"), ref_dist, block, span)
    own = Window.partitionBy("video_id", "__block", "seg")
    at = F.when(is_reference(), F.struct("frame_id", "features"))
    with_ref = segmented.withColumn("ref", F.max(at).over(own))
    measured = with_ref.withColumn("diff", mse_diff(F.col("features"), F.col("ref.features")))
    return measured.select(
        "video_id", "frame_id", F.col("ref.frame_id").alias("ref_id"), "diff",
        ((F.col("diff") < diff_thres) & (F.col("frame_id") != F.col("ref.frame_id"))).alias("discarded"),
    )


def store_segments(test: DataFrame, ref_dist: int, path: str, features: str = "features", block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """Test frames written a segment a row: (video_id, seg, frame_ids, frames), in order of frame id; read back.

    Frames may be arrays of numbers or binary pictures. Laying them out deals them once; whatever is compared later deals nothing.
    """
    rows = _blocked(test.select("video_id", "frame_id", F.col(features).alias("frame")), ref_dist, block, span)
    row = F.array_sort(F.collect_list(F.struct("frame_id", "frame")))
    listed = rows.groupBy("video_id", "__block", "seg").agg(row.alias("rows"))
    return written(listed.select("video_id", "seg", F.col("rows.frame_id").alias("frame_ids"), F.col("rows.frame").alias("frames")), path)


def detect_stored(segments: DataFrame, diff_thres: float, decode: Callable[[bytes], np.ndarray] | None = None) -> DataFrame:
    """What difference_detect gives, from frames as store_segments has laid them out: a segment is decoded and compared where it is read.

    `decode` turns a stored picture into an array; arrays of numbers need none.
    """
    kind = segments.schema["video_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for video, ids, frames in zip(pdf["video_id"], pdf["frame_ids"], pdf["frames"], strict=True):
                ids, mid = np.asarray(ids), len(ids) // 2
                pixels = [np.asarray(f if decode is None else decode(f), np.float64).ravel() for f in frames]
                diff = np.array([np.square(x - pixels[mid]).mean() for x in pixels])
                yield pd.DataFrame({"video_id": video, "frame_id": ids, "ref_id": ids[mid], "diff": diff, "discarded": (diff < diff_thres) & (ids != ids[mid])})

    return segments.select("video_id", "frame_ids", "frames").mapInPandas(run, f"video_id {kind}, frame_id long, ref_id long, diff double, discarded boolean")


def mirror_lists(detected: DataFrame) -> DataFrame:
    """(video_id, frame_id, mirrors) of each remaining frame: the frames discarded in its favour, ascending."""
    gone = detected.where("discarded").groupBy("video_id", F.col("ref_id").alias("frame_id")).agg(F.sort_array(F.collect_list(F.col("frame_id"))).alias("mirrors"))
    kept = detected.where("NOT discarded").select("video_id", "frame_id")
    return kept.join(gone, ["video_id", "frame_id"], "left").withColumn("mirrors", F.coalesce("mirrors", F.array().cast("array<long>")))


def mirrors_of(detected: DataFrame) -> DataFrame:
    return detected.where("discarded").select("video_id", "frame_id", "ref_id", "diff")
