"""Samples, splits and sets of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_sizes(n: int, num_train: float, num_valid: float) -> tuple[int, int]:
    """Sizes of the train and valid splits: up to 1 is a fraction of n (truncated), more is a count."""
    size = lambda x: int(n * x) if x <= 1 else int(x)
    return size(num_train), size(num_valid)


def seeded(seed: int | str, *cols: str) -> Column:
    """A hash of columns that orders rows at random, the same in every run and engine."""
    parts = [F.col(c).cast("string") for c in cols]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts).cast("binary"))


def split_frames(frames: DataFrame, n_train: int, n_valid: int, seed: int = 0) -> DataFrame:
    """(video_id, frame_id, split): the frames with the smallest hashes are train, the next valid, all others test.

    Exact sizes without a sort: frames are counted per hash prefix, a table of
    at most 16 ** 4 rows; whole prefixes fall into one split, and only frames of the two
    prefixes in which a split ends are ranked.
    """
    order = ["__hash", "video_id", "frame_id"]
    hashed = frames.select("video_id", "frame_id", seeded(seed, "video_id", "frame_id").alias("__hash")).withColumn("__prefix", F.substring("__hash", 1, 4))
    ends = (n_train, n_train + n_valid)
    up_to = Window.orderBy("__prefix").rowsBetween(Window.unboundedPreceding, 0)
    counts = hashed.groupBy("__prefix").agg(F.count(F.lit(1)).alias("__n")).withColumn("__end", F.sum("__n").over(up_to))
    starts = counts.select("__prefix", (F.col("__end") - F.col("__n")).alias("__start"), "__end")
    placed = hashed.join(F.broadcast(starts), "__prefix")
    cut = F.lit(False)
    for end in ends:
        cut = cut | ((F.col("__start") < end) & (F.col("__end") > end))
    label = lambda rank: F.when(rank <= ends[0], "train").when(rank <= ends[1], "valid").otherwise("test").alias("split")
    rank = F.col("__start") + F.row_number().over(Window.partitionBy("__prefix").orderBy(*order))
    whole = placed.where(~cut).select("video_id", "frame_id", label(F.col("__end")))
    return whole.unionByName(placed.where(cut).select("video_id", "frame_id", label(rank)))


def sample_per_window(frames: DataFrame, window: int, n: int, seed: int = 0) -> DataFrame:
    """`n` frames (at least one) of each clip, without replacement, with their window_id."""
    clips = frames.withColumn("window_id", F.floor(F.col("frame_id") / window).cast("long"))
    by = Window.partitionBy("video_id", "window_id").orderBy(seeded(seed, "video_id", "frame_id"), "frame_id")
    return clips.withColumn("__turn", F.row_number().over(by)).where(F.col("__turn") <= max(1, n)).drop("__turn")


def complement(all_ids: DataFrame, labelled: DataFrame) -> DataFrame:
    """Ids that are not among the labelled ones."""
    return all_ids.join(labelled.select("video_id", "frame_id"), ["video_id", "frame_id"], "left_anti")


def union_certain(labelled: DataFrame, cleaned: DataFrame, mirrors: DataFrame) -> DataFrame:
    """All frames with a known score and where it comes from."""
    cols = ["video_id", "frame_id", "score"]
    named = [df.select(*cols, F.lit(source).alias("source")) for df, source in ((labelled, "label"), (cleaned, "cleaned"), (mirrors, "mirror"))]
    return named[0].unionByName(named[1]).unionByName(named[2])


def multiset_overlap(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """(overlap): the number of rows in the multiset intersection of one column."""
    return a.select(col).intersectAll(b.select(col)).agg(F.count(F.lit(1)).alias("overlap"))
