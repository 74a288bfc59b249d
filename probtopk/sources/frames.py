"""Frames, cached scores, box blobs, and stages that a later run can start from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordinals import with_range_rank


def frame_numbers(names: DataFrame) -> DataFrame:
    """(name, frame_id): names numbered from 0 by length, then name; ranges of names are ordered apart, so any names spread over all tasks."""
    return with_range_rank(names.select("name", F.length("name").alias("__len")), ["__len", "name"], "frame_id").select("name", "frame_id")


def read_frame_dir(spark: SparkSession, path: str) -> DataFrame:
    """(frame_id, name, content) of every jpg in a directory, numbered from 0 by length of name, then name.

    Only names are ordered; the pictures are joined to their numbers.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(path)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return named.join(frame_numbers(named.select("name")), "name").select("frame_id", "name", "content")


def cut(frames: DataFrame, offset: int = 0, length: int | None = None) -> DataFrame:
    """Frames from `offset` on, `length` of them, renumbered so that `offset` is 0."""
    kept = frames.where(F.col("frame_id") >= offset)
    if length is not None:
        kept = kept.where(F.col("frame_id") < offset + length)
    return kept.withColumn("frame_id", F.col("frame_id") - F.lit(offset))


def read_frames(spark: SparkSession, path: str, offset: int = 0, length: int | None = None) -> DataFrame:
    return cut(spark.read.parquet(path), offset, length)


def read_oracle(spark: SparkSession, path: str, offset: int = 0) -> DataFrame:
    return cut(spark.read.parquet(path).select("video_id", "frame_id", "score"), offset)


BOX_SCHEMA = "frame_id long, det_id long, x1 double, y1 double, x2 double, y2 double, obj_conf double, cls_conf double, cls int"


def decode_box_blobs(blobs: DataFrame) -> DataFrame:
    """One row per box from (frame_id, blob), a blob being n rows of 7 float32 values; empty blobs have no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["x1", "y1", "x2", "y2", "obj_conf", "cls_conf", "cls"]
        for pdf in batches:
            boxes = [np.frombuffer(b or b"", np.float32).reshape(-1, 7) for b in pdf["blob"]]
            sizes = [len(b) for b in boxes]
            out = pd.DataFrame(np.concatenate(boxes or [np.zeros((0, 7))]).astype(float), columns=names)
            out.insert(0, "frame_id", np.repeat(pdf["frame_id"].to_numpy(), sizes))
            out.insert(1, "det_id", np.concatenate([np.arange(n) for n in sizes] or [[]]).astype(np.int64))
            yield out.astype({"cls": np.int32})

    return blobs.select("frame_id", "blob").mapInPandas(run, BOX_SCHEMA)


def encode_box_blobs(boxes: DataFrame) -> DataFrame:
    """(frame_id, blob): the boxes of a frame in order of det_id as float32 values; the inverse of decode_box_blobs."""
    names = ["x1", "y1", "x2", "y2", "obj_conf", "cls_conf", "cls"]
    row = F.array(*[F.col(c).cast("float") for c in names])
    listed = boxes.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("det_id", row.alias("row")))).alias("rows"))

    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([np.concatenate(r).astype(np.float32).tobytes() for r in rows], dtype="object")

    return listed.select("frame_id", run("rows.row").alias("blob"))


def save_stage(df: DataFrame, folder: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{name}")


def has_stage(spark: SparkSession, folder: str, name: str) -> bool:
    """Whether a stage was written to its end; asked of the file system that the folder lies in."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def load_stage(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def mark_stage(spark: SparkSession, folder: str, name: str, made_from: str) -> None:
    """Notes beside a stage what it was made from (options, frames)."""
    spark.createDataFrame([(made_from,)], "made_from string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.made_from")


def stage_mark(spark: SparkSession, folder: str, name: str) -> str | None:
    """What a stage was made from, or None if that was not noted."""
    return spark.read.parquet(f"{folder}/{name}.made_from").first()[0] if has_stage(spark, folder, f"{name}.made_from") else None


def video_prefix(path: Column) -> Column:
    """File name without directories and without its last extension; dots at the start begin no extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"^(\.*[^.].*)\.[^.]*$", "$1")
