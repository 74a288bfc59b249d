"""Frames, scores, mixtures and boxes derived from the driver's tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordinals import with_ordinal

MAX_SCORE = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, frame_id, score, k, value): one video of all events."""
    return table(spark, sf_dir, "events").select(
        F.lit("v0").alias("video_id"),
        F.col("event_id").alias("frame_id"),
        F.least(F.floor(F.col("value") / 10).cast("int"), F.lit(MAX_SCORE - 1)).alias("score"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        "value",
    )


FRAMES = """(SELECT 'v0' AS video_id, event_id AS frame_id, least(CAST(floor(value / 10) AS INT), 49) AS score,
  CAST(json_extract_string(props, '$.k') AS INT) AS k, value FROM events)"""


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many videos: one per event type, frames numbered by event id."""
    numbered = with_ordinal(table(spark, sf_dir, "events").select("event_type", "event_id", "value"), "event_type", "event_id", "frame_id")
    return numbered.select(F.col("event_type").alias("video_id"), "frame_id", F.least(F.floor(F.col("value") / 10).cast("int"), F.lit(49)).alias("score"))


VIDEOS = """(SELECT event_type AS video_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS frame_id,
  least(CAST(floor(value / 10) AS INT), 49) AS score FROM events)"""


def _list(*xs) -> F.Column:
    return F.array(*[(x if not isinstance(x, float) else F.lit(x)).cast("double") for x in xs])


def mixtures(spark: SparkSession, sf_dir: str, kind: str = "noisy") -> DataFrame:
    """The frames with pi, mu, sigma: a noisy proxy, one of two components, a wide one, or an exact one."""
    f = frames(spark, sf_dir)
    off = F.col("k") - F.lit(49.5)
    parts = {
        "noisy": (_list(1.0), _list(F.col("score") + off / 50.0), _list(0.6)),
        "two": (_list(0.7, 0.3), _list(F.col("score"), F.col("score") + off / 25.0), _list(0.5, 1.0)),
        "wide": (_list(0.7, 0.3), _list(F.col("score"), F.col("score") + off / 25.0), _list(4.0, 6.0)),
        "exact": (_list(1.0), _list(F.col("score")), _list(0.1)),
    }[kind]
    return f.select("*", *[c.alias(n) for c, n in zip(parts, ("pi", "mu", "sigma"), strict=True)])


def mixtures_sql(kind: str = "noisy") -> str:
    pi, mu, sigma = {
        "noisy": ("[1.0]", "[score + (k - 49.5) / 50.0]", "[0.6]"),
        "two": ("[0.7, 0.3]", "[score, score + (k - 49.5) / 25.0]", "[0.5, 1.0]"),
        "wide": ("[0.7, 0.3]", "[score, score + (k - 49.5) / 25.0]", "[4.0, 6.0]"),
        "exact": ("[1.0]", "[score]", "[0.1]"),
    }[kind]
    return f"(SELECT *, {pi}::DOUBLE[] AS pi, {mu}::DOUBLE[] AS mu, {sigma}::DOUBLE[] AS sigma FROM {FRAMES})"


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.lit("v0").alias("video_id"), F.col("vec_id").alias("frame_id"), F.col("embedding").alias("features"), F.col("label").alias("score"))


EMBEDDED = "(SELECT 'v0' AS video_id, vec_id AS frame_id, embedding AS features, label AS score FROM embeddings)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of every order's line items, raw and with corners."""
    side = F.lit(20.0) + F.lit(3.0) * F.col("l_quantity").cast("double")
    order = ["l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate"]
    raw = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("frame_id"),
        F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).cast("long").alias("det_id"),
        (F.col("l_suppkey") % 5).cast("int").alias("cls"),
        (F.col("l_partkey") % 416).cast("double").alias("cx"), (F.col("l_suppkey") % 416).cast("double").alias("cy"),
        side.alias("w"), side.alias("h"),
        F.least(F.col("l_extendedprice").cast("double") / 100000.0, F.lit(1.0)).alias("obj_conf"),
        (F.lit(1.0) - F.col("l_discount").cast("double")).alias("cls_conf"),
        F.col("l_returnflag").alias("flag"),
    )
    half = F.col("w") / 2
    return raw.select("*", (F.col("cx") - half).alias("x1"), (F.col("cy") - half).alias("y1"), (F.col("cx") + half).alias("x2"), (F.col("cy") + half).alias("y2"))


BOXES = """(SELECT *, cx - w / 2 AS x1, cy - h / 2 AS y1, cx + w / 2 AS x2, cy + h / 2 AS y2 FROM (
  SELECT l_orderkey AS frame_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate) AS det_id,
    CAST(l_suppkey % 5 AS INT) AS cls, CAST(l_partkey % 416 AS DOUBLE) AS cx, CAST(l_suppkey % 416 AS DOUBLE) AS cy,
    20.0::DOUBLE + 3.0::DOUBLE * CAST(l_quantity AS DOUBLE) AS w, 20.0::DOUBLE + 3.0::DOUBLE * CAST(l_quantity AS DOUBLE) AS h,
    least(CAST(l_extendedprice AS DOUBLE) / 100000.0::DOUBLE, 1.0::DOUBLE) AS obj_conf, 1.0::DOUBLE - CAST(l_discount AS DOUBLE) AS cls_conf,
    l_returnflag AS flag FROM lineitem))"""


def truth_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).where("flag = 'R'").select("frame_id", "cls", "x1", "y1", "x2", "y2")
