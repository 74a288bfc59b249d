"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import scratch, written

_FOLDER: ContextVar[str | None] = ContextVar("folder", default=None)

#: The white space that separates words, as a regular-expression class body.
WS = r"\x20\x09-\x0D"
WORD = rf"[^{WS}]+"
#: The same characters, spelled out for trim functions.
WS_CHARS = " \t\n\x0b\x0c\r"
#: Rows of a table that may be broadcast, some 20 bytes each, and bytes of an Arrow batch.
BROADCAST_ROWS, BATCH_BYTES = 500_000, 4 << 20
#: Ranges of hashes that are counted to cut a sample.
SPANS = 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialized inside are deleted at the end; what is to stay has to be written outside."""
    folder = scratch(spark, "work")
    before = _FOLDER.set(folder)
    try:
        yield
    finally:
        _FOLDER.reset(before)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back.

    Cuts lineage so that what follows does not repeat the work, and survives the
    loss of executors.
    """
    folder = _FOLDER.get()
    return written(df, f"{folder}/{name}-{uuid.uuid4().hex}" if folder else scratch(df.sparkSession, name))


def lookup(df: DataFrame, table: DataFrame, on: str | list[str], how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """`df` joined with a written table of a few numbers a row.

    Up to `most` rows, by count, it is broadcast. A larger one is dealt like `df`; as both
    sides are then plain exchanges, Spark splits the heavy keys of `df`.
    """
    return df.join(F.broadcast(table) if table.count() <= most else table, on, how)


def bound_batches(spark: SparkSession, rows: int = 1000, size: int = BATCH_BYTES) -> None:
    """From now on the session's Python workers get Arrow batches of at most `rows` rows and about `size` bytes.

    Results are lazy, so the setting has to hold when they are written; it stays.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def smallest_hashes(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """The `rows` rows with the smallest hash of `key`; a bounded sample that is the same in every run.

    A histogram of SPANS hash ranges gives the cut: the first range in which the
    count reaches `rows`. Rows of equal keys beyond it are cut by their order, so
    tables of repeated rows give as many rows as others do.
    """
    u = F.pmod(F.xxhash64(*key), F.lit(SPANS))
    up_to = Window.orderBy("__u").rowsBetween(Window.unboundedPreceding, 0)
    counts = df.groupBy(u.alias("__u")).agg(F.count(F.lit(1)).alias("__n")).select("__u", F.sum("__n").over(up_to).alias("__n"))
    cut = counts.where(F.col("__n") >= rows).agg(F.min("__u")).first()[0]  # at most SPANS rows are ordered
    near = df if cut is None else df.where(u <= cut)
    return near.orderBy(u, F.xxhash64(*key), *key).limit(rows)


def hide(docs: DataFrame, *needed: str) -> DataFrame:
    """`docs` with all columns but the needed ones under names that no operator uses, so that none of theirs can clash."""
    return docs.select(*[docs[f"`{c}`"].alias(c if c in needed else f"__other_{i}") for i, c in enumerate(docs.columns)])


def show(rows: DataFrame, docs: DataFrame, *needed: str) -> DataFrame:
    """Rows of hide() with the names and the order of the columns of `docs`."""
    return rows.select(*[F.col(c if c in needed else f"__other_{i}").alias(c) for i, c in enumerate(docs.columns)])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """Words of a text: maximal runs of non-white-space characters."""
    return F.filter(F.split(text, rf"[{WS}]+"), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
