"""Dense ordinals and running sums without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import scratch, written

#: Values of the order column that one task ranks together.
SPAN = 65_536


def with_ordinal(df: DataFrame, key: str, order: str, name: str = "pos", span: int = SPAN) -> DataFrame:
    """`df` with the rank from 0 of each row by the integer column `order` within `key`.

    Rows are ranked inside spans of the order column; a small table of counts per
    span gives the rank at which each span starts.
    """
    spans = df.withColumn("__span", F.floor(F.col(order) / span))
    before = Window.partitionBy(key).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    starts = spans.groupBy(key, "__span").agg(F.count(F.lit(1)).alias("__n"))
    starts = starts.select(key, "__span", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(key, "__span").orderBy(order)) - 1
    return spans.withColumn(name, inside).join(starts, [key, "__span"]).withColumn(name, (F.col(name) + F.col("__start")).cast("long")).drop("__span", "__start")


def range_dealt(df: DataFrame, *order: Column | str) -> DataFrame:
    """`df` dealt into ranges of the order, sorted inside each. Borders come from a sample of rows and their whole order, so rows
    that are equal in the first columns are spread by the others."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)


def with_range_rank(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """`df` with the rank from 0 of each row in a total order, whatever the values look like.

    Rows are numbered inside ranges, which are written once; a row of counts per range gives the rank at which it starts.
    """
    at = F.monotonically_increasing_id()  # the number of the range in the high bits, that of the row in the low 33
    numbered = written(range_dealt(df, *order).withColumn("__at", at), scratch(df.sparkSession, "ranges"))
    placed = numbered.withColumn("__range", F.shiftright("__at", 33))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    rank = F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(starts), "__range").select(*df.columns, rank.cast("long").alias(name))  # a row per range


def low_end(df: DataFrame, value: Column, bin_of: Column, order: list[str], limit: float) -> DataFrame:
    """The rows, lowest first, from which on the sum of `value` over all higher rows and the row itself is below `limit`.

    `value` is at most 0 and `bin_of` rises with the order. Sums run from the highest row down: bins are summed
    first, a table of as many rows as there are bins. Bins below the one in which the limit is passed are taken
    whole; only rows of that bin are ordered.
    """
    binned = df.withColumn("__v", value).withColumn("__bin", bin_of)
    down = Window.orderBy(F.desc("__bin")).rowsBetween(Window.unboundedPreceding, 0)
    sums = binned.groupBy("__bin").agg(F.sum("__v").alias("__s")).withColumn("__to", F.sum("__s").over(down))
    placed = binned.join(F.broadcast(sums.select("__bin", "__to", (F.col("__to") - F.col("__s")).alias("__higher"))), "__bin").where(F.col("__to") < limit)
    whole = placed.where(F.col("__higher") < limit)
    cut = placed.where(F.col("__higher") >= limit)
    own = F.sum("__v").over(Window.partitionBy("__bin").orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0))
    part = cut.withColumn("__own", own).where(F.col("__own") + F.col("__higher") < limit)
    return whole.select(*df.columns).unionByName(part.select(*df.columns))


#: Rows that one task may order.
ORDERED = 65_536


def lowest(df: DataFrame, bin_of: Column, order: list[str], n: int) -> DataFrame:
    """The n lowest rows. A few are a top-n; of many, bins (which rise with the order) below the cut are taken whole, and only rows of the bin of the cut are ranked."""
    if n <= ORDERED:
        return df.orderBy(*order).limit(n)
    binned = df.withColumn("__bin", bin_of)
    up = Window.orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
    counts = binned.groupBy("__bin").agg(F.count(F.lit(1)).alias("__n")).withColumn("__to", F.sum("__n").over(up))
    placed = binned.join(F.broadcast(counts.select("__bin", "__to", (F.col("__to") - F.col("__n")).alias("__from"))), "__bin").where(F.col("__from") < n)  # a row per bin
    cut = placed.where(F.col("__to") > n)
    ranked = with_range_rank(cut, [*order], "__rank").where(F.col("__rank") + F.col("__from") < n)
    return placed.where(F.col("__to") <= n).select(*df.columns).unionByName(ranked.select(*df.columns))
