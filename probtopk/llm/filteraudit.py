"""Audit of how filters interact, by the Walsh-Hadamard transform.

A document fails a subset of the filters, its mask. Per part and label, documents
are summed with the sign (-1) ** |mask & s| for every subset s of the filters: 32
signed parity sums for five filters, which add up over labels. The transform is its own inverse but
for a factor, so the sums give back the exact number of documents of every mask.
Every question about an order of the filters is a sum over these cells:

- a filter removes the documents that fail it and none of the filters before it,
- a document is shared out evenly among the filters that it fails, as each of them is
  first among them in equally many orders: n! / (failed filters) of the n! orders each.

One filter is "an equal text has a smaller id". Rows are first counted by
(digest of the text, id), which deals a large group of copies over all tasks, then by
digest and part, where every task has at most one row per part and label of a group; so there is no
join and no window on the digest of single documents.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Fixed values of the audited filters: least words, least share of distinct words, largest share of capitals, symbols.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 100, 80, 10, "[#$%&*|]"
#: The letter of the filter against copies; the last bit of a mask.
COPY = "E"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text, which must not be null."""
    words = F.col("__words")
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * MIN_DISTINCT,
        "C": (F.length(text) - F.length(F.translate(text, common.UPPER, ""))) * 100 > F.length(text) * MAX_CAPITALS,
        "D": F.regexp_like(text, F.lit(SYMBOLS)),
    }


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, mask, digest) of every row: the filters of the text alone that it fails, as bits in order of their letters.

    Null text counts as empty, a null part as the empty string. Other columns are not read, whatever their names.
    """
    text = common.text_or_empty(text_col)
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), part.alias("part"), text.alias("__text"), common.words(text).alias("__words"))
    mask = F.lit(0)
    for bit, fails in enumerate(text_filters(F.col("__text")).values()):
        mask = mask + F.when(fails, F.lit(1 << bit)).otherwise(F.lit(0))
    return rows.select("id", "part", mask.alias("mask"), F.unhex(F.sha2("__text", 256)).alias("digest"))


def label_flags(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, good, toxic) of ids with a label of 1; an id with several labels has a flag if one of them has. Null ids have none."""
    flag = lambda c: F.max(F.coalesce(F.col(c), F.lit(0)) == 1)
    found = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    return found.where("good OR toxic")


def counted_copies(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, good, toxic, mask, firsts, copies): rows per digest, part and label; copies have a smaller id with an equal text.

    The smallest id may be repeated; all its rows are firsts. Rows without an id are firsts and make no other row a copy.
    """
    keys = ["digest", "part", "mask"]
    rows = masks.groupBy("id", *keys).agg(F.count(F.lit(1)).alias("n"))
    flagged = common.lookup(rows, common.materialize(labels, "label-flags"), "id", "left")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    no_id = F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0))
    per_part = flagged.select("id", *keys, flag("good"), flag("toxic"), "n").groupBy(*keys, "good", "toxic").agg(
        F.min("id").alias("least"), F.coalesce(F.min_by("n", "id"), F.lit(0)).alias("at_least"), no_id.alias("no_id"), F.sum("n").alias("n")
    )
    least = F.min("least").over(Window.partitionBy("digest"))  # a row per part and label
    firsts = F.col("no_id") + F.when(F.col("least") == F.col("least_of_all"), F.col("at_least")).otherwise(F.lit(0))
    marked = per_part.withColumn("least_of_all", least).withColumn("firsts", firsts)
    return marked.select("part", "good", "toxic", "mask", "firsts", (F.col("n") - F.col("firsts")).alias("copies"))


def _sign(mask: Column, subset: Column) -> Column:
    """(-1) ** (number of filters in both sets)."""
    return F.lit(1) - F.bit_count(mask.bitwiseAND(subset)) % 2 * 2


def parity_sums(counted: DataFrame, n_filters: int) -> DataFrame:
    """(part, good, toxic, sums): the 2 ** n_filters signed parity sums of every part and label, partly summed before they are shuffled.

    A row adds its firsts and its copies at once: they differ in the last bit alone, whose sign is that of the subset.
    """
    copy = 1 << n_filters - 1
    parts = []
    for subset in range(1 << n_filters):
        both = F.col("firsts") - F.col("copies") if subset & copy else F.col("firsts") + F.col("copies")
        parts.append(F.sum(_sign(F.col("mask"), F.lit(subset)) * both))
    return counted.groupBy("part", "good", "toxic").agg(F.array(*parts).alias("sums"))


def cells(sums: Column, n_filters: int) -> Column:
    """The exact number of documents of every mask: the inverse transform."""
    subsets = F.sequence(F.lit(0), F.lit((1 << n_filters) - 1))
    signed = lambda mask: F.zip_with(sums, subsets, lambda x, s: x * _sign(mask, s))
    total = lambda mask: F.aggregate(signed(mask), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return F.transform(subsets, lambda mask: F.shiftright(total(mask), n_filters))


def mask_cells(sums: DataFrame, n_filters: int) -> DataFrame:
    """(part, docs, good, toxic): per part three arrays of documents per mask: all, those of good quality, toxic ones."""
    added = lambda where: F.array(*[F.coalesce(F.sum(F.when(where, F.get("sums", F.lit(s)))), F.lit(0)) for s in range(1 << n_filters)])
    kinds = {"docs": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    per_part = sums.groupBy("part").agg(*[added(where).alias(f"{name}_sums") for name, where in kinds.items()])
    return per_part.select("part", *[cells(F.col(f"{name}_sums"), n_filters).alias(name) for name in kinds])


def evaluate_orders(per_part: DataFrame, letters: str) -> DataFrame:
    """A row per part, order of the filters and step, from the cells of mask_cells."""
    orders = ["".join(p) for p in permutations(letters)]
    n = len(letters)
    masks = F.sequence(F.lit(0), F.lit((1 << n) - 1))
    bits = lambda chosen: sum((F.when(F.contains(chosen, F.lit(x)), F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate(letters)), F.lit(0))
    steps = per_part.withColumn("filter_order", F.explode(F.lit(orders))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    sets = F.struct(bits(F.expr("left(filter_order, step - 1)")).alias("before"), bits(F.expr("substr(filter_order, step, 1)")).alias("own"))
    steps = steps.select("*", F.inline(F.array(sets)))  # computed once a row, not once a cell
    before, own = F.col("before"), F.col("own")

    def total(counts: str, where, weight=None) -> Column:
        of = lambda c, m: F.when(where(m), c if weight is None else c * weight(m)).otherwise(F.lit(0).cast("long"))
        return F.aggregate(F.zip_with(counts, masks, of), F.lit(0).cast("long"), lambda acc, x: acc + x)

    fails = lambda m: m.bitwiseAND(own) != 0
    fresh = lambda m: m.bitwiseAND(before) == 0
    share = lambda m: F.floor(F.lit(factorial(n)) / F.greatest(F.bit_count(m), F.lit(1)))
    here = lambda m: fails(m) & fresh(m)
    return steps.select(
        "part", "filter_order", "step",
        total("docs", lambda m: ~fails(m) & fresh(m)).alias("kept"),
        total("docs", here).alias("removed"),
        total("docs", lambda m: fails(m) & ~fresh(m)).alias("redundant"),
        total("docs", lambda m: m == own).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        total("docs", fails, share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """What each of the filters A to E does in every order and part: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null and empty texts are one text; very long texts are read whole; repeated rows count each; rows without an id are
    never copies and have no labels; a null part is the empty one; an empty table has no parts and no rows. Columns other than the
    three are not read.
    """
    letters = "".join(text_filters(F.col(text_col))) + COPY
    masks = common.materialize(failure_masks(docs, id_col, text_col, part_col), "masks")
    sums = parity_sums(counted_copies(masks, label_flags(labels, id_col)), len(letters))
    return evaluate_orders(mask_cells(sums, len(letters)), letters)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of the five filters over all documents, per language. Null languages are the empty part; see `audit` for other cases."""
    return audit(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN coalesce(least < w.doc_id, false) THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(x, bit)),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s AS (SELECT filter_order, step::INT AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, range(1, 6) AS r(step)),
p AS (SELECT DISTINCT part FROM d)
SELECT p.part, filter_order, step,
  coalesce(sum(n) FILTER (mask & (own | before) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) FILTER (mask & own <> 0), 0)::BIGINT AS shapley
FROM p CROSS JOIN s JOIN c ON c.part = p.part GROUP BY p.part, filter_order, step
"""
