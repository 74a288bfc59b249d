"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key, -ln(u) / w, with u from a hash of its id
and w its quality weight; ascending keys are a weighted sample without
replacement. A source whose target is more than its size is first taken whole as
many times as fit (complete epochs); the rest of its budget goes to its
documents in order of their keys, by a running sum of their words. The document
at the end of the budget is taken in part, so the words taken meet the target.

The running sum has two levels: keys fall into a fixed number of buckets by a
monotone map, words are summed per (source, bucket), and only rows of one
(source, bucket) are ordered together. A hot source is therefore spread over
many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
N_BUCKETS = 4096
SEED = "mix-1"
#: Quality weight of a document labelled good, labelled bad, and not labelled.
QUALITY_WEIGHTS = (1.0, 0.25, 0.5)


def n_words(text: str) -> Column:
    return F.regexp_count(common.text_or_empty(text), F.lit(common.WORD)).cast("long")


def es_key(id_col: str, weight: str, seed: str = SEED, no_id: Column | None = None) -> Column:
    """-ln(u) / weight, with u in (0, 1) from the first 48 bits of an md5 of the id, or of what stands for it in rows without one."""
    given = F.coalesce(F.col(id_col).cast("string"), F.lit("") if no_id is None else no_id)
    digest = F.md5(F.concat(given, F.lit(f":{seed}")).cast("binary"))
    bits = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double")
    return -F.ln((bits + 0.5) / F.lit(float(2**48))) / F.col(weight)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Sources by code point, null last, have the weights in turn and share
    `share` times all words; a target stops at `max_epochs` times its source's
    size and the excess is shared again by weight. That ends where
    target = min(cap, level * weight) for one level, which one running sum over
    the sources in order of cap / weight finds. The table is as small as the number of
    sources.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    n = len(weights)
    listed = sizes.withColumn("place", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % n + 1).cast("int")).cast("double")
    )
    capped = listed.withColumn("cap", F.col("source_size") * float(max_epochs)).withColumn("ratio", F.col("cap") / F.col("weight"))
    up_to = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    budget = F.least(F.sum("source_size").over(everything) * share, F.sum("cap").over(everything))
    before = lambda c: F.coalesce(F.sum(c).over(up_to), F.lit(0.0))
    level = (budget - before("cap")) / (F.sum("weight").over(everything) - before("weight"))
    # The level is the one of the first source that does not reach its cap.
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(everything)
    levels = capped.withColumn("level", level).withColumn("level", first["level"])
    target = F.coalesce(F.least("cap", F.col("level") * F.col("weight")), "cap")
    return levels.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", weight_col: str = "weight", keep: tuple[str, ...] = (), no_id: str | None = None, **kw) -> DataFrame:
    """Rows (id, source, size, source_size, target, taken, epochs) of a mix, and the columns to keep.

    `docs` has an id, a source, a size in words and a positive weight. Null
    sources are one source; rows without an id draw by the column `no_id`, or share one random number if there is none. Equal keys are
    ordered by id, size and the columns to keep; rows that repeat an id are each a document; one without words takes nothing; a very long one may be taken in part.
    An empty table gives no rows. Other columns are ignored.
    """
    keyed = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(size_col).alias("size"), es_key(id_col, weight_col, no_id=no_id and F.col(no_id)).alias("key"), *keep
    ).withColumn("bucket", F.floor((1.0 - F.exp(-F.col("key"))) * N_BUCKETS).cast("int"))
    keyed = common.materialize(keyed, "mix-keys")
    buckets = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    plan = targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), **kw)
    plan = plan.withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    ).withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 0.5).cast("long"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    starts = starts.join(plan, same(starts, plan)).select(
        starts["source"], "bucket", "start", "source_size", "target", "epochs", "rest"
    )
    inside = Window.partitionBy("source", "bucket").orderBy("key", "id", "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    ordered = keyed.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = ordered.join(starts, same(ordered, starts) & (ordered["bucket"] == starts["bucket"]))
    part = F.least("size", F.greatest(F.lit(0), F.col("rest") - F.col("start") - F.col("within")))
    return joined.select(
        F.col("id").alias(id_col), ordered["source"].alias("source"), "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), F.col("epochs"), *keep,
    )


def with_weights(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, size, weight, th, no_id): words of the text, the weight of the quality label, the text's hash, and what rows without an id draw by."""
    good, bad, none = map(F.lit, QUALITY_WEIGHTS)
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sized = docs.select("doc_id", "source", n_words("text").alias("size"), F.xxhash64("text").alias("th"), F.when(F.col("doc_id").isNull(), F.md5(common.text_or_empty("text").cast("binary"))).alias("no_id"))
    return sized.join(marks, "doc_id", "left").select(
        "doc_id", "source", "size", F.when(F.col("quality") == 1, good).when(F.col("quality") == 0, bad).otherwise(none).alias("weight"), "th", "no_id"
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents. A null or empty text has no words and nothing is taken of it; the null source comes last; repeated rows are each a document."""
    docs = common.documents(spark, sf_dir)
    mixed = mix(with_weights(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), no_id="no_id")
    return mixed.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "taken")


ORACLE_SQL = r"""
WITH q AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT d.doc_id, d.source,
         len(list_filter(regexp_split_to_array(coalesce(d.text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS size,
         -ln((CAST('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, md5(coalesce(d.text, ''))) || ':mix-1'), 1, 12) AS BIGINT)::DOUBLE + 0.5) / 281474976710656.0)
           / CASE q.quality WHEN 1 THEN 1.0 WHEN 0 THEN 0.25 ELSE 0.5 END AS k
  FROM documents d LEFT JOIN q ON q.doc_id = d.doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
             row_number() OVER (ORDER BY source IS NULL, source) AS place FROM s),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
                 - coalesce(sum(cap) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT source, source_size,
             coalesce(least(cap, (min(CASE WHEN level <= ratio THEN {'r': ratio, 'p': place, 'level': level} END) OVER ()).level * weight), cap)::DOUBLE AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
r AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.epochs,
             floor(p.target - p.epochs * p.source_size + 0.5)::BIGINT AS rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (epochs * size + least(size, greatest(0, rest - before)))::BIGINT AS taken FROM r
"""


def mixed_copies(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` (doc_id, text, source and others) as the mix takes them.

    A row comes once per complete epoch; a row that is taken in part comes with
    the first words that are taken, and a row of which nothing is taken goes.
    Rows without words, null and empty texts too, take no part in the count of words and stay once.
    Null ids and sources are kept, an empty table gives no rows, other columns are handed on, whatever their names.
    """
    needed = ("doc_id", "text", "source")
    given, docs = docs, common.hide(docs, *needed)
    plan = mix(with_weights(docs, labels), keep=("th",), no_id="no_id").select(
        F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("size").alias("__size"), F.col("taken").alias("__taken"), F.col("source").alias("__source")
    )
    # Rows that repeat an id, a source and a text stand for each other: the plan's rows are numbered against the table's.
    key = ["__id", "__source", "__th"]
    plan = plan.withColumn("__turn", F.row_number().over(Window.partitionBy(*key).orderBy("__taken")))
    keyed = docs.withColumns({"__row_th": F.xxhash64("text"), "__n": n_words("text")})
    keyed = keyed.withColumn("__row", F.row_number().over(Window.partitionBy("doc_id", "source", "__row_th").orderBy("__n")))
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__row_th") == F.col("__th")) & (F.col("__row") == F.col("__turn"))
    joined = keyed.join(plan, on).select(*docs.columns, "__n", "__taken")
    whole = F.when(F.col("__n") == 0, 1).otherwise(F.floor(F.col("__taken") / F.col("__n"))).cast("int")
    part = F.when(F.col("__n") == 0, 0).otherwise(F.col("__taken") % F.col("__n")).cast("int")
    takes = F.concat(F.array_repeat(F.col("__n").cast("int"), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    each = joined.withColumn("__take", F.explode(takes))
    pieces = F.regexp_extract_all("text", F.lit(rf"[{common.WS}]*[^{common.WS}]+"), F.lit(0))
    cut = F.when(F.col("__take") == F.col("__n"), F.col("text")).otherwise(F.array_join(F.slice(pieces, F.lit(1), F.col("__take")), ""))
    return common.show(each.select(*[cut.alias(c) if c == "text" else F.col(c) for c in docs.columns]), given, *needed)
