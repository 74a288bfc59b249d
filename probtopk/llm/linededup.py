"""Line deduplication through a sharded minimal perfect hash.

A line's key (trimmed, A-Z lowered) is known by two independent 64-bit hashes.
Documents are counted per key, and every key seen in at least two documents goes
into an index: per shard a minimal perfect hash over the first hashes (levels of
bit maps, a key lives at the first level where it is alone), and beside it an
array of fingerprints (the second hashes) and an array of document counts, both in the order of
the perfect hash. Documents probe these arrays with packed hashes; lines are never
joined as text. A key that is not in the index is told by its fingerprint.

A shard that a common line floods with probes is copied, and its probes are dealt to the copies by the number of
their row, so every key is answered by the arrays and no task has more than about twice its share.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_DOCS = 10
#: Mean number of probes per shard, and the least number for which a shard is copied.
SHARD_PROBES, LEAST_PROBES = 200_000, 2_000
#: Bits per key in each level of the perfect hash.
GAMMA = 2
MAX_LEVELS = 64

INDEX_SCHEMA = "shard int, n_keys long, sizes array<int>, bits binary, fingerprints binary, counts binary"


def line_key(line: Column) -> Column:
    return common.lower_ascii(F.btrim(line, F.lit(common.WS_CHARS)))


def split_lines(text: str) -> Column:
    """Lines of a text; null and empty texts have one empty line."""
    return F.split(common.text_or_empty(text), "\n", -1)


def _first_hash(key: Column) -> Column:
    return F.xxhash64(key)


def key_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(uid, id, th, keys): distinct (h1, h2) of the keys of a row; th tells rows of one id apart, uid numbers all rows and holds in a written table only."""
    keys = F.filter(F.transform(split_lines(text_col), line_key), lambda k: F.length(k) >= max(min_chars, 1))
    return docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col(id_col).alias("id"),
        F.xxhash64(text_col).alias("th"),
        F.transform(F.array_distinct(keys), lambda k: F.struct(_first_hash(k).alias("h1"), F.xxhash64(k, F.lit(1)).alias("h2"))).alias("keys"),
    )


def _spread(h: np.ndarray, level: int) -> np.ndarray:
    """Another 64-bit hash of `h` for each level (multiply and shift)."""
    with np.errstate(over="ignore"):
        x = h ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def build_mph(h: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Level sizes and the bit map of a minimal perfect hash over distinct uint64 `h`."""
    sizes, maps, rest = [], [], h
    for level in range(MAX_LEVELS):
        if not len(rest):
            break
        size = max(64, GAMMA * len(rest))
        at = (_spread(rest, level) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        maps.append(alone)
        rest = rest[~alone[at]]
    if len(rest):
        raise ValueError("keys of a perfect hash must be distinct")
    return sizes, np.concatenate(maps) if maps else np.zeros(0, bool)


def lookup_mph(sizes: list[int], bits: np.ndarray, ranks: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of each hash, or -1; a hash that was never put in may get any index."""
    out = np.full(len(h), -1, np.int64)
    todo, start = np.arange(len(h)), 0
    for level, size in enumerate(sizes):
        at = start + (_spread(h[todo], level) % np.uint64(size)).astype(np.int64)
        hit = bits[at]
        out[todo[hit]] = ranks[at[hit]]
        todo, start = todo[~hit], start + size
    return out


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    h = pdf["h1"].to_numpy(np.int64).view(np.uint64)
    sizes, bits = build_mph(h)
    at = lookup_mph(sizes, bits, np.cumsum(bits) - 1, h)
    prints, counts = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
    prints[at], counts[at] = pdf["h2"].to_numpy(np.int64), pdf["n_docs"].to_numpy(np.int64)
    counts = counts.astype(np.uint32 if len(h) == 0 or counts.max() < 2**32 else np.uint64)
    row = [int(pdf["shard"].iloc[0]), len(h), sizes, np.packbits(bits).tobytes(), prints.tobytes(), counts.tobytes()]
    return pd.DataFrame([row], columns=["shard", "n_keys", "sizes", "bits", "fingerprints", "counts"])


def build_index(counts: DataFrame, n_shards: int) -> DataFrame:
    """One row per shard from (h1, h2, n_docs); a first hash stands for one key."""
    keyed = counts.withColumn("shard", F.pmod("h2", F.lit(n_shards)).cast("int"))
    return keyed.groupBy("shard").applyInPandas(_build_shard, INDEX_SCHEMA)


def _prober(min_docs: int):
    def probe(requests: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        out = requests[["id", "th", "h1"]]
        if not len(index) or not len(requests):
            return out.iloc[:0]
        row = index.iloc[0]
        counts = np.frombuffer(row["counts"], np.uint32 if len(row["counts"]) == 4 * row["n_keys"] else np.uint64)
        prints = np.frombuffer(row["fingerprints"], np.int64)
        sizes = list(row["sizes"])
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(sizes)).astype(bool)
        h = requests["h1"].to_numpy(np.int64).view(np.uint64)
        at = lookup_mph(sizes, bits, np.cumsum(bits) - 1, h)
        known = (at >= 0) & (prints[at] == requests["h2"].to_numpy(np.int64))
        return out[known & (counts[at] >= min_docs)]

    return probe


def repeated_keys(docs: DataFrame, id_col: str, text_col: str, min_docs: int = MIN_DOCS, min_chars: int = 1) -> DataFrame:
    """(id, th, drop): per row with such lines, the first hashes of its keys that are in min_docs rows."""
    keys = common.materialize(key_hashes(docs, id_col, text_col, min_chars), "line-keys")
    n_probes = keys.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    n_shards = max(1, -(-n_probes // SHARD_PROBES), common.n_partitions(docs.sparkSession))
    probes = keys.select("uid", "id", "th", F.explode("keys").alias("k")).select("uid", "id", "th", "k.h1", "k.h2")
    probes = probes.withColumn("shard", F.pmod("h2", F.lit(n_shards)).cast("int"))
    counts = common.materialize(probes.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs")), "line-counts")
    repeated = counts.where(F.col("n_docs") >= 2)
    sizes = common.materialize(counts.groupBy(F.pmod("h2", F.lit(n_shards)).cast("int").alias("shard")).agg(F.sum("n_docs").alias("n")), "shard-probes")
    a_copy = max(LEAST_PROBES, -(-2 * n_probes // n_shards))
    copies = sizes.select("shard", F.ceil(F.col("n") / a_copy).cast("int").alias("copies"))  # two numbers a shard
    of_shard = copies.select("shard", F.col("copies").alias("n"))
    index = common.materialize(build_index(repeated, n_shards), "line-index")
    spread = common.lookup(index, of_shard, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    dealt = common.lookup(probes, copies, "shard").withColumn("copy", F.pmod(F.xxhash64("uid"), F.col("copies").cast("long")).cast("int")).drop("copies", "uid")
    schema = f"id {keys.schema['id'].dataType.simpleString()}, th long, h1 long"
    found = dealt.groupBy("shard", "copy").cogroup(spread.groupBy("shard", "copy")).applyInPandas(_prober(min_docs), schema)
    return found.groupBy("id", "th").agg(F.collect_set("h1").alias("drop"))


def with_kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """All rows and columns of `docs` and `__lines`, `__kept` (arrays of lines).

    Null or empty text is one empty line, which has no key and stays; very long texts are split whole. Rows that
    repeat an id or a text count as documents of their own. An empty table gives no rows.
    """
    drops = repeated_keys(docs, id_col, text_col, **kw).select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("drop").alias("__drop"))
    keyed = docs.withColumn("__row_th", F.xxhash64(text_col))
    joined = keyed.join(drops, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__row_th") == F.col("__th")), "left")
    lines = split_lines(text_col)
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("__drop"), _first_hash(line_key(x))) | (line_key(x) == ""))
    return joined.select(*docs.columns, lines.alias("__lines"), F.when(F.col("__drop").isNull(), lines).otherwise(kept).alias("__kept"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """`docs` with the repeated lines taken out of its text; null text stays null, other columns may have any names."""
    hidden = common.hide(docs, id_col, text_col)
    kept = F.when(F.col(text_col).isNotNull(), F.array_join("__kept", "\n")).alias(text_col)
    rows = with_kept_lines(hidden, id_col, text_col, **kw).select(*[kept if c == text_col else F.col(c) for c in hidden.columns])
    return common.show(rows, docs, id_col, text_col)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines kept of all documents. A null or empty text is one empty line, which stays; very long texts are split whole; repeated rows count as documents of their own."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    lines = with_kept_lines(docs)
    return lines.select(
        "doc_id",
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size("__kept")).cast("long").alias("n_dropped"),
        F.sha2(F.array_join("__kept", "\n"), 256).alias("kept_sha256"),
    )


ORACLE_SQL = r"""
WITH l AS (
  SELECT d.rowid AS rid, d.doc_id, unnest(string_split(coalesce(d.text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(d.text, ''), chr(10)), 1) AS pos
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents) d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10),
m AS (SELECT k.*, c.key IS NOT NULL AS dropped FROM k LEFT JOIN c ON c.key = k.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY rid
"""
