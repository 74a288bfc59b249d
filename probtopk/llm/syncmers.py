"""Document fingerprints from closed syncmers.

The k-mers are K consecutive tokens. A k-mer is an anchor when the smallest of
its K - S + 1 inner s-mers (runs of S tokens, compared by hash) is the first or the last
one. Whether a k-mer is an anchor depends on its own tokens only, so an edit
changes no anchor elsewhere, and equal passages have equal anchors at
equal distances.

Tokens are the pieces of a text: its words cut into runs of at most PIECE
code points, so that a short text does not stand or fall with one word. Texts of
all lengths are read alike. A text without an anchor has one, the hash of all its pieces.

The fingerprint holds the SKETCH smallest distinct anchor hashes with the place
(in pieces) where each comes first. The likeness of two texts is
read from their fingerprints alone: the Jaccard estimate on the SKETCH smallest hashes of
the union, exact where both have at most SKETCH anchors, in which a shared anchor
counts if another one has moved as far from text to text. What is
shared by chance moves by chance, and all of it together counts as one anchor.

Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K, S = 4, 2
SKETCH = 64
PIECE = 4


def token_hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.xxhash64(t))


def _tail(array: Column, start: int, drop: int) -> Column:
    """Elements from `start` (0-based), `drop` fewer than there are."""
    return F.slice(array, F.lit(start + 1), F.greatest(F.size(array) - F.lit(drop), F.lit(0)))


def smer_hashes(tokens: Column) -> Column:
    """Hash of each run of S = 2 token hashes, one element fewer than tokens."""
    return F.zip_with(_tail(tokens, 0, 1), _tail(tokens, 1, 1), lambda a, b: F.xxhash64(a, b))


def anchors_of(smers: Column) -> Column:
    """array<long>: per k-mer its hash if it is a closed syncmer, else null.

    A k-mer of four tokens has the s-mers (a, b, c); its hash is made of a and c, which cover all four.
    """
    pairs = F.arrays_zip(_tail(smers, 1, 2).alias("b"), _tail(smers, 2, 2).alias("c"))
    # An s-mer in the middle that is as small as one at an edge does not count as smaller.
    return F.zip_with(_tail(smers, 0, 2), pairs, lambda a, bc: F.when(bc["b"] >= F.least(a, bc["c"]), F.xxhash64(a, bc["c"])))


def pieces(text: Column) -> Column:
    """Words of a text cut into runs of at most PIECE code points."""
    return F.regexp_extract_all(text, F.lit(rf"[^{common.WS}]{{1,{PIECE}}}"), F.lit(0))


def with_anchors(df: DataFrame, text_col: str, prefix: str) -> DataFrame:
    """Columns <prefix>_anchors: array<long>, null where a k-mer is none, and <prefix>_whole: hash of all pieces.

    What is read several times in the next step is a step of its own.
    """
    tokens = df.withColumn(f"{prefix}_t", token_hashes(pieces(common.text_or_empty(text_col))))
    smers = tokens.withColumns({f"{prefix}_s": smer_hashes(F.col(f"{prefix}_t")), f"{prefix}_whole": F.xxhash64(f"{prefix}_t")})
    return smers.withColumn(f"{prefix}_anchors", anchors_of(F.col(f"{prefix}_s"))).drop(f"{prefix}_t", f"{prefix}_s")


def positional_anchors(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`df` with anchors: array<struct<pos, hash>>, place (in pieces) and hash of each, for positional matching of passages."""
    placed = F.transform(F.col("__anchors"), lambda h, i: F.struct(i.alias("pos"), h.alias("hash")))
    found = with_anchors(df, text_col, "_").withColumn("anchors", F.filter(placed, lambda p: p["hash"].isNotNull()))
    return found.select(*df.columns, "anchors")


def smallest(hashes: Column) -> Column:
    return F.slice(F.array_sort(F.array_distinct(F.array_compact(hashes))), 1, SKETCH)


def with_sketch(df: DataFrame, text_col: str, prefix: str) -> DataFrame:
    """Column <prefix>: struct<hashes, at>, the SKETCH smallest distinct anchor hashes and the place where each comes first."""
    anchors, whole, least, near = (f"{prefix}_{c}" for c in ("anchors", "whole", "least", "near"))
    found = with_anchors(df, text_col, prefix).withColumn(least, smallest(F.col(anchors)))
    # Only anchors up to the greatest hash of the sketch are looked at for places.
    placed = F.transform(F.col(anchors), lambda h, i: F.when(h <= F.element_at(F.col(least), -1), F.struct(h.alias("hash"), i.alias("at"))))
    none = F.size(least) == 0
    held = found.withColumn(near, F.when(none, F.array().cast("array<struct<hash:bigint,at:int>>")).otherwise(F.array_compact(placed)))
    held = held.withColumn(least, F.when(none, F.array(whole)).otherwise(F.col(least)))
    at = F.transform(F.col(least), lambda h: F.coalesce(F.get(F.col(near)["at"], F.array_position(F.col(near)["hash"], h) - 1), F.lit(0)))
    return held.withColumn(prefix, F.struct(F.col(least).alias("hashes"), at.alias("at"))).drop(anchors, whole, least, near)


def as_text(sketch: Column) -> Column:
    """hash@place, by hash."""
    return F.array_join(F.zip_with(sketch["hashes"], sketch["at"], lambda h, i: F.concat(F.lpad(F.lower(F.hex(h)), 16, "0"), F.lit("@"), i.cast("string"))), ",")


def with_likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Column <name>, 0 to 1: likeness of the sketches in the columns a and b."""
    union, shared, moved = (f"{name}_{c}" for c in ("union", "shared", "moved"))
    place = lambda s, h: F.get(F.col(s)["at"], F.array_position(F.col(s)["hashes"], h) - 1)
    steps = df.withColumn(union, F.slice(F.array_sort(F.array_union(F.col(a)["hashes"], F.col(b)["hashes"])), 1, SKETCH))
    steps = steps.withColumn(shared, F.array_intersect(F.array_intersect(F.col(union), F.col(a)["hashes"]), F.col(b)["hashes"]))
    steps = steps.withColumn(moved, F.array_sort(F.transform(F.col(shared), lambda h: place(a, h) - place(b, h))))
    # In order of the way moved, equal ones are neighbours.
    fellows = F.filter(F.col(moved), lambda d, i: F.coalesce(d == F.get(F.col(moved), i - 1), F.lit(False)) | F.coalesce(d == F.get(F.col(moved), i + 1), F.lit(False)))
    counted = F.greatest(F.size(fellows), F.least(F.size(moved), F.lit(1)))
    return steps.withColumn(name, counted / F.size(union)).drop(union, shared, moved)


#: What tells rows apart: the id (0 where it is null), whether it is known, the text's hash.
KEY = ("kid", "known", "th")


def _key(id_col: str, text_col: str) -> list[Column]:
    return [F.coalesce(F.col(id_col), F.lit(0)).cast("long").alias("kid"), F.col(id_col).isNotNull().alias("known"), F.xxhash64(text_col).alias("th")]


def links_to_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """KEY of a row's next row, KEY of the row with the prefix own_, n_chars: each distinct (id, text) with the next one.

    Rows are in order of id (null first), then of the text's hash; after the last comes the
    first. Ids are range-sorted; only the first row of each range travels
    between ranges, so no task orders all ids.
    """
    spark = docs.sparkSession
    keys = docs.select(*_key(id_col, text_col), F.length(common.text_or_empty(text_col)).alias("n_chars"))
    keys = keys.groupBy(*KEY).agg(F.max("n_chars").alias("n_chars"))
    ranged = keys.repartitionByRange(common.n_partitions(spark), "known", "kid", "th").withColumn("part", F.spark_partition_id())
    ranged = common.materialize(ranged, "ranged-ids")
    row = F.struct("known", "kid", "th")
    firsts = ranged.groupBy("part").agg(F.min(row).alias("first"))
    by_part = Window.orderBy("part")
    after = F.coalesce(F.lead("first").over(by_part), F.first("first").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    turns = firsts.select("part", after.alias("turn"))  # one row per range
    following = F.lead(row).over(Window.partitionBy("part").orderBy("known", "kid", "th"))
    linked = ranged.withColumn("following", following).join(F.broadcast(turns), "part").withColumn("following", F.coalesce("following", "turn"))
    return linked.select(*[F.col(f"following.{c}").alias(c) for c in KEY], *[F.col(c).alias(f"own_{c}") for c in KEY], "n_chars")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_chars, edited text's sha256, sketches of both texts and their likeness, and that to the next document's.

    The edited text has its last floor(n_chars / 4) code points replaced by as
    many first ones of the next document. Null text is empty; a null id comes
    first; rows that repeat an id follow each other in order of their text's hash; rows
    that repeat both count once in that order and each gets the same result. The next of a
    single document is itself.

    Texts are dealt by KEY once; both joins use that exchange, and what travels
    besides is the start that a document hands to the one before it.
    """
    links = links_to_next(docs, id_col, text_col)
    dealt = docs.select(*_key(id_col, text_col), F.col(text_col).alias("text")).repartition(common.n_partitions(docs.sparkSession), *KEY)
    handing = with_sketch(dealt.join(links, list(KEY)), "text", "next").select(
        *[F.col(f"own_{c}").alias(c) for c in KEY],
        F.substring(common.text_or_empty("text"), F.lit(1), F.floor(F.col("n_chars") / 4).cast("int")).alias("start"),
        F.col("next").alias("next_sketch"),
    )
    # Rows of one KEY have equal texts (by a hash of 64 bits), so each hands over the same start; one is taken.
    starts = handing.groupBy(*KEY).agg(F.first("start").alias("start"), F.first("next_sketch").alias("next_sketch"))
    text = common.text_or_empty("text")
    n_chars = F.length(text)
    edited = F.concat(F.substring(text, F.lit(1), n_chars - F.floor(n_chars / 4).cast("int")), F.col("start"))
    joined = dealt.join(starts, list(KEY)).withColumn("edited", edited)
    both = with_sketch(with_sketch(joined, "text", "own"), "edited", "other")
    both = with_likeness(with_likeness(both, "own", "other", "near_edited"), "own", "next_sketch", "near_next")
    return both.select(
        F.when(F.col("known"), F.col("kid")).alias(id_col), n_chars.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts. Null texts are empty, a null id comes first, very long texts are read whole, repeated rows get a row each."""
    return fingerprints(common.documents(spark, sf_dir))
