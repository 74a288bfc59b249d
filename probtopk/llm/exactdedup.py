"""Exact deduplication through a sharded cuckoo-filter index.

The index is a table of one row per shard of digests. A shard is a cuckoo filter,
buckets of four 16-bit fingerprints, and in the same places its content: the whole
digest, how many rows have it, and the row that stays. A digest is looked for in
two buckets; only where a fingerprint hits is the content read, and the digests
themselves decide. A digest that finds no place after some evictions doubles the buckets, which are
filled again from the stored digests. Digests whose last row is deleted leave filter and content.

`insert` and `delete` take a batch of rows and give the next version of the index, as a table of its own, `probe`
answers rows. Nothing depends on the order of rows:

- before the shuffle every task gathers its rows in a small index, so a shard gets a digest once a task;
- rows that probe are dealt by shard and, where a shard has many of them, by row number to copies of the shard, so a
  group of copies of any size is spread over tasks, each with a bounded number of rows;
- of rows of the greatest id, that of the greatest row number stays. Row numbers are written before they are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Slots of a bucket, evictions before the buckets double, digests that a task gathers before it hands them on.
SLOTS, MAX_KICKS, GATHERED = 4, 200, 100_000
#: Rows behind a shard of the index; rows that probe one copy of it, at most, and twice the mean of the shards or this many, if that is less.
SHARD_ROWS, PROBE_ROWS, LEAST_ROWS = 100_000, 100_000, 500


class CuckooIndex:
    """Digests (bytes of one length, at least 16) with a count and the greatest (id, uid) of their rows; an id may be null, which is below all others."""

    def __init__(self, n_buckets: int = 16):
        self._empty(n_buckets)

    def _empty(self, n_buckets: int) -> None:
        self.n_buckets, self.size = n_buckets, 0
        n = n_buckets * SLOTS
        self.prints = np.zeros(n, np.uint16)
        self.content: list[list | None] = [None] * n  # [digest, count, id, uid]

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        """The fingerprint, never 0, and the two buckets of a digest."""
        mark = int.from_bytes(digest[:2], "little") % 0xFFFF + 1
        first = int.from_bytes(digest[2:10], "little") % self.n_buckets
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        """The other bucket of a fingerprint; buckets are a power of two, so it leads back as well."""
        return bucket ^ ((mark * 0x5BD1E995 >> 7) % self.n_buckets)

    def _find(self, digest: bytes) -> int:
        mark, *buckets = self._places(digest)
        for bucket in buckets:
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.prints[slot] == mark and self.content[slot][0] == digest:
                    return slot
        return -1

    def get(self, digest: bytes) -> list | None:
        """[digest, count, id, uid], or None."""
        slot = self._find(digest)
        return None if slot < 0 else self.content[slot]

    def insert(self, digest: bytes, count: int, top, uid: int) -> None:
        found = self.get(digest)
        if found is None:
            self._place([digest, count, top, uid])
            return
        found[1] += count
        if _order(top, uid) > _order(*found[2:]):
            found[2:] = [top, uid]

    def _place(self, entry: list) -> None:
        while (entry := self._put(entry)) is not None:  # the filter overflows
            held = [e for e in self.content if e is not None]
            self._empty(self.n_buckets * 2)
            for other in held:
                left = self._put(other)
                if left is not None:  # very rare: once more, larger
                    self._place(left)

    def _put(self, entry: list) -> list | None:
        """Puts an entry in one of its buckets, evicting others from theirs; an entry that is left over."""
        mark, *buckets = self._places(entry[0])
        for kick in range(MAX_KICKS):
            for bucket in buckets:
                for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                    if self.content[slot] is None:
                        self.prints[slot], self.content[slot] = mark, entry
                        self.size += 1
                        return None
            slot = buckets[-1] * SLOTS + kick % SLOTS
            entry, self.content[slot] = self.content[slot], entry
            mark, self.prints[slot] = int(self.prints[slot]), mark
            buckets = [self._other(buckets[-1], mark)]
        return entry

    def delete(self, digest: bytes, count: int = 1) -> bool:
        """Takes rows of a digest away; with the last one the digest leaves. Whether it was there."""
        slot = self._find(digest)
        if slot < 0:
            return False
        self.content[slot][1] -= count
        if self.content[slot][1] <= 0:
            self.prints[slot], self.content[slot] = 0, None
            self.size -= 1
        return True

    def entries(self) -> Iterator[list]:
        return (e for e in self.content if e is not None)


def _order(top, uid: int) -> tuple:
    """Null ids come first."""
    return (top is not None, 0 if top is None else top, uid)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, id, digest) of every row: a number, the id, SHA-256 of the text with A-Z lower-cased; written, as the numbers hold in a table only. Null text is empty."""
    digest = F.unhex(F.sha2(common.lower_ascii(common.text_or_empty(text_col)), 256))
    return common.materialize(docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), digest.alias("digest")), "digests")


def _id_type(rows: DataFrame) -> str:
    return rows.schema["id"].dataType.simpleString()


def _wrapped(rows: DataFrame) -> DataFrame:
    """Ids as arrays of one element, or none for null: pandas would make a column of whole numbers with nulls inexact."""
    return rows.withColumn("id", F.when(F.col("id").isNull(), F.array().cast(f"array<{_id_type(rows)}>")).otherwise(F.array("id")))


def _unwrapped(value):
    return None if not len(value) else value[0].item() if isinstance(value[0], np.generic) else value[0]


def _rows(pdf: pd.DataFrame, *columns: str) -> Iterator[tuple]:
    return zip(*[map(_unwrapped, pdf[c]) if c == "id" else pdf[c].tolist() for c in columns], strict=True)


def _frame(index: CuckooIndex) -> pd.DataFrame:
    rows = list(index.entries())
    return pd.DataFrame(rows, columns=["digest", "n", "id", "uid"], dtype=object).astype({"n": "int64", "uid": "int64"})  # ids stay Python numbers


def gathered(rows: DataFrame) -> DataFrame:
    """(digest, n, id, uid): the rows of every task, each digest once; a task's index is handed on and emptied when it holds GATHERED digests."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = CuckooIndex()
        for pdf in batches:
            for digest, top, uid in _rows(pdf, "digest", "id", "uid"):
                index.insert(digest, 1, top, uid)
            if index.size >= GATHERED:
                yield _frame(index)
                index = CuckooIndex()
        yield _frame(index)

    return _wrapped(rows).mapInPandas(run, f"digest binary, n long, id {_id_type(rows)}, uid long")


def _sharded(rows: DataFrame, n_shards: int) -> DataFrame:
    return rows.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(n_shards)).cast("int"))


def _schema(kind: str) -> str:
    return f"shard int, n_buckets long, n_digests long, prints binary, digests binary, counts array<long>, ids array<array<{kind}>>, uids array<long>"


def _load(row) -> CuckooIndex:
    index = CuckooIndex(int(row["n_buckets"]))
    index.prints = np.frombuffer(row["prints"], np.uint16).copy()
    used = np.flatnonzero(index.prints)
    size = len(row["digests"]) // max(len(used), 1)
    for i, slot in enumerate(used):
        index.content[slot] = [row["digests"][i * size : (i + 1) * size], int(row["counts"][i]), _unwrapped(row["ids"][i]), int(row["uids"][i])]
    index.size = len(used)
    return index


def _dump(shard: int, index: CuckooIndex) -> pd.DataFrame:
    held = list(index.entries())  # in order of their slots, as the fingerprints
    row = [shard, index.n_buckets, index.size, index.prints.tobytes(), b"".join(e[0] for e in held), [e[1] for e in held], [[] if e[2] is None else [e[2]] for e in held], [e[3] for e in held]]
    return pd.DataFrame([row], columns=["shard", "n_buckets", "n_digests", "prints", "digests", "counts", "ids", "uids"])


def empty_index(rows: DataFrame) -> DataFrame:
    """An index without shards for rows as of `digests`."""
    return rows.sparkSession.createDataFrame([], _schema(_id_type(rows)))


def _updated(index: DataFrame, changes: DataFrame, n_shards: int, apply) -> DataFrame:
    """The next version of the index; every shard sees its own changes."""

    def run(held: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
        shard = int((held if len(held) else batch)["shard"].iloc[0])
        state = _load(held.iloc[0]) if len(held) else CuckooIndex()
        for digest, n, top, uid in _rows(batch, "digest", "n", "id", "uid"):
            apply(state, digest, n, top, uid)
        return _dump(shard, state)

    dealt = _sharded(_wrapped(changes), n_shards).groupBy("shard")
    return common.materialize(index.groupBy("shard").cogroup(dealt).applyInPandas(run, index.schema), "cuckoo-index")


def n_shards_for(rows: DataFrame) -> int:
    """Enough shards for rows that are all different; an index keeps its number."""
    return max(common.n_partitions(rows.sparkSession), -(-rows.count() // SHARD_ROWS))


def insert(index: DataFrame, rows: DataFrame, n_shards: int) -> DataFrame:
    """The index with more rows."""
    return _updated(index, gathered(rows), n_shards, lambda state, digest, n, top, uid: state.insert(digest, n, top, uid))


def delete(index: DataFrame, rows: DataFrame, live: DataFrame, n_shards: int) -> DataFrame:
    """The index without `rows` (as of `digests`), which must be in it; `live` are all rows that are in it.

    A digest whose staying row goes gets the greatest of those that are left.
    """

    def away(state: CuckooIndex, digest: bytes, n: int, top, uid: int) -> None:
        found = state.get(digest)
        if found is None or found[1] < n:
            raise ValueError("rows to delete are not in the index")
        state.delete(digest, n)

    def elect(state: CuckooIndex, digest: bytes, n: int, top, uid: int) -> None:
        found = state.get(digest)
        found[2:] = [top, uid]

    smaller = _updated(index, gathered(rows), n_shards, away)
    left = live.join(rows.select("uid"), "uid", "left_anti").join(rows.select("digest").distinct(), "digest", "left_semi")
    return _updated(smaller, gathered(left), n_shards, _greatest(elect))


def _greatest(elect):
    """Applies elections of parts of a group: the first one replaces what is there, later ones only raise it."""
    seen: set[bytes] = set()

    def run(state: CuckooIndex, digest: bytes, n: int, top, uid: int) -> None:
        if digest not in seen:
            seen.add(digest)
            elect(state, digest, n, top, uid)
        elif _order(top, uid) > _order(*state.get(digest)[2:]):
            elect(state, digest, n, top, uid)

    return run


def probe(index: DataFrame, rows: DataFrame, n_shards: int) -> DataFrame:
    """(uid, id, digest, keep_id, group_size, kept) of every row whose digest is in the index.

    Rows are dealt by shard, those of a shard with many rows also by their number, to as many copies of the shard.
    """
    kind = _id_type(rows)

    def run(requests: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held):
            state = _load(held.iloc[0])
            for digest, top, uid in _rows(requests, "digest", "id", "uid"):
                if (found := state.get(digest)) is not None:
                    out.append((uid, top, digest, found[2], found[1], found[3] == uid))
        frame = pd.DataFrame(out, columns=["uid", "id", "digest", "keep_id", "group_size", "kept"], dtype=object)
        return frame.astype({"uid": "int64", "group_size": "int64", "kept": bool})

    sharded = _sharded(rows, n_shards)
    sizes = common.materialize(sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n")), "sizes")  # a row of two numbers per shard
    mean = sizes.agg(F.coalesce(F.avg("n"), F.lit(0.0))).first()[0]
    a_copy = min(PROBE_ROWS, max(LEAST_ROWS, int(2 * mean)))
    copies = sizes.select("shard", F.ceil(F.col("n") / a_copy).cast("int").alias("copies"))
    dealt = common.lookup(_wrapped(sharded), copies, "shard").withColumn("copy", F.pmod(F.xxhash64("uid"), F.col("copies").cast("long")).cast("int"))
    of_shard = copies.select("shard", F.col("copies").alias("n"))
    spread = common.lookup(index, of_shard, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    keys = ["shard", "copy"]
    schema = f"uid long, id {kind}, digest binary, keep_id {kind}, group_size long, kept boolean"
    return dealt.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(run, schema)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, id, digest, keep_id, group_size, kept) of every row; of equal texts the row with the greatest id stays.

    Texts are equal when they are identical after A-Z is lower-cased; null counts as empty; very long texts are digested whole. Null ids are
    below all others; of repeated rows exactly one stays. An empty table gives no rows. Other columns are not read.
    """
    rows = digests(docs, id_col, text_col)
    n_shards = n_shards_for(rows)
    return probe(insert(empty_index(rows), rows, n_shards), rows, n_shards)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns; see exact_groups for nulls, ties and empty tables.

    `docs` is written with row numbers first, under a column name that it does not have.
    """
    number = "uid"
    while number in docs.columns:
        number += "_"
    numbered = common.materialize(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    digest = F.unhex(F.sha2(common.lower_ascii(common.text_or_empty(text_col)), 256))
    rows = common.materialize(numbered.select(F.col(number).alias("uid"), F.col(id_col).alias("id"), digest.alias("digest")), "digests")
    n_shards = n_shards_for(rows)
    found = probe(insert(empty_index(rows), rows, n_shards), rows, n_shards)
    return numbered.join(found.where("kept").select(F.col("uid").alias(number)), number, "left_semi").select(*docs.columns)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every document. Null text is empty; of equal texts the greatest id stays, of repeated rows one; an empty table gives no rows."""
    found = exact_groups(common.documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
r AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
             row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) AS turn FROM d)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, turn = 1 AS kept, sha256(t) AS text_sha256 FROM r
"""
