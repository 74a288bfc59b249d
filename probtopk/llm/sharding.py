"""Sharding by fixed virtual slots.

Records hash by id into thousands of virtual slots, whose number never changes. Bytes
are summed per slot, and a versioned slot-to-shard map says which shard holds a
slot. A new version of the map is an edit of the last one: rebalancing moves
whole slots, and adding shards moves slots only into the new ones.

Everything is DataFrame functions. The map has one row per slot, so it is
bounded by the number of slots and is the only thing that is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

N_SLOTS = 4096
RECORD_OVERHEAD = 8


def record_size(text: str) -> Column:
    """UTF-8 bytes of the text (null: none) and a fixed overhead, as long."""
    return (F.octet_length(common.text_or_empty(text)) + F.lit(RECORD_OVERHEAD)).cast("long")


def with_slot(df: DataFrame, id_col: str, text_col: str, n_slots: int = N_SLOTS) -> DataFrame:
    """(id, size, text_crc32, virtual_slot) of every row; written, as ids are counted first.

    The slot is a hash of the id where one row has it, so that a large group of equal texts spreads over the shards and a row whose
    text is edited stays. Rows without an id, or with one that others have too, go by id and text, so they spread as well;
    only rows that are equal in both are held together.
    """
    text = common.text_or_empty(text_col)
    slot = lambda *key: F.pmod(F.xxhash64(*key), F.lit(n_slots)).cast("int")
    rows = df.select(
        F.col(id_col),
        record_size(text_col).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        slot(F.col(id_col)).alias("__own"),
        slot(F.col(id_col), text).alias("__spread"),
    )
    rows = common.materialize(rows, "slots")
    shared = rows.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    shared = common.materialize(shared.select(id_col, F.lit(True).alias("__shared")), "shared-ids")
    spread = F.col(id_col).isNull() | F.coalesce("__shared", F.lit(False))
    placed = common.lookup(rows, shared, id_col, "left")
    return placed.select(F.col(id_col), "size", "text_crc32", F.when(spread, F.col("__spread")).otherwise(F.col("__own")).alias("virtual_slot"))


def slot_bytes(slotted: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """(virtual_slot, bytes, n_rows) for every slot, empty ones included."""
    sums = slotted.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))
    slots = slotted.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return slots.join(F.broadcast(sums), "virtual_slot", "left").select(
        "virtual_slot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("n_rows", F.lit(0)).alias("n_rows")
    )


def _deal(slots: DataFrame, n_shards: int, first: int = 0) -> DataFrame:
    """(virtual_slot, shard): the heaviest slot first, each to the shard with the
    fewest bytes so far; the fold runs over one array of at most n_slots elements."""
    order = slots.agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot"))).alias("slots"))
    lightest = "CAST(array_position(acc.loads, array_min(acc.loads)) - 1 AS INT)"
    dealt = order.selectExpr(
        "slots",
        f"""aggregate(slots,
            named_struct('loads', array_repeat(0L, {n_shards}), 'shards', CAST(array() AS ARRAY<INT>)),
            (acc, s) -> named_struct(
                'loads', transform(acc.loads, (x, i) -> IF(i = {lightest}, x - s.less + 1L, x)),
                'shards', concat(acc.shards, array({lightest}))),
            acc -> acc.shards) AS shards""",
    )
    pairs = dealt.select(F.explode(F.arrays_zip("slots", "shards")).alias("p"))
    return pairs.select(F.col("p.slots.virtual_slot").alias("virtual_slot"), (F.col("p.shards") + first).alias("shard"))


def initial_map(slots: DataFrame, n_shards: int) -> DataFrame:
    """Version 1 of the map: (version, virtual_slot, shard, bytes, n_rows)."""
    return slots.join(F.broadcast(_deal(slots, n_shards)), "virtual_slot").select(
        F.lit(1).alias("version"), "virtual_slot", "shard", "bytes", "n_rows"
    )


def grow_map(slot_map: DataFrame, n_shards: int, added: int = 1) -> DataFrame:
    """The next version with `added` more shards; slots move only into these.

    Each shard gives up its last slots, as far as they fit in what it holds above
    the new mean.
    """
    total = F.sum("bytes").over(Window.partitionBy("version"))
    own = Window.partitionBy("shard")
    from_end = own.orderBy(F.desc("virtual_slot")).rowsBetween(Window.unboundedPreceding, 0)
    excess = F.sum("bytes").over(own) - F.col("total") / F.lit(n_shards + added)
    marked = (
        slot_map.withColumn("total", total)
        .withColumn("excess", excess)
        .withColumn("moves", (F.sum("bytes").over(from_end) <= F.col("excess")) & (F.col("bytes") > 0))
    )
    new = _deal(marked.where("moves").select("virtual_slot", "bytes"), added, n_shards)
    return marked.join(F.broadcast(new.withColumnRenamed("shard", "new_shard")), "virtual_slot", "left").select(
        (F.col("version") + 1).alias("version"), "virtual_slot", F.coalesce("new_shard", "shard").alias("shard"), "bytes", "n_rows"
    )


def store_map(slot_map: DataFrame, path: str, version: int) -> DataFrame:
    """Write one version of the map; an earlier version stays as it is."""
    slot_map.drop("version").coalesce(1).write.mode("error").parquet(f"{path}/version={version}")
    return load_map(slot_map.sparkSession, path, version)


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    table = spark.read.parquet(f"{path}/version={version}")
    return table.select(F.lit(version).alias("version"), *table.columns)


def assign(slotted: DataFrame, slot_map: DataFrame, id_col: str) -> DataFrame:
    """Every row with its shard and its place in the shard, gapless from 0.

    The place is the number of rows in the shard's earlier slots plus the rank in
    the own slot, so no task ever orders more than one slot.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slot_map.select("virtual_slot", "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(id_col, "text_crc32", "size"))
    ranked = slotted.withColumn("rank", rank)
    return ranked.join(F.broadcast(offsets), "virtual_slot").select(
        id_col, "size", "text_crc32", "shard", (F.col("offset") + F.col("rank") - 1).alias("slot"), "virtual_slot"
    )


def shard(df: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """Deal all rows into shards 0 to n_shards - 1 whose bytes are nearly equal.

    Null text counts as empty, ids may be null or repeated, equal rows get
    places of their own, a very long text is one record, an empty table gives no rows. Columns other than id and
    text are ignored.
    """
    spark = df.sparkSession
    slotted = with_slot(df, id_col, text_col, n_slots)
    path = map_path or common.scratch(spark, "slot-map")
    slot_map = store_map(initial_map(slot_bytes(slotted, n_slots), n_shards), path, 1)
    return assign(slotted, slot_map, id_col)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes. Null texts have 8 bytes, rows are dealt by id (null and repeated ids by id and text), repeated rows have places of their own."""
    placed = shard(common.documents(spark, sf_dir), 24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )
