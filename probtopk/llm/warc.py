"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page id, then by payload. The borders of shards come
from an exact histogram of bytes over that order, never from a sample, and are stored beside the
manifest. A task writes its records as gzip members, one a record, rolls to the next file when the compressed size
is reached, and regenerates every header and digest from the payload. Files are
written under temporary names of the attempt and renamed when complete; the
manifest, a Parquet table written by one Spark job after the last file, commits
them. Readers take only files of the manifest, so leftovers of lost executors
are never read. Times and record ids derive from parameters, page ids and payloads, so
reruns give the same files with the same bytes.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordinals import range_dealt
from . import common

ROLL_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"
#: Uncompressed bytes of html per shard that the number of shards aims at.
SHARD_BYTES = 64 << 20
READ_STEP = 8192
#: Rows of an Arrow batch; rows carry whole pages.
BATCH_ROWS = 500
#: A place in the order is a string of hexadecimal digits: 1 (0 without an id), 16 of the id, 16 of the payload's digest.
PLACE = 33
#: A range of places that holds more than 1 / FINE of a shard's bytes is cut into sixteen.
FINE = 4

MANIFEST_SCHEMA = "file string, shard int, n_records long, bytes long, sha1 string, first_id long, last_id long"
READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload: bytes = b"") -> str:
    """From the page id, or for a page without one from its payload."""
    name = f"page:{page_id}" if page_id is not None else f"payload:{base32_sha1(payload)}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def render(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record before compression; a revisit has no block, a page without id no header for it."""
    block = payload if refers_to is None else b""
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, payload)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", re.sub(r"[\r\n]+", " ", url) if url is not None else None),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("WARC-Page-ID", None if page_id is None else str(page_id)),
        ("WARC-Payload-Length", str(len(payload))),
    ]
    if refers_to is not None:
        head += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(refers_to)),
            ("WARC-Refers-To-Page-ID", str(refers_to)),
        ]
    head.append(("Content-Length", str(len(block))))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


class _Roller:
    """Files of one shard, each complete under its final name only after close()."""

    def __init__(self, folder: str, shard: int, attempt: int, roll_bytes: int):
        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.shard, self.attempt, self.roll_bytes = shard, attempt, roll_bytes
        self.seq, self.out = 0, None

    def put(self, page_id: int | None, record: bytes) -> tuple | None:
        if self.out is None:
            self.name = f"part-{self.shard:05d}-{self.seq:05d}.warc.gz"
            self.temp = f"{self.folder}/.tmp-{self.attempt}-{self.name}"
            self.out, self.size, self.n, self.first, self.sha = self.fs.open_output_stream(self.temp, compression=None), 0, 0, page_id, hashlib.sha1()
        member = gzip.compress(record, 6, mtime=0)
        self.out.write(member)
        self.sha.update(member)
        self.size, self.n, self.last = self.size + len(member), self.n + 1, page_id
        return self.close() if self.size >= self.roll_bytes else None

    def close(self) -> tuple | None:
        if self.out is None:
            return None
        self.out.close()
        self.out, self.seq = None, self.seq + 1
        self.fs.move(self.temp, f"{self.folder}/{self.name}")
        return self.name, self.shard, self.n, self.size, self.sha.hexdigest(), self.first, self.last


def _writer(folder: str, roll_bytes: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        attempt, roller, done, of, refers_to = TaskContext.get().taskAttemptId(), None, [], None, None
        for pdf in batches:
            for shard, page_id, print_, is_page, refers, url, html in zip(*[pdf[c] for c in ("shard", "page_id", "print", "is_page", "refers_to", "url", "html")], strict=True):
                page_id = None if pd.isna(page_id) else int(page_id)
                if roller is None or roller.shard != shard:
                    done.append(roller and roller.close())
                    roller = _Roller(folder, int(shard), attempt, roll_bytes)
                if of != (page_id, print_):
                    of, refers_to = (page_id, print_), None
                if not is_page:  # what was decided for a page and payload comes just before its records
                    refers_to = int(refers)
                    continue
                done.append(roller.put(page_id, render(page_id, url, (html or "").encode(), refers_to)))
        done.append(roller and roller.close())
        frame = pd.DataFrame([x for x in done if x], columns=[x.split(" ")[0] for x in MANIFEST_SCHEMA.split(", ")])
        yield frame.astype({"first_id": "Int64", "last_id": "Int64"})

    return write


def _located(pages: DataFrame) -> DataFrame:
    """Pages with print, the payload's sha256, and place, a string that orders pages by id (null first), then print."""
    html = F.coalesce("html", F.lit(""))
    digits = F.lpad(F.hex(F.col("page_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")  # unsigned, in the order of the ids
    print_ = F.sha2(html, 256)
    place = F.concat(F.when(F.col("page_id").isNull(), F.lit("0" * 17)).otherwise(F.concat(F.lit("1"), digits)), F.upper(F.substring(print_, 1, 16)))
    return pages.select("page_id", "url", "html", F.octet_length(html).cast("long").alias("n"), F.unhex(print_).alias("print"), place.alias("place"))


def decide(facts: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, print, place, refers_to): pages whose payload a larger page id has, with the largest; no id is smaller than any."""
    prints = facts.where(F.col("n") >= min_bytes)
    largest = prints.groupBy("print").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1 AND refers_to IS NOT NULL")
    found = common.lookup(prints, common.materialize(largest.drop("copies"), "largest-ids"), "print")
    return found.where("page_id IS NULL OR page_id < refers_to").select("page_id", "print", "place", "refers_to").distinct()


def shard_ranges(facts: DataFrame, n_shards: int, total: int) -> DataFrame:
    """(prefix, shard): ranges of places that hold at most 1 / FINE of a shard, where that can be, dealt in order so that shards hold nearly equal bytes.

    Bytes are counted by the first digits of the place; only heavy ranges are counted by one digit
    more. There are at most some 64 ranges a shard; they are ordered in parts, and one task orders a row of bytes per part.
    """
    most = total / n_shards / FINE
    open_, ranges, width = facts.select("place", F.greatest("n", F.lit(1)).alias("n")), None, 2
    ends = open_.agg(F.min("place"), F.max("place")).first()
    if ends[0] is not None:  # digits that all places share tell nothing
        width += next((i for i, (x, y) in enumerate(zip(*ends, strict=True)) if x != y), PLACE - 2)
    while True:
        width = min(width, PLACE)
        bins = common.materialize(open_.groupBy(F.substring("place", 1, width).alias("prefix")).agg(F.sum("n").alias("n"), F.min("place").alias("low"), F.max("place").alias("high")), "ranges")
        is_heavy = (F.col("low") != F.col("high")) & (F.col("n") > most)  # one place can't be cut
        heavy, light = bins.where(is_heavy), bins.where(~is_heavy).select("prefix", "n")
        ranges = light if ranges is None else ranges.unionByName(light)
        shared = heavy.agg(F.min(F.expr(f"aggregate(sequence(1, {PLACE}), 0, (n, i) -> IF(n = i - 1 AND substring(low, i, 1) = substring(high, i, 1), i, n))"))).first()[0]
        if shared is None:
            break
        open_ = common.lookup(open_.withColumn("prefix", F.substring("place", 1, width)), heavy.select("prefix"), "prefix", "left_semi").drop("prefix")
        width = shared + 1  # all heavy ranges share so many digits within
    parts = common.materialize(range_dealt(ranges, "prefix").withColumn("part", F.spark_partition_id()), "range-parts")
    up_to = lambda by: F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.groupBy("part").agg(F.sum("n").alias("n")).select("part", up_to(Window.orderBy("part")).alias("start"))
    inside = parts.withColumn("inside", up_to(Window.partitionBy("part").orderBy("prefix")))
    ranges, before = inside.join(F.broadcast(starts), "part"), F.col("start") + F.col("inside")  # a row per part
    shard = F.least(F.floor(before * F.lit(n_shards) / F.lit(max(total, 1))), F.lit(n_shards - 1)).cast("int")
    return ranges.select("prefix", shard.alias("shard"))


def in_shards(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """`rows`, which have a place, with the shard of the range (prefix, shard) that holds it; one lookup for each length of a prefix."""
    columns = rows.columns
    widths = [r[0] for r in ranges.select(F.length("prefix")).distinct().collect()]  # at most PLACE
    for w in widths:
        own = common.materialize(ranges.where(F.length("prefix") == w).select(F.col("prefix").alias(f"p{w}"), F.col("shard").alias(f"s{w}")), "shards")
        rows = common.lookup(rows.withColumn(f"p{w}", F.substring("place", 1, w)), own, f"p{w}", "left")
    return rows.select(*columns, (F.coalesce(*[f"s{w}" for w in widths]) if widths else F.lit(0)).alias("shard"))


def write_warc(pages: DataFrame, folder: str, n_shards: int | None = None, roll_bytes: int = ROLL_BYTES, min_bytes: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) to `folder`; returns the committed manifest.

    Null html is an empty payload, a null url leaves out its header. A row
    without a page id gets a record without that header, named by its payload; it counts as smaller than any id, and refers to a page
    that has one. Rows that repeat a page id get a record each, decided by their own payloads; repeated rows too. Very long
    pages are one record. An empty table gives a manifest without files. Other columns are ignored.
    """
    spark = pages.sparkSession
    common.bound_batches(spark, BATCH_ROWS)
    with common.temporary(spark):
        located = _located(pages)
        facts = common.materialize(located.drop("url", "html"), "page-facts")
        total = facts.agg(F.coalesce(F.sum(F.greatest("n", F.lit(1))), F.lit(0))).first()[0]
        n_shards = n_shards or max(-(-total // SHARD_BYTES), 4)
        shard_ranges(facts, n_shards, total).coalesce(1).write.parquet(f"{folder}/_shards")
        ranges = spark.read.schema("prefix string, shard int").parquet(f"{folder}/_shards")
        none = F.lit(None).cast("string")
        decided = decide(facts, min_bytes).select("page_id", "print", "place", F.lit(False).alias("is_page"), "refers_to", none.alias("url"), none.alias("html"))
        records = located.select("page_id", "print", "place", F.lit(True).alias("is_page"), F.lit(None).cast("long").alias("refers_to"), "url", "html").unionByName(decided)
        if ranges.count() <= common.BROADCAST_ROWS:
            sharded = in_shards(records, ranges)
        else:  # the ranges are looked up by the places alone, the records get theirs in one join
            places = in_shards(facts.select("place").distinct(), ranges)
            sharded = common.lookup(records, common.materialize(places, "places"), "place")
        dealt = sharded.select("shard", "page_id", "place", "print", "is_page", "refers_to", "url", "html").repartitionById(n_shards, F.col("shard"))
        ordered = dealt.sortWithinPartitions("place", "print", "is_page", F.xxhash64("url"), "url")
        place, path = fs.FileSystem.from_uri(folder)
        place.create_dir(path)
        ordered.mapInPandas(_writer(folder, roll_bytes), MANIFEST_SCHEMA).write.parquet(f"{folder}/_manifest")
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{folder}/_manifest")


def parse(data: bytes) -> Iterator[tuple]:
    """Records of one file: (page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload).

    The digest of a response is computed from its payload and held against its header.
    """
    view, at = memoryview(data), 0
    while at < len(view):
        d, parts = zlib.decompressobj(31), []
        while not d.eof and at < len(view):  # step by step, as what is left over of a step is copied
            step = view[at : at + READ_STEP]
            parts.append(d.decompress(step))
            at += len(step) - len(d.unused_data)
        if not d.eof:
            raise ValueError("a record is cut off")
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if f"sha1:{base32_sha1(block)}" != fields["WARC-Block-Digest"]:
            raise ValueError(f"block digest of {fields['WARC-Record-ID']} differs")
        kind, refers = fields["WARC-Type"], fields.get("WARC-Refers-To-Page-ID")
        n = len(block) if kind == "response" else int(fields["WARC-Payload-Length"])
        page_id = fields.get("WARC-Page-ID")
        yield page_id and int(page_id), fields.get("WARC-Target-URI"), n, digest, kind, refers and int(refers), block if kind == "response" else None


def _read(keep_payload: bool):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split(" ")[0] for x in READ_SCHEMA.split(", ")]
        for pdf in batches:
            for data in pdf["content"]:
                rows, held = [], 0
                for row in parse(data):
                    rows.append(row if keep_payload else (*row[:-1], None))
                    held += row[2]
                    if held > ROLL_BYTES:
                        yield _frame(rows, names)
                        rows, held = [], 0
                yield _frame(rows, names)

    return read


def _frame(rows: list, names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})


def read_warc(spark: SparkSession, folder: str, keep_payload: bool = True) -> DataFrame:
    """Records of the files that the manifest commits; files are read one at a time a task. A record without a page id has null."""
    common.bound_batches(spark, 1)  # a row is a whole file
    manifest = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{folder}/_manifest")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    named = files.withColumn("file", F.element_at(F.split("path", "/"), -1))
    committed = common.lookup(named, manifest.select("file"), "file", "left_semi")
    return committed.select("content").mapInPandas(_read(keep_payload), READ_SCHEMA)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages, reads the archives back. Null html is an empty payload, a null id stays null, repeated rows have a record each."""
    folder = common.scratch(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_warc(spark, folder, keep_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
