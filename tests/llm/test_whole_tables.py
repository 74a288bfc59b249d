"""Whole queries against plain Python over whole tables."""

import base64
import hashlib
from collections import defaultdict

import pandas as pd
from sqlcheck import DATA

from probtopk.llm import common, warc
from probtopk.llm.queries import QUERIES


def test_archives_of_all_pages(spark):
    pages = pd.read_parquet(f"{DATA}/pages.parquet")
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    payloads = [(int(i), (h or "").encode()) for i, h in zip(pages["page_id"], pages["html"], strict=True)]
    groups = defaultdict(list)
    for i, b in payloads:
        groups[b].append(i)
    want = sorted((i, len(b), digest(b), "response" if i == max(groups[b]) else "revisit", None if i == max(groups[b]) else max(groups[b])) for i, b in payloads)
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in QUERIES["op9_warc"](spark, DATA).collect())
    assert got == want


def test_shards_of_all_documents(spark):
    """Sizes, checksums and the law, from the texts themselves."""
    import zlib

    docs = pd.read_parquet(f"{DATA}/documents.parquet")
    want = {int(i): (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in zip(docs["doc_id"], docs["text"], strict=True)}
    rows = QUERIES["op10_sharding"](spark, DATA).toPandas()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows[["doc_id", "size", "text_crc32"]].itertuples(index=False)} == want
    for _, part in rows.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert set(rows["shard"]) == set(range(24)) and set(rows["law"]) == {"bytes"}


def test_archives_are_the_same_when_ranges_are_many(spark, tmp_path, monkeypatch):
    """Beyond what may be broadcast, ranges are looked up by places and records get their shard in one join."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet").unionByName(spark.createDataFrame([(None, "u", "<p>no id</p>"), (None, None, None)], "page_id long, url string, html string"))
    rows = {}
    for most in (common.BROADCAST_ROWS, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
        folder = f"file://{tmp_path}/warc-{most}"
        manifest = sorted(tuple(r) for r in warc.write_warc(pages, folder, n_shards=5, roll_bytes=100_000).collect())
        rows[most] = manifest, sorted((str(tuple(r)) for r in warc.read_warc(spark, folder).collect()))
    assert rows[0][1] == rows[500_000][1] and len(rows[0][1]) == pages.count()
    assert [m[:3] for m in rows[0][0]] == [m[:3] for m in rows[500_000][0]]
