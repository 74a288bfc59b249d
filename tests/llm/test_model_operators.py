import base64
import hashlib
import math
import os
import random
import struct
import zlib

import pandas as pd
import pytest
import sentencepiece as sp
from pyspark.sql import functions as F

from probtopk.llm import common, sentencepiece, toxicity, warc

DOCS = "doc_id long, text string, score double, sentences string"


# Toxicity.
BAD = ["zorg", "blarg", "fnord"]


def clean_words(r, n):
    return [f"{r.choice('bcdfgk')}{r.choice('aeiou')}{r.choice('lmnrst')}{r.randrange(50)}" for _ in range(n)]


def labelled(n, seed):
    r, rows = random.Random(seed), []
    for i in range(n):
        sents = [clean_words(r, r.randrange(4, 10)) for _ in range(r.randrange(1, 6))]
        toxic = i % 4 == 0
        if toxic:
            s = r.choice(sents)
            s[r.randrange(len(s))] = r.choice(BAD)
        rows.append((i, ". ".join(map(" ".join, sents)) + ".", int(toxic)))
    return rows


@pytest.fixture(scope="module")
def tox(spark):
    rows = labelled(800, 1)
    docs = spark.createDataFrame([(i, t, None, "x") for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    return rows, docs, labels, toxicity.fit(docs, labels)


def test_toxicity_on_held_out_rows(tox):
    rows, docs, _, model = tox
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [(got[i]["score"], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 100
    assert sum((s >= 0.5) == bool(y) for s, y in held) / len(held) >= 0.97


def test_offending_sentences_are_located(tox):
    rows, docs, _, model = tox
    text = {i: t for i, t, _ in rows}
    spans = [(text[r["doc_id"]], s) for r in toxicity.score(docs, model).collect() for s in r["sentences"]]
    assert spans and sum(any(b in t[s["start"] : s["end"]] for b in BAD) for t, s in spans) / len(spans) > 0.95


def plain_score(model, text):
    """Noisy-or by its definition, sentence by sentence, without the leak's own share."""
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    clean, sentence = 1.0, []
    for c in (text or "") + ".":
        if c not in ".!?\n":
            sentence.append(c)
            continue
        weight = 0.0
        for w in set("".join(sentence).split()):
            bare = w.lower().strip("'\"()[]{},;:-|*#%$&<>_=")
            weight += sum(model.get(f, 0.0) for f in [bare, *(f"^{bare[:n]}" for n in (3, 4, 5, 6) if len(bare) >= n)]) if bare else 0.0
        clean *= (1 - sigmoid(-12 + weight)) / (1 - sigmoid(-12)) if weight > 0 else 1.0
        sentence = []
    return 1 - clean


def test_scores_equal_a_plain_noisy_or(spark, tox):
    rows, docs, _, model = tox
    texts = {i: t for i, t, _ in rows} | {-1: "zorg! blarg? fnord\nzorg", -2: "", -3: "...", -4: "Zorg, (ZORG) 'zorg' zorgon."}
    got = toxicity.score(spark.createDataFrame([(i, t, None, "x") for i, t in texts.items()], DOCS), model).collect()
    assert len(got) == len(texts) and all(r["score"] == pytest.approx(plain_score(model, texts[r["doc_id"]]), abs=1e-9) for r in got)


def test_the_limit_of_toxic_texts(spark):
    docs = spark.createDataFrame([(1, "even", None, "x"), (2, "less", None, "x")], DOCS)
    model = {"even": -toxicity.LEAK + 1e-4, "less": -toxicity.LEAK - 1e-4}  # just above and just below
    assert [r["doc_id"] for r in toxicity.keep_clean(docs, model).collect()] == [2]
    assert {r["doc_id"]: r["score"] >= 0.5 for r in toxicity.score(docs, model).collect()} == {1: True, 2: False}


def test_held_out_labels_do_not_matter(spark, tox):
    rows, docs, labels, model = tox
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(toxicity.fold("doc_id") == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, turned) == model


def test_toxicity_of_edge_cases(spark, tox):
    rows, docs, labels, model = tox
    odd = spark.createDataFrame([(None, "zorg", None, ""), (1, None, None, ""), (2, "", None, ""), (3, "... !!", None, ""), (4, "pure clean words. " * 4000, None, ""), (4, "x", None, "")], DOCS)
    got = [(r["doc_id"], r["score"]) for r in toxicity.score(odd, model).collect()]
    assert len(got) == 6 and all(0 <= s < 0.5 for i, s in got if i is not None)
    kept = toxicity.keep_clean(odd, model)
    assert kept.columns == odd.columns and kept.count() == 5
    assert toxicity.score(odd.limit(0), model).count() == 0
    assert toxicity.fit(docs, labels.limit(0)) == {}
    assert toxicity.score(odd, {}).where("score >= 0.5").count() == 0


def test_clean_texts_of_any_length_stay_clean(spark, tox):
    *_, model = tox
    texts = ["pure clean words. " * 120_000, "line\n" * 200_000, "pure clean words. " * 120_000 + "zorg."]
    docs = spark.createDataFrame([(i, t, None, "") for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert got[0] == got[1] == 0 and got[2] >= 0.5
    assert {r["doc_id"] for r in toxicity.keep_clean(docs, model).collect()} == {0, 1}


# SentencePiece.
TEXTS = ["", "Hello  world", "  lead and trail ", "tabs\tand\nlines\n\n", "漢字😀 é", "▁ mark ▁▁", "a" * 3000, " " * 40, "\x00\x01", "don't stop—now…", "éàü " * 200]


@pytest.fixture(scope="module")
def model():
    return open(sentencepiece.MODEL, "rb").read()


def test_pieces_equal_those_of_the_runtime(model):
    own, runtime = sentencepiece.parse_model(model), sp.SentencePieceProcessor(model_proto=model)
    assert [p[0] for p in own["pieces"]] == [runtime.id_to_piece(i) for i in range(runtime.vocab_size())]
    assert [p[1] for p in own["pieces"]] == [runtime.get_score(i) for i in range(runtime.vocab_size())]


def test_parity_and_round_trip(model):
    r = random.Random(0)
    texts = TEXTS + ["".join(r.choice("abc déñ  \n.,😀▁'") for _ in range(r.randrange(80))) for _ in range(300)]
    runtime = sp.SentencePieceProcessor(model_proto=model)
    ids = sentencepiece.encoded(model, texts)
    assert ids == [runtime.encode(t) for t in texts]
    back = sentencepiece.decoded(model, ids)
    assert back == sentencepiece._built(model).decode_batch(ids, skip_special_tokens=False)
    assert back == [t.replace("▁", " ") for t in texts]


def message(*fields):
    """A protocol-buffer message of (number, value): int, float or bytes."""
    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def varint(n):
    out = b""
    while n >= 128:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def unigram(byte_fallback=True, extra_spaces=0):
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(f"<0x{b:02X}>", -20.0, 6) for b in range(256)] if byte_fallback else []
    pieces += [(p, -float(i % 7) - len(p) / 8 - 1.0, 1) for i, p in enumerate(["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "▁b", "▁▁", "ca", "▁abc"])]
    body = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces)
    return body + message((2, message((3, 1), (35, int(byte_fallback)))), (3, message((3, 1), (4, extra_spaces), (5, 1))))


@pytest.mark.parametrize("byte_fallback", [True, False])
@pytest.mark.parametrize("extra_spaces", [0, 1])
def test_unigram_models(byte_fallback, extra_spaces):
    data = unigram(byte_fallback, extra_spaces)
    runtime = sp.SentencePieceProcessor(model_proto=data)
    r = random.Random(1)
    texts = ["".join(r.choice("aabbcc  ") for _ in range(r.randrange(1, 30))) for _ in range(200)] + (["é abc"] if byte_fallback else ["xabc"])
    assert sentencepiece.encoded(data, texts) == [runtime.encode(t) for t in texts]


def test_encode_edge_cases(spark, model):
    docs = spark.createDataFrame([(50 * i if i % 3 else None, t, 0.5, "x") for i, t in enumerate([*TEXTS, None])], DOCS)
    out = sentencepiece.encode(docs)
    rows = out.collect()
    assert len(rows) == len(TEXTS) + 1 and all(r["round_trip"] for r in rows)
    assert {r["parity"] for r in rows} == {True} and any(r["doc_id"] is None for r in rows)
    assert sorted(r["decoded"] for r in sentencepiece.decode(out).collect()) == sorted((t or "").replace("▁", " ") for t in [*TEXTS, None])
    assert sentencepiece.encode(docs.limit(0)).count() == 0


def test_parity_is_checked_on_every_row(spark, model, monkeypatch):
    docs = spark.createDataFrame([(i, f"text number {i}", 0.5, "x") for i in range(1, 120)], DOCS)
    assert {r["parity"] for r in sentencepiece.encode(docs).collect()} == {True}
    right = sentencepiece._encoder(model)
    monkeypatch.setattr(sentencepiece, "_encoder", lambda data: lambda texts: [[*i, 5] if "odd" in t else i for t, i in zip(texts, right(texts), strict=True)])
    got = sentencepiece._coded(model, sentencepiece.pd.Series([7, 8, None], dtype="Int64"), ["odd one", "even one", "odd"], False)
    assert got["parity"].tolist() == [False, True, False]


def bpe(byte_fallback, dummy_prefix, extra_spaces=0, across=False):
    """A byte-pair model; with `across`, one piece goes over the start of a word."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if byte_fallback else []
    joined = ["ab", "▁a", "▁ab", "ca", "abc", "▁▁", "▁abc", *(["b▁"] if across else [])]
    pieces += [(p, -float(i), 1) for i, p in enumerate([*joined, "▁", "a", "b", "c"])]
    body = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces)
    return body + message((2, message((3, 2), (35, int(byte_fallback)))), (3, message((3, dummy_prefix), (4, extra_spaces), (5, 1))))


@pytest.mark.parametrize("byte_fallback", [True, False])
@pytest.mark.parametrize("dummy_prefix", [1, 0])
@pytest.mark.parametrize("extra_spaces", [0, 1])
@pytest.mark.parametrize("across", [False, True])
def test_byte_pair_models_of_short_and_long_texts(byte_fallback, dummy_prefix, extra_spaces, across, monkeypatch):
    data = bpe(byte_fallback, dummy_prefix, extra_spaces, across)
    runtime, r = sp.SentencePieceProcessor(model_proto=data), random.Random(2)
    texts = ["", " ", "  ", *("".join(r.choice("aabbcc  x" + "▁" * (1 - extra_spaces)) for _ in range(r.randrange(1, 40))) for _ in range(300))]
    monkeypatch.setattr(sentencepiece, "SEQUENCE_CHARS", 20)
    ids = sentencepiece.encoded(data, texts)
    assert ids == [runtime.encode(t) for t in texts]
    assert sentencepiece.decoded(data, ids) == sentencepiece._built(data).decode_batch(ids, skip_special_tokens=False)


def test_short_texts_are_not_split_and_long_ones_are(model, monkeypatch):
    """Splitting cost more than the merges (check: 1,077 CPU s a GB of 900), but merges of long texts take n log n steps."""
    split, text = [], "one two  three " * 20
    by = sentencepiece._built(model)

    class Splits:
        model = by.model

        def encode_batch_fast(self, texts, **options):
            split.extend(texts)
            return by.encode_batch_fast(texts, **options)

    monkeypatch.setattr(sentencepiece, "_built", lambda data: Splits())
    monkeypatch.setattr(sentencepiece, "SEQUENCE_CHARS", len(text))
    encode = sentencepiece._encoder.__wrapped__(model)
    runtime = sp.SentencePieceProcessor(model_proto=model)
    assert encode([text, text + "é", ""]) == [runtime.encode(t) for t in [text, text + "é", ""]]
    assert split == [text + "é"]


def test_decoding_sets_the_threads_of_the_library(spark):
    """Decoding left their number to the library, one a core, and workers that had decoded crashed in the next query."""

    @F.pandas_udf("string")
    def threads(texts: pd.Series) -> pd.Series:
        return texts.map(lambda _: os.environ.get("RAYON_NUM_THREADS"))

    tokens = spark.range(40).selectExpr("id", "array(1, 2, CAST(300 + id AS INT)) AS ids")
    got = sentencepiece.decode(tokens).withColumn("threads", threads("decoded")).collect()
    assert len(got) == 40 and all(r["decoded"] for r in got) and {r["threads"] for r in got} == {str(sentencepiece.THREADS)}


# WARC.
PAGES = "page_id long, url string, html string, shard string"


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def written(spark, rows, **kw):
    folder = common.scratch(spark, "warc")
    manifest = warc.write_warc(spark.createDataFrame([(*r, "x") for r in rows], PAGES), folder, **kw)
    return folder, manifest


ROWS = [(1, "http://a/é", "same"), (2, "http://b", "same"), (9, None, "same"), (3, "u", None), (4, "u", ""), (5, "x\r\nInjected: 1", "é漢😀\r\n\r\nWARC/1.1"), (6, "u", "z" * 300_000)]


def test_warc_round_trip(spark):
    folder, _ = written(spark, ROWS)
    got = {r["page_id"]: r for r in warc.read_warc(spark, folder).collect()}
    assert len(got) == len(ROWS)
    for page_id, _, html in ROWS:
        data = (html or "").encode()
        assert got[page_id]["payload_bytes"] == len(data) and got[page_id]["payload_digest"] == digest(data)
        if got[page_id]["record_type"] == "response":
            assert bytes(got[page_id]["payload"]) == data
    kinds = {i: (r["record_type"], r["refers_to"]) for i, r in got.items()}
    assert kinds == {1: ("revisit", 9), 2: ("revisit", 9), 9: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), 6: ("response", None)}


def test_warc_files_roll_and_reruns_give_the_same_bytes(spark):
    rows = [(i, f"http://h/{i}", str(random.Random(i).getrandbits(4000))) for i in range(200)]
    made = [written(spark, rows, n_shards=3, roll_bytes=20_000)[1].orderBy("file").collect() for _ in range(2)]
    assert made[0] == made[1] and len(made[0]) > 3
    assert sum(r["n_records"] for r in made[0]) == 200
    ranges = sorted((r["first_id"], r["last_id"]) for r in made[0])
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))


def test_uncommitted_files_are_not_read(spark):
    folder, _ = written(spark, ROWS[:2], n_shards=1)
    path = folder.removeprefix("file://")
    import gzip

    with open(f"{path}/part-00099-00000.warc.gz", "wb") as f:
        f.write(gzip.compress(warc.render(77, "u", b"lost", None)))
    assert {r["page_id"] for r in warc.read_warc(spark, folder).collect()} == {1, 2}


def test_warc_of_repeated_rows_small_payloads_and_empty_tables(spark):
    folder, _ = written(spark, [(1, "a", "same"), (1, "a", "same"), (2, "b", "same")], min_bytes=5)
    assert sorted((r["page_id"], r["record_type"]) for r in warc.read_warc(spark, folder).collect()) == [(1, "response"), (1, "response"), (2, "response")]
    empty = common.scratch(spark, "warc")
    assert warc.write_warc(spark.createDataFrame([], PAGES), empty).count() == 0
    assert warc.read_warc(spark, empty).count() == 0


@pytest.mark.parametrize("n_shards", [None, 3])
def test_warc_of_repeated_ids_with_other_payloads(spark, n_shards):
    folder, manifest = written(spark, [(1, "a", "same"), (1, "b", "UNIQUE PAYLOAD"), (9, "c", "same"), (-5, "d", "same")], n_shards=n_shards)
    got = warc.read_warc(spark, folder).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"] or 0, bytes(r["payload"] or b"")) for r in got) == [
        (-5, "revisit", 9, b""), (1, "response", 0, b"UNIQUE PAYLOAD"), (1, "revisit", 9, b""), (9, "response", 0, b"same")]


@pytest.mark.parametrize("n_shards", [None, 3])
def test_warc_keeps_pages_without_id(spark, n_shards):
    folder, manifest = written(spark, [(None, "a", "same"), (None, None, None), (4, "b", "same"), (None, "c", "own"), (None, "d", "own")], n_shards=n_shards)
    got = warc.read_warc(spark, folder).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0, bytes(r["payload"] or b"")) for r in got) == [
        (0, "response", 0, b""), (0, "response", 0, b"own"), (0, "response", 0, b"own"), (0, "revisit", 4, b""), (4, "response", 0, b"same")]
    assert sum(r["n_records"] for r in manifest.collect()) == 5


def test_warc_borders_are_the_same_in_every_run(spark):
    """As many rows as Spark's own range partitioner would sample; ids in clusters, one of them with large pages."""
    from pyspark.sql import functions as F

    ids = F.col("id") * F.when(F.col("id") < 20_000, 1).otherwise(1_000_003)
    rows = spark.range(40_000).select(ids.alias("page_id"), F.concat(F.lit("u"), "id").alias("url"), F.expr("repeat(concat('p', id), cast(if(id between 500 and 900, 400, id % 7) as int))").alias("html"))
    made = []
    for df in (rows, rows.repartition(7)):
        folder = common.scratch(spark, "warc")
        made.append(warc.write_warc(df, folder, n_shards=6).orderBy("file").collect())
    assert made[0] == made[1] and sum(r["n_records"] for r in made[0]) == 40_000 and len(made[0]) == 6
    ranges = [(r["first_id"], r["last_id"]) for r in made[0]]
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    assert max(r["n_records"] for r in made[0]) < 40_000 / 2


def test_cut_off_records_are_refused():
    import gzip

    data = gzip.compress(warc.render(1, "u", b"payload" * 100, None))
    assert next(warc.parse(data))[0] == 1
    with pytest.raises(ValueError):
        list(warc.parse(data[:-12]))
