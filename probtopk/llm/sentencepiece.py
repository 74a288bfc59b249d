"""SentencePiece encoding and decoding with the tokenizers library.

The model file, a protocol buffer, is parsed here; from its pieces, scores and
normaliser settings an equal pipeline of the tokenizers library is built:
normaliser, metaspace marker, the unigram model with its scores or the byte-pair
model with merges ordered by score, byte fallback, and the decoder. Whole texts are encoded and decoded in batches by the
library's threads. Where a normaliser does no more than mark spaces, the marker is put and taken by str, as the library's
replacements keep an alignment for every byte. Parity with the reference runtime and the round trip are checked on all rows.

The runtime and the file are both public; the file's path is a parameter.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from . import common

MODEL = os.environ.get("PROBTOPK_TOKENIZERS", "/opt/tokenizers") + "/piece_bpe_32k.model"
MARK = "▁"
#: Code points that are encoded together, and rows of an Arrow batch.
BATCH_CHARS, BATCH_ROWS = 250_000, 500
BATCH_BYTES = 2 << 20
#: Texts of at most so many code points go through a byte-pair model as one sequence. Longer ones are split at words where pieces
#: allow it: splitting costs more than the merges of a short text, but these take n log n steps.
SEQUENCE_CHARS = 100_000
#: Threads of the library in a Python worker. Spark has a worker on every core; give more where tasks have several cores.
THREADS = 1

# Fixed values of the model's protocol buffer: field numbers and piece types.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, TYPE = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MODEL_TYPE, SUFFIX_MARK, BYTE_FALLBACK, UNK_ID = 3, 24, 35, 40
CHARSMAP, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE = 2, 3, 4, 5
UNIGRAM, BPE = 1, 2


def wire(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of one protocol-buffer message: int, 4 or 8 raw bytes, or bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind} is not used by models")
        yield tag >> 3, value


def parse_model(data: bytes) -> dict:
    """pieces [(piece, score, type)], model_type, byte_fallback, unk_id and the normaliser's settings."""
    pieces, trainer, normalizer = [], {}, {}
    for field, value in wire(data):
        if field == PIECES:
            p = dict(wire(value))
            score = struct.unpack("<f", p[SCORE])[0] if SCORE in p else 0.0
            pieces.append((p.get(PIECE, b"").decode(), score, p.get(TYPE, NORMAL)))
        elif field == TRAINER:
            trainer = dict(wire(value))
        elif field == NORMALIZER:
            normalizer = dict(wire(value))
    unknown = [i for i, p in enumerate(pieces) if p[2] == UNKNOWN]
    return {
        "pieces": pieces,
        "model_type": trainer.get(MODEL_TYPE, UNIGRAM),
        "byte_fallback": bool(trainer.get(BYTE_FALLBACK, 0)),
        "suffix_mark": bool(trainer.get(SUFFIX_MARK, 0)),
        "unk_id": unknown[0] if unknown else 0,
        "charsmap": normalizer.get(CHARSMAP, b""),
        "dummy_prefix": bool(normalizer.get(DUMMY_PREFIX, 1)),
        "extra_spaces": bool(normalizer.get(EXTRA_SPACES, 1)),
        "escape": bool(normalizer.get(ESCAPE, 1)),
    }


def words_apart(parsed: dict) -> bool:
    """Whether no piece goes over the start of a word, so that the library may split texts there and keep the ids of words."""
    return parsed["escape"] and not any(MARK in p.lstrip(MARK) for p, _, kind in parsed["pieces"] if kind == NORMAL)


def build(parsed: dict):
    """A tokenizers.Tokenizer that encodes as the model does.

    Models of words or characters, with user-defined pieces, or with the marker behind words are refused.
    """
    pieces = parsed["pieces"]
    if parsed["model_type"] not in (UNIGRAM, BPE) or parsed["suffix_mark"] or any(p[2] == USER_DEFINED for p in pieces):
        raise ValueError("only unigram and byte-pair models without user-defined pieces are supported")
    steps = [normalizers.Precompiled(parsed["charsmap"])] if parsed["charsmap"] else []
    if parsed["extra_spaces"]:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if parsed["dummy_prefix"]:
        steps.append(normalizers.Prepend(MARK if parsed["escape"] else " "))
    if parsed["escape"]:
        steps.append(normalizers.Replace(" ", MARK))
    if parsed["model_type"] == UNIGRAM:
        vocab = [(p, s) for p, s, _ in pieces]
        tokenizer = Tokenizer(models.Unigram(vocab, parsed["unk_id"], parsed["byte_fallback"]))
    else:
        ids = {p: i for i, (p, _, kind) in enumerate(pieces)}
        # A merge makes its joined piece; the piece with the higher score is made first.
        plain = {p for p, _, kind in pieces if kind in (NORMAL, UNUSED)}
        merges = []
        for piece, score, kind in pieces:
            if kind in (NORMAL, UNUSED):
                splits = ((piece[:i], piece[i:]) for i in range(1, len(piece)))
                merges += [(-score, ids[piece], a, b) for a, b in splits if a in plain and b in plain]
        merges.sort(key=lambda m: m[:2])
        model = models.BPE(ids, [(a, b) for _, _, a, b in merges], unk_token=pieces[parsed["unk_id"]][0], fuse_unk=True, byte_fallback=parsed["byte_fallback"])
        tokenizer = Tokenizer(model)
    tokenizer.normalizer = normalizers.Sequence(steps)
    if words_apart(parsed):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+"), "merged_with_next")
    strip = [decoders.Strip(" ", 1, 0)] if parsed["dummy_prefix"] else []
    tokenizer.decoder = decoders.Sequence([decoders.ByteFallback(), decoders.Fuse(), decoders.Replace(MARK, " "), *strip])
    return tokenizer


@lru_cache(1)
def _built(data: bytes):
    return build(parse_model(data))


def read_model(spark: SparkSession, path: str) -> bytes:
    """The model file through Spark's reader, so that it may lie in any store; a few MB at most."""
    uri = path if "://" in path else f"file://{os.path.abspath(path)}"
    return bytes(spark.read.format("binaryFile").load(uri).select("content").first()[0])


def _set_threads() -> None:
    """The library reads these when a worker first encodes or decodes, so both have to set them."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))


def _batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Slices of at most BATCH_CHARS code points, or of one text."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > BATCH_CHARS:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def marks_only(parsed: dict) -> bool:
    """Whether normalising a text is no more than marking its spaces and its start."""
    return parsed["escape"] and not parsed["charsmap"] and not parsed["extra_spaces"]


@lru_cache(1)
def _encoder(data: bytes):
    """Encodes a batch of whole texts by the library's threads."""
    tokenizer, parsed = _built(data), parse_model(data)

    def ids(by, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in by.encode_batch_fast(texts, add_special_tokens=False)]

    if parsed["model_type"] != BPE or not marks_only(parsed):
        return lambda texts: ids(tokenizer, texts)
    sequences, prefix = Tokenizer(tokenizer.model), MARK if parsed["dummy_prefix"] else ""

    def run(texts: list[str]) -> list[list[int]]:
        short = iter(ids(sequences, [t and prefix + t.replace(" ", MARK) for t in texts if len(t) <= SEQUENCE_CHARS]))
        long = iter(ids(tokenizer, [t for t in texts if len(t) > SEQUENCE_CHARS]))
        return [next(short if len(t) <= SEQUENCE_CHARS else long) for t in texts]

    return run


def encoded(data: bytes, texts: list[str]) -> list[list[int]]:
    encode, out = _encoder(data), []
    for a, b in _batches(texts):
        out += encode(texts[a:b])
    return out


@lru_cache(1)
def _decoder(data: bytes):
    """Decodes a batch by the library's threads: pieces, bytes and their joining by the library, the marker by str."""
    joined = Tokenizer(_built(data).model)
    joined.decoder = decoders.Sequence([decoders.ByteFallback(), decoders.Fuse()])
    prefix = " " if parse_model(data)["dummy_prefix"] else ""
    return lambda ids: [t.replace(MARK, " ").removeprefix(prefix) for t in joined.decode_batch(ids, skip_special_tokens=False)]


def decoded(data: bytes, ids: list[list[int]]) -> list[str]:
    return _decoder(data)(ids)


@lru_cache(1)
def _runtime(data: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=data)


def parity(data: bytes, texts: list[str], ids: list[np.ndarray]) -> list[bool]:
    """Whether the reference runtime gives each whole text the same ids."""
    runtime = _runtime(data)
    return [np.array_equal(runtime.encode(t, return_type="numpy"), i) for t, i in zip(texts, ids, strict=True)]


ENCODED = "id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string, round_trip boolean, parity boolean"


def _coded(data: bytes, row_ids: pd.Series, texts: list[str], keep_ids: bool) -> pd.DataFrame:
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lists = _encoder(data)(texts)
    ids = [np.asarray(i, "<i4") for i in lists]
    back, same = decoded(data, lists), parity(data, texts, ids)
    return pd.DataFrame(
        {
            "id": row_ids.astype("Int64").to_numpy(),
            "n_tokens": [len(i) for i in ids],
            "ids": ids if keep_ids else None,
            "ids_sha256": [sha(i.tobytes()) for i in ids],
            "decoded_sha256": [sha(b.encode()) for b in back],
            # The marker itself reads as a space.
            "round_trip": [b == t.replace(MARK, " ") for b, t in zip(back, texts, strict=True)],
            "parity": same,
        }
    )


def _coder(held, keep_ids: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _set_threads()
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            for a, b in _batches(texts):
                yield _coded(held.value, pdf["id"].iloc[a:b], texts[a:b], keep_ids)

    return run


def encode(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per row: id, n_tokens, ids, digests of the ids (as little-endian int32) and of the decoded text, round_trip, parity.

    round_trip says that decoding gives the text again (it does for models
    whose normaliser keeps texts as they are); parity that the reference runtime
    gives the same ids, which is checked and told on every row, those without an id too. Null and empty texts have no tokens, very long ones are encoded whole. Repeated rows each get a
    row, an empty table gives none; other columns are ignored.
    """
    spark = docs.sparkSession
    common.bound_batches(spark, BATCH_ROWS, BATCH_BYTES)
    held = spark.sparkContext.broadcast(read_model(spark, model))  # the model file, a few MB
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInPandas(_coder(held, keep_ids), ENCODED).withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, model: str = MODEL, ids_col: str = "ids") -> DataFrame:
    """`tokens` with a column decoded; null ids decode to null."""
    spark = tokens.sparkSession
    held = spark.sparkContext.broadcast(read_model(spark, model))

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        _set_threads()
        texts = iter(decoded(held.value, [list(map(int, i)) for i in ids if i is not None]))
        return pd.Series([None if i is None else next(texts) for i in ids], dtype="object")

    return tokens.withColumn("decoded", run(ids_col))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of all documents; null and empty texts have none of either, repeated rows are coded each."""
    return encode(common.documents(spark, sf_dir), keep_ids=False).drop("ids")
