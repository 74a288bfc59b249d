"""A corpus pipeline: toxicity, line dedup, near-duplicate documents, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from probtopk.llm import common, jaccard, linededup, mixing, sentencepiece, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that score 0.5 or more.

    Null and empty texts stay, as do null ids and repeated rows with clean texts; very long texts are
    read whole; an empty table, or labels of one kind only, drops nothing.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that many documents share out of every text.

    No document goes: one that loses all lines has an empty text, a null text stays null. Repeated rows and null ids count as
    documents of their own; very long texts are split whole; an empty table stays empty.
    """
    return linededup.dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by n-gram similarity, the one with the least id.

    Documents without words and without an id all stay; rows that repeat an id stay or go together; very long
    texts are compared whole; an empty table stays empty.
    """
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that sources have their target weights.

    Documents without words stay once; null sources are one source, null ids and repeated rows are documents of their
    own; a very long text may be taken in part; an empty table stays empty.
    """
    return mixing.mixed_copies(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every text, with digests of what they decode to.

    Null and empty texts have no tokens, very long ones are encoded whole; every row, repeated or without id, gets a row.
    """
    return sentencepiece.encode(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again. What a stage has written for itself is deleted after it."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = common.scratch(spark, f"stage-{name}")
        with common.temporary(spark):
            docs = common.written(stage(spark, docs, sf_dir), path)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained scores and tokens can't be expressed in SQL; the stages are tested by themselves.
ORACLE_SQL = None
