"""Rows that share ids or lines, and columns whose names clash with those of the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from sqlcheck import DATA

import corpus_pipeline
from probtopk.llm import common, jaccard, linededup, mixing, sharding

CLASHES = ["__id", "__th", "__gone", "__row", "__n", "__take", "th", "id", "uid", "shard", "size", "key", "digest", "node", "n_shingles", "component_id", "lines", "__lines", "__kept", "score", "keys", "copy"]


def test_stages_hand_on_columns_of_any_name(spark):
    rows = [(i, f"word{i} " * 12 + "\nshared line here" if i % 3 else "the same words in all of these texts", "en", "a", 5) for i in range(30)] + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select(*docs.columns, *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id"), F.lit(-1))).alias(c) for c in CLASHES])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, DATA), name)
        assert docs.columns[-len(CLASHES) :] == CLASHES and docs.count()
        for r in docs.collect():
            assert all(r[c] == f"{c}:{-1 if r['doc_id'] is None else r['doc_id']}" for c in CLASHES)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == docs.count()


@pytest.mark.parametrize("ids", ["7L", "CAST(NULL AS BIGINT)"])
def test_shards_of_one_id_are_near_in_bytes(spark, ids):
    docs = spark.range(24_000).selectExpr(f"{ids} AS doc_id", "concat('text ', id) AS text")
    placed = sharding.shard(docs, 24)
    sums = {r["shard"]: (r["n"], r["size"]) for r in placed.groupBy("shard").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()}
    sizes = np.array([s for _, s in sums.values()])
    assert len(sums) == 24 and sizes.max() < 1.05 * sizes.mean() and sizes.min() > 0.95 * sizes.mean()
    assert placed.groupBy("shard").agg((F.max("slot") + 1 == F.count(F.lit(1))).alias("gapless")).where("NOT gapless").count() == 0


def test_only_shared_ids_go_by_their_text(spark):
    """Ids of one row keep their slot when the text is edited; the rows of one id, or of none, spread."""
    rows = spark.range(600).selectExpr("CASE WHEN id < 200 THEN 7 WHEN id < 400 THEN NULL ELSE id END AS doc_id", "concat('text ', id) AS text")
    slots = [sharding.with_slot(d, "doc_id", "text").toPandas() for d in (rows, rows.selectExpr("doc_id", "concat(text, '!') AS text"))]
    own = [s[s["doc_id"] >= 400].set_index("doc_id")["virtual_slot"].to_dict() for s in slots]
    assert len(slots[0]) == 600 and len(own[0]) == 200 and own[0] == own[1]
    assert all(s[mine(s)]["virtual_slot"].nunique() > 180 for s in slots for mine in (lambda s: s["doc_id"] == 7, lambda s: s["doc_id"].isna()))


def test_rows_without_id_draw_each_for_themselves(spark):
    docs = spark.range(4_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "concat('some words ', id) AS text", "IF(id % 4 = 0, 'a', 'b') AS source")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    weighted = mixing.with_weights(docs, labels)
    buckets = weighted.select(F.floor((1.0 - F.exp(-mixing.es_key("doc_id", "weight", no_id=F.col("no_id")))) * mixing.N_BUCKETS)).distinct().count()
    assert buckets > 1_000
    first = sorted(map(tuple, mixing.mixed_copies(docs, labels).collect()), key=str)
    assert first == sorted(map(tuple, mixing.mixed_copies(docs.orderBy(F.rand(3)), labels).collect()), key=str)


def test_every_drop_is_answered_by_the_index(spark, monkeypatch):
    """Whatever number of probes: the index has all repeated keys, probes of a common line are dealt to several copies of its shard."""
    monkeypatch.setattr(linededup, "LEAST_PROBES", 100)
    docs = spark.range(3_000).selectExpr("id AS doc_id", "concat('common line\nline ', id, '\npair ', id div 2, '\nten ', id div 10) AS text")
    seen = []
    prober = linededup._prober

    def noted(min_docs):
        seen.append(min_docs)
        return prober(min_docs)

    monkeypatch.setattr(linededup, "_prober", noted)
    drops = linededup.repeated_keys(docs, "doc_id", "text")
    plan = drops._jdf.queryExecution().executedPlan().toString()
    assert seen == [10] and "FlatMapCoGroupsInPandas" in plan and "Union" not in plan
    rows = {r["id"]: len(r["drop"]) for r in drops.collect()}
    assert rows == dict.fromkeys(range(3_000), 2)  # the common line and the one that ten share


def test_long_lists_are_led_at_every_size(spark, monkeypatch):
    """Every long list with several components has a leader first, however few pairs are open, and the answers are those of plain sets."""
    texts = ["in all of them " + " ".join(f"w{i}x{j}" for j in range(40)) for i in range(60)] + ["in all of them " + " ".join(f"c{j}" for j in range(40)) + f" t{i}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rounds, lead = [], jaccard._lead

    def counted(*args):
        rounds.append(lead(*args))
        return rounds[-1]

    monkeypatch.setattr(jaccard, "_lead", counted)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similarity_classes(docs).collect()}
    assert len(rounds) >= 1
    assert got == {i: i if i < 60 else 60 for i in range(100)}


@pytest.mark.parametrize("ids", ["7L", "CAST(NULL AS BIGINT)"])
def test_rows_of_one_id_are_spread_over_buckets(spark, ids):
    docs = spark.range(3_000).selectExpr(f"{ids} AS doc_id", "IF(id % 2 = 0, '', concat_ws(' ', 'a', id, 'b', id, 'c', id, 'd')) AS text")
    held = spark.sparkContext.broadcast((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    entries = jaccard.word_hashes(docs, "doc_id", "text").mapInPandas(jaccard._entries(held, 30), jaccard.ENTRY)
    sizes = [r["count"] for r in entries.where("bucket >= 60").groupBy("bucket").count().collect()]
    assert len(sizes) == 30 and max(sizes) < 1.2 * np.median(sizes)
