import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from sqlcheck import DATA, duck, same  # noqa: E402

import corpus_pipeline  # noqa: E402
from probtopk.llm import common, jaccard, linededup  # noqa: E402
from probtopk.llm.queries import ORACLES, QUERIES  # noqa: E402

#: The columns that the queries' results have at least.
COLUMNS = {
    "op1_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op2_line_dedup": "doc_id n_lines n_dropped kept_sha256",
    "op3_sentencepiece": "doc_id n_tokens ids_sha256 decoded_sha256 round_trip parity",
    "op4_toxicity": "doc_id held_out score predicted",
    "op5_ngram_jaccard": "doc_id n_shingles component_id",
    "op6_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op7_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op8_mixing": "doc_id size source_size target taken",
    "op9_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op10_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op12_spelling_variants": "word n n_near form form_n root",
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    got = QUERIES[name](spark, DATA).toPandas()
    want = duck(ORACLES[name])
    if name == "op8_mixing":
        got, want = got.round({"target": 6}), want.round({"target": 6})
    same(got, want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_a_row_per_row_and_its_columns(spark, name):
    got = QUERIES[name](spark, DATA)
    assert set(COLUMNS[name].split()) <= set(got.columns)
    if name == "op12_spelling_variants":  # a row per word; its rows are held against plain Python elsewhere
        return
    source = "pages" if name == "op9_warc" else "documents"
    assert got.count() == spark.read.parquet(f"{DATA}/{source}.parquet").count()


def test_held_out_toxicity_is_found(spark):
    rows = QUERIES["op4_toxicity"](spark, DATA.replace("sf0.001", "sf0.01")).where("held_out")
    labels = spark.read.parquet(DATA.replace("sf0.001", "sf0.01") + "/labels.parquet")
    marked = rows.join(labels, "doc_id").toPandas()
    assert (marked["predicted"] == marked["toxic"]).mean() > 0.85


def test_pipeline_stages_hand_on_documents(spark):
    docs = common.documents(spark, DATA)
    columns, kept = docs.columns, {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, DATA), name)
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and ids <= kept
        kept = ids
        if name == "ngram_jaccard":
            assert jaccard.similarity_classes(docs).where("doc_id != component_id").count() == 0
        if name == "mixing":
            assert docs.count() > len(ids)  # some documents are taken twice
    out = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert out.where("NOT round_trip OR NOT parity").count() == 0 and out.count() == docs.count()
    assert corpus_pipeline.run(spark, DATA).count() == out.count()


def test_lines_that_went_are_gone_everywhere(spark):
    docs = common.documents(spark, DATA)
    once = common.materialize(linededup.dedup_lines(docs), "once")
    assert linededup.repeated_keys(once, "doc_id", "text").count() == 0


EDGES = [
    (None, "no id here", None, "a", 10), (None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", "b", 0), (3, " \t\n", "en", "a", 3), (4, "w " * 30_000, "en", "a", 60_000),
    (5, "one two three four five six seven", "en", "a", 33), (5, "one two three four five six seven", "en", "a", 33), (6, "one two three four five six seven", "en", "b", 33),
]


def test_pipeline_on_edge_rows_and_on_an_empty_table(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = spark.createDataFrame(EDGES, schema)
    for docs in (rows, rows.limit(0)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.materialize(stage(spark, docs, DATA), name)
            assert docs.columns == rows.columns
            if name in ("toxicity", "line_dedup"):
                assert docs.count() == n  # nothing toxic, and no document goes with its lines
            if name == "ngram_jaccard" and n:
                assert sorted(str(r["doc_id"]) for r in docs.collect()) == sorted(map(str, [None, None, 1, 2, 3, 4, 5, 5]))
        out = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
        assert out.count() == docs.count() and (n or not out.count())
