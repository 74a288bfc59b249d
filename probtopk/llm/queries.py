"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import exactdedup, filteraudit, jaccard, linededup, mixing, quality, secrets, sentencepiece, sharding, spelling, syncmers, toxicity, warc

QUERIES = {
    "op1_fingerprints": syncmers.op1_fingerprints,
    "op2_line_dedup": linededup.op2_line_dedup,
    "op3_sentencepiece": sentencepiece.op3_sentencepiece,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_ngram_jaccard": jaccard.op5_ngram_jaccard,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_secrets": secrets.op7_secrets,
    "op8_mixing": mixing.op8_mixing,
    "op9_warc": warc.op9_warc,
    "op10_sharding": sharding.op10_sharding,
    "op11_filter_audit": filteraudit.op11_filter_audit,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_exact_dedup": exactdedup.op13_exact_dedup,
}

ORACLES = {
    "op2_line_dedup": linededup.ORACLE_SQL,
    "op5_ngram_jaccard": jaccard.ORACLE_SQL,
    "op8_mixing": mixing.ORACLE_SQL,
    "op11_filter_audit": filteraudit.ORACLE_SQL,
    "op13_exact_dedup": exactdedup.ORACLE_SQL,
}
