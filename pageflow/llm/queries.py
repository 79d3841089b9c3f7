"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from pageflow.llm import chat_format, fim, merkle, minhash, packing, phrase_index, pii, quality_model, quality_rules, sharding, suffixes, url_filter, warc

QUERIES = {
    "op1_pii": pii.query,
    "op2_best_fit_packing": packing.query,
    "op3_minhash_near_dedup": minhash.query,
    "op4_chat_format": chat_format.query,
    "op5_warc": warc.query,
    "op6_quality_classifier": quality_model.query,
    "op7_sharding": sharding.query,
    "op8_benchmark_decontamination": phrase_index.query,
    "op9_quality_rules": quality_rules.query,
    "op10_suffix_dedup": suffixes.query,
    "op11_url_filter": url_filter.query,
    "op12_merkle_manifest": merkle.query,
    "op13_fill_in_middle": fim.query,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {
    "op3_minhash_near_dedup": minhash.SQL,
    "op4_chat_format": chat_format.SQL,
    "op5_warc": warc.SQL,
    "op8_benchmark_decontamination": phrase_index.SQL,
    "op11_url_filter": url_filter.SQL,
    "op12_merkle_manifest": merkle.SQL,
    "op13_fill_in_middle": fim.SQL,
}
