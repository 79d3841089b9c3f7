"""The corpus pipeline: quality rules, near duplicates, decontamination, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; its result is
written as Parquet and read again. All stages but the last return the columns of ``documents``; the last
returns the packed pieces.

1. quality rules: documents that fail the base rules or their compression bands go.
2. MinHash near-dedup: of each group of near duplicates (shingles of five words, similarity of 0.8 or more) the
   document of least doc_id stays.
3. benchmark decontamination: documents of which a twentieth or more lies in benchmark windows go.
4. personal data: spans become their kind in brackets, n_chars follows.
5. best-fit packing: token pieces in sequences of 1024.

Null and empty texts fail the first stage. Rows that repeat a doc_id are one document from the second on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pageflow.llm import minhash, packing, phrase_index, pii, quality_rules
from pageflow.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules.stage),
    ("minhash_near_dedup", minhash.stage),
    ("benchmark_decontamination", phrase_index.stage),
    ("pii", pii.stage),
    ("best_fit_packing", packing.stage),
]

#: Compression ratios, boosted trees and tokens have no SQL form; the tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
