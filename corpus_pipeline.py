"""From raw documents to packed training sequences: five stages, each a written table.

Each function takes (spark, docs, sf_dir). All but the last return the columns of
``docs``: quality rules, near-dedup and decontamination drop rows, pseudonyms change
``text`` (and ``n_chars`` with it). The last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hearken.llm import decontaminate, minhash, packing, pii, quality_mcd
from hearken.llm.common import stored_alone, table
from hearken.llm.settings import BYTE_BPE, PSEUDONYM_KEY


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_mcd.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.replace_in(docs, PSEUDONYM_KEY)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, BYTE_BPE, 2048)


STAGES = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("pii_pseudonyms", pseudonyms),
    ("best_fit_packing", sequences),
]
#: Tokenisation has no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's table is deleted once the next one's is written, so one copy of the corpus is held at a time."""
    docs, folder = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, folder = stored_alone(spark, lambda: stage(spark, docs, sf_dir), folder)
    return STAGES[-1][1](spark, docs, sf_dir)
