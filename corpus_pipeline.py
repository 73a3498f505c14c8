"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, mixing to target weights, best-fit packing.

Every stage takes what its predecessor kept, whole, and all but the last return the columns of documents. Between stages the
rows are written to the folder that driver and executors share, so a lost executor never costs more than its own stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kerbline.llm import langid, line_dedup, mixing, near, packing
from kerbline.llm.common import cut, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or without a language of probability 1/2 or more go."""
    return langid.keep_known(docs, least=0.5)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Aligned blocks go from the later document; a document goes if nothing is left of it."""
    return line_dedup.keep_rest(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more over five-word shingles the one of smallest id stays."""
    return near.keep_one(docs, shingle=5, least=0.8, radius=3)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of unwanted domains are thinned down to the target weights; mainly clean ones stay, however scarce the others are."""
    return mixing.keep_mixed(docs, mixing.label_domains(table(spark, sf_dir, "labels")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and place."""
    return packing.pack(docs, capacity=2048)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mixing", mix_to_targets),
    ("best_fit_packing", pack),
]

#: Tokenising, alignment and fitting are beyond SQL; tests/llm holds the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, name)
    return docs
