"""A corpus from raw documents to packed training sequences, stage by stage.

Each stage works on all rows that the one before it kept. All but the last return the
columns of ``documents``.
"""

from pyspark.sql import DataFrame, SparkSession

from agestrata.llm import langid, mixing, packing, secrets, simhash
from agestrata.llm.queries import LEAST_SCORE, TOKENIZER, language_model, table
from agestrata.llm.store import new_folder


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, with it in ``lang``. Those without letters go,
    and those whose best language scores less than ``LEAST_SCORE``."""
    return langid.accepted(docs, language_model(docs), LEAST_SCORE)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id."""
    return simhash.one_of_each(docs, shingle=3, distance=2)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found in ``text`` replaced by a mark."""
    return secrets.redact_secrets(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a mix of the sources takes, each as often as it does."""
    return mixing.mixed_rows(docs, weights=(1, 2, 3), most=3)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return packing.pack(docs, TOKENIZER, most=2048, end_id=0)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Fingerprints, kernels and byte-pair ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        folder = new_folder(spark, f"pipeline-{name}")
        out.write.parquet(folder)
        docs = spark.read.schema(out.schema).parquet(folder)
    return docs
