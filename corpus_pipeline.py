"""A training corpus from ``documents``: language, near copies, private data, mixture, packing.

``STAGES`` are written and read again one by one; each works on all that the stage
before it kept, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language, mixing, packing, pii, simhash
from tessera.llm.queries import MIX_EXPONENT, MIX_SEED, PII_KEY, tokenizer_path

#: Documents go whose words are known worse than the language's by more standard errors.
LEAST_FIT = -12.0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose words are those of a language: others, and documents without letters, go."""
    model = language.train(docs)
    scored = docs.withColumn("__language", language.language(spark, model, F.col("text")))
    return scored.where((F.col("__language.lang_pred") != language.UNKNOWN) & (F.col("__language.fit") >= LEAST_FIT)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of copies: five-word shingles, similarity of 0.8 or more."""
    return simhash.without_copies(docs, similarity=0.8, shingle=5)


def replace_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces private values by pseudonyms and counts the characters anew."""
    found = pii.pseudonymise(docs, key=PII_KEY).select(*docs.columns)
    return found.withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents until the sources weigh as the square roots of their sizes."""
    return mixing.mix(docs, exponent=MIX_EXPONENT, seed=MIX_SEED).select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into windows of 4096."""
    return packing.pack(docs, tokenizer_path)


STAGES = [
    ("language", identify_language),
    ("near copies", drop_near_copies),
    ("private data", replace_private_data),
    ("mixture", mix_sources),
    ("packing", pack_windows),
]

#: SQL has no XXH64, keyed permutation or tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each from what the one before wrote to the shared folder."""
    from uuid import uuid4

    from tessera.llm.common import read, use_checkpoint_dir

    use_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid4()}"
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name.replace(' ', '_')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
