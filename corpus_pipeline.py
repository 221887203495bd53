"""A training corpus from ``documents``: filter, deduplicate, mix and encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import bpe, linededup, mix, quality, shingles, simhash
from cellweave.llm.common import documents, staged

#: The stages learn a classifier and hash lines, shingles and tokens: no SQL expresses them.  They
#: are tested against brute force in tests/llm.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores 0.7 or more; its labels are those of ``labels``."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated line chunks; ``n_chars`` follows the text."""
    out = linededup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by id, of each component of texts whose five-word shingles are 0.8 alike or more;
    SimHash by multi-index hashing and least shingles propose, whole sets decide."""
    return simhash.one_of_each(docs, classes=shingles.similar_classes(docs))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mix.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each document of the mix."""
    return bpe.encoded_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("lines", drop_repeated_lines),
    ("near duplicates", one_of_near_duplicates),
    ("mix", mix_to_targets),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else staged(docs, "corpus"), sf_dir)
    return docs
