"""A corpus in four stages: toxic documents go, one of each group of near copies stays, sources
are mixed to their target weights, and the result is packed into training sequences.

Each stage reads what its predecessor wrote. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lapwing.llm import mixing, packing, simhash, toxicity
from lapwing.llm.common import shared_dir, table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the severity model, fitted on their labelled rows, finds toxic; all others stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    verdict = ("__severity", "__grade", "__toxic")  # the documents may have columns called severity, grade or toxic
    return toxicity.score(docs, model, columns=verdict).where("not __toxic").select(*docs.columns)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by SimHash fingerprints at most 3 bits apart, or at a Jaccard similarity of 0.8 or more, on shingles of five words."""
    return simhash.drop_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and cuts sources to their target weights: a row for each use of a document, in the schedule's order."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenizes and packs whole documents; one row per piece."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [("toxicity", remove_toxic), ("simhash near-dedup", remove_near_copies), ("mixing to target weights", mix_sources), ("best-fit packing", pack_sequences)]

#: Fitted models, fingerprints and tokenization have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written to the shared folder and read again."""
    docs, at = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = f"{at}/{k}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
