"""The corpus pipeline: quality rules, n-gram Jaccard join, secret scans, mixing sources to target weights, subword sampling.

Each stage works on all rows that its predecessor kept. The first four return the columns of `documents`: rejected documents go, and
lines that too many of a host's documents have; one document of each class of linked ones (five words, similarity 0.8) stays, secrets are
replaced in the text, and the mixture repeats or leaves out documents. The last returns the sampled segmentations, a row a document (of the mixture) and sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheafmill.llm import common, op3_secrets, op5_jaccard, op7_quality, op8_mixture, op10_subwords


#: Near copies are those that near-duplicate stages take where no contract says otherwise: five words, 0.8 or more.
NEAR = op5_jaccard.Near(5, 80, 100)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7_quality.filtered(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op5_jaccard.one_each(docs, NEAR)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op3_secrets.redacted(docs, op3_secrets.trained(op3_secrets.seed_findings(spark), op3_secrets.dictionary(docs)))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op8_mixture.mixed(docs)


def subwords(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return op10_subwords.sampled(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("jaccard_join", distinct), ("secrets", secrets), ("mixture", mixture), ("subwords", subwords)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's result is written and read again as the next one's input, and what the stage wrote on its
    way, and its input, are deleted."""
    docs, begun = common.load(spark, sf_dir, "documents"), len(common.Scratch.paths)
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.Scratch.delete(spark, begun, keep=1)
    return docs


#: Subword sampling cannot be said in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None
