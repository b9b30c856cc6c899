"""The corpus pipeline over ``documents``: quality rules, exact dedup, near dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows the stage before
it kept. All but the last return the columns of ``documents``; the last gives
each row its piece ids in place of its text. No text is changed before that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakewright.llm import exact, mixing, neardup, quality, sampling
from lakewright.llm.common import Steps
from lakewright.sources.tables import Tables


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or consist of boilerplate lines for the most part go."""
    return quality.good_documents(docs, quality.fit(docs, Tables(spark, sf_dir).labels))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space the longest stays."""
    return exact.without_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (similarity 0.8 or more) the document with the smallest id stays."""
    return neardup.without_near_duplicates(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: never, once or twice."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_chars, ids, n_pieces, lossless): sampled piece ids of each text."""
    return sampling.encode(docs, carry=["lang", "source", "n_chars"])


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: No SQL can express the trained line labels, the sampled pieces and the components.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order. What a stage keeps is written before the next, which reads it several times."""
    docs = Tables(spark, sf_dir).documents
    steps = Steps(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = steps.write(f"stage-{k}", docs)
    return docs
