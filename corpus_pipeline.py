"""From raw documents to token ids, in five stages.

Every stage works on all that its predecessor kept and is written as Parquet;
the next one reads that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwood.llm.decontaminate import decontaminated
from driftwood.llm.line_dedup import line_dedup
from driftwood.llm.near_dedup import near_deduplicated
from driftwood.llm.quality_rules import quality_filtered
from driftwood.llm.sentence_pieces import encoded
from driftwood.sources.tables import table
from driftwood.sources.workspace import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_filtered(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten or more documents go from all but the first; n_chars follows the text."""
    kept = line_dedup(docs, min_docs=10, min_chars=1, keep="first")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    return near_deduplicated(docs, threshold=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"), n=10)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the round trip checked."""
    return encoded(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding", sentence_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can express neither the bands of MinHash nor the pieces; tests/llm has brute-force versions.
ORACLE_SQL = None
