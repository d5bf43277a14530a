"""A training-data pipeline: each stage is one operator over all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, jaccard, lines, quality, winnowing
from ledgerloom.llm.common import Tables, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the perplexity band reject go; null and empty texts have no words and go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents left without any; ``n_chars`` follows the text."""
    return lines.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id; texts without words stay."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth of the words go; an empty benchmark takes none."""
    return winnowing.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and byte offsets of the tokens, their number and digests, instead of the text; see ``bpe.tokenize`` for awkward rows."""
    return bpe.tokenize(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("byte_bpe", tokens),
]

#: SQL can express neither the language model nor the merges; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written as Parquet in the shared folder and reread as the next one's ``docs``."""
    docs = table(spark, sf_dir, "documents")
    with Tables(spark) as tables:
        before = None
        for _, stage in STAGES[:-1]:
            docs = tables.write(stage(spark, docs, sf_dir))
            if before is not None:
                tables.drop(before)
            before = docs
        return tables.keep(STAGES[-1][1](spark, docs, sf_dir))
