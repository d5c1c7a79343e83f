"""A training corpus from the documents: classify, clean, one of each group of near copies, mix sources, pack.

Each stage takes (spark, docs, sf_dir); the table that it returns is written and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taktwerk.llm.common import Scratch, n_words, read_table
from taktwerk.llm.mixing import mixed_documents
from taktwerk.llm.ngram_join import one_of_each
from taktwerk.llm.packing import copies_of, pack
from taktwerk.llm.quality_model import keep_quality
from taktwerk.llm.quality_rules import keep_clean


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_quality(docs, read_table(spark, sf_dir, "labels"), Scratch(spark, "stage-quality"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail the rules go, and documents that lose too much with them."""
    return keep_clean(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8) stays."""
    return one_of_each(docs, Scratch(spark, "stage-ngrams"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed_documents(docs, Scratch(spark, "stage-mix"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in a sequence."""
    text = F.col("text")
    return pack(docs, size=n_words(text), cluster=copies_of(text), scratch=Scratch(spark, "stage-pack"))


STAGES = [
    ("quality classifier", classify_quality),
    ("quality rules", apply_rules),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The classifier and the packing are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, scratch = read_table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
