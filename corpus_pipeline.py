"""A corpus made ready for training, in five stages.

Each stage takes (spark, docs, sf_dir), works on all of docs, and returns documents again, the last
one packed pieces. Stages are written as Parquet and read again before the next; what the last one
wrote stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import jaccard, mixing, packing, quality, substring
from sluice.llm.shared import new_path, remove, scratch


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from all labels of documents at hand.

    Null and empty texts are judged by the classifier's offset; without labels of both classes every
    document has the same score. Equal texts go or stay together.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, quality.train(docs, labels, F.lit(True)))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document: that with the smallest id, if one has an id.

    Groups are made of texts alone; documents without a word are in no group and stay.
    """
    return jaccard.one_per_class(docs)


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words under windows that occur twice or more; n_chars, if there is one, follows the text.

    Null texts become empty ones; a document that loses all its words stays with an empty text.
    """
    out = substring.without_repeats(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; one without a word is taken as its source's others are, at most twice."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in training sequences; a null or empty text is its end token alone."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("repeated_passages", no_repeated_passages),
    ("mixing", mixed_sources),
    ("packing", packed),
]

#: SQL expresses neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = None
    for name, stage in STAGES:
        with scratch(spark):  # what a stage wrote for itself goes with it
            out = stage(spark, docs, sf_dir)
            path = new_path(spark, name)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if held:
            remove(spark, held)
        held = path
    return docs
