"""The corpus pipeline: documents in, token files out; every stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, decontaminate, mixing, near, quality, token_files

#: Parameters of production.
TOKENIZER = "byte_bpe_50k.json"


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labels of these documents, doesn't reject.

    Null and empty texts are scored like any other; rows that share an id are judged each by its own text, and so are those of null id. Without
    labels all have score 0.5 and stay. Columns of any name pass."""
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"))
    name = "_".join(["score", *docs.columns])  # no column of the table's own
    return quality.score(docs, model, name).filter(F.col(name) >= quality.THRESHOLD).select(*docs.columns)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest id.

    Null texts, those without a word, and rows of null id are in no group and stay; of rows that share a kept id one stays."""
    return near.one_of_each(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark.

    Each row goes or stays for its own text, whatever its id; null and empty texts stay. An empty benchmark takes nothing away."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Null texts have size 0 and a null source is a source of its own; rows alike in id and text are interchangeable."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files, written into the shared folder, and what they say of each document, in ascending id order, null ids first.

    A null text is an empty one; rows that share an id each have their place. Of no documents there is an empty file."""
    return token_files.encoded(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality", good), ("near_dedup", unlike), ("decontaminate", unseen), ("mix", mixed), ("token_files", tokens)]
#: Ridge, signatures, alignment and tokenization have no SQL form; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(docs, f"stage-{name}")
    return docs
