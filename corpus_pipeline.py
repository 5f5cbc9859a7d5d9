"""A training corpus from raw documents: toxicity, quality, near-duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as
the next stage's docs. All but the last return the columns of documents, also extra ones of any
name. Each stage defines its results for null, empty and very long texts, ties, repeated rows and
empty tables in its operator's docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from winnowlake.llm import common, op1_packing, op2_quality, op4_substring, op5_simhash, op9_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores below the threshold. It learns from the labelled ones among docs."""
    labels = common.table(spark, sf_dir, "labels").where(~op9_toxicity.held_out())
    return op9_toxicity.keep(docs, op9_toxicity.fit(docs, labels))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy of the rule ledger keeps."""
    return op2_quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each component of near copies (five-word shingles,
    similarity of 0.8 or more): candidates by operator 5's fingerprints and, for what they miss, by
    signatures, then verified exactly (see op5_simhash.near_texts)."""
    return op5_simhash.keep(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of smaller doc_id has."""
    return op4_substring.keep(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return op1_packing.pack(docs)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("packing", packing)]

#: Scores of a trained network decide the first stage: SQL can't express run()'s rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = common.written()
        after = common.settled(spark, stage(spark, docs, sf_dir), f"stage-{name}")
        # what the stage wrote on its way, and what it read, is read no more
        common.dropped(spark, docs, *(p for p in common.written() if p not in before and p != after._settled_at))
        docs = after
    return docs
