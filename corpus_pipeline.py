"""The corpus pipeline: filter toxic texts, keep one of each near-duplicate group, drop texts that
hold benchmark passages, redact secrets, encode into pieces.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; run() writes
each stage's result as Parquet to shared storage and reads it back as the next one's docs.

In every stage an empty table gives an empty result, texts are read whole whatever their length, and
further columns of docs stay as they are, whatever their names (the last stage's results replace
columns of their names). The other cases are stated with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm import common, decontam, secrets, simhash, toxicity, wfst
from lumenfold.llm.pieces import Vocabulary


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows that the grammar predicts toxic.

    Null and empty texts stay; repeated rows go or stay together, since only the text counts; without labels
    of both kinds the fixed lists and weights decide; a score of exactly one half goes.
    """
    return toxicity.drop_toxic(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: similarity of five-word shingles of 0.8 or more, among candidates by fingerprints.

    The row with the smallest id stays, rows without an id come last; of several rows with that id the one
    whose text has the smallest hash, once. Null and empty texts are one group, as they have no words.
    """
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those whose words are a twentieth or more benchmark passages.

    Null and empty texts stay; exactly a twentieth goes; repeated rows go or stay together; an item
    without words or without an id has no passage.
    """
    return decontam.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with every finding replaced by a mask, and n_chars kept true.

    Null and empty texts stay as they are; findings that touch or overlap become one mask; repeated rows are
    redacted alike; a score of exactly the threshold is a finding.
    """
    return secrets.redact(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with ids, n_tokens, n_fallback and round_trip (whether decoding gives the text back).

    A null text has null ids, no tokens and null round_trip, an empty one no ids; repeated rows are encoded
    alike; of equal paths the one with the longer last piece wins.
    """
    return wfst.encode(docs, wfst.Codec(Vocabulary.load()), docs.columns)


STAGES = [
    ("toxicity", toxicity_filter),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scan", redact_secrets),
    ("sentencepiece", encode_pieces),
]

#: The learned stages (1, 4) can't be said in SQL; tests hold the pipeline against plain versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{i}", before if i else None)
        before = docs
    return docs
