"""Corpus pipeline: quality classifier, quality rules, line dedup, SimHash near-dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and
returns a DataFrame, which is written as Parquet and reread as the next one's
docs. All but the last return the columns of ``docs``.

Defined results: null text reads as empty (short texts fail the rules); one
row of each SimHash group stays and no other row goes, also where rows repeat
an id or have none; empty tables give empty ones;
further columns pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from offerlab.llm import line_dedup, packing, quality, rules, simhash
from offerlab.llm.common import read_table, written
from offerlab.llm.queries import held_out, tokenizer

THRESHOLD = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    labels = read_table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "quality")
    scored = quality.score_quality(docs.withColumn("_row", F.struct(*docs.columns)).select("doc_id", "text", "_row"), labels, threshold=THRESHOLD)
    return scored.where("predicted = 1").select("_row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and are no outliers of their language and source."""
    row = docs.select(F.struct(*docs.columns).alias("_document"), "text", "lang", "source")
    return rules.apply_rules(row, keep=["_document"]).where("kept").select("_document.*")


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that come earlier in the corpus; n_chars follows the text."""
    row = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_document"))
    clean = line_dedup.dedup_lines(row)
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return clean.select(*[new.get(c, F.col(f"_document.`{c}`")).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest id, null ids last."""
    return simhash.first_of_groups(docs, shingle=4, bits=4)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"), capacity=packing.CAPACITY)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("line_dedup", line_deduplication),
    ("simhash_near_dedup", near_duplicates),
    ("best_fit_packing", best_fit_packing),
]

#: Encoding, robust estimates and fingerprints have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
