"""One registered query per operator, over the whole driver tables, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from offerlab.llm import bpe, chat, collocations, embedding_dedup, line_dedup, lm_scores, packing, passages, quality, rules, simhash, spelling, token_counts
from offerlab.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Folder of the vocabulary files; a parameter, set in the environment where it differs.
TOKENIZERS = os.environ.get("OFFERLAB_TOKENIZERS", "")


def tokenizer(name: str) -> str:
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer("word_bpe_49k.json")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.transcode(docs, path)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.read_back(chat.format_chat(rows.unionByName(extra)))


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts.token_counts(docs, tokenizer("byte_bpe_50k.json"), limit=512)
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def held_out():
    """Documents whose labels are never learned from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "quality")
    return quality.score_quality(docs, labels, threshold=0.3).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return rules.apply_rules(docs, keep=["doc_id"])


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = simhash.simhash_groups(docs, shingle=4, bits=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup_embeddings(read_table(spark, sf_dir, "embeddings"), threshold=0.93)


@query
def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_scores.lm_scores(read_table(spark, sf_dir, "documents"), backoff=0.4)
    return out.select("doc_id", "n_words", (F.round(F.col("logprob") * 100) / 100 + 0.0).alias("logprob"),
                      (F.round(F.col("logprob") / F.nullif("n_words", F.lit(0)) * 10000) / 10000 + 0.0).alias("mean_logprob"))


ORACLES["op10_lm_scores"] = lm_scores.ORACLE.format(vocabulary=10**9, backoff=0.4)


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"), edits=2)
    return out.select("doc_id", "n_lines", "n_dropped", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
                      F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


@query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.spelling_variants(docs, min_chars=7, min_count=2, ratio=10, every=31)


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents").select("text", "lang"), least=100, covered_percent=100, top=2000)


ORACLES["op11_collocations"] = collocations.ORACLE.format(least=100, covered=100, top=2000)


@query
def op13_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = passages.repeated_passages(read_table(spark, sf_dir, "documents").select("doc_id", "text"), span=50)
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return out.select("doc_id", size.alias("n_bytes"), (size - F.octet_length("kept")).cast("long").alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
