"""The queries of this subpackage: each applies its operator to the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, table
from . import bpe, chat, decontaminate, divergence, embed, jaccard, license, phrases, pii, tokens, topk, toxicity, warc


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hit_spans")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(ship(spark), sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(ship(spark), sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(ship(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(ship(spark), sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("SELECT -7L AS conv_id, t.turn, t.role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return chat.read_back(chat.format_turns(rows.unionByName(probe)))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(spark, *warc.write(table(ship(spark), sf_dir, "pages")))


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read(spark, *tokens.write(table(ship(spark), sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(ship(spark), sf_dir, "documents"))


def op9_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(table(ship(spark), sf_dir, "embeddings"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(ship(spark), sf_dir, "documents")).drop("spans")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(ship(spark), sf_dir, "documents"))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(topk.sparse_rows(table(ship(spark), sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(ship(spark), sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_pii, op3_byte_bpe, op4_toxicity, op5_chat_format, op6_warc, op7_token_shards, op8_jaccard_join, op9_embedding_neardup, op10_license_scan, op11_source_divergence, op12_exact_topk, op13_phrase_collocations, pipeline)}
ORACLES = {"op1_decontaminate": decontaminate.ORACLE, "op5_chat_format": chat.ORACLE, "op6_warc": warc.ORACLE, "op8_jaccard_join": jaccard.ORACLE, "op9_embedding_neardup": embed.ORACLE, "op11_source_divergence": divergence.ORACLE, "op12_exact_topk": topk.ORACLE, "op13_phrase_collocations": phrases.ORACLE}
