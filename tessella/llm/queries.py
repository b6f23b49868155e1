"""The registered queries of this subpackage: (spark, folder) -> DataFrame, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import mixing, norm_search, parity_join, preference
from tessella.runtime import scratch, table


def op1_pack_documents(spark: SparkSession, folder: str) -> DataFrame:
    from tessella.llm.packing import pack_documents

    crc = F.crc32("ids").alias("ids_crc32")
    return pack_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096, keep=(crc,))


def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    from tessella.llm.mixing import plan_mix

    mix = plan_mix(table(spark, folder, "documents"), weights=(3, 1, 2), share=1.5, max_copies=2)
    return mix.decisions().select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op3_top_products(spark: SparkSession, folder: str) -> DataFrame:
    return norm_search.top_products(table(spark, folder, "embeddings"), k=20, query_mod=20, scale=64.0)


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    from tessella.llm.quality import classify

    return classify(table(spark, folder, "documents"), table(spark, folder, "labels"), threshold=0.3, held_mod=5)


def op5_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    from tessella.llm.lm import score_texts

    return score_texts(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), held_mod=7, held=2)


def op6_nearest(spark: SparkSession, folder: str) -> DataFrame:
    from tessella.llm.multi_index import nearest_rows

    return nearest_rows(table(spark, folder, "embeddings"), k=10, query_mod=100)


def op7_preference_samples(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    out = preference.preference_samples(rows, preference.halved(rows))
    return out.withColumns({c: preference.spans_text(F.col(c)) for c in ("chosen_spans", "rejected_spans")})


def op8_jaccard_groups(spark: SparkSession, folder: str) -> DataFrame:
    return parity_join.jaccard_groups(table(spark, folder, "documents"), k=3, num=90, den=100)


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from tessella.llm.token_counts import token_counts

    return token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op10_sorted_shards(spark: SparkSession, folder: str) -> DataFrame:
    from tessella.llm.sst import read_shards, write_shards

    root = scratch(spark, "shards")
    write_shards(table(spark, folder, "documents"), root, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_shards(spark, root).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {
    "op1_pack_documents": op1_pack_documents,
    "op2_mix_sources": op2_mix_sources,
    "op3_top_products": op3_top_products,
    "op4_quality": op4_quality,
    "op5_lm_scores": op5_lm_scores,
    "op6_nearest": op6_nearest,
    "op7_preference_samples": op7_preference_samples,
    "op8_jaccard_groups": op8_jaccard_groups,
    "op9_token_counts": op9_token_counts,
    "op10_sorted_shards": op10_sorted_shards,
}

SQL: dict[str, str] = {
    "op2_mix_sources": mixing.sql(),
    "op3_top_products": norm_search.SQL,
    "op7_preference_samples": preference.SQL,
    "op8_jaccard_groups": parity_join.sql(),
}
