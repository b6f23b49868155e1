"""A training-data pipeline over ``documents``: classify, de-duplicate, mix, pack.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``docs``, whatever others
these have beside doc_id, text, source and n_chars.

Rows with a null or empty text, or a null id: the classifier scores them like others and keeps
those that it doesn't reject; the near-copy stage links them with nothing, so they stay; the
mix counts no words in null or empty texts and so takes none of their words; packing
gives each an end id. Repeated rows are scored, mixed and packed one by one, and one of
them stays behind the near-copy stage. Very long texts pass whole. An empty table gives an
empty one at every stage; without usable labels the classifier rejects nothing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.mixing import plan_mix
from tessella.llm.packing import pack_documents
from tessella.llm.parity_join import keep_one_of_each
from tessella.llm.quality import keep_good
from tessella.runtime import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores below 0.3 go."""
    return keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group that links of five-word shingles at a similarity of 0.8 make."""
    return keep_one_of_each(docs, k=5, num=80, den=100)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by weights 3, 1, 2 to 150 % of all words; a document is there as often as it is taken."""
    return plan_mix(docs, weights=(3, 1, 2), share=1.5, max_copies=2).repeat(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 ids with their sequences, offsets and checksums."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096, keep=(F.crc32("ids").alias("ids_crc32"),))


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_copies), ("mixing sources", mix), ("best-fit packing", pack)]

#: SQL can't express the classifier's fit, so the pipeline has none; it is tested stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
    return docs
