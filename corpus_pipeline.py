"""A corpus pipeline of five stages; each reads, as Parquet, what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.llm.bpe import bpe_encode
from tablemill.llm.common import staged, table
from tablemill.llm.exact_dedup import drop_copies
from tablemill.llm.mixing import draw
from tablemill.llm.ngram_join import drop_near_copies
from tablemill.llm.quality import drop_rejected


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or come from a rejected host, go."""
    return drop_rejected(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id stays, as in the operator's query."""
    return drop_copies(docs, keep="max")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id stays."""
    return drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last repetition of each source in part."""
    return draw(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row of the mix, and whether they decode to its text."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    text = F.coalesce(docs["text"], F.lit(""))
    ids = bpe_encode(docs.select("doc_id", "text", "lang", "source", "n_chars", F.sha2(text, 256).alias("_text")), path, public_tokenizers.PATTERN, keep=["doc_id", "lang", "source", "_text"], decoded_col="decoded")
    return ids.select("doc_id", "lang", "source", "n_tokens", "ids", (F.sha2("decoded", 256) == F.col("_text")).alias("round_trip"))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing sources", mixed), ("byte-level BPE", encoded)]

#: SQL can't encode by ranks or hash shingles in reasonable time; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{k}")
    return docs
