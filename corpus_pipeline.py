"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
in the shared folder and read again as the next stage's docs.

1. toxicity: documents that the classifier scores 0.5 or more go. It learns from the labels
   of documents outside the held-out fold.
2. line_dedup: lines that an earlier line equals, or is one word edit from, leave the texts;
   n_chars follows. A document of which no line is left goes: all of it stands elsewhere.
3. simhash_near_dedup: one document of each group of near copies stays (shingles of five
   words, Jaccard similarity of 0.8 or more, copies included).
4. decontamination: documents with a passage of the benchmark go.
5. byte_bpe: documents as token ids; each is decoded again and compared.

SQL can express neither the classifier nor the tokenizer, so there is no ORACLE_SQL. The
tests hold line dedup, near-dedup and decontamination against brute force, the decoded texts
against the texts, and the classifier's stage against the operator's own scores.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import byte_bpe, decontam, line_dedup, simhash, toxicity
from barloom.llm.common import table, work_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.train_outside_fold(docs, table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # plain names, since the documents may have any
    names = [c if c in ("doc_id", "text", "n_chars") else f"c{i}" for i, c in enumerate(docs.columns)]
    kept = line_dedup.dedup_lines(docs.toDF(*names))
    emptied = (F.col("line_dedup_dropped") > 0) & (F.trim("text") == "")
    changed = F.when(F.col("line_dedup_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return (
        kept.where(~F.coalesce(emptied, F.lit(False)))
        .select(*(changed.cast("long").alias(c) if c == "n_chars" else F.col(c) for c in names))
        .toDF(*docs.columns)
    )


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup_documents(docs, shingle=5, similarity=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", byte_bpe_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), work_path(spark, "corpus")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
