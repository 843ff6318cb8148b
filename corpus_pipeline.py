"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows of its predecessor and returns a
DataFrame; all but the last return the columns of ``documents``. Between stages the rows are
written as Parquet to the cluster's shared folder and read again, so that a lost executor costs
one stage at most and no stage computes its predecessors anew.

Defined cases are those of the operators: nulls, empty and very long texts, ties, repeated
rows, empty tables and extra columns need no care here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossmill.llm import decontaminate, language_id, line_dedup, near_duplicates, packing
from glossmill.llm.queries import word_tokenizer
from glossmill.scratch import written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be learned from the corpus; rejected ones go."""
    return language_id.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the later occurrences of any three lines in a row."""
    return line_dedup.remove_repeated_lines(docs, size=3)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return near_duplicates.drop_near_duplicates(docs, percent=80, shingle=5)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verbatim window of ten words of the benchmark."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, word_tokenizer(), capacity=4096, end_id=1)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_documents),
    ("benchmark decontamination", decontaminate_benchmark),
    ("best-fit packing", pack_sequences),
]

#: Language models and packing are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
