"""Training-data pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Defined results of all stages: a null text counts as empty, and empty texts are copies of each other. A null ``doc_id`` is
an id of its own. Of equal rows one stays. Other columns, whatever their names, keep their values. An empty table stays empty.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuspipe.llm import bpe
from corpuspipe.llm.common import discard, new_folder, own, unboxed
from corpuspipe.llm.decontaminate import without_leaks
from corpuspipe.llm.exact_dedup import without_copies
from corpuspipe.llm.jaccard_join import without_near_copies
from corpuspipe.llm.quality import without_rejected
from corpuspipe.sources.tables import read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the resampling does not draw go."""
    return without_rejected(docs, read_table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that share 0.8 of their five-word n-grams one stays, links taken as far as they reach."""
    return without_near_copies(docs, n=5, num=80, den=100)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, word by word or edited, go."""
    return without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (``ids, n_tokens``), and as ``text`` what they decode to. A null text has no ids and is empty.

    The rows' other columns stay; where one has the name of a new column, the new one gets underscores behind its name.
    """
    import public_tokenizers

    kept = [name for name in docs.columns if name != "text"]

    def unused(name: str) -> str:
        while name.lower() in {column.lower() for column in kept}:
            name += "_"
        return name

    rows = docs.select(F.struct(*(own(name) for name in kept)).alias("box"), "text")
    coded = bpe.round_trip(rows, "byte_bpe_50k.tiktoken", public_tokenizers.PATTERN, ("box",))
    return unboxed(
        coded,
        F.size("ids").cast("long").alias(unused("n_tokens")),
        F.col("ids").alias(unused("ids")),
        F.col("decoded").cast("string").alias("text"),
    )


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("byte-level BPE", tokens),
]

# Model weights, alignments and tokens have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        path = os.path.join(folder, str(number))
        stage(spark, docs, sf_dir).write.parquet(path)
        done, docs = docs, spark.read.parquet(path)
        if number:
            discard(done)
        docs._stored_path = path
    return docs
