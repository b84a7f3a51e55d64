"""A training-corpus pipeline over ``documents``: language ID, MinHash near-dedup, substring dedup, benchmark
decontamination, byte-level BPE. Each stage's result is written as Parquet and read again as the next one's input.

The stages and their defined results for nulls, ties, repeated rows, empty tables and other columns are in
``scorecube.llm``. All but the last return the columns of ``documents``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scorecube.llm import op4_decontamination, op6_byte_bpe, op7_near_dedup, op8_language_id, op10_substrings
from scorecube.session import shared_dir
from scorecube.sources.tables import read_table

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", op8_language_id.stage),
    ("minhash_near_dedup", op7_near_dedup.stage),
    ("substring_dedup", op10_substrings.stage),
    ("benchmark_decontamination", op4_decontamination.stage),
    ("byte_bpe", op6_byte_bpe.stage),
]

#: SQL can express neither the learned language filters nor BPE
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written to the cluster's shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    root = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex[:12]}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{root}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
