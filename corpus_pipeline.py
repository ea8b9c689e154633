"""The pipeline over documents: each stage calls one operator of concord.llm and works on all that the stage before kept.

toxicity      documents scored as toxic go
near_copies   one document of each group of SimHash near-duplicates stays: five-word shingles, similarity of 0.8 or more
benchmark     documents that hold a benchmark window go
secrets       secrets in the text are masked, and n_chars follows
packing       what is left is packed into token sequences: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)

All stages but the last return the columns of documents. Each is written as Parquet in the shared folder and read again,
so a lost executor costs a re-read of the stage before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from concord.llm.bin_slack import pack_documents
from concord.llm.common import table
from concord.llm.randomness_tests import redacted
from concord.llm.simhash_similar import drop_similar
from concord.llm.suffix_match import decontaminated
from concord.llm.toxicity_gru import without_toxic
from concord.session import as_table, new_run_dir


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_similar(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("near_copies", near_copies), ("benchmark", benchmark), ("secrets", secrets), ("packing", packing)]

#: The learned stage, the fingerprints and the tokenizer are beyond SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_run_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = as_table(stage(spark, docs, sf_dir), folder, f"{k}_{name}")
    return docs
