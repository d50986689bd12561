"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: the first four the documents that stay, with the columns of
documents, the last the packed pieces. run() writes each stage's result as Parquet and reads it again as the next one's docs.

A stage's defined results for odd rows: documents with a null or empty text pass the first two stages as they are; of all
such texts, which have the same (no) words, the third keeps one. A row is known by its id, null or not, and its text: rows that share an
id keep what is their own. Repeated rows, of one id and text, lose the same lines; the third stage keeps one of them. Empty tables stay
empty, and further columns of any name are kept up to packing. A document without a token but the end id is one packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bytesift.llm.common import materialize
from bytesift.llm.decontaminate import drop_contaminated
from bytesift.llm.encode import vocabulary
from bytesift.llm.lines import drop_near_lines
from bytesift.llm.near_documents import drop_near_documents
from bytesift.llm.packing import pack_documents
from bytesift.llm.toxicity import drop_toxic, fit


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    return drop_toxic(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate lines the first stays; a document that loses all its lines goes."""
    return drop_near_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by an exact Jaccard similarity of 0.8 or more (shingles of five words) the one with the smallest id stays.

    Candidates are SimHash fingerprints that Golay keys bring together, and MinHash bands for what is beyond their reach."""
    return drop_near_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 13 consecutive words of a benchmark item go, however long they are, and those of which a twentieth of the words lie in shorter items."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept texts as token sequences of 1024 by best fit: one row per piece."""
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: Tokenisers, fitted scores and hashes are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
