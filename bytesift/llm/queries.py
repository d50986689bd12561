"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contamination, is_contaminated
from .encode import vocabulary
from .packing import pack_documents
from . import oracle
from .common import materialize, scratch_path
from .store import read_summary, write_store
from .suffixes import remove_repeats
from .urls import judge
from .warc import page_of, read_warc, write_warc
from .toxicity import fit, held_out, score_column
from .fingerprints import edit_report
from .lines import line_groups
from .simhash import near_groups


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_groups(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "line_no", "component_id", "keep")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_report(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_groups(_table(spark, sf_dir, "documents"))
    return rows.select(F.col("__id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, vocabulary("byte_bpe_50k.json")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = contamination(docs, _table(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "found.items"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "store")
    write_store(_table(spark, sf_dir, "documents").select("doc_id", "text"), path, vocabulary("word_bpe_49k.json"), end_id=1)
    return read_summary(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_warc(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    read = read_warc(spark, path).select(page_of("name").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", page_of("refers_to").alias("refers_to"))
    read = materialize(read, "warc-read")
    first = read.where("record_type = 'response'").select(F.col("page_id").alias("of"), F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b")).distinct()
    revisits = read.where("record_type = 'revisit'").join(first, (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("d")), "left")
    revisits = revisits.select("page_id", F.col("b").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return read.where("record_type = 'response'").unionByName(revisits)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = fit(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    rows = docs.select("doc_id", held_out().alias("held_out"), score_column(docs, lexicon).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_line_dedup": op1_line_dedup, "op2_fingerprints": op2_fingerprints, "op3_simhash": op3_simhash, "op4_best_fit_packing": op4_best_fit_packing, "op5_decontaminate": op5_decontaminate, "op6_token_store": op6_token_store, "op7_suffix_dedup": op7_suffix_dedup, "op8_url_filter": op8_url_filter, "op9_warc": op9_warc, "op10_toxicity": op10_toxicity}


def oracle_sql() -> dict[str, str]:
    return {"op5_decontaminate": oracle.OP5, "op9_warc": oracle.OP9}
