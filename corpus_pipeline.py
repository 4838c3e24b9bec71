"""The corpus pipeline: quality, line dedup, near-duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame. All but the last return the columns of docs.
The near-duplicate stage works on shingles of five words at a similarity of 0.8.

Defined results: every stage takes null, empty and very long texts, rows that repeat a doc_id, and further columns of
any name. Rows of one doc_id share their fate: they go if any of them is rejected as a near-duplicate or as
contaminated, and all stay whose document is kept by quality. An empty table goes through all stages and gives an
empty result; without labels every document has good quality, without benchmark items none is contaminated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlark.llm.bpe_automaton import encode_documents
from meterlark.llm.common import NO_ID, fresh, shared_dir
from meterlark.llm.decontaminate import decontaminate
from meterlark.llm.line_dedup import drop_repeated_lines
from meterlark.llm.minhash import near_duplicates
from meterlark.llm.quality import keep_quality
from meterlark.llm.queries import tokenizer_path


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the doc_ids of gone; rows with a null doc_id are judged like any other."""
    key = fresh(docs, "_key")
    keys = gone.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias(key)).distinct()
    marked = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    return marked.join(keys, key, "left_anti").select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, near_duplicates(docs, shingle=5).where("NOT kept"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where("contaminated"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs, tokenizer_path("word_bpe_49k.json"), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]

#: The quality model and the tokens have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
