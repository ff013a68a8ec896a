"""Queries of the text operators; each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, decontaminate, html, langid, packing, pii, repair, simhash, suffixes, topk, windows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, whose markup and address bear witness; the likelihoods are learnt from the labels of documents."""
    pages = langid.from_pages(table(spark, sf_dir, "pages"))
    found = langid.identify(pages, langid.train(table(spark, sf_dir, "documents")), id_col="id", declared=F.col("declared"), suffix=F.col("suffix"), host=F.col("host"))
    return found.withColumnRenamed("doc_id", "page_id")


@query
def op7_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.shared_dir(spark).rstrip('/')}/tessera-{uuid.uuid4().hex}"
    repair.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return repair.read(spark.read.parquet(path))


@query
def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


SQL["op8_topk"] = topk.SQL


@query
def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


@query
def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op6_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.near_passages(table(spark, sf_dir, "documents"))[1]
