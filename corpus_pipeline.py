"""A corpus pipeline of the text operators, stage after stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, all but the last with the columns of documents. The
model of the language stage is trained on a bounded sample of its own input's labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, decontaminate, langid, packing, pii, simhash


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified, with that language; each row is judged by itself, with or without an id.

    A verdict is told by a 64-bit hash of the row's id, text, language and source. Only verdicts that change a row are
    joined back, so texts move only if these are too many for a broadcast."""
    row, name, gone = common.fresh(docs, "row", "own_lang", "gone")
    told = F.xxhash64("doc_id", "text", "lang", "source")
    found = langid.identify(docs.withColumn(row, told), langid.train(docs), id_col=row, declared=F.col("lang"), host=F.col("source"))
    found = found.select(F.col("doc_id").alias(row), F.col("lang").alias(name), (~F.col("kept")).alias(gone)).dropDuplicates([row])
    before = docs.select(told.alias(row), "lang").dropDuplicates([row])
    changed = found.join(before, row).where(F.col(gone) | ~F.col(name).eqNullSafe(F.col("lang"))).select(row, name, gone)
    out = docs.withColumn(row, told).join(common.small(common.stash(changed).df), row, "left").where(F.coalesce(~F.col(gone), F.lit(True)))
    return out.withColumn("lang", F.coalesce(name, "lang")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with similar sets of five-word shingles (0.8 or more), that with the smallest id."""
    return simhash.dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item's template."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by <kind>."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return packing.pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", best_fit)]
#: Likelihoods, reachability and best fit aren't SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.stash(stage(spark, docs, sf_dir)).df
    return STAGES[-1][1](spark, docs, sf_dir)
