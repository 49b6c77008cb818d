"""A training-data pipeline: each stage reads what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubflow.llm import exact, mixing, packing, simhash, toxicity
from hubflow.llm.common import cut, table
from hubflow.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are more likely toxic than not (operator 6)."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs.select(*COLUMNS), model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts (operator 10)."""
    return exact.keep_one(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five-word shingles, similarity of 0.8 or more (operator 3)."""
    return simhash.keep_unlike(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents as the mix takes them (operator 1)."""
    mixed = mixing.mix(docs, keep=["text", "lang", "source", "n_chars"])
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every copy of every document into sequences (operator 4)."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxic_out), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("mixing", mix_sources), ("packing", pack_documents)]

#: The classifier, the fingerprints and the tokenizer can't be stated in SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet in the shared folder and read as the next one's docs."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), instead_of=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
