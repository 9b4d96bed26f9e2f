"""The corpus pipeline: toxicity, line removal, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written before the next
stage reads it; all but the last keep the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm import line_dedup, minhash_join, packing, source_mix, toxicity
from seriesloom.llm.common import crc_mod, table, written
from seriesloom.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    fold = (crc_mod(F.col("doc_id"), 5) != 1).cast("int")
    model = toxicity.learn(docs.where(crc_mod(F.col("doc_id"), 5) != 0), table(spark, sf_dir, "labels"), fold)
    return toxicity.keep_clean(docs, model)


def drop_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_lines(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in kept.columns else kept


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_site_lines),
    ("near_dedup", keep_one_of_near_copies),
    ("source_mix", mix_sources),
    ("packing", pack),
]

#: Neither the models nor the draw of the mix can be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
