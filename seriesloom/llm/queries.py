"""The registered queries of the corpus operators: thin digests over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm import (
    language_id,
    line_dedup,
    minhash_join,
    packing,
    quality_rules,
    rank_bpe,
    repeat_index,
    source_mix,
    square_runs,
    token_alignment,
    top_products,
    toxicity,
    url_filters,
)
from seriesloom.llm.common import crc_mod, same, table, words, written
from seriesloom.llm.sql import SQL  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def register(build):
        QUERIES[name] = build
        return build

    return register


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_source_mix")
def op1_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    sizes = written(source_mix.sized(table(spark, folder, "documents")), "mix-sizes")
    chosen = source_mix.decide(sizes).select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"),
        "source_size", "target", "copies",
    )
    match = same(F.col("doc_id"), F.col("_id")) & same(F.col("source"), F.col("_source")) & (F.col("size") == F.col("_size"))
    return sizes.join(chosen, match).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )


@query("op2_repeat_index")
def op2_repeat_index(spark: SparkSession, folder: str) -> DataFrame:
    kept = repeat_index.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", "n_shared", F.sha2("kept_bytes", 256).alias("kept_sha256"))


@query("op3_minhash_join")
def op3_minhash_join(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_join.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


@query("op4_language_id")
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    model = language_id.learn(docs.where(~held_out))
    return language_id.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)


@query("op5_top_products")
def op5_top_products(spark: SparkSession, folder: str) -> DataFrame:
    return top_products.top_products(table(spark, folder, "embeddings"), lambda key: key % 50 == 0)


@query("op6_url_rules")
def op6_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    # A page's label is that of the document with its id: toxic or low quality means block.
    labels = table(spark, folder, "labels").select(
        F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("block")
    )
    pages = table(spark, folder, "pages").select("page_id", "url")
    return url_filters.judge(pages, labels).select("page_id", "host", "path", "rule", "verdict")


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents").select("doc_id", "text"), tokenizer_path())


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    model = toxicity.learn(
        docs.where(~held_out), table(spark, folder, "labels"), (crc_mod(F.col("doc_id"), 5) != 1).cast("int")
    )
    return toxicity.score(docs.withColumn("held_out", held_out), model)


@query("op9_quality_cascade")
def op9_quality_cascade(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality_rules.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op10_site_lines")
def op10_site_lines(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256")
    )


def _with_periodic_tails(docs: DataFrame) -> DataFrame:
    """In one document of ten, chosen by a hash of its id, the words from some place on repeat."""
    hashed = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    some = docs.where(hashed % 10 == 0).select("doc_id", hashed.alias("_h"), words(F.col("text")).alias("_words"))
    g, n = F.floor(F.col("_h") / 10), F.size("_words")
    first = (g % F.greatest(n, F.lit(1))).cast("int")
    period = (1 + F.floor((n - first) / (3 + g % 8))).cast("int")
    unit = F.slice("_words", first + 1, period)
    times = F.ceil((n - first) / period).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(unit, times)), F.lit(1), n - first)
    return docs.where(hashed % 10 != 0).select("doc_id", "text").union(
        some.select("doc_id", F.array_join(F.concat(F.slice("_words", F.lit(1), first), tail), " ").alias("text"))
    )


@query("op11_square_runs")
def op11_square_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = square_runs.periodic_runs(_with_periodic_tails(table(spark, folder, "documents")))
    best = found.select("*", square_runs.longest_run(F.col("runs")).alias("_best"))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        (-F.col("_best.short")).alias("length"),
        F.col("_best.period").alias("period"),
        F.expr("1000 * -_best.short div _best.period").alias("exponent_milli"),
        F.sha2(square_runs.run_lines(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return token_alignment.linked(docs, tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


@query("op13_rank_bpe")
def op13_rank_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = rank_bpe.encode_decode(docs, tokenizer_path("word_bpe_49k.json"))
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
