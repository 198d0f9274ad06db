"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .bpe import decode, digests, encode, load_ranks
from .common import table
from .decontaminate import decontaminate
from .mixing import score
from .neardup import near_duplicates
from .quality import fit_quality, quality
from .secrets import KINDS, find_secrets, rendered
from .sharding import shard
from .store import read_store, write_store
from .toxicity import toxicity, train
from .weak import classify


def op1_byte_level_bpe(spark: SparkSession, sf_dir: str, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    ranks = load_ranks(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = encode(table(spark, sf_dir, "documents"), ranks, pattern or public_tokenizers.PATTERN)
    return digests(decode(encoded, ranks), "doc_id")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, threshold=80)


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(rank: int, kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{kind}")

    counts = [count(r, kind) for r, kind in enumerate(KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(rendered("base_spans"), 256).alias("base_sha256"), rendered("spans").alias("spans"))


def op6_token_store(spark: SparkSession, sf_dir: str, json_path: str | None = None, pattern: str | None = None, end_id: int = 2) -> DataFrame:
    with open(json_path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        json_text = f.read()
    path = write_store(table(spark, sf_dir, "documents"), json_text, pattern or public_tokenizers.PATTERN, end_id)
    return read_store(spark, path).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32", "verified")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, train(docs, table(spark, sf_dir, "labels")))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    put = shard(table(spark, sf_dir, "documents"), shards=8)
    return put.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op3's rows, which SQL can express."""
    return op3_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op5_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many base spans of each kind op5 finds, which SQL can express."""
    return op5_secret_scans(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def op10_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of op10's shards: all rows and bytes, texts undivided, slots without gaps, and no shard above the mean by
    more than the largest group of equal texts."""
    put = op10_sharding(spark, sf_dir)
    shards = put.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("w"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.count_distinct("slot").alias("d"))
    one = shards.agg(F.count("*").alias("shards"), F.sum("n").alias("n_rows"), F.sum("w").alias("size"), F.bool_and((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("d") == F.col("n"))).alias("slots_gapless"), F.max("w").alias("_most"))
    texts = put.join(table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("g")), "doc_id").groupBy("g").agg(F.count_distinct("shard").alias("of"), F.sum("size").alias("w")).agg((F.max("of") == 1).alias("groups_whole"), F.max("w").alias("_group"))
    out = one.join(F.broadcast(texts))  # a row on either side
    return out.select("shards", "n_rows", "size", "groups_whole", "slots_gapless", (F.col("_most") <= F.col("size") / F.col("shards") + F.col("_group")).alias("balanced"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_byte_level_bpe, op2_lm_scoring, op3_quality_rules, op4_minhash_near_dedup, op5_secret_scans, op6_token_store, op7_benchmark_decontamination, op8_toxicity, op9_quality_classifier, op10_sharding, op3_base, op5_base, op10_base)}
ORACLES: dict[str, str] = {"op4_minhash_near_dedup": sql.NEAR_DUPLICATES, "op7_benchmark_decontamination": sql.DECONTAMINATION, "op3_base": sql.QUALITY_BASE, "op5_base": sql.SECRETS_BASE, "op10_base": sql.SHARDING_BASE}
