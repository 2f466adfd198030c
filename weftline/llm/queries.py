"""Driver queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import oracles
from weftline.llm.exact_dedup import exact_dedup
from weftline.llm.external_shuffle import sharded
from weftline.llm.filter_audit import filter_audit
from weftline.llm.license_scan import scan
from weftline.llm.line_frequency import line_frequency
from weftline.llm.mixing import DOMAINS, Mixture, labelled_domains
from weftline.llm.packing import packed
from weftline.llm.prefix_trie import prefix_trie
from weftline.llm.reply_trees import chat_format, linear
from weftline.llm.simhash import simhash_dedup
from weftline.llm.sstable import token_shards
from weftline.llm.token_rollup import rollup_of
from weftline.llm.toxicity import toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency(table(spark, sf_dir, "documents"))


def op2_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = labelled_domains(table(spark, sf_dir, "labels"))
    rates = Mixture(table(spark, sf_dir, "documents"), labels, list(DOMAINS.values())).rates()
    return rates.withColumnsRenamed({f"p{k}": f"p_{name}" for k, name in enumerate(DOMAINS)})


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup_of(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


def op10_sstable_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards(table(spark, sf_dir, "documents"))


def op4_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_format(linear(conversations)).drop("rank")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op11_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_frequency": op1_line_frequency,
        "op2_soft_mixing": op2_soft_mixing,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_reply_trees": op4_reply_trees,
        "op5_toxicity": op5_toxicity,
        "op6_token_rollup": op6_token_rollup,
        "op7_license_scan": op7_license_scan,
        "op8_simhash": op8_simhash,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_sstable_shards": op10_sstable_shards,
        "op11_external_shuffle": op11_external_shuffle,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_frequency": oracles.LINE_FREQUENCY,
        "op3_exact_dedup": oracles.EXACT_DEDUP,
        "op4_reply_trees": oracles.REPLY_TREES,
        "op12_prefix_trie": oracles.PREFIX_TRIE,
        "op13_filter_audit": oracles.FILTER_AUDIT,
    }
