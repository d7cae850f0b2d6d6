"""The registered queries of this subpackage, each over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.llm import bit_packing, context_tree, fuse_dedup, latent_leaks, license_rules, line_dedup, packing, severity, simhash, url_templates
from folio.llm.rows import read

VOCABULARY = "byte_bpe_50k.json"


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ordinal_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severity.op1_ordinal_severity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.op2_context_tree(read(spark, sf_dir, "documents"))


def op3_fuse_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse_dedup.op3_fuse_dedup(read(spark, sf_dir, "documents"))


def op4_bit_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_packing.op4_bit_packed_ids(read(spark, sf_dir, "documents"), tokenizer_path())


def op5_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op5_pivot_simhash(read(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op6_line_dedup(read(spark, sf_dir, "documents"))


def op7_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.op7_url_templates(read(spark, sf_dir, "pages"))


def op8_differencing_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op8_differencing_windows(read(spark, sf_dir, "documents"), tokenizer_path())


def op9_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent_leaks.op9_latent_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.op10_license_rules(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ordinal_severity, op2_context_tree, op3_fuse_dedup, op4_bit_packed_ids, op5_pivot_simhash, op6_line_dedup, op7_url_templates, op8_differencing_windows, op9_latent_leaks, op10_license_rules)}
ORACLES: dict[str, str] = {"op3_fuse_dedup": fuse_dedup.ORACLE, "op6_line_dedup": line_dedup.ORACLE, "op7_url_templates": url_templates.ORACLE}
