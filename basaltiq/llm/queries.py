"""Thin queries of the operators over their whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltiq.llm import byte_bpe, chat, decontaminate, line_dedup, near_duplicates, packing, pii, quality_model, quality_rules, sale_versions, sstable, warc, whitening
from basaltiq.llm.common import table


def tokenizer_path(name: str) -> str:
    """A public vocabulary file, from the folder in ``BASALTIQ_TOKENIZERS`` where that is set."""
    if folder := os.environ.get("BASALTIQ_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).drop("kept")


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(manifest, with_html=False).drop("url", "html")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer=tokenizer_path("byte_bpe_50k.json"))


def op9_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = sstable.write_shards(table(spark, sf_dir, "documents"), tokenizer=tokenizer_path("word_bpe_49k.json"), end_id=2)
    return sstable.read_shards(manifest)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations")).withColumn("rendered_sha256", F.sha2("rendered", 256))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` is null from 2**63 on; ``deviation_exact`` is not."""
    made = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return made.withColumns({"deviation_exact": F.col("deviation"), "deviation": F.col("deviation").try_cast("long")})


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = tokenizer_path("byte_bpe_50k.tiktoken")
    coded, ids = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks=path, pattern=public_tokenizers.PATTERN), F.col("ids")
    return coded.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(byte_bpe.little_endian(ids, ranks=path), 256).alias("ids_sha256"), F.sha2(byte_bpe.decode(ids, ranks=path), 256).alias("decoded_sha256"))


def op13_sale_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sale_versions.enrich_sales(table(spark, sf_dir, "sales"), table(spark, sf_dir, "client_changes"))


OPERATORS = (op1_line_dedup, op2_quality_model, op3_quality_rules, op4_decontaminate, op5_pii, op6_warc, op7_near_duplicates, op8_packing, op9_sstable, op10_chat, op11_whitening, op12_byte_bpe, op13_sale_versions)
BUILDERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in OPERATORS}
SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op6_warc": warc.OP6_SQL,
    "op13_sale_versions": sale_versions.OP13_SQL,
}
