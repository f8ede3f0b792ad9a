"""The corpus pipeline: each stage is one operator over all that the stage before it kept, written as Parquet between.

Defined results, by stage. Quality rules: null and empty texts go, repeated rows share a verdict, null ids are judged like
any. Line dedup: null and empty texts become empty ones; repeated rows lose the same lines; rows with a null id lose none.
Near copies: texts without words all stay; of equal rows one stays; among ties the smallest id, a null id last.
Decontamination: texts without words stay; repeated rows share a verdict. Packing: a null or empty text is its end id. An
empty table gives an empty one in every stage, and extra columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltiq.llm import decontaminate, line_dedup, near_duplicates, packing, quality_rules
from basaltiq.llm.common import table, written
from basaltiq.llm.queries import tokenizer_path


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that fail the base rules or the likelihood ratio go."""
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("whole_row"))
    judged = quality_rules.judge(whole, table(spark, sf_dir, "labels"), keep=("whole_row",))
    # A row number keeps the filter above the verdict: pushed below, it would repeat all its nested expressions.
    return judged.withColumn("row_number", F.monotonically_increasing_id()).where("kept and row_number >= 0").select("whole_row.*")


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: each document with the lines that stay; ``n_chars`` is that of the new text."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    kept = line_dedup.dedup_lines(docs, keep=rest)
    made = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")} | {c: F.col(f"x_{c}") for c in rest}
    return kept.select(*[made[c].alias(c) if c in made else F.col(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each group stays, that with the smallest id."""
    return near_duplicates.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with a twentieth of their words or more in benchmark windows go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixture-controlled packing into sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer=tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", drop_low_quality),
    ("line_dedup", drop_common_lines),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


BUILDERS = {"pipeline": run}
SQL: dict[str, str] = {}
