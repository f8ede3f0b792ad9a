"""Conversation analytics over ``conv_id, turn, role, text``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words between blanks: engines differ on whether an accented letter ends a word.
LANGUAGES = {k: f"(^| )({w})( |$)" for k, w in {"english": "the|and|of", "german": "der|die|und", "french": "le|la|les", "spanish": "el|que|los"}.items()}


def bounds(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.min("turn").alias("first"), F.max("turn").alias("last"), F.count("*").alias("n_turns"), F.sum(F.length("text")).cast("long").alias("n_chars"))


def keyword_profile(turns: DataFrame) -> DataFrame:
    """``keyword, turns``: turns that bear a group's words, in one pass."""
    counted = turns.agg(*[F.count_if(F.lower("text").rlike(p)).alias(k) for k, p in LANGUAGES.items()])
    return counted.select(F.explode(F.create_map(*[x for k in LANGUAGES for x in (F.lit(k), F.col(k))])).alias("keyword", "turns"))


def compact(turns: DataFrame, budget: int) -> DataFrame:
    """The newest turns of each conversation whose lengths fit the budget together."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("used", F.sum(F.length("text")).over(w)).where(F.col("used") <= budget).select("conv_id", "turn", "used")


def problems(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, problem``: users' sentences that ask."""
    asked = F.regexp_extract("text", r"([^.\n?]*[?])", 1)
    return turns.where("role = 'user'").select("conv_id", "turn", F.trim(asked).alias("problem")).where("problem <> ''")


def settings_flat(docs: DataFrame, ident: str, column: str) -> DataFrame:
    """``ident, key, value`` of the top level of JSON objects."""
    parsed = F.from_json(F.col(column), "map<string,string>")
    return docs.select(ident, F.explode(parsed).alias("key", "value"))


#: What announces a decision, in order; and a quoted file.
DECISIONS = (r"(?i)Let me\s+(\w+)", r"(?i)I('ll| will)\s+(\w+)", r"(?i)decided to\s+(\w+)")
FILE = r"`([^`]+\.[a-zA-Z]+)`"


def digest(turns: DataFrame, *, decisions: int = 5, files: int = 15) -> DataFrame:
    """``conv_id, kind, place, value``: what a conversation comes to, without a model.

    ``reasoning``: the first 500 signs of the assistant's first turn. ``decision``: of each of its turns the first announcement, the
    earliest ``decisions`` of them. ``file``: files quoted by anyone, each once, the ``files`` first mentioned. Equal turns go by
    value; a null turn comes first; null texts hold nothing. Turns without a conversation are one. Only what was found is shuffled,
    and each task sends no more than the limits of a conversation."""
    from pyspark.sql import Window

    said = turns.where("text is not null").select("conv_id", "turn", "role", "text")
    own = said.where("role = 'assistant'")
    first = own.groupBy("conv_id").agg(F.min(F.struct("turn", F.left("text", F.lit(500)).alias("v"))).alias("m")).select("conv_id", F.lit("reasoning").alias("kind"), F.lit(1).alias("place"), F.col("m.v").alias("value"))
    announced = F.coalesce(*[F.nullif(F.regexp_extract("text", p, 0), F.lit("")) for p in DECISIONS])
    decided = own.select("conv_id", "turn", F.left(announced, F.lit(100)).alias("value")).where("value is not null")
    quoted = said.select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit(FILE), F.lit(1))).alias("value")).groupBy("conv_id", "value").agg(F.min("turn").alias("turn"))

    def earliest(found: DataFrame, kind: str, most: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "value"))
        return found.withColumn("place", place).where(F.col("place") <= most).select("conv_id", F.lit(kind).alias("kind"), "place", "value")

    return first.unionByName(earliest(decided, "decision", decisions)).unionByName(earliest(quoted, "file", files)).withColumn("place", F.col("place").cast("long"))
