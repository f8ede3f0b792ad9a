"""Many names sought in many texts at once, without pairing each with each.

A name is hung on its anchor: of the runs of ``GRAM`` signs without a blank in it, the one that the fewest words of texts hold (a name of shorter words is hung on
its longest word). A text that contains a name contains its anchor, so texts meet only the names whose anchors they hold; then the
name is looked up in the text. Anchors are sought in the different words of all texts, and texts meet them by their words; words with
anchors are broadcast behind a count. Texts are shuffled once, with their candidates.

Defined results. Null texts and names, and names without a visible sign, give no rows. Names and texts that stand twice count once. Case counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basaltiq.operators.graph import cut

GRAM = 4
#: Anchors that are broadcast; each takes some tens of bytes.
BROADCAST_ROWS = 1_000_000


def _grams(text: Column, n: int) -> Column:
    """Every run of n signs without a blank, overlapping, by one scan of the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?=(\S{{{n}}}))"), F.lit(1))


def _candidates(names: DataFrame) -> DataFrame:
    """``name, anchor``: all anchors that a name could hang on."""
    longest = F.array_max(F.transform(F.regexp_extract_all("name", F.lit(r"\S+"), F.lit(0)), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    anchors = F.when(longest["n"] >= GRAM, F.array_distinct(_grams(F.col("name"), GRAM))).otherwise(F.array(longest["w"]))
    return names.where(F.col("name").rlike(r"\S")).select("name", F.explode(anchors).alias("anchor"))


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """``id, name`` of ``texts (id, text)`` and ``names (name)``: the names that each text contains, also within its words."""
    known = cut(_candidates(names.select("name").distinct()))
    lengths = sorted(r[0] for r in known.select(F.length("anchor")).distinct().collect())  # at most GRAM numbers
    own = texts.select("id", "text").where("text is not null")
    if not lengths:
        return own.select("id", F.lit("").alias("name")).limit(0)
    held = own.select("id", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("word"))
    # An anchor has no blank, so it lies in a word; each different word is scanned once, not each text.
    vocabulary = held.groupBy("word").agg(F.count("*").alias("texts"))
    grams = F.array_distinct(F.flatten(F.array(*[_grams(F.col("word"), n) for n in lengths])))
    spots = cut(vocabulary.select("word", "texts", F.explode(grams).alias("anchor")).join(_few(known.select("anchor").distinct()), "anchor", "left_semi"))
    counts = spots.groupBy("anchor").agg(F.sum("texts").alias("texts"))
    # A name of which some candidate is in no text is in none itself.
    rare = known.join(counts, "anchor", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "anchor")).alias("m")).where("m.texts > 0")
    hung = cut(rare.select("name", F.col("m.anchor").alias("anchor")))
    at = cut(spots.select("word", "anchor").join(hung, "anchor").select("word", "name").distinct())
    met = held.join(_few(at), "word").groupBy("id").agg(F.collect_set("name").alias("names"))
    found = own.join(met, "id").select("id", F.explode(F.filter("names", lambda n: F.contains(F.col("text"), n))).alias("name"))
    return found.distinct()


def package_references(packages: DataFrame, files: DataFrame) -> DataFrame:
    """``package, language, id, file_language, confidence`` of ``packages (package, language)`` and ``files (id, text, language)``: files of another language
    whose text contains a package's name, whatever the case of both. A file or package without a language is of another one."""
    own = packages.select("package", "language", F.lower("package").alias("name")).distinct()
    of = files.select("id", F.col("language").alias("file_language")).distinct()
    found = mentions(files.select("id", F.lower("text").alias("text")), own)
    rows = found.join(own, "name").join(of, "id").where(~F.coalesce(F.col("language") == F.col("file_language"), F.lit(False)))
    return rows.select("package", "language", "id", "file_language", F.lit(0.5).alias("confidence"))
