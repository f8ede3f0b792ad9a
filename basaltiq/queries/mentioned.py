"""Names of packages in texts (X26): openings of benchmark items stand for the names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltiq.operators import patterns
from basaltiq.registry import CORE
from basaltiq.sources.tables import read

Q = CORE.query


LANGUAGE = "CASE item_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' END"


@Q(rf"""WITH w AS (SELECT string_split(text, ' ') AS w, {LANGUAGE} AS language FROM benchmark), p AS (SELECT DISTINCT unnest([w[1], w[1] || ' ' || w[2] || ' ' || w[3], w[4]]) AS package, language FROM w)
SELECT DISTINCT package, p.language, doc_id AS id, lang AS file_language, 0.5::DOUBLE AS confidence FROM documents, p
WHERE regexp_matches(package, '\S') AND contains(lower(text), lower(package)) AND coalesce(p.language <> lang, true)""")
def package_references(spark: SparkSession, d: str) -> DataFrame:
    words = F.split("text", " ")
    word = lambda k: F.get(words, F.lit(k))
    names = F.explode(F.array(word(0), F.concat(word(0), F.lit(" "), word(1), F.lit(" "), word(2)), word(3)))
    packages = read(spark, d, "benchmark").select(names.alias("package"), F.expr(LANGUAGE).alias("language"))
    return patterns.package_references(packages, read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("language")))
