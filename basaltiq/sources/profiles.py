"""Profiles of delimited files: which sign parts the cells, and what each column holds. Whole files and tables are counted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: In order of preference where several part the lines alike.
DELIMITERS = (",", ";", "\t", "|")
NUMBER = r"^-?[0-9]+([.][0-9]+)?$"


def delimiters(spark: SparkSession, path: str) -> DataFrame:
    """``file, delimiter, columns, share``: for each file the sign of which most lines hold the same number, outside of quotes; one
    row a file. Blank lines do not count. ``share`` is that part of the lines; a file without any such sign has one column and
    no delimiter. Only counts are shuffled: a few for each file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r'"([^"]|"")*"', "").alias("l")).where("trim(l) <> ''")
    counted = [F.struct(F.lit(i).alias("i"), F.lit(d).alias("delimiter"), (F.length("l") - F.length(F.replace("l", F.lit(d), F.lit("")))).alias("k")) for i, d in enumerate(DELIMITERS)]
    groups = lines.select("file", F.explode(F.array(*counted)).alias("c")).groupBy("file", "c").agg(F.count("*").alias("n"))
    total = F.sum(F.when(F.col("c.i") == 0, F.col("n")))
    # Most lines first, then most columns, then the preferred sign.
    rank = F.struct("n", F.col("c.k").alias("k"), (-F.col("c.i")).alias("i"))
    best = groups.groupBy("file").agg(total.alias("lines"), F.max_by(F.struct("c", "n"), F.when(F.col("c.k") > 0, rank)).alias("best"))
    return best.select("file", F.col("best.c.delimiter").alias("delimiter"), F.coalesce(F.col("best.c.k") + 1, F.lit(1)).cast("long").alias("columns"), F.round(F.coalesce(F.col("best.n") / F.col("lines"), F.lit(1.0)), 4).alias("share"))


def column_details(df: DataFrame, *, samples: int = 5) -> DataFrame:
    """``column_name, n_filled, n_empty, n_distinct, kind, lo, hi, mean, samples``: a row for each column, read as text.

    Null and empty cells are empty. A column is numeric if more than half of its filled cells are; ``lo``, ``hi`` and ``mean`` are
    those of its numbers, null for text. ``samples`` are its smallest values, joined by ``|``. Cells are counted by value before
    they are shuffled, so a frequent value costs a row a task. A table without rows gives text columns of no cells."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("v")) for c in df.columns])
    values = df.select(F.explode(cells).alias("c")).groupBy(F.col("c.column_name").alias("column_name"), F.nullif(F.col("c.v"), F.lit("")).alias("v")).agg(F.count("*").alias("n"))
    filled, x = F.col("v").isNotNull(), F.when(F.col("v").rlike(NUMBER), F.col("v").cast("double"))
    known = reduce(DataFrame.unionByName, [df.sparkSession.range(1).select(F.lit(c).alias("column_name")) for c in df.columns])
    n, numbers = F.when(filled, F.col("n")), F.when(x.isNotNull(), F.col("n"))
    made = values.groupBy("column_name").agg(
        F.sum(n).alias("filled"), F.sum(F.when(~filled, F.col("n"))).alias("empty"), F.count("v").alias("n_distinct"), F.sum(numbers).alias("numbers"),
        F.min(x).alias("lo"), F.max(x).alias("hi"), (F.sum(x * F.col("n")) / F.sum(numbers)).alias("mean"))
    first = values.where(filled).withColumn("r", F.row_number().over(Window.partitionBy("column_name").orderBy("v"))).where(F.col("r") <= samples)
    shown = first.groupBy("column_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda s: s["v"]), "|").alias("samples"))
    numeric = F.coalesce(F.col("numbers") * 2 > F.col("filled"), F.lit(False))
    return known.join(made, "column_name", "left").join(shown, "column_name", "left").select(
        "column_name", *[F.coalesce(c, F.lit(0)).cast("long").alias(name) for c, name in (("filled", "n_filled"), ("empty", "n_empty"), ("n_distinct", "n_distinct"))],
        F.when(numeric, "numeric").otherwise("text").alias("kind"), *[F.when(numeric, F.col(c)).alias(c) for c in ("lo", "hi")], F.when(numeric, F.round("mean", 2)).alias("mean"), "samples")
