"""Sources and sinks: repository walks, text, CSV, JSON, logs, profiles, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltiq.functions.text import glob_to_regex


def walk(spark: SparkSession, root: str, *, most_bytes: int = 10 << 20, pattern: str | None = None) -> DataFrame:
    """``path, length, modificationTime`` of the files below ``root`` up to a size; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(root)
    return files.where(F.col("length") <= most_bytes).select("path", "length", "modificationTime")


def contents(spark: SparkSession, root: str, *, most_bytes: int = 10 << 20) -> DataFrame:
    """``path, text, hash`` of the files up to a size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= most_bytes)
    return files.select("path", F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("hash"))


def ignored(path: Column, rules: list[str]) -> Column:
    """Ignore rules: the last one that matches decides; ``!`` takes back, ``/`` anchors, a trailing ``/`` means a folder."""
    out = F.lit(False)
    for rule in rules:
        rule = rule.strip()
        if not rule or rule.startswith("#"):
            continue
        back = rule.startswith("!")
        body = rule[1:] if back else rule
        folder, anchored = body.endswith("/"), "/" in body.rstrip("/")
        core = glob_to_regex(body.strip("/")).removeprefix("(?s)^").removesuffix("$").replace(".*", "[^/]*")
        out = F.when(path.rlike(("^" if anchored else "(^|/)") + core + ("/" if folder else "(/|$)")), F.lit(not back)).otherwise(out)
    return out


KINDS = {
    "code": ("py", "js", "ts", "java", "go", "rs", "c", "cpp", "h", "cs", "rb", "php", "kt", "swift", "sql", "sh"), "document": ("md", "rst", "txt", "html", "docx", "odt"),
    "paper": ("pdf", "tex"), "image": ("png", "jpg", "jpeg", "gif", "svg", "webp"), "office": ("xlsx", "pptx", "csv"), "video": ("mp4", "mov", "avi", "mkv"),
}


def classify(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit("other")
    for kind, extensions in KINDS.items():
        out = F.when(extension.isin(*extensions), kind).otherwise(out)
    return out


def read_csv(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return spark.read.options(header="true", inferSchema="true", multiLine="true", **options).csv(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", "true").json(path)


def flatten(df: DataFrame, depth: int = 4) -> DataFrame:
    """Nested structs as dotted names, to a depth."""
    from pyspark.sql.types import StructType

    for _ in range(depth):
        if not any(isinstance(f.dataType, StructType) for f in df.schema):
            break
        cols: list[Column] = []
        for f in df.schema:
            if isinstance(f.dataType, StructType):
                cols += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}_{g.name}") for g in f.dataType]
            else:
                cols.append(F.col(f"`{f.name}`"))
        df = df.select(*cols)
    return df


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """``file, ts, level, message`` of log lines, gzip included."""
    from basaltiq.operators.logs import parse_level, parse_timestamp

    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return rows.select("file", parse_timestamp(F.col("value")).alias("ts"), parse_level(F.col("value")).alias("level"), F.col("value").alias("message"))


def json_profile(docs: DataFrame, column: str) -> DataFrame:
    """``kind, n, max_depth``: JSON types of the top-level values, and how deep the deepest of each nests; a scalar has depth 0."""
    pairs = docs.select(F.explode(F.from_json(F.col(column), "map<string,string>")).alias("key", "v"))
    kind = F.when(F.col("v").isNull(), "null").when(F.col("v").rlike(r"^-?[0-9]+(\.[0-9]+)?$"), "number").when(F.col("v").isin("true", "false"), "boolean").when(F.col("v").startswith("{"), "object").when(F.col("v").startswith("["), "array").otherwise("string")
    bare = F.regexp_replace(F.regexp_replace("v", r'"(\\.|[^"\\])*"', ""), r"[^\[\]{}]", "")
    step = lambda s, c: F.struct((s["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("now"), F.greatest(s["most"], s["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("most"))
    signs = F.filter(F.split(bare, ""), lambda c: c != "")
    deep = F.aggregate(signs, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda s: s["most"])
    own = pairs.select(kind.alias("kind"), F.when(kind.isin("object", "array"), deep).otherwise(0).alias("depth"))
    return own.groupBy("kind").agg(F.count("*").alias("n"), F.max("depth").alias("max_depth"))


def export(df: DataFrame, path: str, fmt: str) -> None:
    """JSON lines, CSV or Parquet, in as many parts as the data has; JSON and CSV compressed."""
    writer = df.write.mode("errorifexists")
    if fmt in ("json", "csv"):
        writer = writer.option("compression", "gzip").option("header", "true")
    writer.format(fmt).save(path)


def markdown(df: DataFrame, order: list[str], limit: int | None = None) -> DataFrame:
    """One row ``markdown``: a table of all rows, or of the first ``limit``, in an order. The row grows with the table;
    ``markdown_lines`` gives a row a line instead."""
    rows = df.orderBy(*order).limit(limit) if limit else df
    head = f"| {' | '.join(df.columns)} |\n|{'-|' * len(df.columns)}\n"
    return markdown_lines(rows, order).agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n")).alias("markdown"))


def markdown_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """``k, line``: a line of a markdown table for each row, with its order."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(" |"))
    return df.select(F.struct(*order).alias("k"), cells.alias("line"))
