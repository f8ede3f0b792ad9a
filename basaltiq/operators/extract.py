"""Rule tables over texts: secrets, tags, masks, chunks, complexity, routes and symbols.

Rules are a fixed list in the code, so they become expressions of one pass and no join.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basaltiq.operators.graph import cut, layers

Rule = tuple[str, str, str]  # name, severity, pattern

RULES: list[Rule] = [
    ("aws_key", "critical", r"AKIA[0-9A-Z]{16}"), ("token", "high", r"token = \"[0-9a-f]{16,}\""), ("password", "high", r"password=[0-9A-Za-z]{6,}"),
    ("email", "medium", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+"), ("ssn", "high", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), ("ip", "low", r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"), ("license", "low", r"[Ll]icense"),
]


def scan(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``doc_id, rule, severity, n``: matches of each rule."""
    counts = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"), F.regexp_count("text", F.lit(p)).cast("long").alias("n")) for n, s, p in rules])
    return docs.select("doc_id", F.explode(counts).alias("f")).select("doc_id", "f.*").where("n > 0")


def findings(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``doc_id, line, col, rule, hit``: the first match of each rule in each line."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "l"))
    first = F.array(*[F.struct(F.lit(n).alias("rule"), F.regexp_extract("l", f"({p})", 1).alias("hit")) for n, _, p in rules])
    hits = lines.select("doc_id", (F.col("i") + 1).cast("long").alias("line"), "l", F.explode(F.filter(first, lambda x: x["hit"] != "")).alias("f"))
    return hits.select("doc_id", "line", F.instr("l", F.col("f.hit")).cast("long").alias("col"), "f.rule", "f.hit")


def mask(text: Column, rules: list[Rule] = RULES) -> Column:
    for name, severity, pattern in rules:
        if severity in ("critical", "high", "medium"):
            text = F.regexp_replace(text, pattern, f"[{name}]")
    return text


def action(text: Column, rules: list[Rule] = RULES) -> Column:
    """block, mask or allow by the worst rule that matches."""
    any_of = lambda level: F.coalesce(text.rlike("|".join(f"(?:{p})" for _, s, p in rules if s in level)), F.lit(False))
    return F.when(any_of(("critical",)), "block").when(any_of(("high", "medium")), "mask").otherwise("allow")


def entropy(df: DataFrame, ident: str, text: str) -> DataFrame:
    """Shannon entropy of the characters, in bits; null texts have none. Rows are dealt before their characters are counted: a short
    table lies in one file, and its one task would hold a count for every character of every row."""
    dealt = df.select(ident, text).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), ident, text)
    chars = dealt.select(ident, F.explode(F.split(F.col(text), "")).alias("c")).where("c <> ''").groupBy(ident, "c").agg(F.count("*").alias("n"))
    total = chars.groupBy(ident).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return total.select(ident, F.round(F.log2("t") - F.col("s") / F.col("t"), 5).alias("entropy"))


TYPES = {"rule": r"\b(must|shall|never|always)\b", "decision": r"\b(decided|chose|because)\b", "pattern": r"\b(pattern|approach)\b", "example": r"\b(example|for)\b"}


def knowledge_chunks(docs: DataFrame, least: int = 15) -> DataFrame:
    """``doc_id, kind, content``: sentences that bear a type's words; of equal openings (100 characters) the first stays."""
    s = docs.select("doc_id", F.posexplode(F.split("text", r"[.\n]")).alias("i", "s")).select("doc_id", "i", F.trim("s").alias("content")).where(F.length("content") >= least)
    kinds = F.array_compact(F.array(*[F.when(F.lower("content").rlike(p), F.lit(k)) for k, p in TYPES.items()]))
    typed = s.select("doc_id", "i", "content", F.explode(kinds).alias("kind"))
    key = F.md5(F.lower(F.left("content", F.lit(100))))
    first = typed.groupBy("kind", key.alias("key")).agg(F.min_by(F.struct("doc_id", "content"), F.struct("doc_id", "i")).alias("c"))
    return first.select("c.doc_id", "kind", "c.content")


def importance(text: Column) -> Column:
    """Weighted signals: .3 structure words, .2 critical words, .2 length class, .1 names, .1 modules, .1 length."""
    t = F.lower(text)
    share = lambda ws: F.least(F.lit(1.0), sum((F.when(t.contains(w), 1).otherwise(0) for w in ws), F.lit(0)) / F.lit(2.0))
    names = F.least(F.lit(1.0), F.regexp_count(text, F.lit(r"\b[A-Z][a-z]+[A-Z][a-z]+\b")) / 5.0)
    modules = F.least(F.lit(1.0), F.regexp_count(text, F.lit(r"\b[a-z]+_[a-z]+\b")) / 3.0)
    size = F.least(F.lit(1.0), F.length(text) / 500.0)
    return 0.3 * share(("service", "layer", "module")) + 0.2 * share(("critical", "must", "never")) + 0.2 * F.when(F.length(text) > 1000, 1.0).otherwise(0.5) + 0.1 * names + 0.1 * modules + 0.1 * size


def complexity(text: Column) -> dict[str, Column]:
    """Branch words, comment share and a maintainability index of a text."""
    branches = F.regexp_count(text, F.lit(r"\b(if|for|while|and|or|except|case)\b"))
    lines = F.size(F.split(text, "\n"))
    comments = F.regexp_count(text, F.lit(r"(?m)^\s*#"))
    index = F.greatest(F.lit(0.0), 100 - 0.23 * branches - 16.2 * F.log(F.greatest(lines, F.lit(1))) / 10)
    return {"cyclomatic": (branches + 1).cast("long"), "comment_density": F.round(comments / F.greatest(lines, F.lit(1)), 6), "maintainability": F.round(index, 4)}


def slop(text: Column) -> Column:
    parts = [(r"\b(very|really|just|quite)\b", 5), (r"!!", 3), (r"[*#$%&]{3}", 2), (r"\b(thing|stuff)\b", 5)]
    total = sum((F.least(F.regexp_count(text, F.lit(p)) * w, F.lit(100)) for p, w in parts), F.lit(0))
    return F.round(total / len(parts), 4)


def readability(text: Column) -> Column:
    """Flesch reading ease with vowel groups for syllables."""
    n_words = F.greatest(F.regexp_count(text, F.lit(r"[A-Za-z]+")), F.lit(1))
    n_sentences = F.greatest(F.regexp_count(text, F.lit(r"[.!?]+")), F.lit(1))
    syllables = F.greatest(F.regexp_count(text, F.lit(r"(?i)[aeiouy]+")), F.lit(1))
    return F.round(206.835 - 1.015 * n_words / n_sentences - 84.6 * syllables / n_words, 6)


def links(pages: DataFrame) -> DataFrame:
    """``page_id, target``: distinct link targets."""
    return pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1))).alias("target"))


def routes(sources: DataFrame) -> DataFrame:
    """``path, method, route, handler`` of decorator-style routes; the handler is the next definition."""
    w = Window.partitionBy("path").orderBy("i").rowsBetween(1, 5)
    lines = sources.select("path", F.posexplode(F.split("text", "\n")).alias("i", "l"))
    named = lines.withColumn("handler", F.first(F.nullif(F.regexp_extract("l", r"^\s*(?:async )?def (\w+)", 1), F.lit("")), ignorenulls=True).over(w))
    hit = named.where(F.col("l").rlike(r"^\s*@\w+\.(get|post|put|delete|patch|route)\("))
    return hit.select("path", F.upper(F.regexp_extract("l", r"@\w+\.(\w+)\(", 1)).alias("method"), F.regexp_extract("l", r"\([\"']([^\"']*)", 1).alias("route"), "handler")


def orm_models(sources: DataFrame) -> DataFrame:
    """``path, model, table``: declarative classes with a table name."""
    found = F.regexp_extract_all("text", F.lit(r"class (\w+)\([^)]*\):\s+__tablename__ = [\"']\w+"), 1)
    table = F.regexp_extract_all("text", F.lit(r"class \w+\([^)]*\):\s+__tablename__ = [\"'](\w+)"), 1)
    return sources.select("path", F.explode(F.arrays_zip(found.alias("model"), table.alias("table"))).alias("m")).select("path", "m.model", "m.table")


def sql_tables(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\b(?:from|join|into|update)\s+([a-z_][a-z0-9_]*)"), 1))


SYMBOLS = "path string, name string, kind string, parent string, start_line long, end_line long, calls array<string>"


def python_symbols(sources: DataFrame) -> DataFrame:
    """Symbols of Python sources ``(path, text)`` by the standard parser; files that do not parse give no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"], strict=True):
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError, RecursionError):
                    continue
                todo: list[tuple[ast.AST, str | None]] = [(tree, None)]
                while todo:
                    node, parent = todo.pop()
                    for child in ast.iter_child_nodes(node):
                        if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                            kind = "class" if isinstance(child, ast.ClassDef) else "method" if isinstance(node, ast.ClassDef) else "function"
                            calls = [] if kind == "class" else [c.func.attr if isinstance(c.func, ast.Attribute) else c.func.id for c in ast.walk(child) if isinstance(c, ast.Call) and isinstance(c.func, ast.Attribute | ast.Name)]
                            rows.append((path, child.name, kind, parent, child.lineno, child.end_lineno, calls))
                            todo.append((child, child.name))
                        else:
                            todo.append((child, parent))
            yield pd.DataFrame(rows, columns=["path", "name", "kind", "parent", "start_line", "end_line", "calls"])

    return sources.select("path", "text").mapInPandas(run, SYMBOLS)


def call_edges(symbols: DataFrame) -> DataFrame:
    """``src, dst, weight`` by name, without calls to oneself."""
    calls = symbols.where("kind <> 'class'").select(F.concat_ws("::", "path", "name").alias("src"), "name", F.explode("calls").alias("callee"))
    named = symbols.select(F.col("name").alias("callee"), F.concat_ws("::", "path", "name").alias("dst"))
    return calls.join(named, "callee").where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def shared_state(sources: DataFrame) -> DataFrame:
    """``path, name``: module-level mutable values that functions write through ``global``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"], strict=True):
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError, RecursionError):
                    continue
                own = {t.id for n in tree.body if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name)}
                rows += [(path, name) for name in sorted(own & {x for n in ast.walk(tree) if isinstance(n, ast.Global) for x in n.names})]
            yield pd.DataFrame(rows, columns=["path", "name"])

    return sources.select("path", "text").mapInPandas(run, "path string, name string")


def _merged(name: str, lists: list[list[str]]) -> list[str] | None:
    """The name, then always the first head that stands in no other list's tail; None where there is no such head."""
    out = [name]
    while lists := [x for x in lists if x]:
        head = next((x[0] for x in lists if not any(x[0] in y[1:] for y in lists)), None)
        if head is None:
            return None
        out.append(head)
        lists = [x[1:] if x[0] == head else x for x in lists]
    return out


def _linear(names: pd.Series, parents: pd.Series) -> pd.Series:
    """A class from its bases ``(base, mro)``, in order; None where a base has none."""

    def one(name: str, own: list[dict]) -> list[str] | None:
        if any(x["mro"] is None for x in own):
            return None
        return _merged(name, [*[list(x["mro"]) for x in own], [x["base"] for x in own]])

    return pd.Series([one(n, list(p)) for n, p in zip(names, parents, strict=True)])


def mro(classes: DataFrame) -> DataFrame:
    """``name, mro``: C3 linearisation of ``classes (name, bases)``; inconsistent or cyclic ones, and what builds on them, have none.
    What stands in several rows is the union of its bases; bases that are no rows have no bases.

    Classes are linearised in topological waves, each from the arrays of its own bases: a row at a time, so that no task sees more
    of a hierarchy than a class and its bases, whatever joins them above."""
    own = cut(classes.groupBy("name").agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce("bases", F.array().cast("array<string>"))))).alias("bases")))
    links = cut(own.select("name", F.posexplode("bases").alias("place", "base")))
    waves = cut(layers(links.select(F.col("base").alias("src"), F.col("name").alias("dst")), own.select(F.col("name").alias("id"))))
    linear = F.pandas_udf(_linear, "array<string>")
    known = cut(waves.where("layer = 0").select(F.col("id").alias("name"), F.array("id").alias("mro")))
    highest = waves.agg(F.max("layer").alias("n")).first().n or 0
    done = [known]
    for level in range(1, highest + 1):
        wave = waves.where(F.col("layer") == level).select(F.col("id").alias("name"))
        # Bases may stand in any lower wave.
        below = reduce(DataFrame.unionByName, done).withColumnRenamed("name", "base")
        own_bases = links.join(wave, "name", "left_semi").join(below, "base")
        gathered = own_bases.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("place", "base", "mro"))).alias("parents"))
        done.append(cut(gathered.select("name", linear("name", F.transform("parents", lambda x: F.struct(x["base"].alias("base"), x["mro"].alias("mro")))).alias("mro"))))
    return own.select("name").join(reduce(DataFrame.unionByName, done), "name", "left")


def overrides(linear: DataFrame, methods: DataFrame) -> DataFrame:
    """``name, method, overridden``: methods ``(name, method)`` that the nearest class after the own one in ``linear (name, mro)`` defines too."""
    after = linear.select("name", F.posexplode("mro").alias("place", "above")).where("place > 0")
    theirs = methods.select(F.col("name").alias("above"), "method").distinct()
    near = methods.distinct().join(after, "name").join(theirs, ["above", "method"])
    return near.groupBy("name", "method").agg(F.min_by("above", "place").alias("overridden"))
