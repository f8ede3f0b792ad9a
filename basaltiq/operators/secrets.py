"""Candidate secrets in texts: token forms and assignments to risky names, each with the entropy of its own value.

Every rule is an expression on a line, so the scan is one pass without a shuffle; lines without a candidate go before anything
is counted. A candidate lies in one line (lines end at ``\\n``). Null and empty texts have none; repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Token forms.
TOKENS = (
    ("aws_access_key", r"AKIA[0-9A-Z]{16}", "critical"),
    ("aws_secret_key", r"(?i)(aws_secret_access_key|secret_access_key)\s*[=:]\s*['\"]([A-Za-z0-9/+=]{40})['\"]", "critical"),
    ("github_token", r"ghp_[A-Za-z0-9]{36}", "critical"),
    ("private_key", r"-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", "critical"),
)
#: Names that are assigned secrets, and a quoted value.
NAMES = r"(?:password|passwd|secret|api_key|apikey|token|credential|private_key|access_key)\s*[=:]"
VALUE = r"['\"]([^'\"]{8,})['\"]"
ASSIGNED = rf"(?i){NAMES}\s*{VALUE}"
#: How risky a name is; the first that it holds decides.
RISK = (
    ("password", 0.9), ("passwd", 0.9), ("secret", 0.85), ("api_key", 0.8), ("apikey", 0.8), ("token", 0.7), ("credential", 0.85), ("private_key", 0.9),
    ("access_key", 0.75), ("auth", 0.6),
)
NO_RISK = 0.1
#: Signs of a value that stands for a secret, and of a line that reads one from the environment.
PLACEHOLDERS = ("your-", "example", "placeholder", "dummy", "fake", "test", "sample", "xxx", "change_me", "replace_me")
ENVIRONMENT = ("os.environ", "getenv", "process.env")
DAMPED = 0.3


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def entropy(value: Column) -> Column:
    """Shannon entropy of a value's characters, in bits: counted inside the row, once for each distinct character."""
    signs = F.filter(F.array_distinct(F.split(value, "")), lambda c: c != "")
    times = F.transform(signs, lambda c: (F.length(value) - F.length(F.replace(value, c, F.lit("")))).cast("double"))
    total = F.aggregate(times, F.lit(0.0), lambda s, n: s + n * F.log2(n))
    return F.when(F.length(value) > 0, F.log2(F.length(value)) - total / F.length(value)).otherwise(0.0)


def _matches(pattern: str, made: Callable[[Column], Column]) -> Column:
    return F.transform(F.regexp_extract_all("l", F.lit(f"({pattern})"), F.lit(1)), lambda m: made(m))


def candidates(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """``ident, line, kind, severity, name, n_chars, entropy, risk, confidence, reason``, a row for each candidate.

    ``confidence`` grows with the entropy of the candidate itself: for token forms up to 1, for assignments times the name's
    risk. A placeholder damps both; a line that reads the environment damps an assignment. ``reason`` says which."""
    lines = docs.select(ident, F.posexplode(F.split(text, "\n")).alias("i", "l")).where(F.col("l").rlike("|".join(f"(?:{p})" for p in (*(p for _, p, _ in TOKENS), ASSIGNED))))
    none = F.lit(None).cast("string")
    each = [_matches(p, lambda m, k=kind, s=severity: F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"), none.alias("name"), m.alias("value"))) for kind, p, severity in TOKENS]
    whole_name, whole_value = f"(?i)^({NAMES})", f"{VALUE}$"
    named = _matches(ASSIGNED, lambda m: F.struct(F.lit("high_risk_variable").alias("kind"), none.alias("severity"), F.regexp_extract(m, whole_name, 1).alias("name"), F.regexp_extract(m, whole_value, 1).alias("value")))
    found = lines.select(ident, (F.col("i") + 1).cast("long").alias("line"), "l", F.explode(F.concat(*each, named)).alias("c")).select(ident, "line", "l", "c.*")
    lower = F.lower("name")
    risk = F.when(F.col("name").isNotNull(), F.coalesce(*[F.when(F.contains(lower, F.lit(w)), F.lit(r)) for w, r in RISK], F.lit(NO_RISK)))
    placeholder, environment = _holds(F.lower("value"), PLACEHOLDERS), _holds(F.col("l"), ENVIRONMENT)
    reason = F.when(placeholder, "placeholder").when(environment, "environment").otherwise("candidate")
    scored = found.withColumns({"risk": risk, "entropy": entropy(F.col("value")), "reason": reason})
    likely = F.col("entropy") / 4 + 0.5
    token = F.least(F.lit(1.0), likely) * F.when(placeholder, DAMPED).otherwise(1.0)
    assigned = F.col("risk") * F.when(F.col("reason") == "candidate", likely).otherwise(DAMPED)
    return scored.select(
        ident, "line", "kind", F.coalesce("severity", F.when(F.col("risk") > 0.7, "high").otherwise("medium")).alias("severity"), F.rtrim(F.regexp_replace("name", r"[=:]$", "")).alias("name"),
        F.length("value").cast("long").alias("n_chars"), F.round("entropy", 5).alias("entropy"), "risk", F.round(F.when(F.col("name").isNull(), token).otherwise(assigned), 5).alias("confidence"), "reason")
