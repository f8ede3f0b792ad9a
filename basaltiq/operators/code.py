"""Checks of source texts: comment tags, empty bodies, brackets, structure, the security filter, resolution of names.

Line operators take ``sources (path, text)``; a text is split into lines in its row, and windows run within a path.
"""

from __future__ import annotations

import builtins
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Comment tags and their priorities.
COMMENT_TAGS = {
    "TODO": "high", "FIXME": "critical", "XXX": "high", "HACK": "medium", "WARN": "medium", "NOTE": "low", "WIP": "medium", "STUB": "high",
    "REVIEW": "medium", "OPTIMIZE": "low", "DEPRECATED": "medium", "BUG": "critical", "UNDONE": "medium", "CONSIDER": "medium", "QUESTION": "medium",
}

#: What the security filter masks, by name, severity and pattern.
SENSITIVE = [
    ("private_key", "critical", r"-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    ("ssh_private_key", "critical", r"-----BEGIN OPENSSH PRIVATE KEY-----"),
    ("pgp_private_key", "critical", r"-----BEGIN PGP PRIVATE KEY BLOCK-----"),
    ("github_token", "critical", r"(?i)(ghp_|gho_|ghu_|ghs_|ghr_)[A-Za-z0-9_\-]{30,}"),
    ("jwt", "critical", r"eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}"),
    ("slack_token", "critical", r"(?i)(xox[baprs]-[A-Za-z0-9\-]{10,}|slack_token)"),
    ("stripe_live", "critical", r"(?i)(sk_live_|pk_live_)[A-Za-z0-9_\-]{10,}"),
    ("bearer_hardcoded", "critical", r"(?i)(Bearer\s+[A-Za-z0-9_\-\.]{20,}|authorization:\s*Bearer\s+[A-Za-z0-9_\-\.]{20,})"),
    ("docker_auth", "critical", r'"auth"\s*:\s*"[A-Za-z0-9+/=]{20,}"'),
    ("pg_conn", "high", r"(?i)(postgres(ql)?://[A-Za-z0-9_\-]+:[^@]+@[A-Za-z0-9_\-\.]+)"),
    ("mysql_conn", "high", r"(?i)(mysql://[A-Za-z0-9_\-]+:[^@]+@[A-Za-z0-9_\-\.]+)"),
    ("mongodb_conn", "high", r"(?i)(mongodb(\+srv)?://[A-Za-z0-9_\-]+:[^@]+@[A-Za-z0-9_\-\.]+)"),
    ("redis_conn", "high", r"(?i)(redis://:?[^@]+@[A-Za-z0-9_\-\.]+)"),
    ("jdbc_url", "high", r"(?i)jdbc:[a-z]+://[A-Za-z0-9_\-]+:[^@]+@"),
    ("aws_key", "high", r"(?i)(AKIA[0-9A-Z]{16}|aws_access_key_id|aws_secret_access_key)"),
    ("gcp_key", "high", r'"private_key_id"\s*:\s*"[A-Za-z0-9_\-]{20,}"'),
    ("azure_key", "high", r"(?i)(azure_|AZURE_)[A-Za-z0-9_\-]{20,}"),
    ("gitlab_token", "high", r"(?i)(glpat-|gitlab_token|gitlab_access_token)\s*[:=]\s*[\"']?[A-Za-z0-9_\-]{10,}[\"']?"),
    ("stripe_test", "high", r"(?i)(sk_test_|pk_test_)[A-Za-z0-9_\-]{10,}"),
    ("firebase_key", "high", r"(?i)(AIza[A-Za-z0-9_\-]{10,}|firebase_secret|FIREBASE_SECRET)"),
    ("telegram_bot", "high", r"(?i)(\d{8,10}:[A-Za-z0-9_\-]{30,}|telegram_bot_token)"),
    ("slack_webhook", "high", r"(?i)https?://hooks\.slack\.com/services/[A-Za-z0-9/]{20,}"),
    ("twilio_key", "high", r"(?i)(SK[A-Z0-9]{32}|TWILIO_AUTH_TOKEN|twilio_auth_token)"),
    ("cloudflare_api", "high", r"(?i)(cloudflare_api|CF_API|cloudflare_token)\s*[:=]\s*[\"']?[A-Za-z0-9_\-]{20,}[\"']?"),
    ("password", "medium", r"(?i)(password|passwd|pwd)\s*[:=]\s*[\"'][^\"']{4,}[\"']"),
    ("api_key", "medium", r"(?i)(?:api[_-]?key|apikey|api[_-]?secret|api_secret)\s*[:=]\s*[\"']?[A-Za-z0-9_\-]{16,}[\"']?"),
    ("generic_secret", "medium", r"(?i)(secret|secret_key|private_key|encryption_key)\s*[:=]\s*[\"'][A-Za-z0-9_\-]{16,}[\"']"),
    ("github_old_token", "medium", r"(?i)(github_token|github_access_token)\s*[:=]\s*[\"']?[A-Za-z0-9_\-]{20,}[\"']?"),
    ("discord_token", "medium", r"(?i)(discord_token|discord_bot_token)\s*[:=]\s*[\"']?[A-Za-z0-9_\-\.]{20,}[\"']?"),
    ("email_creds", "medium", r"(?i)(smtp_password|imap_password|email_password|mail_password)\s*[:=]\s*[\"'][^\"']+[\"']"),
    ("npm_token", "medium", r"(?i)(npm_token|npm_auth_token|_authToken)\s*[:=]\s*[\"'][A-Za-z0-9_\-]{20,}[\"']"),
    ("heroku_api", "medium", r"(?i)(heroku_api_key|HEROKU_API_KEY)\s*[:=]\s*[\"']?[A-Za-z0-9_\-]{20,}[\"']?"),
    ("sonar_token", "medium", r"(?i)(sonar_token|sonarqube_token|SONAR_TOKEN)\s*[:=]\s*[\"']?[A-Za-z0-9_\-]{20,}[\"']?"),
    ("datadog_key", "medium", r"(?i)(datadog_api_key|datadog_app_key|DD_API_KEY)\s*[:=]\s*[\"']?[A-Za-z0-9_\-]{20,}[\"']?"),
    ("newrelic_key", "medium", r"(?i)(new_relic_license_key|newrelic_api_key|NEW_RELIC)\s*[:=]\s*[\"']?[A-Za-z0-9_\-]{20,}[\"']?"),
    ("sendgrid_key", "medium", r"(?i)(sendgrid_api_key|SENDGRID_API_KEY)\s*[:=]\s*[\"']?[A-Za-z0-9_\-]{20,}[\"']?"),
    ("mailgun_key", "medium", r"(?i)(mailgun_api_key|mailgun_private_key|MAILGUN_API)\s*[:=]\s*[\"']?[A-Za-z0-9_\-]{20,}[\"']?"),
    ("s3_creds", "medium", r"(?i)(s3_access_key|s3_secret_key|aws_access_key|aws_secret_key)"),
    ("ssn", "low", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("credit_card", "low", r"\b(?:\d{4}[-\s]?){3}\d{4}\b"),
    ("ip_private", "low", r"\b(?:10\.\d{1,3}\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2[0-9]|3[0-1])\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3})\b"),
]
#: What is always blocked, and what stands for a secret.
VULGAR = r"(?i)\b(?:NSFW|explicit[_-]?content|adult[_-]?content|xxx)\b"
PLACEHOLDER = "***MASKED***"
#: Of each pattern, in lower case: every match holds one of these. Looking for them is much faster than the patterns, which begin
#: with alternatives in any case. ``RUN`` stands for three digits in a row.
RUN = r"\d{3}"
HELD = {
    "private_key": ["private key-----"], "ssh_private_key": ["-----begin openssh"], "pgp_private_key": ["-----begin pgp"],
    "github_token": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], "jwt": ["eyj"], "slack_token": ["xox", "slack_token"], "stripe_live": ["sk_live_", "pk_live_"],
    "bearer_hardcoded": ["bearer"], "docker_auth": ['"auth"'], "pg_conn": ["postgres"], "mysql_conn": ["mysql://"], "mongodb_conn": ["mongodb"], "redis_conn": ["redis://"],
    "jdbc_url": ["jdbc:"], "aws_key": ["akia", "aws_access_key_id", "aws_secret_access_key"], "gcp_key": ['"private_key_id"'], "azure_key": ["azure_"],
    "gitlab_token": ["glpat-", "gitlab_token", "gitlab_access_token"], "stripe_test": ["sk_test_", "pk_test_"], "firebase_key": ["aiza", "firebase_secret"],
    "telegram_bot": [RUN, "telegram_bot_token"], "slack_webhook": ["hooks.slack.com/services/"], "twilio_key": ["sk", "twilio_auth_token"],
    "cloudflare_api": ["cloudflare_api", "cf_api", "cloudflare_token"], "password": ["password", "passwd", "pwd"], "api_key": ["api"],
    "generic_secret": ["secret", "private_key", "encryption_key"], "github_old_token": ["github_token", "github_access_token"], "discord_token": ["discord_token", "discord_bot_token"],
    "email_creds": ["smtp_password", "imap_password", "email_password", "mail_password"], "npm_token": ["npm_token", "npm_auth_token", "_authtoken"], "heroku_api": ["heroku_api_key"],
    "sonar_token": ["sonar_token", "sonarqube_token"], "datadog_key": ["datadog_api_key", "datadog_app_key", "dd_api_key"], "newrelic_key": ["new_relic", "newrelic_api_key"],
    "sendgrid_key": ["sendgrid_api_key"], "mailgun_key": ["mailgun_api", "mailgun_private_key"], "s3_creds": ["s3_access_key", "s3_secret_key", "aws_access_key", "aws_secret_key"],
    "ssn": [RUN], "credit_card": [RUN], "ip_private": ["10.", "172.", "192.168."],
}


def _may_match(name: str) -> Column:
    """Of rows with ``low``, the text in lower case, and ``run``."""
    return reduce(lambda a, b: a | b, [F.col("run") if h == RUN else F.contains("low", F.lit(h)) for h in HELD[name]])


def _lowered(docs: DataFrame, ident: str, text: str) -> DataFrame:
    return docs.select(ident, F.col(text).alias("t"), F.lower(text).alias("low"), F.col(text).rlike(RUN).alias("run"))


def sensitive(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """``ident, name, severity``: the patterns that a text holds."""
    found = F.array(*[F.when(_may_match(n) & F.col("t").rlike(p), F.struct(F.lit(n).alias("name"), F.lit(s).alias("severity"))) for n, s, p in SENSITIVE])
    return _lowered(docs, ident, text).select(ident, F.explode(F.array_compact(found)).alias("f")).select(ident, "f.*")


def masked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``m``: ``t`` without what is sensitive, rule by rule. Nothing that ``HELD`` lists can begin, end or lie in a placeholder,
    so a rule that may not match at first never does."""
    rules = F.array_compact(F.array(*[F.when(_may_match(n), F.lit(p)) for n, _, p in SENSITIVE]))
    return rows.withColumn("m", F.aggregate(rules, F.col("t"), lambda t, p: F.regexp_replace(t, p, F.lit(PLACEHOLDER))))


def filtered(docs: DataFrame, ident: str, text: str, *, strict: bool = False) -> DataFrame:
    """``ident, action, text``: block (no text) what is vulgar, and in strict mode all that is sensitive; mask the latter otherwise."""
    own = masked(_lowered(docs, ident, text).withColumn("bad", F.coalesce(F.col("t").rlike(VULGAR), F.lit(False))))
    action = F.when(F.col("bad"), "block").when(F.col("m") != F.col("t"), "block" if strict else "mask").otherwise("allow")
    return own.withColumn("action", action).select(ident, "action", F.when(F.col("action") == "block", "").when(F.col("action") == "mask", F.col("m")).otherwise(F.col("t")).alias("text"))


def lines(sources: DataFrame) -> DataFrame:
    """``path, n, line, bare, indent``; ``bare``: the line without blanks around it; numbered from 1."""
    rows = sources.select("path", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return rows.select("path", (F.col("i") + 1).cast("long").alias("n"), "line", F.trim("line").alias("bare"), (F.length("line") - F.length(F.ltrim("line"))).cast("long").alias("indent"))


def comment_tags(sources: DataFrame) -> DataFrame:
    """``path, n, col, tag, priority``: the first of each tag in each line."""
    found = F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(p).alias("priority"), F.regexp_instr("line", F.lit(rf"(?i)\b{t}\s*:")).cast("long").alias("col")) for t, p in COMMENT_TAGS.items()])
    return lines(sources).select("path", "n", F.explode(F.filter(found, lambda x: x["col"] > 0)).alias("f")).select("path", "n", "f.col", "f.tag", "f.priority")


def empty_bodies(sources: DataFrame) -> DataFrame:
    """``path, n, kind, name``: functions and classes whose first meaning line after the head does nothing."""
    w = lambda k: Window.partitionBy("path").orderBy("n").rowsBetween(1, k)
    skip = (F.col("bare") == "") | F.col("bare").rlike("^(#|\"\"\"|''')")
    next_ = lambda more, k: F.first(F.when(~more, F.col("bare")), ignorenulls=True).over(w(k))
    rows = lines(sources).withColumn("after_def", next_(skip, 9)).withColumn("after_class", next_(skip | F.col("bare").rlike("^(class |def )"), 14))
    name = lambda p: F.nullif(F.regexp_extract("line", p, 1), F.lit(""))
    rows = rows.withColumns({"f": name(r"def\s+(\w+)\s*\([^)]*\)\s*:"), "c": name(r"class\s+(\w+)(?:\([^)]*\))?\s*:")})
    function = F.col("f").isNotNull() & F.coalesce(F.col("after_def").rlike(r"^(pass$|raise\s+(NotImplementedError|NotImplemented)\b|\{\s*\}$)"), F.lit(False))
    klass = F.col("c").isNotNull() & F.coalesce(F.col("after_class").rlike(r"^(pass$|\{\s*\}$)"), F.lit(False))
    return rows.where(function | klass).select("path", "n", F.when(function, "empty_function").otherwise("empty_class").alias("kind"), F.when(function, F.col("f")).otherwise(F.col("c")).alias("name"))


def unclosed_brackets(sources: DataFrame) -> DataFrame:
    """``path, n, unclosed, unmatched, mismatched``: per line, outside strings and comments, brackets left open, closing ones
    without an open one, and closing ones that close another kind."""
    bare = F.regexp_replace(F.regexp_replace("line", r'"(\\.|[^"\\])*"?|\'(\\.|[^\'\\])*\'?', ""), "#.*", "")
    signs = F.split(F.regexp_replace(bare, r"[^\[\](){}]", ""), "")
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit("").alias("open"), zero.alias("unmatched"), zero.alias("mismatched"))

    def step(s: Column, c: Column) -> Column:
        opens, closes, last = c.isin("(", "[", "{"), c.isin(")", "]", "}"), F.right(s["open"], F.lit(1))
        rest = F.when(opens, F.concat(s["open"], c)).when(closes & (last != ""), F.left(s["open"], F.length(s["open"]) - 1)).otherwise(s["open"])
        other = closes & (last != "") & (F.translate(last, "([{", ")]}") != c)
        return F.struct(rest.alias("open"), (s["unmatched"] + F.when(closes & (last == ""), 1).otherwise(0)).alias("unmatched"), (s["mismatched"] + F.when(other, 1).otherwise(0)).alias("mismatched"))

    found = lines(sources).select("path", "n", F.aggregate(signs, start, step).alias("s"))
    return found.select("path", "n", F.length("s.open").cast("long").alias("unclosed"), "s.unmatched", "s.mismatched").where("unclosed + unmatched + mismatched > 0")


def functions(sources: DataFrame, *, ahead: int = 200) -> DataFrame:
    """``path, n, name, length, params``: each function with its length in lines. It ends before the next line, two or more
    further on, that is no comment and not indented beyond its head; at most ``ahead`` lines are looked at."""
    row = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.cast("long").alias("i"), x.alias("line"), F.trim(x).alias("bare"), (F.length(x) - F.length(F.ltrim(x))).alias("indent")))
    heads = F.filter("rows", lambda x: x["line"].rlike(r"^\s*def\s+\w+\s*\("))
    one = sources.select("path", row.alias("rows")).select("path", "rows", F.explode(heads).alias("h"))
    i, last = F.col("h.i"), F.least(F.col("h.i") + ahead, F.size("rows").cast("long")) - 1
    near = F.slice("rows", (i + 2).cast("int"), F.greatest(last - i, F.lit(0)).cast("int"))
    solid = lambda x: (x["bare"] != "") & ~x["bare"].rlike(r"^(#|//|/\*|\*)")
    end = F.get(F.filter(near, lambda x: solid(x) & (x["indent"] <= F.col("h.indent")) & (x["i"] > F.col("h.i") + 1)), 0)["i"] - 1
    inside = F.regexp_replace(F.regexp_extract("h.line", r"def\s+\w+\s*\(([^)]*)\)", 1), r"[\(\[{].*?(?:[\)\]}]|$)", "")
    params = F.when(F.trim(inside) == "", 0).otherwise(F.size(F.split(inside, ",")))
    name = F.regexp_extract("h.line", r"def\s+(\w+)", 1)
    return one.select("path", (i + 1).alias("n"), name.alias("name"), (F.coalesce(end, F.greatest(last, i + 1)) - i).alias("length"), params.cast("long").alias("params"))


def deep_nesting(sources: DataFrame, *, most: int = 4) -> DataFrame:
    """``path, n, depth``: lines indented by more than ``most`` levels of four blanks; the first and the last line do not count."""
    rows = sources.select("path", F.size(F.split("text", "\n")).alias("total")).join(lines(sources), "path")
    solid = (F.col("bare") != "") & ~F.col("bare").rlike("^(#|//|/\\*|\\*|'''|\"\"\")")
    depth = F.floor(F.col("indent") / 4)
    return rows.where(solid & (depth > most) & (F.col("n") > 1) & (F.col("n") < F.col("total"))).select("path", "n", depth.cast("long").alias("depth"))


def class_methods(sources: DataFrame) -> DataFrame:
    """``path, n, name, methods``: each class with the indented definitions until the next class."""
    running = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("line").rlike(r"^\s*class\s+\w+")
    rows = lines(sources).withColumn("at", F.last(F.when(head, F.col("n")), ignorenulls=True).over(running)).where("at is not null")
    name = F.max(F.when(head, F.regexp_extract("line", r"^\s*class\s+(\w+)", 1)))
    return rows.groupBy("path", F.col("at").alias("n")).agg(name.alias("name"), F.count_if(F.col("line").rlike(r"^\s+def\s+\w+")).alias("methods"))


BUILTINS = sorted(vars(builtins))
OWN = ("self", "this", "super", "super()", "cls", "@")


def resolve_calls(calls: DataFrame, local: DataFrame, imports: DataFrame, known: DataFrame) -> DataFrame:
    """``call_id, called_name, called_path`` of calls ``(call_id, file, full_name)``.

    Builtins are left out. Calls on the own object stay in the file; then the name, or the object before the first dot, is
    looked up among ``local (file, name)``, ``imports (file, alias, path, name)`` and ``known (name, path)``, of which the least
    path counts; the order decides. What is found nowhere is external and left out.
    """
    dots = F.length("full_name") - F.length(F.replace("full_name", F.lit("."), F.lit("")))
    called, base = F.element_at(F.split("full_name", r"\."), -1), F.when(dots > 0, F.element_at(F.split("full_name", r"\."), 1))
    own = calls.withColumns({"called": called, "base": base, "chained": dots > 1}).where(~F.col("called").isin(BUILTINS))
    self_ = F.coalesce(F.col("base").isin(*OWN), F.lit(False))
    own = own.withColumn("own", self_ & ~F.col("chained")).withColumn("lookup", F.when(self_ & F.col("chained"), F.col("called")).otherwise(F.coalesce("base", "called")))
    here = local.select("file", F.col("name").alias("lookup"), F.lit(True).alias("is_local")).distinct()
    alias = imports.groupBy("file", F.col("alias").alias("lookup")).agg(F.min(F.struct("path", "name")).alias("imported"))
    least = known.groupBy(F.col("name").alias("lookup")).agg(F.min("path").alias("known_path"))
    found = own.join(here, ["file", "lookup"], "left").join(alias, ["file", "lookup"], "left").join(least, "lookup", "left")
    by_local, by_import = F.coalesce("is_local", F.lit(False)), F.col("imported").isNotNull()
    path = F.when(F.col("own") | by_local, F.col("file")).when(by_import, F.col("imported.path")).otherwise(F.col("known_path"))
    name = F.when(F.col("own"), F.col("called")).when(by_local, F.col("lookup")).when(by_import, F.col("imported.name")).otherwise(F.col("lookup"))
    return found.where(F.col("own") | by_local | by_import | F.col("known_path").isNotNull()).select("call_id", name.alias("called_name"), path.alias("called_path"))


def resolve_bases(bases: DataFrame, local: DataFrame, imports: DataFrame, known: DataFrame) -> DataFrame:
    """``child, parent, parent_path`` of ``bases (file, child, base)``: as for calls, by the whole name first, and for a dotted
    name by its first part, which names the module; ``object`` is left out."""
    dotted = F.col("base").contains(".")
    own = bases.where("base <> 'object'").withColumns({"first": F.split("base", r"\.")[0], "last": F.element_at(F.split("base", r"\."), -1)})
    here = local.select("file", F.col("name").alias("base"), F.lit(True).alias("is_local")).distinct()
    alias = imports.groupBy("file", "alias").agg(F.min(F.struct("path", "name")).alias("i"))
    least = known.groupBy("name").agg(F.min("path").alias("p"))
    found = own.join(here, ["file", "base"], "left")
    for c, key in (("whole", "base"), ("part", "first")):
        found = found.join(alias.select("file", F.col("alias").alias(key), F.col("i").alias(f"{c}_import")), ["file", key], "left")
        found = found.join(least.select(F.col("name").alias(key), F.col("p").alias(f"{c}_path")), key, "left")
    whole = F.coalesce("is_local", F.lit(False)) | F.col("whole_import").isNotNull() | F.col("whole_path").isNotNull()
    path = F.when(F.col("is_local"), F.col("file")).when(F.col("whole_import").isNotNull(), F.col("whole_import.path")).when(whole, F.col("whole_path")).when(F.col("part_import").isNotNull(), F.col("part_import.path")).otherwise(F.col("part_path"))
    name = F.when(F.col("is_local"), F.col("base")).when(F.col("whole_import").isNotNull(), F.col("whole_import.name")).when(whole, F.col("base")).otherwise(F.col("last"))
    kept = found.where(whole | (dotted & (F.col("part_import").isNotNull() | F.col("part_path").isNotNull())))
    return kept.select("child", name.alias("parent"), path.alias("parent_path"))


#: Knowledge patterns by type, with flags (i: any case, m: lines, s: a dot is any sign) and confidence.
KNOWLEDGE = {
    "concept": [
        (r"\*\*(?:Concept|Term|Entity|Domain)\s*\*{0,2}:\s*\*{0,2}(.+?)(?:\n|$)", "im", 1.0), (r"^[-*]\s+\*\*(.+?)\*\*\s*[—–\-:]\s*(.+?)$", "m", 0.6), (r"^\|\s*`(.+?)`\s*\|\s*(.+?)\s*\|", "m", 0.5),
    ],
    "constraint": [
        (r"\*\*(?:Constraint|Rule|Must|Required)\*\*:?\s*(.+?)(?:\n|$)", "im", 1.0), (r"(?:^|\n)\s*[-*]\s*(?:MUST|SHOULD|MUST NOT|SHALL|REQUIRED)\s+(.+?)(?=\n|$)", "m", 0.9), (r"(?:cannot|can't|must not|may not|should not)\s+(.+?)[,.\n]", "i", 0.7),
        (r"(?:is|are)\s+(?:always|never|required|mandatory)\s+(?:to|for|that)\s+(.+?)[,.\n]", "i", 0.6), (r"No\s+(?:direct\s+)?(?:access|modification|deletion)\s+(?:to|of|from)\s+(.+?)[,.\n]", "i", 0.7),
    ],
    "decision": [
        (r"##+\s*(?:Decision|Approach|Solution|Chosen)\s*\n(.+?)(?=\n##+\s|\z)", "ims", 0.9), (r"\*\*(?:Decision|Approach|Solution)\*\*:?\s*(.+?)(?:\n|$)", "im", 0.8),
        (r"We\s+(?:chose|adopted|selected|decided|implemented|migrated)\s+(.+?)[,.\n]", "i", 0.7), (r"(?:was|were)\s+(?:chosen|adopted|selected)\s+(?:due to|because of|for)\s+(.+?)[,.\n]", "i", 0.6),
    ],
    "flow": [
        (r"##+\s*(?:Flow|Process|Lifecycle|Pipeline)\s*\n(.+?)(?=\n##+\s|\z)", "ims", 0.9), (r"\d+\.\s+(.+?)(?=\n\d+\.|\n\n|\z)", "m", 0.7), (r"Step\s+\d+[:\s]+(.+?)(?:\n|$)", "i", 0.7), (r"(?:flow|process|lifecycle|pipeline)[:\s]+(.+?)(?:\n\n|\z)", "ims", 0.6),
    ],
    "risk": [
        (r"\*\*(?:Risk|Warning|Caution|Concern)\*\*:?\s*(.+?)(?:\n|$)", "im", 1.0), (r"(?:risk|risk of|risk that|danger|pitfall|drawback)[:\s]+(.+?)(?:\n|$)", "i", 0.8),
        (r"(?:tightly coupled|high coupling|fragile|brittle|unstable|bottleneck)\s+(.+?)[,.\n]", "i", 0.7), (r"(?:single point of failure|SPOF|no fallback|no backup)\s*(.+?)[,.\n]", "i", 0.9),
    ],
    "invariant": [
        (r"\*\*(?:Invariant|Integrity)\*\*:?\s*(.+?)(?:\n|$)", "im", 1.0), (r"(?:must always|must never|always must|must remain|must be unique)\s+(.+?)[,.\n]", "i", 0.9), (r"(?:invariant|integrity rule|business rule)[:\s]+(.+?)(?:\n|$)", "i", 0.8),
        (r"Each\s+\w+\s+(?:must|shall|should)\s+(?:have|be|belong|contain)\s+(.+?)[,.\n]", "i", 0.7), (r"(?:unique|distinct|cannot duplicate)\s+(.+?)[,.\n]", "i", 0.6),
    ],
    "anti_pattern": [
        (r"\*\*(?:Anti-pattern|Anti pattern|Avoid|Do not)\*\*:?\s*(.+?)(?:\n|$)", "im", 1.0), (r"(?:anti-pattern|bad practice|common mistake|code smell)[:\s]+(.+?)(?:\n|$)", "i", 0.8), (r"Don't\s+(.+?)[,.\n]", "i", 0.7), (r"avoid\s+(?:using|doing|creating|making)\s+(.+?)[,.\n]", "i", 0.7),
    ],
    "principle": [
        (r"\*\*(?:Principle|Standard|Guideline)\*\*:?\s*(.+?)(?:\n|$)", "im", 1.0), (r"##+\s*(?:Principles?|Standards?)\s*\n(.+?)(?=\n##+\s|\z)", "ims", 0.9), (r"(?:principle|our philosophy|we believe|we follow)[:\s]+(.+?)(?:\n|$)", "i", 0.7),
        (r"(modular[-_](?:first|by.design)|loose.coupling|high.cohesion|single.responsibility)", "i", 0.6),
    ],
}


def knowledge(docs: DataFrame, ident: str, text: str, *, least: int = 15) -> DataFrame:
    """``ident, kind, content, confidence``: what the patterns extract, without blanks around it; of equal openings (100 characters,
    any case) of one type in a document the most confident stays."""

    # d: as in the patterns' own dialect, only a line feed ends a line.
    def hits(kind: str, pattern: str, flags: str, confidence: float) -> Column:
        found = F.regexp_extract_all(text, F.lit(f"(?{flags}d){pattern}"), 1)
        return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), F.regexp_replace(x, r"^\s+|\s+$", "").alias("content"), F.lit(confidence).alias("confidence")))

    found = [hits(kind, *rule) for kind, rules in KNOWLEDGE.items() for rule in rules]
    rows = docs.select(ident, F.explode(F.concat(*found)).alias("f")).select(ident, "f.*").where(F.length("content") >= least)
    best = rows.groupBy(ident, "kind", F.md5(F.lower(F.left("content", F.lit(100)))).alias("key")).agg(F.max_by(F.struct("content", "confidence"), F.struct("confidence", "content")).alias("b"))
    return best.select(ident, "kind", "b.content", "b.confidence")


#: Words of high criticality, and words by tag.
CRITICAL = ("critical", "blocker", "must", "never", "always", "required", "vital", "essential", "mandatory", "security", "integrity")
TAGS = {
    "security": ("security", "auth", "permission"), "performance": ("perform", "scale", "latency", "cache"), "data": ("database", "sql", "orm", "query", "store"),
    "api": ("api", "endpoint", "route", "rest"), "testing": ("test", "coverage", "qa"),
}


def knowledge_marks(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """``ident, criticality, concepts, modules, tags``: by words; at most five names in camel or upper case, camel first, and three paths."""
    t, low = F.col(text), F.lower(F.col(text))
    any_of = lambda ws: reduce(lambda a, b: a | b, [low.contains(w) for w in ws])
    names = F.concat(F.regexp_extract_all(t, F.lit(r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b"), 1), F.regexp_extract_all(t, F.lit(r"\b([A-Z]{2,})\b"), 1))
    modules = F.regexp_extract_all(t, F.lit(r"\b((?:src|app|lib|packages)/[\w/.-]+)"), 1)
    tags = F.array_compact(F.array(*[F.when(any_of(ws), F.lit(tag)) for tag, ws in TAGS.items()]))
    return docs.select(ident, F.when(any_of(CRITICAL), "high").otherwise("low").alias("criticality"), F.array_join(F.slice(names, 1, 5), ",").alias("concepts"), F.array_join(F.slice(modules, 1, 3), ",").alias("modules"), F.array_join(tags, ",").alias("tags"))


def relevant(entries: DataFrame, context: str, limit: int = 10) -> DataFrame:
    """``id, score`` of ``entries (id, content, tags, applies_to)``: how many words of the context, over three letters, an entry holds."""
    import re

    words = sorted({w for w in re.sub(r"[^\w\s]", "", context.lower()).split() if len(w) > 3})
    own = F.lower(F.concat_ws(" ", "content", "tags"))
    applies = F.lower(F.concat_ws(" ", "applies_to"))
    score = reduce(lambda a, b: a + b, [F.when(own.contains(w) | applies.contains(w), 1).otherwise(0) for w in words], F.lit(0))
    rows = entries.select("id", score.cast("long").alias("score"))
    return (rows.where("score > 0") if words else rows).orderBy(F.desc("score"), "id").limit(limit)
