"""Personal data: fixed base rules, and further spans by weak supervision.

Base spans (e-mail, IP, card, phone) follow exact rules and always stay. Looser candidates (spelled-out e-mail, local
phone, social-security number, IBAN, titled name, secret) get votes from labelers - strict regex, gazetteer, context,
counter-context, checksum or shape - each of them for, against or silent. Expectation-maximisation over all
candidates estimates how reliable each labeler is and how likely each candidate; a logistic classifier is then fitted
to those probabilities on votes and shape features and decides.

All features are discrete, so the corpus reaches the driver as counts by pattern: at most the number of patterns
(kinds x 3**labelers x shapes), whatever the number of documents. Texts are read once; candidates are written without
them. Defined results: null is empty and has no span; repeated rows are found each alike; without candidates no span
is added.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basaltiq.llm.common import sources_of, written

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that begins within a run of digits would have begun before it, so the look-behind only saves time.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((2 * int(d) - 9 if d > "4" else 2 * int(d)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern finds them from the left, in linear time: a local part ends at its @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)``, in order."""
    found = [(s, 0, e) for s, e in emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(n := p.lstrip("0")) <= 3 and int(n or "0") <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if len(m[0]) > 11 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found)


#: Candidates: kind, pattern, and a lower-case text without which the pattern cannot match, whatever its case.
CANDIDATES = (
    ("email", re.compile(r"(?i)\b[a-z0-9][a-z0-9._%+-]{0,63} ?(?:\[at\]|\(at\)| at ) ?[a-z0-9-]{1,63} ?(?:\[dot\]|\(dot\)| dot ) ?[a-z]{2,24}\b"), "dot"),
    ("phone", re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])"), ""),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), "-"),
    ("iban", re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"), ""),
    ("name", re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?"), ""),
    ("secret", re.compile(r"\bAKIA[0-9A-Z]{16}\b"), "akia"),
    ("secret", re.compile(r"(?i)\b(?:password|passwd|token|secret|api_?key) ?[=:] ?\"?[a-z0-9_\-]{8,}\"?"), ""),
    ("secret", re.compile(r"\b(?:gh[pousr]_|sk-|xox[abp]-|glpat-)[A-Za-z0-9_-]{16,}"), ""),
)
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|write|contact|reach|address)\b", "phone": r"(?i)\b(?:call|phone|tel|mobile|fax|contact|cell)\b", "ssn": r"(?i)\b(?:ssn|social|security|taxpayer)\b",
    "iban": r"(?i)\b(?:iban|account|bank|transfer)\b", "name": r"(?i)\b(?:dear|signed|sincerely|by|patient|with)\b", "secret": r"(?i)\b(?:key|secret|login|credentials?|aws|auth)\b",
}
CONTEXT = {k: re.compile(v) for k, v in CONTEXT.items()}
COUNTER = re.compile(r"(?i)\b(?:version|isbn|page|order|figure|chapter|example|license|copyright|serial)\b")
#: Values that stand where a secret would, in examples and templates.
PLACEHOLDER = re.compile(r"(?i)change.?me|example|placeholder|dummy|sample|your|x{4}|\*{3}|0{6}|1234|password\b|secret\b|token\b")
#: Given names and surnames that are frequent in the four languages.
NAMES = frozenset(
    """james john robert michael william david richard thomas mary patricia linda barbara elizabeth susan anna emma peter paul mark george laura sarah
    smith jones brown miller davis wilson taylor clark lewis walker jean pierre marie louis claire sophie camille julien martin bernard dubois durand moreau
    hans klaus karl heinz ursula monika petra sabine schmidt schneider fischer weber meyer wagner becker schulz jose juan carlos luis maria carmen ana
    pedro garcia martinez lopez sanchez perez gomez rodriguez fernandez""".split()
)
#: What the gazetteer labeler says: top-level domains, area codes and number ranges in use, countries, names, vendors' prefixes.
GAZETTEER = {
    "email": lambda s: 1 if re.search(r"(?i)\b(?:com|org|net|edu|gov|io|de|fr|es|uk)$", s) else 0,
    "phone": lambda s: 1 if re.match(r"\(?[2-9][0-9]{2}", s) else -1,
    "iban": lambda s: 1 if re.match(r"(?:DE|FR|ES|GB|IT|NL|BE|AT|CH|PT)", s) else -1,
    "name": lambda s: 1 if any(w in NAMES for w in s.lower().split()[1:]) else 0,
    "ssn": lambda s: 1 if re.match(r"(?!000|666|9)", s) else -1,
    "secret": lambda s: -1 if PLACEHOLDER.search(re.split("[=:]", s, maxsplit=1)[-1]) else 1 if re.match(r"AKIA|gh[pousr]_|sk-|xox|glpat-", s) else 0,
}
STRICT = {
    "email": re.compile(r"(?i)[\[(]at[\])].*[\[(]dot[\])]"), "phone": re.compile(r"^\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}$|^([0-9]{3})([-.])[0-9]{3}\2[0-9]{4}$"), "ssn": re.compile(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"),
    "iban": re.compile(r"^[A-Z]{2}[0-9]{2}(?: ?[0-9]{4})+"), "name": re.compile(r"\. [A-Z][a-z]+ [A-Z][a-z]+$"), "secret": re.compile(r"^(?:AKIA|gh[pousr]_|sk-|xox|glpat-)|[=:] ?\"?[0-9a-f]{16,}\"?$"),
}
LABELERS = 5


def iban(s: str) -> bool:
    """Whether the check digits are right."""
    packed = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


def _checks(kind: str, s: str) -> int:
    """The checksum or shape labeler."""
    if kind == "iban":
        return 1 if 15 <= len(s.replace(" ", "")) <= 32 else -1
    if kind == "secret":
        tail = re.split("[=:]", s)[-1].strip(' "')
        return 1 if len(set(tail)) >= 8 and any(c.isdigit() for c in tail) else -1
    if kind == "phone":
        return 1 if len(set(_digits(s))) > 3 else -1
    if kind == "email":
        return 0 if " at " in s and "[" not in s and "(" not in s else 1
    return 0


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, pattern)`` of candidates that overlap no base span; pattern: kind, votes, shape."""
    found, ends = [], -1
    folded = text.lower()
    for kind, pattern, needs in CANDIDATES:
        if needs not in folded:
            continue
        for m in pattern.finditer(text):
            if any(s < m.end() and m.start() < e for s, _, e in taken) or (kind == "iban" and not iban(m[0])):
                continue
            s, before = m[0], text[max(0, m.start() - 40) : m.start()]
            votes = (
                1 if STRICT[kind].search(s) else -1,
                GAZETTEER[kind](s),
                1 if CONTEXT[kind].search(before) else 0,
                -1 if COUNTER.search(before) else 0,
                _checks(kind, s),
            )
            digits = sum(c.isdigit() for c in s)
            shape = f"{min(3, len(s) // 12)}{4 * digits // (len(s) + 1)}{int(bool(before) and before[-1].isspace())}"
            found.append((m.start(), m.end(), kind, f"{kind}|{''.join('-0+'[v + 1] for v in votes)}|{shape}"))
    # Of overlapping candidates the leftmost, then longest, stays.
    out = []
    for c in sorted(found, key=lambda c: (c[0], -c[1], c[2])):
        if c[0] >= ends:
            out.append(c)
            ends = c[1]
    return out


def _votes(pattern: str) -> list[int]:
    return ["-0+".index(c) - 1 for c in pattern.split("|")[1]]


def posterior(patterns: list[str], prior: dict[str, float], right: np.ndarray) -> np.ndarray:
    """The probability that each pattern's spans are personal data, for conditionally independent labelers."""
    votes = np.array([_votes(p) for p in patterns])
    odds = np.array([np.log(prior[k] / (1 - prior[k])) for k in (p.split("|")[0] for p in patterns)]) + votes @ np.log(right / (1 - right))
    return 1 / (1 + np.exp(-odds))


def estimate(patterns: dict[str, int], rounds: int = 50) -> tuple[dict[str, float], np.ndarray]:
    """EM: how likely each kind's candidates are, and how often each labeler is right when it votes. Counts weigh the patterns."""
    names = sorted(patterns)
    n = np.array([patterns[p] for p in names], float)
    votes = np.array([_votes(p) for p in names])
    kinds = np.array([p.split("|")[0] for p in names])
    right = np.full(LABELERS, 0.8)
    prior = dict.fromkeys(kinds.tolist(), 0.5)
    for _ in range(rounds):
        p = posterior(names, prior, right)
        for j in range(LABELERS):
            spoke = votes[:, j] != 0
            agree = np.where(votes[:, j] > 0, p, 1 - p)
            # A beta prior of 8 right and 2 wrong votes keeps a rare labeler near its start.
            right[j] = np.clip((n[spoke] @ agree[spoke] + 8) / (n[spoke].sum() + 10), 0.55, 0.99)
        prior = {k: float(np.clip((n[kinds == k] @ p[kinds == k] + 1) / (n[kinds == k].sum() + 2), 0.02, 0.98)) for k in prior}
    return prior, right


def _features(pattern: str, kinds: list[str]) -> list[float]:
    kind, _, shape = pattern.split("|")
    return [1.0, *(float(kind == k) for k in kinds), *map(float, _votes(pattern)), *(int(c) / 3 for c in shape)]


def train(patterns: dict[str, int], steps: int = 400) -> dict[str, float]:
    """The span classifier, fitted to the EM probabilities; as inputs are discrete it is given as a score by pattern."""
    if not patterns:
        return {}
    names = sorted(patterns)
    kinds = sorted({p.split("|")[0] for p in names})
    x = np.array([_features(p, kinds) for p in names])
    y, n = posterior(names, *estimate(patterns)), np.array([patterns[p] for p in names], float)
    n /= n.sum()
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        w -= 2.0 * (x.T @ (n * (p - y)) + 1e-4 * w)
    return dict(zip(names, (1 / (1 + np.exp(-x @ w))).tolist(), strict=True))


OUT = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans", "has_personal_data")


def find(docs: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans, has_personal_data`` of every document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cand = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("kind", pa.string()), ("p", pa.string())]))
        for b in batches:
            base, more = [], []
            for t in b.column("text").to_pylist():
                own = base_spans(t or "")
                base.append(own)
                more.append([{"s": s, "e": e, "kind": k, "p": p} for s, e, k, p in candidates(t or "", own)])
            counts = [pa.array([sum(s[1] == k for s in own) for own in base], pa.int64()) for k in range(4)]
            text = [",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in own) for own in base]
            yield pa.record_batch([b.column("doc_id"), *counts, pa.array(text, pa.string()), pa.array(more, cand)], names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "more"])

    own = sources_of(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = written(own.mapInArrow(scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, more array<struct<s long, e long, kind string, p string>>"), "pii-candidates")
    patterns = {r["p"]: r["n"] for r in scanned.select(F.explode("more").alias("c")).groupBy(F.col("c.p").alias("p")).agg(F.count("*").alias("n")).collect()}
    taken = {p for p, score in train(patterns).items() if score >= threshold}

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = {k: i for i, k in enumerate((*KINDS, "ssn", "iban", "name", "secret"))}
        for b in batches:
            digests, spans, added, total = [], [], [], []
            for base, more in zip(b.column("base").to_pylist(), b.column("more").to_pylist(), strict=True):
                kept = [(c["s"], order[c["kind"]], f"{c['kind']}:{c['s']}:{c['e']}") for c in more if c["p"] in taken]
                every = [(int((x := s.split(":"))[1]), order[x[0]], s) for s in base.split(",") if s] + kept
                digests.append(hashlib.sha256(base.encode()).hexdigest())
                spans.append(",".join(s for *_, s in sorted(every)))
                added.append(len(kept))
                total.append(len(every))
            made = [pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64()), pa.array(total, pa.int64()), pa.array([n > 0 for n in total], pa.bool_())]
            yield pa.record_batch([*(b.column(c) for c in OUT[:5]), *made], names=list(OUT))

    return scanned.mapInArrow(decide, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long, has_personal_data boolean")
