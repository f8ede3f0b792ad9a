"""Nested documents and versions in time, against plain folds."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from basaltiq.operators import documents, snapshots


def plain_walk(value, keys=(), path="$", depth=4):
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(value), "number")
    yield tuple(keys), path, len(keys), kind, None if kind in ("object", "array", "null") else {"boolean": str(value).lower()}.get(kind, str(value))
    if len(keys) < depth:
        parts = value.items() if kind == "object" else enumerate(value) if kind == "array" else ()
        for k, v in parts:
            yield from plain_walk(v, (*keys, str(k)), f"{path}[{k}]" if kind == "array" else f"{path}.{k}", depth)


def made(rng, left=6):
    if left == 0 or rng.random() < 0.3:
        return rng.choice([1, -7, "x", "", True, None, "é\n", 12.5])
    if rng.random() < 0.5:
        return [made(rng, left - 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice("abcdef") * rng.randint(1, 2): made(rng, left - 1) for _ in range(rng.randint(0, 4))}


def test_walk(spark):
    rng = random.Random(3)
    values = {k: made(rng) for k in range(80)}
    values[80] = list(range(3000))
    rows = [(k, json.dumps(v, ensure_ascii=False)) for k, v in values.items()] + [(90, None), (91, ""), (92, '{"a": '), (93, '{"a": 1, "a": 2}')]
    docs = spark.createDataFrame(rows, "k long, t string").withColumns({"keys": F.lit(1), "path": F.lit(2), "e": F.lit(3), "depth": F.lit(4)})
    got = [(r.k, tuple(r["keys"]), r.path, r.depth, r.kind, r.value) for r in documents.walk(docs, "k", "t").collect()]
    want = [(k, *x) for k, v in values.items() for x in plain_walk(v)]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and max(x[3] for x in got) == 4
    assert documents.walk(docs.limit(0), "k", "t").count() == 0
    plan = documents.walk(docs, "k", "t")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_contracts(spark):
    text = json.dumps({"openapi": "3.0.0", "paths": {"/a/{id}": {"get": {"operationId": "readA", "summary": "One"}, "parameters": {"get": 1}}, "/b": {"post": {}, "x-note": {}}}})
    got = documents.contracts(spark.createDataFrame([(1, text), (2, "{}"), (3, None)], "k long, t string"), "k", "t")
    assert sorted((r.k, r.endpoint, r.method, r.operation, r.summary) for r in got.collect()) == [(1, "/a/{id}", "get", "readA", "One"), (1, "/b", "post", None, None)]


START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def changes(spark):
    """Two thirds of one key, ties, repeated rows, nulls."""
    rng = random.Random(8)
    rows = [(rng.choice([1, 1, *range(2, 30)]) if k % 2 else 1, START + timedelta(hours=rng.randint(0, 900)), rng.randint(0, 2), k, rng.choice("IUUDU"), rng.choice(["x", "y", None]), rng.randint(0, 2)) for k in range(600)]
    rows += [rows[3], rows[3], (None, START, 0, 1, "U", "x", 1), (5, None, 0, 2, "U", "x", 1), (77, START, 0, 3, None, "x", 1), (78, START, 0, 4, "D", "x", 1)]
    return rows, spark.createDataFrame(rows, "k long, at timestamp_ntz, seq int, id long, op string, p string, q int").repartition(4)


SPEC = {"at": "at", "order": ["seq", "id"], "op": "op"}


def plain_state(rows, instant):
    last = {}
    for k, at, seq, i, op, p, q in rows:
        if k is not None and at is not None and at <= instant:
            last[k] = max(last.get(k, ((START - timedelta(1), 0, 0), None)), ((at, seq, i), (op, p, q)), key=lambda x: x[0])
    return {k: v[1:] for k, (_, v) in last.items() if v[0] != "D"}


def test_states_and_differences(changes):
    rows, frame = changes
    for a, b in ((100, 500), (500, 100), (-5, 2000), (300, 300)):
        first, second = START + timedelta(hours=a), START + timedelta(hours=b)
        one, two = plain_state(rows, first), plain_state(rows, second)
        assert {r.k: (r.p, r.q) for r in snapshots.as_of(frame, ["k"], ["p", "q"], second, **SPEC).collect()} == two
        want = {k: ("added", "") for k in two.keys() - one.keys()} | {k: ("removed", "") for k in one.keys() - two.keys()}
        want |= {k: ("changed", ",".join(n for n, x, y in zip("pq", one[k], two[k], strict=True) if x != y)) for k in one.keys() & two.keys() if one[k] != two[k]}
        found = snapshots.difference(frame, ["k"], ["p", "q"], first, second, **SPEC)
        assert {r.k: (r.change, r.fields) for r in found.collect()} == want
        assert {r.change: r.n for r in snapshots.summary(found).collect()} == {c: sum(x[0] == c for x in want.values()) for c in ("added", "removed", "changed")}


def test_intervals(changes):
    rows, frame = changes
    got = snapshots.intervals(frame, ["k"], at="at", order=["seq", "id"], slot="day").collect()
    known = sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[:4])
    want = [(r[3], r[0], r[1], n[1] if n and n[0] == r[0] else None) for r, n in zip(known, [*known[1:], None], strict=True)]
    assert sorted(map(repr, [(r.id, r.k, r["at"], r.valid_to) for r in got])) == sorted(map(repr, want))
