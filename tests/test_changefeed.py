"""Change events: bursts, renames and synchronisation against a plain fold, as tables and as streams."""

import datetime as dt
import random
from collections import defaultdict

import pytest

from basaltiq.streaming import changefeed

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def sessions(rows, key, time, width):
    by = defaultdict(list)
    for r in rows:
        by[key(r)].append(r)
    for found in by.values():
        found.sort(key=time)
        run = found[:1]
        for r in found[1:]:
            if time(r) - time(run[-1]) > dt.timedelta(seconds=width):
                yield run
                run = []
            run.append(r)
        yield run


def plain_feed(events, quiet=1, within=2):
    made = []
    for run in sessions([e for e in events if e[0] is not None and e[1] and e[3]], lambda e: e[0], lambda e: e[3], quiet):
        order = sorted(run, key=lambda e: (e[3], -1 if e[4] is None else e[4], e[1], e[2] or ""))
        first, last = order[0][1], order[-1][1]
        event = (None if first == "create" else "delete") if last == "delete" else "create" if first == "create" else "modify"
        if event:
            made.append((run[0][0], event, order[-1][3], order[-1][2], len(run)))
    pairs = set()
    for key in (lambda b: b[3], lambda b: (b[3], b[0].rsplit("/", 1)[-1])):
        for run in sessions([b for b in made if b[1] != "modify" and b[3]], key, lambda b: b[2], within):
            old, new = [b for b in run if b[1] == "delete"], [b for b in run if b[1] == "create"]
            if len(old) == len(new) == 1 and old[0][0] != new[0][0]:
                pairs.add((old[0], new[0]))
    was, gone = {n: o[0] for o, n in pairs}, {o for o, _ in pairs}
    return sorted((b[0], "rename" if b in was else b[1], b[2], b[3], was.get(b), b[4]) for b in made if b not in gone)


def rows_of(df):
    return sorted((r.path, r.event, r["at"].astimezone(dt.UTC), r.hash, r.was, r.n) for r in df.collect())


def batch_feed(spark, events):
    found = changefeed.bursts(spark.createDataFrame(events, changefeed.EVENTS))
    return changefeed.feed(found, changefeed.moves(found))


def some_events(seed, n):
    r = random.Random(seed)
    return [(f"{r.choice('ab')}/{r.choice('xyz')}", r.choice(["create", "modify", "delete"]), r.choice(["h1", "h2", "h3", "h4"]), at(r.randrange(n * 2) / 2), k) for k in range(n)]


def test_kinds_of_bursts(spark):
    events = [
        ("new", "create", "a", at(0), 0), ("new", "modify", "b", at(0.5), 1), ("new", "modify", "c", at(1.5), 2),
        ("flash", "create", "d", at(0), 0), ("flash", "delete", "d", at(0.2), 1),
        ("saved", "delete", "e", at(0), 0), ("saved", "create", "f", at(0), 1),
        ("twice", "modify", "g", at(0), 0), ("twice", "modify", "g", at(1.1), 1),
        (None, "create", "a", at(0), 0), ("no time", "create", "a", None, 0), ("no kind", None, "a", at(0), 0),
    ]
    got = [(r[0], r[1], r[3], r[5]) for r in rows_of(batch_feed(spark, events))]
    assert got == [("new", "create", "c", 3), ("saved", "modify", "f", 2), ("twice", "modify", "g", 1), ("twice", "modify", "g", 1)]


def test_renames(spark):
    events = [
        ("a/x", "delete", "one", at(0), 0), ("b/y", "create", "one", at(1), 1),
        ("a/p", "delete", "two", at(0), 0), ("a/q", "delete", "two", at(0), 1), ("b/p", "create", "two", at(1), 2), ("b/r", "create", "two", at(1), 3),
        ("a/far", "delete", "three", at(0), 0), ("b/far", "create", "three", at(9), 1),
        ("a/empty", "delete", "", at(0), 0), ("b/empty", "create", "", at(1), 1), ("a/none", "delete", None, at(0), 0), ("b/none", "create", None, at(1), 1),
    ]
    got = {(r.path, r.event, r.was) for r in batch_feed(spark, events).collect()}
    assert {g for g in got if g[1] == "rename"} == {("b/y", "rename", "a/x"), ("b/p", "rename", "a/p")}
    # Two files of one content under new names: nothing says which became which.
    assert {("a/q", "delete", None), ("b/r", "create", None), ("a/far", "delete", None), ("b/far", "create", None), ("b/empty", "create", None), ("a/none", "delete", None)} <= got
    assert not {p for p, _, _ in got} & {"a/x", "a/p"}


@pytest.mark.parametrize("seed", range(3))
def test_table_equals_fold(spark, seed):
    events = some_events(seed, 80)
    want = plain_feed(events)
    assert rows_of(batch_feed(spark, events)) == want
    assert any(r[1] == "rename" for r in want) and any(r[5] > 1 for r in want)
    # Repeated events count, and change nothing else.
    assert [r[:5] for r in rows_of(batch_feed(spark, events * 3))] == [r[:5] for r in want]


def test_no_events(spark):
    assert batch_feed(spark, []).count() == 0


def test_extra_columns(spark):
    events = spark.createDataFrame([("p", "create", "h", T0, 0, 1, 2)], changefeed.EVENTS + ", first int, n int")
    assert changefeed.bursts(events).columns == ["path", "event", "hash", "at", "n"]


def test_stream_equals_fold_in_any_order(spark, tmp_path):
    """Three starts on one checkpoint; arrival is shuffled within the lateness; renames and bursts cross the starts."""
    events = sorted(some_events(7, 120), key=lambda e: e[3])
    r = random.Random(1)
    arrival = sorted(events, key=lambda e: (e[3] - T0).total_seconds() + r.random() * 10)
    source, base = f"{tmp_path}/events", f"{tmp_path}/state"
    seen = 0
    for part in (arrival[:45], arrival[45:80], arrival[80:]):
        frame = spark.createDataFrame(part, changefeed.EVENTS).repartition(2)
        if part[-1] is arrival[-1]:
            frame = frame.unionByName(changefeed.closing(spark, at(300), dt.timedelta(seconds=60)))
        frame.write.mode("append").parquet(source)
        changefeed.follow(spark, source, base, late="20 seconds")
        now = changefeed.followed(spark, base).count()
        assert now >= seen
        seen = now
    assert rows_of(changefeed.followed(spark, base)) == plain_feed(events)


def test_sync(spark):
    changes = spark.createDataFrame(
        [("a", "modify", at(1), "h", None, 1), ("b", "create", at(5), "h", None, 1), ("c", "delete", at(6), "h", None, 1), ("d", "rename", at(7), "h", "b", 1), ("e", "delete", at(8), "h", None, 1), ("e", "create", at(9), "h", None, 1), ("f", "rename", at(9), "h", "e", 1)],
        "path string, event string, at timestamp, hash string, was string, n long",
    )
    manifest, listing = spark.createDataFrame([("old",), ("a",)], "path string"), spark.createDataFrame([("a",), ("d",)], "path string")
    actions = lambda **k: (lambda df, why: ({(r.path, r.action) for r in df.collect()}, why))(*changefeed.sync_actions(changes, manifest, listing, **k))
    assert actions(since=at(2)) == ({("b", "drop"), ("c", "drop"), ("d", "read"), ("e", "read"), ("f", "read")}, None)
    full = {("a", "read"), ("d", "read"), ("old", "drop")}
    assert actions(since=None) == (full, "no earlier position")
    got, why = actions(since=at(2), kept_from=at(3))
    assert got == full and "kept" in why
    assert actions(since=at(99)) == (set(), None)
