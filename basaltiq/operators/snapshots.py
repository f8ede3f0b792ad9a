"""Versions in time: validity intervals, the state at an instant, and what differs between two instants.

A change is a row with its key, its instant, the columns that order changes of one instant, an operation (``D`` takes away) and attributes. A
state is an aggregate of the latest change of each key, so a key with a third of all changes is combined on the map side; a difference is
the same aggregate for both instants in one pass.

Defined results. Changes without an instant or without one of the keys are left out. What is taken away is absent until it is put again.
Null attributes are equal to each other. Of repeated changes one counts in a state; each has its own interval, of which all but the last
are empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GONE = "D"


def _known(changes: DataFrame, keys: list[str], at: str) -> DataFrame:
    return changes.dropna(subset=[*keys, at])


def intervals(changes: DataFrame, keys: list[str], *, at: str, order: list[str], slot: str = "week") -> DataFrame:
    """``changes`` with ``valid_to``, the instant of the key's next change, or null. Changes are sorted within a key and a slot of time; the last of
    a slot takes the first instant of the key's next slot that has any, so no task sorts a key's whole history."""
    rows = _known(changes, keys, at).withColumn("_slot", F.date_trunc(slot, F.col(at)))
    own = Window.partitionBy(*keys, "_slot").orderBy(at, *order)
    slots = rows.groupBy(*keys, "_slot").agg(F.min(at).alias("_first"))
    following = slots.select(*keys, "_slot", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_slot")).alias("_following"))
    made = rows.withColumn("_next", F.lead(at).over(own)).join(following, [*keys, "_slot"])
    return made.withColumn("valid_to", F.coalesce("_next", "_following")).select(*changes.columns, "valid_to")


def _latest(keys: list[str], values: list[str], at: str, order: list[str], op: str, until: object):
    """The latest change up to an instant, as a struct; null where there is none or where it takes away."""
    last = F.max_by(F.struct(op, *values), F.when(F.col(at) <= F.lit(until).cast("timestamp_ntz"), F.struct(at, *order)))
    return F.when(last[op].isNull() | (last[op] != GONE), last)


def as_of(changes: DataFrame, keys: list[str], values: list[str], instant: object, *, at: str, order: list[str], op: str) -> DataFrame:
    """``keys`` and ``values`` of what stands at the instant."""
    rows = _known(changes, keys, at).where(F.col(at) <= F.lit(instant).cast("timestamp_ntz"))
    state = rows.groupBy(*keys).agg(_latest(keys, values, at, order, op, instant).alias("s"))
    return state.where("s is not null").select(*keys, *[F.col(f"s.{v}") for v in values])


def difference(changes: DataFrame, keys: list[str], values: list[str], first: object, second: object, *, at: str, order: list[str], op: str) -> DataFrame:
    """``keys, change, fields``: what was ``added``, ``removed`` or ``changed`` from one instant to the other; ``fields`` lists the changed
    attributes, with commas. Vertices have one key, edges have two."""
    later = F.greatest(*[F.lit(x).cast("timestamp_ntz") for x in (first, second)])
    both = _known(changes, keys, at).where(F.col(at) <= later).groupBy(*keys).agg(_latest(keys, values, at, order, op, first).alias("a"), _latest(keys, values, at, order, op, second).alias("b"))
    unlike = F.array_compact(F.array(*[F.when(~F.col(f"a.{v}").eqNullSafe(F.col(f"b.{v}")), F.lit(v)) for v in values]))
    kind = F.when(F.col("a").isNull() & F.col("b").isNotNull(), "added").when(F.col("a").isNotNull() & F.col("b").isNull(), "removed")
    kind = kind.when(F.col("a").isNotNull() & (F.size(unlike) > 0), "changed")
    return both.select(*keys, kind.alias("change"), F.when(kind == "changed", F.array_join(unlike, ",")).otherwise("").alias("fields")).where("change is not null")


def summary(difference_rows: DataFrame) -> DataFrame:
    """``change, n``, with a row for each of the three kinds."""
    kinds = ("added", "removed", "changed")
    counts = difference_rows.agg(*[F.count_if(F.col("change") == k).alias(k) for k in kinds])
    return counts.select(F.explode(F.create_map(*reduce(lambda a, k: [*a, F.lit(k), F.col(k)], kinds, []))).alias("change", "n"))
