"""Valid-time enrichment: each sale gets the version of its client that held when it was sold.

Sales and client changes arrive in batches, out of order. Both tables, as one stream, feed a stateful query
(``transformWithState``) that is started anew for every batch on one checkpoint. Its state are two lists: the clients'
versions, sorted, and the sales that wait until no earlier version can come. A clock row in every batch carries both
watermarks: the largest time of each table in the batches before, less a slack. ``H`` is the smaller one. A batch stores its
changes (those below their watermark are late and reported), emits new and waiting sales below ``H``, finding their versions
by bisection, and then prunes versions that ``H`` has passed, all but a client's last.

A call of the stateful function costs as much for one client as for hundreds, so the key is a block of clients, about
``block_rows`` rows, and a state element a sorted run of them; each client is searched and pruned by itself. A client of more
than ``block_rows`` sales is dealt to several shards: its sales by their id, its changes to each shard. There are never more
shards than make the copies of its changes outnumber its sales. All versions of one client that ``H`` has not passed yet
must fit in a task. Only the watermarks of each batch reach the driver.

Defined results. Repeated changes (equal in all columns) count once, repeated sales each. Changes without ``valid_at`` are
ignored; sales without ``sold_at`` are emitted in the batch of their arrival, without a version; sales without a client have
none, and hold none. Days before the first count as the first, rows without a day too. A null ``seq`` or ``change_id`` sorts
before others. A null or non-finite balance gives null cents. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from basaltiq.llm.common import fresh_path

#: Stands for a missing number in sorted arrays, and for a watermark of minus infinity.
NONE = -(2**63)
HOUR = 3_600_000_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Every start is one batch: a store that is closed after it holds no local files for the next ones.
UNLOAD = "spark.sql.streaming.stateStore.unloadOnCommit"
PARTITIONS = "spark.sql.shuffle.partitions"

FED = "block int, shard int, kind string, client long, known boolean, at long, seq long, id long, op string, cents long, step long, sales_mark long, changes_mark long"
OUT = "rec string, id long, batch long, n_held long, change_id long, balance_cents long, op string"
VERSIONS = ("client", "at", "seq", "id", "op", "cents")
WAITING = ("client", "known", "at", "id")
KINDS = {"client": np.int64, "at": np.int64, "seq": np.int64, "id": np.int64, "cents": np.int64, "known": bool, "op": object}
TYPES = {np.int64: "bigint", bool: "boolean", object: "string"}
#: Rows of one state element.
RUN = 4096


def _state_schema(columns: tuple[str, ...]) -> str:
    return ", ".join(f"{c} array<{TYPES[KINDS[c]]}>" for c in columns)


def _frame(columns: tuple[str, ...], runs: list[tuple]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([np.array(r[k], KINDS[c]) for r in runs] or [np.empty(0, KINDS[c])]) for k, c in enumerate(columns)}


def _runs(columns: tuple[str, ...], rows: dict[str, np.ndarray]) -> list[tuple]:
    return [tuple(rows[c][at : at + RUN].tolist() for c in columns) for at in range(0, len(rows["at"]), RUN)]


def bisect_versions(versions: dict[str, np.ndarray], client: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each sale the place of its client's last version at or before it, -1 without one; and the client's versions."""
    first, end = np.searchsorted(versions["client"], client, "left"), np.searchsorted(versions["client"], client, "right")
    low, high = first.copy(), end.copy()
    while (open_ := low < high).any():
        mid = (low + high) // 2
        right = open_ & (versions["at"][np.minimum(mid, len(versions["at"]) - 1)] <= at)
        low, high = np.where(right, mid + 1, low), np.where(open_ & ~right, mid, high)
    return np.where(low > first, low - 1, -1), end - first


def pruned(versions: dict[str, np.ndarray], upto: int) -> dict[str, np.ndarray]:
    """Without those at or before ``upto`` that a later one of their client, also at or before it, follows."""
    passed = versions["at"] <= upto
    followed = np.zeros(len(passed), bool)
    followed[:-1] = passed[:-1] & passed[1:] & (versions["client"][:-1] == versions["client"][1:])
    return {c: v[~followed] for c, v in versions.items()}


class Enricher(StatefulProcessor):
    """Sorted runs of versions and of waiting sales of one block of clients."""

    def __init__(self, last_step: int) -> None:
        self._last = last_step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._versions = handle.getListState("versions", _state_schema(VERSIONS))
        self._waiting = handle.getListState("waiting", _state_schema(WAITING))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fed = pd.concat(rows, ignore_index=True)
        held, waiting = _frame(VERSIONS, list(self._versions.get())), _frame(WAITING, list(self._waiting.get()))
        new, sales = fed[fed["kind"] == "change"], fed[fed["kind"] == "sale"]
        touched = bool(len(new))
        waiting = {c: np.concatenate([waiting[c], sales[c].to_numpy(KINDS[c])]) for c in WAITING}
        changed = bool(len(sales))
        # The last batch has a second clock, which closes the stream: what still waits is emitted after the batch's own sales.
        for clock in fed[fed["kind"] == "clock"].sort_values("step").itertuples():
            step, changes_mark = int(clock.step), int(clock.changes_mark)
            upto = min(int(clock.sales_mark), changes_mark)
            late = new[new["at"] < changes_mark]
            if key[1] == 0 and len(late):
                yield _result("late", late["id"].to_numpy(np.int64), step)
            more = new[(new["at"] >= changes_mark) & new["known"].astype(bool)]
            if len(more):
                both = {c: np.concatenate([held[c], more[c].to_numpy(KINDS[c])]) for c in VERSIONS}
                order = np.lexsort((both["id"], both["seq"], both["at"], both["client"]))
                held = {c: v[order] for c, v in both.items()}
            new = new.iloc[:0]
            out = (waiting["at"] == NONE) | (waiting["at"] < upto) | (step == self._last)
            if out.any():
                yield self._emitted({c: v[out] for c, v in waiting.items()}, held, step)
                waiting, changed = {c: v[~out] for c, v in waiting.items()}, True
            kept = pruned(held, upto)
            touched, held = touched or len(kept["at"]) < len(held["at"]), kept
        if changed:
            _put(self._waiting, _runs(WAITING, waiting))
        if touched:
            _put(self._versions, _runs(VERSIONS, held))

    @staticmethod
    def _emitted(sales: dict[str, np.ndarray], held: dict[str, np.ndarray], step: int) -> pd.DataFrame:
        place, n_held = bisect_versions(held, sales["client"], sales["at"])
        place, n_held = np.where(sales["known"], place, -1), np.where(sales["known"], n_held, 0)
        made, found = _result("sale", sales["id"], step), place >= 0
        made["n_held"] = pd.array(n_held, dtype="Int64")
        for column, of in (("change_id", "id"), ("balance_cents", "cents")):
            values = np.full(len(place), NONE, np.int64)
            values[found] = held[of][place[found]]
            made[column] = _nullable(values)
        op = np.full(len(place), None, object)
        op[found] = held["op"][place[found]]
        made["op"] = op
        return made

    def close(self) -> None:
        pass


def _put(state, runs: list[tuple]) -> None:
    state.put(runs) if runs else state.clear()


def _nullable(values: np.ndarray) -> pd.arrays.IntegerArray:
    return pd.arrays.IntegerArray(values, values == NONE)


def _result(rec: str, ids: np.ndarray, step: int) -> pd.DataFrame:
    none = _nullable(np.full(len(ids), NONE, np.int64))
    return pd.DataFrame({"rec": rec, "id": _nullable(ids), "batch": np.int64(step), "n_held": none, "change_id": none, "balance_cents": none, "op": None}, index=range(len(ids)))


def _micros(at: Column) -> Column:
    """Microseconds since 1970 of a timestamp's own fields, whatever the session's zone."""
    seconds = F.unix_date(at.cast("date")).cast("long") * 86400 + F.hour(at) * 3600 + F.minute(at) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), at) * 1_000_000).cast("long")


def _batch(day: Column, batches: int, first_day: int, days: int) -> Column:
    number = F.floor((day - first_day) * batches / days).cast("long")
    return F.least(F.lit(batches - 1), F.greatest(F.lit(0), F.coalesce(number, F.lit(0)))).cast("long")


def _or_none(c: Column) -> Column:
    return F.coalesce(c.cast("long"), F.lit(NONE))


def _cut(spark: SparkSession, sales: DataFrame, changes: DataFrame, batches: int, first_day: int, days: int, slack_hours: int, block_rows: int) -> str:
    """Writes both tables and the clock rows, a folder for each batch; the folder above them."""
    base, zero = fresh_path(spark, "sale-versions"), F.lit(0).cast("long")
    changes = changes.select("change_id", "client_id", "seq", "op", "valid_at", *[c for c in changes.columns if c not in ("change_id", "client_id", "seq", "op", "valid_at")]).where("valid_at is not null").distinct()
    blocks = max(1, -(-(sales.count() + changes.count()) // block_rows))
    many = sales.groupBy("client_id").agg(F.count("*").alias("n")).where(F.col("n") > block_rows)
    also = changes.join(many.select("client_id"), "client_id", "left_semi").groupBy(F.col("client_id").alias("other")).agg(F.count("*").alias("m"))
    shards = F.least(F.ceil(F.col("n") / block_rows), F.ceil(F.col("n") / F.coalesce("m", F.lit(1))))
    hot = many.join(also, F.col("client_id") == F.col("other"), "left").select(F.col("client_id").alias("hot"), F.greatest(F.lit(1), shards).cast("int").alias("shards"))

    def dealt(rows: DataFrame, shard: Column, own: Column) -> DataFrame:
        by = F.when(F.col("client_id").isNull(), F.xxhash64(own)).otherwise(F.xxhash64("client_id"))
        return rows.join(hot, F.col("client_id") == F.col("hot"), "left").withColumns({"block": F.pmod(by, F.lit(blocks)).cast("int"), "shard": shard, "client": F.coalesce("client_id", F.lit(0)).cast("long"), "known": F.col("client_id").isNotNull()})

    n = F.coalesce("shards", F.lit(1))
    day = F.unix_date(F.col("arrived_at").cast("date"))
    sold = dealt(sales.select("sale_id", "client_id", "sold_at", "arrived_at"), F.pmod(F.xxhash64("sale_id"), n).cast("int"), F.col("sale_id")).select(
        "block", "shard", F.lit("sale").alias("kind"), "client", "known", _or_none(_micros(F.col("sold_at"))).alias("at"), zero.alias("seq"), _or_none(F.col("sale_id")).alias("id"),
        F.lit(None).cast("string").alias("op"), zero.alias("cents"), _batch(day, batches, first_day, days).alias("step"), zero.alias("sales_mark"), zero.alias("changes_mark"))
    delay = F.coalesce(F.crc32(F.col("change_id").cast("string").cast("binary")) % 4, F.lit(0))
    day = F.unix_date(F.col("valid_at").cast("date")) + delay
    balance = F.col("balance").cast("double")
    cents = F.when((F.abs(balance) < float("inf")) & ~F.isnan(balance), F.floor(100 * balance + 0.5))
    changed = dealt(changes, F.explode(F.sequence(F.lit(0), n - 1)), F.col("change_id")).select(
        "block", "shard", F.lit("change").alias("kind"), "client", "known", _micros(F.col("valid_at")).alias("at"), _or_none(F.col("seq")).alias("seq"), _or_none(F.col("change_id")).alias("id"),
        "op", _or_none(cents).alias("cents"), _batch(day, batches, first_day, days).alias("step"), zero.alias("sales_mark"), zero.alias("changes_mark"))
    for rows in (sold, changed):
        # No more files of a batch than there are blocks.
        rows.coalesce(blocks).withColumn("batch", F.col("step")).write.mode("append").option("compression", "zstd").partitionBy("batch").parquet(base)

    largest = spark.read.schema(FED).parquet(base).where(F.col("at") > NONE).groupBy("step", "kind").agg(F.max("at").alias("at")).collect()
    marks = []
    for step in range(batches + 1):
        before = {kind: [r.at - slack_hours * HOUR for r in largest if r.kind == kind and r.step < step] for kind in ("sale", "change")}
        marks.append((step, max(before["sale"], default=NONE), max(before["change"], default=NONE)))
    every = spark.range(blocks).select(F.col("id").cast("int").alias("block"), F.lit(0).alias("shard"))
    more = hot.where("shards > 1").select(F.pmod(F.xxhash64("hot"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(1), F.col("shards") - 1)).alias("shard")).distinct()
    clock = F.explode(F.array(*[F.struct(*[F.lit(x).cast("long").alias(c) for x, c in zip(m, ("step", "sales_mark", "changes_mark"), strict=True)]) for m in marks]))
    clocks = every.unionByName(more).withColumn("c", clock)
    # Numbers without a meaning are 0 throughout: pandas would make doubles of a column with nulls.
    have = {"block": F.col("block"), "shard": F.col("shard"), "kind": F.lit("clock")} | {c: F.col(f"c.{c}") for c in ("step", "sales_mark", "changes_mark")}
    fields = [p.strip().split() for p in FED.split(",")]
    clocks = clocks.select(*[have.get(c, F.lit(None if kind == "string" else 0)).cast(kind).alias(c) for c, kind in fields])
    clocks.coalesce(1 + blocks // block_rows).withColumn("batch", F.least("step", F.lit(batches - 1))).write.mode("append").partitionBy("batch").parquet(base)
    return base


def enrich_sales(sales: DataFrame, changes: DataFrame, *, batches: int = 8, first_day: int = 19723, days: int = 152, slack_hours: int = 12, block_rows: int = 20_000) -> DataFrame:
    """``rec, id, batch, n_held, change_id, balance_cents, op``: a row for each emitted sale and late change.

    ``sales (sale_id, client_id, sold_at, arrived_at)`` are cut by the day of arrival, ``changes (change_id, client_id, seq,
    op, valid_at, balance)`` by that of ``valid_at`` plus a delay of 0 to 3 days that follows from their id."""
    spark = sales.sparkSession
    base, out, checkpoint = _cut(spark, sales, changes, batches, first_day, days, slack_hours, block_rows), fresh_path(spark, "sale-versions-out"), fresh_path(spark, "sale-versions-state")
    # A state partition has a store of its own: no more of them than there are blocks and shards.
    keys = spark.read.schema(FED).parquet(f"{base}/batch={batches - 1}").where((F.col("kind") == "clock") & (F.col("step") == batches)).count()
    settings = {PROVIDER: ROCKS, UNLOAD: "true", PARTITIONS: str(min(keys, int(spark.conf.get(PARTITIONS))))}
    was = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        for step in range(batches):
            # The source is what has been published so far; the checkpoint knows the files of earlier starts.
            stream = spark.readStream.schema(FED).parquet(f"{base}/batch={{{','.join(map(str, range(step + 1)))}}}")
            made = stream.groupBy("block", "shard").transformWithStateInPandas(Enricher(batches), OUT, "Append", "None")
            made.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        for name, value in was.items():
            spark.conf.set(name, value)
    return spark.read.schema(OUT).parquet(out)


def _crc_sql(digits: str) -> str:
    """CRC-32 of the ASCII bytes of a text, by bits."""
    step = "list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({digits}, ''), lambda d: ascii(d)::BIGINT)), lambda c, b: {step}), 4294967295)"


OP13_SQL = f"""WITH s AS (SELECT sale_id, client_id, sold_at, least(7, greatest(0, floor((arrived_at::DATE - DATE '1970-01-01' - 19723) * 8 / 152)))::BIGINT AS b FROM sales),
c AS (SELECT *, least(7, greatest(0, floor((valid_at::DATE - DATE '1970-01-01' + {_crc_sql("change_id::VARCHAR")} % 4 - 19723) * 8 / 152)))::BIGINT AS b
  FROM (SELECT DISTINCT * FROM client_changes WHERE valid_at IS NOT NULL)),
k AS (SELECT range AS b FROM range(9)),
w AS (SELECT k.b, (SELECT max(sold_at) FROM s WHERE s.b < k.b) - INTERVAL 12 HOUR AS ws, (SELECT max(valid_at) FROM c WHERE c.b < k.b) - INTERVAL 12 HOUR AS wc FROM k),
h AS (SELECT b, wc, CASE WHEN ws IS NULL OR wc IS NULL THEN NULL ELSE least(ws, wc) END AS h FROM w),
v AS (SELECT c.*, wc IS NOT NULL AND valid_at < wc AS late FROM c JOIN h USING (b)),
e AS (SELECT s.*, coalesce((SELECT min(h.b) FROM h WHERE h.b >= s.b AND h.b < 8 AND (s.sold_at IS NULL OR s.sold_at < h.h)), 8) AS out FROM s),
own AS (SELECT DISTINCT client_id, out FROM e),
last AS (SELECT client_id, out, arg_max(change_id, (valid_at, seq, change_id)) AS kept FROM own JOIN v USING (client_id) JOIN h ON h.b = out - 1 WHERE NOT late AND v.b < out AND valid_at <= h.h GROUP BY 1, 2),
live AS (SELECT o.client_id, o.out, v.change_id, v.valid_at, v.seq, v.op, v.balance FROM own o JOIN v ON o.client_id = v.client_id AND NOT v.late AND v.b <= o.out
  LEFT JOIN h ON h.b = o.out - 1 LEFT JOIN last l ON l.client_id = o.client_id AND l.out = o.out WHERE h.h IS NULL OR v.valid_at > h.h OR v.b = o.out OR v.change_id = l.kept),
n AS (SELECT client_id, out, count(*) AS n FROM live GROUP BY 1, 2),
hit AS (SELECT e.sale_id, e.out, e.client_id, arg_max(struct_pack(i := change_id, o := op, x := balance), (valid_at, seq, change_id)) AS m FROM e JOIN live l ON l.client_id = e.client_id AND l.out = e.out AND valid_at <= sold_at GROUP BY 1, 2, 3)
SELECT 'sale' AS rec, e.sale_id AS id, e.out AS batch, coalesce(n.n, 0) AS n_held, m.i AS change_id, floor(100 * m.x + 0.5)::BIGINT AS balance_cents, m.o AS op
FROM e LEFT JOIN n ON n.client_id = e.client_id AND n.out = e.out LEFT JOIN hit ON hit.sale_id = e.sale_id
UNION ALL SELECT 'late', change_id, b, NULL, NULL, NULL, NULL FROM v WHERE late"""
