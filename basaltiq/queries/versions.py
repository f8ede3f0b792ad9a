"""Queries over nested documents and over versions in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltiq.operators import documents, snapshots
from basaltiq.registry import CORE
from basaltiq.sources.tables import read

Q = CORE.query

WALK = """walk AS (SELECT click_id, e.fullkey AS path, len(regexp_extract_all(substr(e.fullkey, 2), '[.]|\\[')) AS depth,
CASE e.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind, json_extract_string(e.atom, '$') AS value
FROM clicks, json_tree(CASE WHEN json_valid(props) THEN props END) e)"""


@Q(f"WITH {WALK} SELECT click_id, path, depth, kind, value FROM walk WHERE depth <= 4")
def settings_at_depth(spark: SparkSession, d: str) -> DataFrame:
    return documents.walk(read(spark, d, "clicks"), "click_id", "props").drop("keys")


@Q(f"WITH {WALK} SELECT regexp_replace(path, '\\[[0-9]+\\]', '[]', 'g') AS path, kind, count(*) AS n FROM walk WHERE depth <= 4 GROUP BY 1, 2")
def json_types_by_place(spark: SparkSession, d: str) -> DataFrame:
    return documents.type_profile(read(spark, d, "clicks"), "click_id", "props")


FIRST, SECOND = "2024-02-01", "2024-04-15"
CLIENT = {"keys": ["client_id"], "values": ["source", "segment", "city"], "at": "valid_at", "order": ["seq", "change_id"], "op": "op"}
EDGE = {"keys": ["src", "dst"], "values": ["weight"], "at": "shipped", "order": ["l_orderkey", "l_linenumber", "weight"], "op": "op"}
EDGES_SQL = "supplies AS (SELECT l_suppkey AS src, l_partkey AS dst, CASE WHEN l_returnflag = 'R' THEN 'D' ELSE 'U' END AS op, l_quantity AS weight, CAST(l_shipdate AS TIMESTAMP) AS shipped, l_orderkey, l_linenumber FROM lineitem)"


def _difference_sql(rows: str, spec: dict, first: str, second: str) -> str:
    keys, order = ", ".join(spec["keys"]), ", ".join(f"{c} DESC NULLS LAST" for c in [spec["at"], *spec["order"]])
    known = " AND ".join(f"{c} IS NOT NULL" for c in [*spec["keys"], spec["at"]])
    state = lambda t: f"SELECT * FROM (SELECT * FROM {rows} WHERE {known} AND {spec['at']} <= TIMESTAMP '{t}' QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {order}) = 1) WHERE op IS NULL OR op <> 'D'"
    fields = ", ".join(f"CASE WHEN a.{v} IS DISTINCT FROM b.{v} THEN '{v}' END" for v in spec["values"])
    on, k = " AND ".join(f"a.{c} = b.{c}" for c in spec["keys"]), spec["keys"][0]
    names = ", ".join(f"coalesce(a.{c}, b.{c}) AS {c}" for c in spec["keys"])
    return f"""SELECT * FROM (SELECT {names}, CASE WHEN a.{k} IS NULL THEN 'added' WHEN b.{k} IS NULL THEN 'removed' WHEN concat_ws(',', {fields}) <> '' THEN 'changed' END AS change,
CASE WHEN a.{k} IS NULL OR b.{k} IS NULL THEN '' ELSE concat_ws(',', {fields}) END AS fields FROM ({state(first)}) a FULL JOIN ({state(second)}) b ON {on}) WHERE change IS NOT NULL"""


@Q(_difference_sql("client_changes", CLIENT, FIRST, SECOND))
def vertex_differences(spark: SparkSession, d: str) -> DataFrame:
    """Clients as vertices: what two versions of the graph differ in."""
    return snapshots.difference(read(spark, d, "client_changes"), first=FIRST, second=SECOND, **CLIENT)


def _edge_events(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("l_returnflag") == "R", "D").otherwise("U")
    return read(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), op.alias("op"), F.col("l_quantity").alias("weight"), F.col("l_shipdate").cast("timestamp_ntz").alias("shipped"), "l_orderkey", "l_linenumber")


EDGE_FIRST, EDGE_SECOND = "1994-06-01", "1996-06-01"


@Q(f"WITH {EDGES_SQL} {_difference_sql('supplies', EDGE, EDGE_FIRST, EDGE_SECOND)}")
def edge_differences(spark: SparkSession, d: str) -> DataFrame:
    """Who supplies which part: edges that were added, removed or weigh otherwise."""
    return snapshots.difference(_edge_events(spark, d), first=EDGE_FIRST, second=EDGE_SECOND, **EDGE)


@Q("""SELECT change_id, client_id, valid_at, lead(valid_at) OVER (PARTITION BY client_id ORDER BY valid_at, seq, change_id) AS valid_to FROM client_changes WHERE client_id IS NOT NULL AND valid_at IS NOT NULL""")
def validity_intervals(spark: SparkSession, d: str) -> DataFrame:
    made = snapshots.intervals(read(spark, d, "client_changes"), ["client_id"], at="valid_at", order=["seq", "change_id"])
    return made.select("change_id", "client_id", "valid_at", "valid_to")
