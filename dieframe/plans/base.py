"""Registry of queries, and the role views over the given tables: the same SQL text serves Spark and the SQL check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

BASE = """SELECT cast(l_suppkey AS string) AS lot, concat('W', lpad(cast(l_linenumber AS string), 2, '0')) AS wafer, cast(l_partkey % 5 AS int) AS x, cast(l_orderkey % 2 AS int) AS y,
  20 + l_tax * 100 AS temp, l_returnflag AS step, l_linestatus AS seq, cast(5 + l_linenumber % 3 AS int) AS site, l_shipdate AS ts, 'L1' AS line, l_quantity AS QTY, l_extendedprice AS PRICE, l_discount AS DISC FROM {lineitem}"""
TRACKING = """SELECT cast(floor(o_custkey / 25) AS string) AS lot, cast(o_custkey % 25 + 1 AS string) AS wafer, o_orderpriority AS step, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS ppid,
  cast(year(o_orderdate) AS string) AS reticle, o_orderdate AS ts, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE cast(o_orderkey % 11 AS string) END AS ecn, concat('L', cast(o_orderkey % 2 AS string)) AS line FROM {orders}"""
METROLOGY = """SELECT cast(l_suppkey AS string) AS lot, lpad(cast(l_linenumber AS string), 2, '0') AS wafer, l_returnflag AS step, p_type AS item,
  CASE l_linenumber % 3 WHEN 0 THEN 'q2' WHEN 1 THEN 'S1' ELSE 'MAX' END AS subitem, l_quantity AS fab_value, l_shipdate AS ts FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""
KEYS = "lot, wafer, x, y, temp, step, site"
RULES = """SELECT * FROM (VALUES ('QTY', 'Qty', 2.0, false), ('PRICE', 'Cost', -0.5, true)) AS r(item, alias, scale, absolute)"""
SPECS = """SELECT item, cast(lsl AS double) AS lsl, cast(target AS double) AS target, cast(usl AS double) AS usl, cast(width AS double) AS width
  FROM (VALUES ('QTY', 20.0, 25.0, 30.0, 1.0), ('PRICE', 30000.0, 35000.0, 38000.0, 2.0), ('DISC', 0.02, 0.05, 0.06, NULL)) AS s(item, lsl, target, usl, width)"""
GID = "CASE cast(lot AS int) % 3 WHEN 0 THEN 'g0' WHEN 1 THEN 'g1' ELSE '' END"
EXACT = "cast(sum(cast(value AS decimal(20,6))) AS double) / count(value)"

#: Common table expressions for the SQL check, each with those it needs.
PARTS = {
    "base": ((), BASE.format(lineitem="lineitem")),
    "long": (("base",), "SELECT lot, wafer, x, y, temp, step, seq, site, ts, line, 'QTY' AS item, QTY AS value FROM base UNION ALL SELECT lot, wafer, x, y, temp, step, seq, site, ts, line, 'PRICE', PRICE FROM base UNION ALL SELECT lot, wafer, x, y, temp, step, seq, site, ts, line, 'DISC', DISC FROM base"),
    "rounded": (("long",), "SELECT lot, wafer, x, y, round(temp / 5) * 5 AS temp, step, seq, site, ts, line, item, value FROM long"),
    "retest": (("rounded",), f"SELECT {KEYS}, seq, item, value, ts FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS}, seq, item ORDER BY ts DESC NULLS LAST, value DESC) AS rn FROM rounded WHERE value IS NOT NULL) t WHERE rn = 1"),
    "merged": (("retest",), f"SELECT {KEYS}, item, {EXACT} AS value, count(value) AS n FROM retest GROUP BY {KEYS}, item"),
    "wide": (("merged",), f"SELECT {KEYS}, max(value) FILTER (item = 'QTY') AS QTY, max(value) FILTER (item = 'PRICE') AS PRICE, max(value) FILTER (item = 'DISC') AS DISC FROM merged GROUP BY {KEYS}"),
    "pts": (("wide",), f"SELECT md5(concat_ws('|', {KEYS})) AS key, lot, wafer, {GID} AS gid, step, temp, site, QTY, PRICE, DISC FROM wide"),
    "plong": (("merged",), f"SELECT md5(concat_ws('|', {KEYS})) AS key, lot, wafer, {GID} AS gid, step, temp, site, item, value FROM merged"),
    "tracking": ((), TRACKING.format(orders="orders").replace("floor(o_custkey / 25)", "o_custkey // 25")),
    "metrology": ((), METROLOGY.format(lineitem="lineitem", part="part")),
    "rules": ((), RULES),
    "specs": ((), SPECS),
    "wafer": (("merged",), f"SELECT lot, wafer, item, {EXACT} AS avg, count(*) AS n FROM merged GROUP BY lot, wafer, item"),
}


def with_parts(sql: str, *names: str) -> str:
    """sql behind the named common table expressions and what they need."""
    order: list[str] = []

    def need(n: str) -> None:
        for m in PARTS[n][0]:
            need(m)
        if n not in order:
            order.append(n)

    for n in names:
        need(n)
    return ("WITH " + ", ".join(f"{n} AS ({PARTS[n][1]})" for n in order) + " " if order else "") + sql


def query(name: str, sql: str | None = None, *parts: str):
    """Registers a query and, behind the named parts, the SQL that it must equal."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = with_parts(sql, *parts)
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def base(spark, sf) -> DataFrame:
    return spark.sql(BASE, lineitem=read(spark, sf, "lineitem"))


def long(spark, sf) -> DataFrame:
    return base(spark, sf).unpivot(["lot", "wafer", "x", "y", "temp", "step", "seq", "site", "ts", "line"], ["QTY", "PRICE", "DISC"], "item", "value")


def rounded(spark, sf) -> DataFrame:
    from ..functions.columns import temp_round5

    return long(spark, sf).withColumn("temp", temp_round5("temp"))


def merged(spark, sf) -> DataFrame:
    from ..operators.merge import exact_mean, merge_retest, merge_seq

    return merge_seq(merge_retest(rounded(spark, sf)), mean=exact_mean())


def wide(spark, sf) -> DataFrame:
    from ..operators.merge import pivot_wide

    return pivot_wide(merged(spark, sf), ["QTY", "PRICE", "DISC"])


def tracking(spark, sf) -> DataFrame:
    return spark.sql(TRACKING, orders=read(spark, sf, "orders"))


def metrology(spark, sf) -> DataFrame:
    return spark.sql(METROLOGY, lineitem=read(spark, sf, "lineitem"), part=read(spark, sf, "part"))


def rules(spark) -> DataFrame:
    return spark.sql(RULES)


def specs(spark) -> DataFrame:
    return spark.sql(SPECS)


def _context(df: DataFrame) -> DataFrame:
    from ..functions.columns import key_hash
    from ..sources.schema import KEY7

    return df.withColumn("key", key_hash(*KEY7)).withColumn("gid", F.expr(GID)).drop("x", "y", "n")


def points(spark, sf) -> DataFrame:
    """The analysis frame: key, lot, wafer, gid, step, temp, site and the items as columns."""
    return _context(wide(spark, sf))


def points_long(spark, sf) -> DataFrame:
    """The same with one row a point and item."""
    return _context(merged(spark, sf))
