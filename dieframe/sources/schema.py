"""The fixed schema of long measurements, and tables brought into it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C

# The columns of raw long measurements.
LONG = T.StructType([
    T.StructField("line_id", T.StringType()),
    T.StructField("root_lot_id", T.StringType()),
    T.StructField("wafer_id", T.StringType()),
    T.StructField("chip_x_pos", T.IntegerType()),
    T.StructField("chip_y_pos", T.IntegerType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("step_id", T.StringType()),
    T.StructField("step_seq", T.StringType()),
    T.StructField("total_site_cnt", T.IntegerType()),
    T.StructField("tkout_time", T.TimestampNTZType()),
    T.StructField("item_id", T.StringType()),
    T.StructField("et_value", T.DoubleType()),
    T.StructField("part_id", T.StringType()),
])
KEY7 = ["lot", "wafer", "x", "y", "temp", "step", "site"]
RESERVED = ["key", "lot", "wafer", "gid", "step", "temp", "site"]
CRITICAL = ["step_seq", "tkout_time", "temperature", "total_site_cnt"]


def norm_columns(df: DataFrame, schema: T.StructType = LONG) -> DataFrame:
    """Names matched without case and edge blanks; of several, the exact one first, then the first that isn't null."""
    by_name: dict[str, list[str]] = {}
    for c in df.columns:
        by_name.setdefault(c.strip().lower(), []).append(c)
    out, used = [], set()
    for name in schema.names:
        found = sorted(by_name.get(name.lower(), []), key=lambda c: c != name)
        used |= set(found)
        if found:
            out.append(F.coalesce(*(F.col(f"`{c}`") for c in found)).alias(name))
    return df.select(*out, *(F.col(f"`{c}`") for c in df.columns if c not in used))


def norm_time(df: DataFrame) -> DataFrame:
    """Text columns *_time and *_dttm as timestamps; what can't be read is null."""
    found = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name.lower().endswith(("_time", "_dttm"))]
    return df.withColumns({c: F.col(c).try_cast("timestamp_ntz") for c in found})


def norm_numeric(df: DataFrame, schema: T.StructType = LONG) -> DataFrame:
    """Numbers kept as text or decimals, to the schema's type; what can't be read is null."""
    kinds = {f.name: f.dataType for f in schema.fields if isinstance(f.dataType, T.NumericType)}
    return df.withColumns({c: C.number(c).try_cast(t) for c, t in kinds.items() if c in df.columns})


def norm_seq(df: DataFrame, column: str = "step_seq") -> DataFrame:
    return df.withColumn(column, C.seq_text(column)) if column in df.columns else df


def fill_missing(df: DataFrame, schema: T.StructType = LONG) -> DataFrame:
    """The schema's columns in its order, absent ones as typed nulls; others stand at the end."""
    own = [F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    return df.select(*own, *(F.col(f"`{c}`") for c in df.columns if c not in schema.names))


def normalize(df: DataFrame, schema: T.StructType = LONG) -> DataFrame:
    """Names, times, numbers, sequences, missing columns, temperature, in this order."""
    for step in (lambda d: norm_columns(d, schema), norm_time, lambda d: norm_numeric(d, schema), norm_seq, lambda d: fill_missing(d, schema)):
        df = df.transform(step)
    return df.withColumn("temperature", C.temp_round5("temperature"))


def emptied_keys(before: DataFrame, after: DataFrame, keys: list[str] = CRITICAL) -> DataFrame:
    """column, reason of each key column without any value: 'absent' in the source, or 'lost' in conversion."""
    there = [c for c in keys if c in before.columns]
    old = before.agg(*(F.count(c).alias(c) for c in there), F.count("*").alias("rows"))
    new = after.agg(*(F.count(c).alias(f"new_{c}") for c in keys))
    each = [F.struct(F.lit(c).alias("column"), F.when((F.col(c) if c in there else F.lit(0)) > 0, "lost").otherwise("absent").alias("reason"), (F.col(f"new_{c}") == 0).alias("empty")) for c in keys]
    return old.crossJoin(new).where("rows > 0").select(F.explode(F.array(*each)).alias("k")).where("k.empty").select("k.column", "k.reason")


def read_long(spark, *paths: str) -> DataFrame:
    return spark.read.schema(LONG).parquet(*paths).withColumnRenamed("et_value", "value")


# Roles of tables from elsewhere.

# The names that columns of a role have, the first one found counts.
ALIASES = {
    "lot": ["root_lot_id", "lot_id", "lot", "lotid", "lot_no"],
    "wafer": ["wafer_id", "wafer", "wafer_no", "waferid", "slot_no", "slot"],
    "x": ["chip_x_pos", "die_x", "x_pos", "chip_x", "x"],
    "y": ["chip_y_pos", "die_y", "y_pos", "chip_y", "y"],
    "temp": ["temperature", "temp"],
    "step": ["step_id", "step", "oper", "operation"],
    "seq": ["step_seq", "seq", "retest_cnt"],
    "site": ["total_site_cnt", "site_cnt", "site_no", "site"],
    "time": ["tkout_time", "create_dttm", "meas_time", "test_time", "dttm"],
    "line": ["line_id", "line", "fab", "fab_id"],
    "process": ["process_id", "process", "proc_id"],
    "part": ["part_id", "part", "product_id", "device_id"],
    "key": ["key_hash", "key"],
    "item": ["item_id", "item", "param", "parameter", "item_name"],
    "value": ["et_value", "value", "val", "result", "meas_value"],
}
# The name that this package's own merged rows use beyond those.
ALIASES["time"].append("ts")


class Profile:
    """What a table's columns are for. layout is long if it has an item and a value column, else wide."""

    def __init__(self, df: DataFrame):
        lower = {c.lower(): c for c in reversed(df.columns)}
        self.roles = {r: next(lower[a] for a in names if a in lower) for r, names in ALIASES.items() if any(a in lower for a in names)}
        self.layout = "long" if {"item", "value"} <= self.roles.keys() else "wide"
        taken = set(self.roles.values()) | {c for c in df.columns if c.lower() in RESERVED}
        self.items = [f.name for f in df.schema.fields if f.name not in taken and isinstance(f.dataType, T.NumericType)]
        if not self.items and self.layout == "wide":  # values kept as text
            self.items = [f.name for f in df.schema.fields if f.name not in taken and isinstance(f.dataType, T.StringType)]

    def column(self, role: str, kind: str = "string") -> Column:
        return F.col(f"`{self.roles[role]}`") if role in self.roles else F.lit(None).cast(kind)


def pick_table(names: list[str], widths: dict[str, int]) -> str:
    """et_data, else fact, else the widest that is no meta table."""
    for want in ("et_data", "fact"):
        if want in names:
            return want
    return max((n for n in names if not n.startswith("meta")), key=lambda n: (widths[n], n))


def row_key(p: Profile) -> Column:
    if "key" in p.roles:
        return p.column("key").cast("string")
    found = [p.column(r) for r in ("lot", "wafer", "x", "y", "step", "temp", "site", "seq") if r in p.roles]
    return C.key_hash(*found) if found else F.monotonically_increasing_id().cast("string")


def context(p: Profile) -> list[Column]:
    return [row_key(p).alias("key"), p.column("lot").cast("string").alias("lot"), p.column("wafer").cast("string").alias("wafer"), F.lit("").alias("gid"), p.column("step").cast("string").alias("step"), C.temp_round5(p.column("temp")).alias("temp"), p.column("site").try_cast("int").alias("site")]


def in_lots(df: DataFrame, lots: list[str], column: str = "lot") -> DataFrame:
    """No lots: no filter."""
    return df.where(F.col(column).isin(sorted(set(lots)))) if lots else df


def latest_retest(df: DataFrame, keys: list[str], time: str, *ties: str) -> DataFrame:
    """One row a key: the latest; a null time is the earliest; ties by the columns named, larger first."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(F.col(time).desc_nulls_last(), *(F.col(c).desc_nulls_last() for c in ties))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def select_wide(df: DataFrame, items: list[str], lots: list[str] = ()) -> DataFrame:
    """Context and the chosen items of a wide table; lots are filtered before retests are ranked."""
    p = Profile(df)
    df = in_lots(df, list(lots), p.roles["lot"]) if "lot" in p.roles else df
    keys = [p.roles[r] for r in ("lot", "wafer", "x", "y", "temp", "step", "site", "seq") if r in p.roles]
    df = latest_retest(df, keys, p.roles["time"], *items) if "time" in p.roles and "lot" in p.roles else df
    return df.select(*context(p), *(C.number(f"`{i}`").alias(i) for i in items))


def select_long(df: DataFrame, items: list[str], lots: list[str] = ()) -> DataFrame:
    """Context and one column an item of a long table."""
    p = Profile(df)
    df = in_lots(df, list(lots), p.roles["lot"]).where(p.column("item").isin(items))
    rows = df.select(*context(p), p.column("item").alias("_item"), C.number(p.column("value")).alias("_value"))
    return rows.groupBy(*RESERVED).pivot("_item", items).agg(F.max("_value"))


def all_equal_schema(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
