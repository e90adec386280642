"""Extraction filters, readers of sheets, and sinks."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.predicates import ConditionError


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a new local folder, but not on a cluster, whose executors wouldn't share it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="dieframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: what several passes over it share is computed once."""
    path = scratch(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def date_window(df: DataFrame, time: str, first: str, last: str) -> DataFrame:
    """[first 00:00, the day after last 00:00). Of a table laid out by day or month, only the window's folders are read."""
    low, high = F.lit(first).cast("date"), F.date_add(F.lit(last).cast("date"), 1)
    for unit in UNITS:
        if unit in df.columns:
            df = df.where((F.col(unit) >= F.trunc(low, unit) if unit == "month" else F.col(unit) >= low) & (F.col(unit) < high))
    return df.where((F.col(time) >= low.cast("timestamp_ntz")) & (F.col(time) < high.cast("timestamp_ntz")))


UNITS = ("day", "month")  # the columns that a table is laid out by; a month stands as its first day


def lay_out(df: DataFrame, path: str, time: str = "ts", unit: str = "day") -> None:
    """Writes df in folders by day or month; rows without a time stand in a folder of their own, which no window reads.

    A folder's rows are dealt over as many tasks as their size asks for, so a busy day is no single task's work.
    """
    if unit not in UNITS:
        raise ValueError(f"laid out by {' or '.join(UNITS)}")
    at = F.to_date(time) if unit == "day" else F.trunc(time, "month")
    df.withColumn(unit, at).hint("rebalance", unit).write.partitionBy(unit).parquet(path)


def laid_days(spark: SparkSession, path: str) -> DataFrame:
    """day, files, bytes of a table laid out by day, from its folders alone: no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    day = F.regexp_extract("path", r"/day=(\d{4}-\d{2}-\d{2})/", 1).try_cast("date")
    return files.select(day.alias("day"), "length").where("day IS NOT NULL").groupBy("day").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def item_filter(long: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of the listed items; the list may be as long as it likes."""
    return long.join(items.select("item").distinct(), "item", "left_semi")


def extract(long: DataFrame, line: str, first: str, last: str, items: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """The extraction: a line and a date window are mandatory; the rest narrows down."""
    if not line:
        raise ConditionError("line: the condition is empty")
    out = date_window(long.where(F.col("line") == line), "ts", first, last)
    out = out if items is None else out.where(F.col("item").isin(items))
    return out if where is None else out.where(where)


def probe_days(df: DataFrame, time: str) -> DataFrame:
    """The days under whatever conditions df has. Laid out by day, nothing but the conditions' columns is read; without any, ask `laid_days`."""
    if "day" in df.columns:
        return df.select("day").distinct().where("day IS NOT NULL").orderBy("day")
    return df.select(F.to_date(time).alias("day")).distinct().orderBy("day")


def probe_items(df: DataFrame, item: str = "item", most: int = 5000) -> DataFrame:
    return df.select(item).distinct().limit(most)


def tracking_source(
    tracking: DataFrame, line: str, lots: list[str] = (), first: str | None = None, last: str | None = None, with_ecn: bool = True,
    processes: list[str] = (), parts: list[str] = (),
) -> DataFrame:
    """Passes of a line, those without a change number left out unless asked for. Empty lists narrow nothing."""
    out = tracking.where(F.col("line") == line)
    out = out.where("ecn IS NOT NULL") if with_ecn else out
    for c, wanted in (("lot", lots), ("process", processes), ("part", parts)):
        out = out.where(F.col(c).isin(sorted(set(wanted)))) if wanted else out
    return date_window(out, "ts", first, last or first) if first else out


def metrology_source(
    metrology: DataFrame, lots: list[str], steps: list[str] = (), items: list[str] = (), item_pattern: str | None = None, first: str | None = None, last: str | None = None,
) -> DataFrame:
    if not lots:
        raise ConditionError("lot: the condition is empty")
    out = metrology.where(F.col("lot").isin(sorted(set(lots))))
    out = out.where(F.col("step").isin(list(steps))) if steps else out
    out = out.where(F.col("item").isin(list(items))) if items else out
    out = date_window(out, "ts", first, last or first) if first else out
    return out.where(F.col("item").rlike(item_pattern)) if item_pattern else out


def read_sheet(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A sheet from delimited text: names trimmed and, where repeated, numbered; blank cells null. A column whose
    cells are all numbers becomes double, unless one has a leading zero (a code)."""
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    seen: dict[str, int] = {}
    names = []
    for c in raw.columns:
        c = c.strip()
        seen[c] = seen.get(c, 0) + 1
        names.append(c if seen[c] == 1 else f"{c}_{seen[c]}")
    df = raw.toDF(*names)
    df = df.select(*(F.when(F.trim(f"`{c}`") != "", F.trim(f"`{c}`")).alias(c) for c in names))
    plain = lambda c: F.col(f"`{c}`").try_cast("double").isNotNull() & ~F.col(f"`{c}`").rlike(r"^[-+]?0\d")
    kinds = df.agg(*(F.every(plain(c) | F.col(f"`{c}`").isNull()).alias(c) for c in names)).first()
    return df.select(*(F.col(f"`{c}`").cast("double").alias(c) if kinds[c] else F.col(f"`{c}`") for c in names))


def list_items(df: DataFrame) -> DataFrame:
    return df.select("item").distinct()


def as_long(long: DataFrame) -> DataFrame:
    """The short names of this package as the schema's."""
    names = {"line": "line_id", "lot": "root_lot_id", "wafer": "wafer_id", "x": "chip_x_pos", "y": "chip_y_pos", "temp": "temperature", "step": "step_id", "seq": "step_seq", "site": "total_site_cnt", "ts": "tkout_time", "item": "item_id", "value": "et_value"}
    return long.withColumnsRenamed(names)


def write_chunk(df: DataFrame, path: str, *by: str) -> None:
    (df.write.partitionBy(*by) if by else df.write).parquet(path)


def sources(df: DataFrame) -> list[list]:
    """Path, size and modification time of each file that df reads, from the folder lists; no file is opened."""
    paths = sorted(df.inputFiles())
    if not paths:
        return []
    files = df.sparkSession.read.format("binaryFile").load(paths).select("path", "length", F.unix_micros("modificationTime").alias("at"))
    return sorted([r.path, r.length, r["at"]] for r in files.collect())


def materialize(long: DataFrame, lots: list[str], items: list[str], root: str | None = None) -> DataFrame:
    """The working set of lots and items, written once and read back.

    With a root folder, a set of the same lots, items and rows that is there already is used as it is. The rows are
    told by their canonical plan and by the size and time of each file they come from: a file written anew under its
    name makes a new set.
    """
    spark = long.sparkSession
    rows = long.where(F.col("lot").isin(lots) & F.col("item").isin(items))
    if root is None:
        path = scratch(spark, "workset")
    else:
        plan = re.sub(r"#\d+", "#", long._jdf.queryExecution().analyzed().canonicalized().toString())
        asked = json.dumps([sorted(set(lots)), sorted(set(items)), sources(long), plan])
        path = f"{root}/workset-{hashlib.sha256(asked.encode()).hexdigest()}"
        if exists(spark, f"{path}/_SUCCESS"):  # left by a write that came to its end
            return spark.read.parquet(path)
    rows.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: Statements for `preview`, to be filled in.
SNIPPETS = {
    "all": "SELECT * FROM et_data",
    "lot": "SELECT * FROM et_data WHERE lot = '{lot}'",
    "period": "SELECT * FROM et_data WHERE ts >= DATE '{first}' AND ts < date_add(DATE '{last}', 1)",
    "wafer mean": "SELECT lot, wafer, item, avg(value) AS mean FROM et_data GROUP BY lot, wafer, item",
    "item list": "SELECT DISTINCT item FROM et_data ORDER BY item",
}


def export(df: DataFrame, path: str, kind: str = "parquet", sep: str = ",") -> None:
    (df.write.option("header", True).option("sep", sep).csv(path) if kind == "csv" else df.write.parquet(path))


def preview(df: DataFrame, sql: str, most: int = 200) -> DataFrame:
    """Free SQL over the view et_data."""
    df.createOrReplaceTempView("et_data")
    return df.sparkSession.sql(sql).limit(most)


def replace_report(old: DataFrame, new: DataFrame, report: str) -> DataFrame:
    """One report's rows anew; other reports and their columns stay."""
    return old.where(~F.col("report").eqNullSafe(F.lit(report))).unionByName(new.withColumn("report", F.lit(report)), allowMissingColumns=True)
