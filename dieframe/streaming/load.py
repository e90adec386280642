"""Incremental loads of chunk files into the merged store: a load log, counters, the last days, and an available-now stream."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import key_hash
from ..operators.merge import all_new, changes, observed_batch, observed_changes, store
from ..sources.schema import KEY7
from ..sources.tables import exists, extract

COLUMNS = ["key", "lot", "wafer", "x", "y", "temp", "step", "site", "ts", "item", "value"]
STORED = "key string, lot string, wafer string, x int, y int, temp double, step string, site int, ts timestamp_ntz, item string, value double"
VERSION = "version long, attempt string, batch string, bucket int, buckets int, at timestamp"
LOG = "attempt string, file string, rows long, at timestamp"
#: What a load counts, in the passes that do its work.
COUNTS = ("rows_in", "rows_empty", "cells", "averaged", "rows_out", "points_new", "points_updated", "points_changed", "cells_filled", "cells_replaced")
BUCKET_ROWS = 20_000_000  #: cells of a bucket, about, once the store holds a year of batches like the first one


def load_log(df: DataFrame, path: str = "_metadata.file_path") -> DataFrame:
    """file, rows of what a read takes in. No data column is read."""
    return df.groupBy(F.col(path).alias("file")).agg(F.count("*").alias("rows"))


def recent(long: DataFrame, days: int, today: Column) -> DataFrame:
    """The last `days` days, today included."""
    return long.where((F.col("ts") >= F.date_sub(today, days - 1).cast("timestamp_ntz")) & (F.col("ts") < F.date_add(today, 1).cast("timestamp_ntz")))


class Store:
    """The long merged store in a shared folder, in buckets by lot.

    A load writes its batch once (the one pass over its input), then the buckets of its lots anew, both under its own
    attempt's name, and appends to the table of versions. Only what stands there counts, so a lost attempt leaves the
    store as it was, and whoever opens the folder later finds the last state. A batch that is there already is not
    loaded again. One load at a time may write; another one at the same time would overwrite no file, but hide the
    first one's cells in buckets that both touch.

    The first load settles the number of buckets: as given, or from its cells times `batches` of its kind.
    """

    def __init__(self, spark: SparkSession, root: str, mean: Column | None = None, buckets: int | None = None, batches: int = 365):
        self.spark, self.root, self.mean, self.buckets, self.batches = spark, root, mean, buckets, batches

    def _rows(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def versions(self) -> DataFrame:
        return self._rows("versions", VERSION)

    def batches_loaded(self) -> set[str]:
        return {r.batch for r in self.versions().select("batch").distinct().collect()}

    def log(self) -> DataFrame:
        """file, rows, at of each file loaded; an attempt that failed doesn't show."""
        return self._rows("log", LOG).join(self.versions().select("attempt").distinct(), "attempt", "left_semi").select("file", "rows", "at")

    def _of(self, latest: dict[int, str]) -> DataFrame:
        paths = [f"{self.root}/data/attempt={a}/bucket={b}" for b, a in sorted(latest.items())]
        return self.spark.read.schema(STORED).parquet(*paths) if paths else self.spark.createDataFrame([], STORED)

    def _latest(self) -> dict[int, str]:
        """The attempt that wrote each bucket last; as many rows as there are buckets."""
        return {r.bucket: r.attempt for r in self.versions().groupBy("bucket").agg(F.max_by("attempt", "version").alias("attempt")).collect() if r.bucket >= 0}

    def table(self) -> DataFrame:
        return self._of(self._latest())

    def load(self, long: DataFrame, batch: str, files: DataFrame | None = None) -> dict[str, int] | None:
        """Merges a batch of long rows and puts it in. Returns COUNTS; None if the batch was loaded before.

        files (file, rows) goes to the load log. The counts come from the two writes: rows read and those in cells
        without a value, cells and those averaged over sequences; cells written, points new and met again, points
        changed, and empty cells filled and values replaced in them.
        """
        state = self.versions().agg(F.max("version").alias("last"), F.max("buckets").alias("buckets"), F.count_if(F.col("batch") == batch).alias("there")).first()
        if state.there:
            return None
        version, attempt = 1 if state.last is None else state.last + 1, uuid.uuid4().hex
        seen, done = Observation(), Observation()
        staged = f"{self.root}/batches/attempt={attempt}"
        staging = [c for c in COLUMNS if c != "key"]  # the hash of a point is its longest column, and follows from the others
        observed_batch(store(long, mean=self.mean, counted=True), seen).select(*staging, "first").write.parquet(staged)
        counts = seen.get
        merged = self.spark.read.schema(f"{STORED}, first boolean").parquet(staged).select(*staging, "first")
        buckets = state.buckets or self.buckets or max(16, -(-counts["cells"] * self.batches // BUCKET_ROWS))
        point = key_hash(*KEY7)
        bucket = F.pmod(F.xxhash64("lot"), F.lit(buckets)).cast("int").alias("bucket")
        touched = [r.bucket for r in merged.select(bucket).distinct().collect()]
        there = {b: a for b, a in self._latest().items() if b in touched}
        dealt = changes(self._of(there), merged.withColumn("key", point)) if there else all_new(merged).withColumn("key", point)
        observed_changes(dealt.withColumn("bucket", bucket), done).select(*COLUMNS, "bucket").write.partitionBy("bucket").parquet(f"{self.root}/data/attempt={attempt}")
        now = F.current_timestamp().alias("at")
        if files is not None:
            files.select(F.lit(attempt).alias("attempt"), "file", "rows", now).write.mode("append").parquet(f"{self.root}/log")
        rows = [(version, attempt, batch, b, buckets) for b in touched or [-1]]  # a batch without cells is there too
        self._note(self.spark.createDataFrame(rows, "version long, attempt string, batch string, bucket int, buckets int").select("*", now))
        return {c: int((counts | done.get)[c]) for c in COUNTS}

    def _note(self, rows: DataFrame) -> None:
        """The load counts from here on."""
        rows.coalesce(1).write.mode("append").parquet(f"{self.root}/versions")  # a row a bucket


def stream_into(folder: str, schema, target: Store, shape: Callable[[DataFrame], DataFrame], files: int = 1) -> None:
    """Every file of the folder not loaded yet, `files` a batch, through the upsert; ends when there is no more.

    What has been read is noted beside the store, so the next call goes on where this one stopped or was lost. What
    has been loaded is told by the load log, file by file: a lost note, or another one beside an old store, neither
    loads a file twice nor leaves one out. A batch is named by its files.
    """

    def put(df: DataFrame, number: int) -> None:
        there = load_log(df, "_path").join(target.log().select("file"), "file", "left_anti").collect()  # `files` rows at most
        if not there:
            return
        names = sorted(r.file for r in there)
        rows = df.where(F.col("_path").isin(names)).drop("_path")
        log = target.spark.createDataFrame([(r.file, r.rows) for r in there], "file string, rows long")
        target.load(shape(rows), hashlib.sha256("\n".join(names).encode()).hexdigest(), log)

    stream = target.spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder).select("*", F.col("_metadata.file_path").alias("_path"))
    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{target.root}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def run(
    source: DataFrame, target: Store, batch: str, line: str, first: str, last: str,
    rules: Callable[[DataFrame], DataFrame] = lambda df: df, items: list[str] | None = None, where: Column | None = None,
) -> dict[str, int] | None:
    """Extraction, rules and load in one. Returns the load's counts; None if the batch was loaded before."""
    return target.load(rules(extract(source, line, first, last, items, where)), batch)
