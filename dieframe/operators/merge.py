"""Retests and sequences merged to one value a point and item, and the store's upsert.

The long merged table is the canonical store; wide views are pivots of named items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.columns import key_hash
from ..sources.schema import KEY7


def exact_mean(value: str = "value", scale: int = 6) -> Column:
    """A mean that doesn't depend on the order of rows: the sum is decimal."""
    return F.sum(F.col(value).cast(f"decimal(20,{scale})")).cast("double") / F.count(value)


def merge_retest(long: DataFrame, keys: list[str] = KEY7, seq: str = "seq", time: str = "ts") -> DataFrame:
    """Per point, sequence and item the latest value. Null values never win, a null time is the earliest, ties go to the larger value.

    Rows are dealt by point once, which serves all later steps by point. Within a partition they are put in order by a
    sort that can spill, and the first of each stays.
    """
    rows = long.where("value IS NOT NULL").select(*keys, seq, "item", time, "value")
    return _dealt(rows, keys).withColumn("_place", _latest_first([*keys, seq, "item"], time)).where("_place = 1").drop("_place").select(*keys, seq, "item", "value", time)


def _dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows dealt by point, by its keys that aren't floating numbers: windows normalise those, and would deal the rows again."""
    kinds = dict(rows.dtypes)
    return rows.repartition(*([k for k in keys if kinds[k] not in ("double", "float")] or keys))


def _latest_first(by: list[str], time: str) -> Column:
    """A row's place among those of its point, sequence and item: values before null, the latest first, of equal times the larger."""
    order = [F.col("value").isNull(), F.col(time).desc_nulls_last(), F.col("value").desc()]
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def merge_seq(retested: DataFrame, keys: list[str] = KEY7, mean: Column | None = None) -> DataFrame:
    """Per point and item the mean over sequences, and how many there were."""
    return retested.groupBy(*keys, "item").agg((F.avg("value") if mean is None else mean).alias("value"), F.count("value").alias("n"))


def averaged_cells(merged: DataFrame) -> DataFrame:
    """item, cells: how many values were averaged over more than one sequence."""
    return merged.where("n > 1").groupBy("item").agg(F.count("*").alias("cells"))


def merge_keys(long: DataFrame, keys: list[str] = KEY7, time: str = "ts") -> DataFrame:
    """Per point its hash, the last time, and the smallest line and part."""
    return long.groupBy(*keys).agg(F.max(time).alias(time), F.min("line").alias("line"), *([F.min("part").alias("part")] if "part" in long.columns else [])).withColumn("key", key_hash(*keys))


def pivot_wide(merged: DataFrame, items: list[str], keys: list[str] = KEY7) -> DataFrame:
    return merged.groupBy(*keys).pivot("item", items).agg(F.max("value"))


def store(long: DataFrame, keys: list[str] = KEY7, mean: Column | None = None, counted: bool = False) -> DataFrame:
    """The long merged store of a batch: key, point, its last time, item, value.

    One scan and one shuffle, by point (its hash comes after it); retests, sequences and the point's last time (of all its rows, also
    those without a value) follow from that. counted: also n (sequences averaged; 0: no value), rows (how many
    rows went in) and first (one cell with a value of each point), and cells without a value stay, so that what is counted over all rows is all that was read.
    """
    rows = long.select(*keys, "seq", "item", "ts", "value")
    last = _dealt(rows, keys).withColumn("value", F.when(_latest_first([*keys, "seq", "item"], "ts") == 1, F.col("value")))
    cells = last.groupBy(*keys, "item").agg((F.avg("value") if mean is None else mean).alias("value"), F.count("value").alias("n"), F.max("ts").alias("ts"), F.count("*").alias("rows"))
    there, whole = F.when(F.col("n") > 0, F.col("item")), Window.partitionBy(*keys)
    flag = {"first": F.coalesce(there == F.min(there).over(whole), F.lit(False))} if counted else {}
    out = cells.withColumns({"ts": F.max("ts").over(whole), **flag}).withColumn("key", key_hash(*keys))
    point = ["key", *keys]
    return out.select(*point, "item", "value", "ts", "n", "rows", "first") if counted else out.where("n > 0").select(*point, "item", "value", "ts")


DEALT = ("lot", "wafer")  #: what a store's cells are dealt by
CHANGES = ("new", "first", "filled", "replaced", "changed")


def changes(stored: DataFrame, batch: DataFrame, keys: list[str] = KEY7) -> DataFrame:
    """The store after a batch (see `upsert`) with flags of each cell: new (its point wasn't stored), filled (an empty cell of a stored
    point), replaced (by another, later value); and of one cell a point of the batch: first, changed (any filled or replaced).

    Rows are dealt once, by lot and wafer where a point has them (as the store is laid out), else by key; a point's cells
    are then put together in the same partition.
    """
    side = lambda df, new: df.select("key", *keys, "item", "ts", "value", F.lit(new).alias("new"))
    deal = [k for k in DEALT if k in keys] or ["key"]
    rows = side(stored, False).unionByName(side(batch, True)).repartition(*deal)
    of = lambda c, new: F.max(F.when(F.col("new") == new, F.col(c)))
    cells = rows.groupBy("key", *keys, "item").agg(
        of("value", False).alias("a"), of("value", True).alias("b"), of("ts", False).alias("ta"), of("ts", True).alias("tb"),
        F.bool_or(~F.col("new")).alias("old"), F.bool_or("new").alias("met"),
    )
    point = Window.partitionBy(*{"key": 0} | dict.fromkeys(deal))
    cells = cells.withColumns({c: F.max(c).over(point) for c in ("ta", "tb", "old", "met")})
    newer = F.coalesce(F.col("tb") > F.col("ta"), F.col("ta").isNull())
    filled = F.col("old") & F.col("a").isNull() & F.col("b").isNotNull()
    replaced = F.coalesce(F.col("old") & newer & (F.col("a") != F.col("b")), F.lit(False))
    cells = cells.withColumns({
        "value": F.when(newer, F.coalesce("b", "a")).otherwise(F.coalesce("a", "b")), "ts": F.greatest("ta", "tb"), "new": ~F.col("old"), "filled": filled, "replaced": replaced,
        "first": F.col("met") & (F.col("item") == F.min("item").over(point)),
    })
    return cells.withColumn("changed", F.col("first") & F.max(F.col("filled") | F.col("replaced")).over(point)).select("key", *keys, "ts", "item", "value", *CHANGES)


def all_new(batch: DataFrame) -> DataFrame:
    """What `changes` makes of a batch (with first) where nothing is stored: without a shuffle but the one by lot and wafer."""
    none = F.lit(False)
    return batch.withColumns({"new": F.lit(True), "filled": none, "replaced": none, "changed": none}).repartition(*DEALT)


def upsert(stored: DataFrame, batch: DataFrame, keys: list[str] = KEY7) -> DataFrame:
    """The store after a batch. A point met later than stored replaces values by its own that aren't null; else it only fills gaps.

    The times compared are the points', not the items'. Applying a batch again changes nothing. A key and item
    stands once in each table.
    """
    return changes(stored, batch, keys).drop(*CHANGES)


def new_points(batch: DataFrame, stored: DataFrame) -> DataFrame:
    return batch.select("key").distinct().join(stored.select("key"), "key", "left_anti")


def observed_batch(merged: DataFrame, seen: Observation) -> DataFrame:
    """The cells of a counted batch that have a value. Counts what passes: rows_in, rows_empty, cells, averaged."""
    return merged.observe(
        seen, F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_in"), F.coalesce(F.sum(F.when(F.col("n") == 0, F.col("rows"))), F.lit(0)).alias("rows_empty"),
        F.count_if(F.col("n") > 0).alias("cells"), F.count_if(F.col("n") > 1).alias("averaged"),
    ).where("n > 0")


def observed_changes(changed: DataFrame, seen: Observation) -> DataFrame:
    """The store after a batch. Counts what passes: rows_out, points_new, points_updated, points_changed, cells_filled, cells_replaced."""
    flag = F.col
    return changed.observe(
        seen, F.count("*").alias("rows_out"), F.count_if(flag("first") & flag("new")).alias("points_new"), F.count_if(flag("first") & ~flag("new")).alias("points_updated"),
        F.count_if("changed").alias("points_changed"), F.count_if("filled").alias("cells_filled"), F.count_if("replaced").alias("cells_replaced"),
    ).drop(*CHANGES)
