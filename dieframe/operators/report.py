"""Report tables, templates, orders, runs and pages; groups of wafers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.tables import scratch, stored
from .stats import delta, quantiles

# Windows.


def center(df: DataFrame, columns: list[str], by: str = "lot") -> DataFrame:
    return df.withColumns({c: F.col(c) - F.avg(c).over(Window.partitionBy(by)) for c in columns})


def median_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls become the column's median. df is computed once and read by three passes."""
    df = stored(df)
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("value")) for c in columns))).alias("e")
    found = quantiles(df.select(each).select("e.*"), {"med": 0.5}, ("item",))
    medians = found.agg(*(F.max(F.when(F.col("item") == c, F.col("med"))).alias(f"_{c}") for c in columns))  # one row
    return df.crossJoin(F.broadcast(medians)).withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*(f"_{c}" for c in columns))


def running(df: DataFrame, order: list[Column], name: str, amount: Column | None = None) -> DataFrame:
    """Adds name: the sum of `amount` (rows, if not given) over all rows before this one in order. No task sees more than a range of the rows.

    Rows are dealt by ranges of the order and written so, once; each range's sum is put before the next one's, and within
    a range rows are summed up on their own. Only the ranges' sums, as many as there are partitions, meet in one task.
    """
    spark = df.sparkSession
    path = scratch(spark, "ranges")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("_amount", F.lit(1).cast("long") if amount is None else amount.cast("long")).repartitionByRange(parts, *order)
    ranged.withColumn("_range", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_range").agg(F.sum("_amount").alias("_sum"))
    sums = sums.select("_range", F.coalesce(F.sum("_sum").over(earlier.orderBy("_range")), F.lit(0)).alias("_before"))
    own = F.coalesce(F.sum("_amount").over(earlier.partitionBy("_range").orderBy(*order)), F.lit(0))
    return rows.withColumn(name, own).join(sums, "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_amount", "_before")


def ranked(df: DataFrame, *order: Column, by: list[str] = (), name: str = "rank") -> DataFrame:
    """Adds name: the row's number in order, from 1, within the groups named or over all rows."""
    if by:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return running(df, [*order], name).withColumn(name, (F.col(name) + 1).cast("int"))


def day_spans(days: DataFrame, most: int, by: list[str] = ()) -> DataFrame:
    """Runs of consecutive days, cut to `most` days each: first, last. days: one row a day with data."""
    w = Window.partitionBy(*by).orderBy("day")
    t = days.withColumn("k", F.row_number().over(w)).withColumn("island", F.date_sub("day", F.col("k")))
    t = t.withColumn("part", F.floor((F.row_number().over(Window.partitionBy(*by, "island").orderBy("day")) - 1) / most))
    return t.groupBy(*by, "island", "part").agg(F.min("day").alias("first"), F.max("day").alias("last")).drop("island", "part")


def runs(df: DataFrame, by: list[str], order: list[Column | str], columns: list[str]) -> DataFrame:
    """Adds <column>_run: numbers of runs of equal values in order; a column breaks where one before it does."""
    w = Window.partitionBy(*by).orderBy(*order)
    broken = F.lag(F.lit(1)).over(w).isNull()
    for c in columns:
        broken = broken | ~F.col(c).eqNullSafe(F.lag(c).over(w))
        df = df.withColumn(f"_{c}", broken.cast("int"))
    return df.withColumns({f"{c}_run": F.sum(f"_{c}").over(w) for c in columns}).drop(*(f"_{c}" for c in columns))


def pages(wafers: DataFrame, most: int = 12) -> DataFrame:
    """Adds page: lots start anew, at most `most` wafers each, in natural order. Pages are numbered over the lots' page counts."""
    in_lot = Window.partitionBy("lot").orderBy(C.natural_key("wafer"))
    t = wafers.withColumn("in_lot", F.floor((F.row_number().over(in_lot) - 1) / most))
    per = t.groupBy("lot").agg((F.max("in_lot") + 1).alias("n"))
    return t.join(running(per, [C.natural_key("lot")], "before", F.col("n")).select("lot", "before"), "lot").withColumn("page", F.col("before") + F.col("in_lot") + 1).drop("in_lot", "before")


def deck_meta(long: DataFrame) -> DataFrame:
    """One row: the steps (sorted), how many lots and temperatures there are, the first line and the last time."""
    return long.agg(F.sort_array(F.collect_set("step")).alias("steps"), F.countDistinct("lot").alias("lots"), F.countDistinct("temp").alias("temps"), F.min("line").alias("line"), F.max("ts").alias("last"))


def spec_columns(long: DataFrame, specs: DataFrame) -> DataFrame:
    """item, lsl, target, usl of the items that the data and the rule sheet both have."""
    return specs.select("item", "lsl", "target", "usl").join(long.select("item").distinct(), "item", "left_semi")


def most_frequent(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """The k values with the most rows, ties by the value: column, n."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column).limit(k)


def column_order(wafers: DataFrame, grouped: bool = False) -> DataFrame:
    """Adds place: lot and wafer in natural order, within the group if grouped (no group last)."""
    first = [F.when(F.col("gid") != "", F.col("gid")).asc_nulls_last()] if grouped else []
    return ranked(wafers, *first, C.natural_key("lot").asc(), C.natural_key("wafer").asc(), name="place")


# Tables.


def summary(template: DataFrame, stats: DataFrame, specs: DataFrame, stat: str = "avg", ref: DataFrame | None = None) -> DataFrame:
    """Template rows x wafers: the statistic, its spec columns and offspec (of the mean without delta only)."""
    t = template.join(stats, "item").join(specs, "item", "left")
    if ref is not None:
        t = delta(t, ref, stat).withColumn(stat, F.col("delta")).drop("delta")
    flag = C.off_spec(stat, "lsl", "usl") if stat == "avg" and ref is None else F.lit(False)
    return t.withColumn("offspec", flag)


def group_table(template: DataFrame, groups: DataFrame, specs: DataFrame, ref: DataFrame | None = None) -> DataFrame:
    """Template rows x groups; offspec in any table without delta."""
    t = template.join(groups, "item").join(specs, "item", "left").withColumn("offspec", C.off_spec("value", "lsl", "usl") if ref is None else F.lit(False))
    return t if ref is None else delta(t, ref).withColumn("value", F.col("delta")).drop("delta")


def pairs(x: Column, y: Column) -> Column:
    """Comma lists as aligned pairs; the shorter one's last element goes on."""
    a, b = F.split(x, r"\s*,\s*"), F.split(y, r"\s*,\s*")
    n = F.greatest(F.size(a), F.size(b))
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.element_at(a, F.least(i, F.size(a))).alias("x"), F.element_at(b, F.least(i, F.size(b))).alias("y")))


def needed_items(plots: DataFrame, tables: DataFrame) -> DataFrame:
    names = plots.select(F.explode(F.concat(F.split("x_name", r"\s*,\s*"), F.split("y_name", r"\s*,\s*"))).alias("item")).unionByName(tables.select("item"))
    return names.where("item <> ''").distinct()


def validate_plots(plots: DataFrame, known: DataFrame) -> DataFrame:
    """Adds type (normalised) and problem: null where the row can be drawn. known: the items there are."""
    kind = F.lower(F.trim("Type"))
    kind = F.when(kind.isin("scatter", "xy"), "scatter").when(kind.isin("box", "boxplot"), "box").when(kind.isin("bar", "trend"), kind)
    names = F.when(kind == "scatter", F.concat(F.split("x_name", r"\s*,\s*"), F.split("y_name", r"\s*,\s*"))).otherwise(F.split("y_name", r"\s*,\s*"))
    bad = plots.select("id", F.explode(names).alias("item")).where("item <> ''").join(known, "item", "left_anti").groupBy("id").agg(F.min("item").alias("unknown"))
    sizes = F.size(F.split("x_name", ",")), F.size(F.split("y_name", ","))
    t = plots.join(bad, "id", "left").withColumn("kind", kind)
    problem = F.when(F.col("kind").isNull(), "type").when(F.col("order").try_cast("int").isNull(), "order").when(F.col("unknown").isNotNull(), F.concat(F.lit("unknown "), F.col("unknown")))
    problem = problem.when((F.col("kind") == "scatter") & (sizes[0] != sizes[1]) & (F.least(*sizes) > 1), "counts").when((F.col("kind") == "trend") & ~F.upper("x_name").isin("W", "L"), "axis").when(F.col("kind").isin("box", "bar") & (F.trim("x_name") == ""), "category")
    twice = F.count("*").over(Window.partitionBy("Report", "page", "x", "y")) > 1
    return t.withColumn("problem", problem).withColumn("twice", twice).drop("unknown")


# Groups.


def auto_groups(wafers: DataFrame, by: list[Column | str]) -> DataFrame:
    """lot, wafer, group, is_ref: a group for each value, in natural order, the first being the reference."""
    names = [C.natural_key(c) if isinstance(c, str) else c for c in by]
    g = wafers.select("lot", "wafer", F.struct(*names).alias("k"), F.concat_ws("-", *by).alias("name"))
    ids = running(g.groupBy("k", "name").agg(F.count("*").alias("wafers")), [F.col("k")], "place")
    return g.drop("name").join(ids, "k").select("lot", "wafer", F.concat(F.lit("g"), F.col("place").cast("string")).alias("gid"), "name", (F.col("place") == 0).alias("is_ref"))


def table_groups(table: DataFrame, wafers: DataFrame, known: list[str]) -> tuple[DataFrame, DataFrame]:
    """Assignments (lot, wafer or blank for the whole lot, gid) of stored wafers, whatever the spelling, and what fits nothing."""
    t = table.select(C.norm_lot("lot").alias("_lot"), F.when(F.trim("wafer") != "", C.norm_wafer("wafer")).alias("_wafer"), F.col("group").alias("gid"), "lot", "wafer")
    own = wafers.select("lot", "wafer", C.norm_lot("lot").alias("_lot"), C.norm_wafer("wafer").alias("_w"))
    good = t.where(F.col("gid").isin(known)).drop("lot", "wafer")
    fits = own.join(good, "_lot").where("_wafer IS NULL OR _wafer = _w").select("lot", "wafer", "gid", "_lot", "_wafer").distinct()
    met = fits.select(F.col("_lot").alias("f_lot"), F.col("_wafer").alias("f_wafer")).distinct()
    lost = t.where(F.col("gid").isin(known)).join(met, (F.col("_lot") == F.col("f_lot")) & F.col("_wafer").eqNullSafe(F.col("f_wafer")), "left_anti")
    bad = t.where(~F.col("gid").isin(known)).select("lot", "wafer", F.lit("group").alias("problem")).unionByName(lost.select("lot", "wafer", F.lit("wafer").alias("problem")))
    return fits.drop("_lot", "_wafer"), bad
