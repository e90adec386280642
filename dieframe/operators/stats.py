"""Statistics of wafers, groups and lots; coverage; outliers; ranges. All on long rows, so any number of items costs one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def statistic(kind: str, value: str = "value") -> Column:
    return {"avg": F.avg(value), "med": F.median(value), "std": F.stddev_samp(value)}[kind]


def wafer_stats(long: DataFrame, kinds: dict[str, Column] | None = None, by: tuple[str, ...] = ("lot", "wafer", "item")) -> DataFrame:
    """Per wafer and item the statistics asked for (name: aggregate)."""
    return long.groupBy(*by).agg(*((v.alias(k) for k, v in (kinds or {k: statistic(k) for k in ("avg", "med", "std")}).items())))


def wafer_excluded(points: DataFrame, log: DataFrame) -> DataFrame:
    """lot, wafer, n of wafers with excluded points."""
    return points.join(log.select("key").distinct(), "key", "left_semi").groupBy("lot", "wafer").agg(F.count("*").alias("n"))


def group_rep(long: DataFrame, wafer: Column, over: Column, by: tuple[str, ...] = ("gid", "item")) -> DataFrame:
    """Mean over wafers of a wafer statistic. wafer: an aggregate of value; over: one of value again."""
    each = long.groupBy(*by, "lot", "wafer").agg(wafer.alias("value"))
    return each.groupBy(*by).agg(over.alias("value"), F.count("*").alias("wafers"))


def ref_value(long: DataFrame, gid: str, stat: Column) -> DataFrame:
    """item, ref: the statistic over all points of the reference group."""
    return long.where(F.col("gid") == gid).groupBy("item").agg(stat.alias("ref"))


def delta(df: DataFrame, ref: DataFrame, value: str = "value") -> DataFrame:
    """Adds delta: value less the reference value of the item."""
    return df.join(ref, "item", "left").withColumn("delta", F.col(value) - F.col("ref")).drop("ref")


def wafer_index(df: DataFrame) -> DataFrame:
    """Points of each lot, wafer, step, temp and site: distinct dies where x and y are there, else rows."""
    n = F.countDistinct("x", "y") if {"x", "y"} <= set(df.columns) else F.count("*")
    return df.groupBy("lot", "wafer", "step", "temp", "site").agg(n.alias("points"))


def lot_index(df: DataFrame) -> DataFrame:
    return df.groupBy("lot").agg(F.countDistinct("wafer").alias("wafers"))


def smallest(df: DataFrame, c: str, most: int) -> DataFrame:
    """One row: the `most` smallest distinct values of c, sorted. Each task keeps that many, whatever it reads."""
    return df.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c).limit(most).agg(F.sort_array(F.collect_list(c)).alias(c))


def lot_context(df: DataFrame, names: tuple[str, ...] = ("line", "process", "part"), most: int = 20, back: int = 180) -> DataFrame:
    """Up to `most` sorted values of each name, the first and last day, and where the lookback begins."""
    days = df.agg(F.min("ts").cast("date").alias("first"), F.max("ts").cast("date").alias("last")).withColumn("since", F.date_sub("first", back))
    each = [smallest(df, c, most) for c in names if c in df.columns]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), [*each, days])  # one row each


def coverage_items(long: DataFrame) -> DataFrame:
    """lot, items (sorted), n."""
    return long.where("value IS NOT NULL").groupBy("lot").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("n", F.size("items"))


def coverage_lots(long: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """Per lot its wafers, items, median points a wafer and conditions, against the base lot: most items, then the lowest id as text.

    Items and conditions are told apart as rows before a lot's are put into a list: it holds each once, whatever the wafers.
    """
    cond = F.concat_ws("/", "step", F.col("temp").cast("string"), F.col("site").cast("string"))
    wafers = long.select("lot", "wafer", "key").distinct().groupBy("lot", "wafer").agg(F.count("*").alias("p"))
    points = wafers.groupBy("lot").agg(F.count("*").alias("wafers"), F.median("p").alias("points"))
    has = F.explode(F.array(F.struct(F.lit("items").alias("of"), F.when(F.col("value").isNotNull(), F.col("item")).alias("name")), F.struct(F.lit("conditions").alias("of"), cond.alias("name")))).alias("h")
    own = long.select("lot", has).select("lot", "h.of", "h.name").where("name IS NOT NULL").distinct()
    names = [F.sort_array(F.collect_list(F.when(F.col("of") == of, F.col("name")))).alias(of) for of in ("items", "conditions")]
    lots = own.groupBy("lot").agg(*names).withColumn("n", F.size("items")).where("n > 0").join(points, "lot")
    best = F.min(F.struct((-F.col("n")).alias("fewer"), *(F.col(c) for c in ("lot", "items", "points", "conditions")))).alias("m")
    base = lots.agg(best).select(*(F.col(f"m.{c}").alias(f"base_{c}") for c in ("lot", "items", "points", "conditions")))
    out = lots.crossJoin(F.broadcast(base))  # one row
    ratio = F.try_divide(F.col("points"), F.col("base_points"))
    missing = {f"{word}_{of}": F.array_except(a, b) for word, of, a, b in (
        ("missing", "items", "base_items", "items"), ("missing", "conditions", "base_conditions", "conditions"), ("extra", "conditions", "conditions", "base_conditions"))}
    return out.select(
        "lot", "wafers", F.col("n").alias("n_items"), "points", "base_lot", *(v.alias(k) for k, v in missing.items()),
        ratio.alias("ratio"), (F.abs(ratio - 1) > tolerance).alias("off"))


def coverage_notes(lots: DataFrame) -> DataFrame:
    """lot, note: a line for each lot that differs from the base lot."""
    parts = [F.when(F.size("missing_items") > 0, F.concat(F.lit("missing items: "), F.array_join("missing_items", ", "))), F.when(F.size("missing_conditions") > 0, F.concat(F.lit("missing conditions: "), F.size("missing_conditions").cast("string"))), F.when(F.size("extra_conditions") > 0, F.concat(F.lit("extra conditions: "), F.size("extra_conditions").cast("string"))), F.when(F.col("off"), F.lit("points differ"))]
    return lots.select("lot", F.concat_ws("; ", *parts).alias("note")).where("note <> ''")


# Outliers.


SURE = 10_000  #: values up to which a group's quantiles need no bracket, and the accuracy of the sketch beyond


def quantiles(long: DataFrame, qs: dict[str, float], by: tuple[str, ...], interp: str = "linear", value: str = "value") -> DataFrame:
    """Exact quantiles of each group (null is a group), and n, the number of values.

    interp: linear between the two nearest ranks, or nearest (rank round((n - 1) q), halves up).

    A mergeable sketch brackets each quantile; values in the brackets, a thousandth of a large group, are then
    counted by value, those below as one number. So no task sees all values of a group.
    """
    rows = long.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    width = 5 / SURE
    ends = [max(0.0, min(1.0, q + s * width)) for q in qs.values() for s in (-1, 1)]
    sketch = rows.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("_v", ends, SURE).alias("_ends"))
    each = []
    for i, (name, q) in enumerate(qs.items()):
        low, high = (F.when(F.col("n") > SURE, F.col("_ends")[2 * i + k]) for k in (0, 1))
        rank = F.floor((F.col("n") - 1) * q + 0.5) if interp == "nearest" else (F.col("n") - 1) * q
        each.append(F.struct(F.lit(name).alias("q"), low.alias("low"), high.alias("high"), rank.cast("double").alias("rank")))
    wanted = sketch.select(*by, "n", F.explode(F.array(*each)).alias("w")).select(*by, "n", "w.*")
    met = join_groups(rows, wanted, by) if by else rows.crossJoin(F.broadcast(wanted))
    inside = F.coalesce(F.col("_v").between(F.col("low"), F.col("high")), F.lit(True))
    below = F.coalesce(F.col("_v") < F.col("low"), F.lit(False))
    place = F.when(inside, F.col("_v")).alias("_v")  # null: below the bracket
    counts = met.where(inside | below).groupBy(*by, "q", "rank", "n", place).agg(F.count("*").alias("m"))
    upto = F.sum("m").over(Window.partitionBy(*by, "q").orderBy(F.col("_v").asc_nulls_first()))
    counts = counts.withColumns({"_to": upto, "_from": upto - F.col("m")})
    at = lambda r: F.max(F.when((F.col("_from") <= r) & (F.col("_to") > r), F.col("_v")))
    low, share = F.floor("rank"), F.col("rank") - F.floor("rank")
    found = counts.groupBy(*by, "q", "n", "rank").agg(at(low).alias("a"), at(F.least(low + 1, F.col("n") - 1)).alias("b"))
    mixed = F.when(share == 0, F.col("a")).otherwise((1 - share) * F.col("a") + share * F.col("b"))
    named = [F.max(F.when(F.col("q") == name, mixed)).alias(name) for name in qs]
    return found.groupBy(*by, "n").agg(*named).select(*by, *qs, "n")


def tukey_bounds(long: DataFrame, k: float = 1.5, by: tuple[str, ...] = ("item",), least: int = 12, interp: str = "nearest") -> DataFrame:
    """Per group Q1 - k IQR and Q3 + k IQR, null below `least` values. interp: nearest (rank), or linear."""
    q = quantiles(long, {"q1": 0.25, "q3": 0.75}, by, interp)
    ok = F.col("n") >= least
    return q.select(*by, F.when(ok, F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("lo"), F.when(ok, F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("hi"), "n")


def join_bounds(long: DataFrame, bounds: DataFrame, by: tuple[str, ...] = ("item",)) -> DataFrame:
    """Bounds by group, or the one common row to all."""
    known = reduce(lambda a, c: a.where(F.col(c).isNotNull()), by, long)  # a null has no bounds
    return join_groups(known, bounds.drop("n"), by) if by else long.crossJoin(F.broadcast(bounds.drop("n").limit(1)))


def tukey_flag(long: DataFrame, bounds: DataFrame, order: list[str], by: tuple[str, ...] = ("item",)) -> DataFrame:
    """key, item of each outlying point: the first failing item in the given order."""
    bad = join_bounds(long, bounds, by).where("value < lo OR value > hi")
    listed = F.array_position(F.array(*map(F.lit, order)), F.col("item"))
    place = F.when(listed > 0, listed).otherwise(len(order) + 1)  # an item that isn't listed comes last
    return bad.groupBy("key").agg(F.min(F.struct(place.alias("p"), "item")).alias("m")).select("key", F.col("m.item").alias("item"))


def tukey_summary(flagged: DataFrame, top: int = 3) -> DataFrame:
    return flagged.groupBy("item").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "item").limit(top)


def pearson(df: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """r, n; null below three pairs or without variance."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by)
    ok = (F.count("*") >= 3) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    return both.agg(F.when(ok, F.corr(x, y)).alias("r"), F.count("*").alias("n"))


# Ranges of axes.


def item_range(
    long: DataFrame, specs: DataFrame, log_items: list[str] = (), margin: float = 0.2, manual: DataFrame | None = None, corners: DataFrame | None = None,
) -> DataFrame:
    """item, lo, hi: values and spec limits with a margin on their span (in decades for log items, where only positive ones count).

    corners (item, corner, limit; see `rules.corners`): items that have some take these limits in place of lsl and usl.
    Without span a tenth of the size, or 1, stands in. A manual end replaces the computed one.
    """
    log = F.col("item").isin(list(log_items))
    limits = specs.select("item", F.explode(F.array("lsl", "usl")).alias("value"))
    if corners is not None:
        limits = limits.join(corners.select("item").distinct(), "item", "left_anti").unionByName(corners.select("item", F.col("limit").alias("value")))
    rows = long.select("item", "value").unionByName(limits).where("value IS NOT NULL").where(~log | (F.col("value") > 0))
    t = rows.join(long.select("item").distinct(), "item", "left_semi").withColumn("value", F.when(log, F.log10("value")).otherwise(F.col("value")))
    t = t.groupBy("item").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    pad = F.when(F.col("b") > F.col("a"), (F.col("b") - F.col("a")) * margin / 2).when(F.col("a") != 0, F.abs("a") * 0.1).otherwise(F.lit(1.0))
    back = lambda c: F.when(log, F.pow(F.lit(10.0), c)).otherwise(c)
    t = t.select("item", back(F.col("a") - pad).alias("lo"), back(F.col("b") + pad).alias("hi"))
    if manual is None:
        return t
    return t.join(manual.withColumnsRenamed({"lo": "_lo", "hi": "_hi"}), "item", "left").select("item", F.coalesce("_lo", "lo").alias("lo"), F.coalesce("_hi", "hi").alias("hi"))


# Plot data.


def scatter_pairs(points: DataFrame, pairs: list[tuple[str, str]], stat: str = "site") -> DataFrame:
    """pair, lot, wafer, gid, key, x, y; with a statistic, one point a wafer."""
    each = [F.struct(F.lit(f"{x}:{y}").alias("pair"), F.col(f"`{x}`").alias("x"), F.col(f"`{y}`").alias("y")) for x, y in pairs]
    rows = points.select("lot", "wafer", "gid", "key", F.explode(F.array(*each)).alias("p")).select("lot", "wafer", "gid", "key", "p.*")
    if stat == "site":
        return rows.where("x IS NOT NULL AND y IS NOT NULL")
    out = rows.groupBy("pair", "lot", "wafer", "gid").agg(statistic(stat, "x").alias("x"), statistic(stat, "y").alias("y"))
    return out.where("x IS NOT NULL AND y IS NOT NULL")


def scatter_unpaired(points: DataFrame, x: str, y: str) -> DataFrame:
    """unpaired: both have values, but never in one row."""
    a, b = F.col(x).isNotNull(), F.col(y).isNotNull()
    return points.agg((F.bool_or(a) & F.bool_or(b) & ~F.bool_or(a & b)).alias("unpaired"))


def scatter_keys(points: DataFrame) -> DataFrame:
    return points.groupBy("lot", "wafer").agg(F.sort_array(F.collect_list("key")).alias("keys"))


def box_stats(long: DataFrame, by: tuple[str, ...] = ("gid", "category")) -> DataFrame:
    """Quartiles (linear), whiskers at the last values within 1.5 IQR, and the number of fliers."""
    q = quantiles(long, {"q1": 0.25, "med": 0.5, "q3": 0.75}, by).drop("n")
    joined = join_groups(long, q, by).withColumn("in", F.col("value").between(F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))))
    return joined.groupBy(*by, "q1", "med", "q3").agg(F.min(F.when(F.col("in"), F.col("value"))).alias("low"), F.max(F.when(F.col("in"), F.col("value"))).alias("high"), F.count(F.when(~F.col("in"), 1)).alias("fliers"))


def box_values(points: DataFrame, item: str, stat: Column | None = None, by: str = "category") -> DataFrame:
    """Per category, lot and wafer a statistic of an item's values (stat: an aggregate of value); without one, each point's value, with its key."""
    rows = points.select(by, "lot", "wafer", *(["key"] if stat is None else []), F.col(f"`{item}`").alias("value")).where("value IS NOT NULL")
    return rows if stat is None else rows.groupBy(by, "lot", "wafer").agg(stat.alias("value"))


def bar_means(points: DataFrame, item: str, mean: Column, by: tuple[str, ...] = ("gid", "category")) -> DataFrame:
    """Per group and category the mean of an item's values (mean: an aggregate of value)."""
    return points.select(*by, F.col(f"`{item}`").alias("value")).groupBy(*by).agg(mean.alias("value"))


def lot_parts(long: DataFrame, wafer: Column, over: Column) -> DataFrame:
    """Per group, lot and item the mean over wafers, and how many wafers there are."""
    each = wafer_stats(long, {"value": wafer}, ("gid", "lot", "wafer", "item"))
    return each.groupBy("gid", "lot", "item").agg(over.alias("value"), F.count("*").alias("wafers"))


SHARES = 128  #: parts that the rows of each group are dealt over where they meet what was found of their groups


def join_groups(rows: DataFrame, found: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """rows with what was found of their groups; null is a group. Few groups may hold all rows, so each is dealt over SHARES parts by chance."""
    from .joins import null_safe

    shares = F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))
    dealt = rows.withColumn("_share", F.floor(F.rand(7) * SHARES).cast("int"))
    return null_safe(dealt, found.withColumn("_share", shares), [*by, "_share"], "inner").drop("_share")


def trend_points(long: DataFrame, geometry: DataFrame, stat: Column, over: Column, targets: DataFrame | None = None, points: bool = False) -> DataFrame:
    """kind, gid, lot, wafer, item, x, value: what a trend shows of each item at its x position; items without one are left out.

    Kinds: strip (a dot a wafer, or a point each with `points`), lot and group (lines over wafer values), target (marks; from
    item, target). Wafer values are computed once, and the three levels over them in one expand.
    """
    at = geometry.where("x IS NOT NULL").select("item", "x")
    each = long.groupBy("gid", "lot", "wafer", "item").agg(stat.alias("value")).join(at, "item")
    shared = [F.col("gid"), F.col("item"), F.col("x")]
    wafer, lot = [*shared, F.col("lot"), F.col("wafer")], [*shared, F.col("lot")]
    levels = [lot, shared] if points else [wafer, lot, shared]
    sets = each.groupingSets(levels, *wafer).agg(over.alias("value"), F.grouping("wafer").alias("_w"), F.grouping("lot").alias("_l"))
    kind = F.when(F.col("_w") == 0, "strip").when(F.col("_l") == 0, "lot").otherwise("group")
    columns = ["kind", "gid", "lot", "wafer", "item", "x", "value"]
    out = sets.withColumn("kind", kind).select(columns)
    if points:
        out = out.unionByName(long.where("value IS NOT NULL").join(at, "item").withColumn("kind", F.lit("strip")).select(columns))
    if targets is not None:
        there = targets.where("target IS NOT NULL").join(at, "item").join(each.select("item").distinct(), "item", "left_semi")
        marks = there.select(F.lit("target").alias("kind"), *(F.lit(None).cast("string").alias(c) for c in ("gid", "lot", "wafer")), "item", "x", F.col("target").alias("value"))
        out = out.unionByName(marks)
    return out


def natural_order(df: DataFrame, *columns: str) -> DataFrame:
    return df.orderBy(*(C.natural_key(c) for c in columns))
