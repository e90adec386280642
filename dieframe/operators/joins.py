"""Filters by groups and exclusions, and the joins of other sources by lot and wafer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.schema import RESERVED
from ..sources.tables import scratch
from ..sources.tables import stored as written

# Filters.


def by_condition(df: DataFrame, step: str = "", site: str = "", temp: str = "", seen: Observation | None = None) -> DataFrame:
    """Equality compared as text; blank takes all, and so does a column that isn't there.

    seen counts kept and dropped rows in the pass that reads them.
    """
    asked = [F.coalesce(F.col(name).cast("string") == v, F.lit(False)) for name, v in (("step", step), ("site", site), ("temp", temp)) if v and name in df.columns]
    fits = reduce(lambda a, b: a & b, asked, F.lit(True))
    if seen is not None:
        df = df.observe(seen, F.count_if(fits).alias("kept"), F.count_if(~fits).alias("dropped"))
    return df.where(fits)


def numeric_aware(c: str) -> list[Column]:
    """Numbers first, in their order, then text."""
    return [F.col(c).cast("string").try_cast("double").asc_nulls_last(), F.col(c).cast("string").asc_nulls_last()]


def choices(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.col(name).cast("string").alias(name)).distinct().orderBy(*numeric_aware(name))


def active(df: DataFrame, excluded: DataFrame) -> DataFrame:
    return df.join(excluded.select("key").distinct(), "key", "left_anti")


def hidden(df: DataFrame, excluded: DataFrame) -> DataFrame:
    return df.join(excluded.select("key").distinct(), "key", "left_semi")


def visible_groups(df: DataFrame, off: list[str] = ()) -> DataFrame:
    """Rows of the groups not switched off; all rows if none has a group."""
    grouped = df.where("gid <> ''").limit(1).agg((F.count("*") > 0).alias("_any"))
    return df.crossJoin(F.broadcast(grouped)).where(~F.col("_any") | (F.col("gid") != "") & ~F.col("gid").isin(["", *off])).drop("_any")


def by_globs(df: DataFrame, patterns: list[str], extra: list[str] = (), item: str = "item") -> DataFrame:
    """Rows of items that match one of the globs (without case) or are named."""
    if not patterns:
        return df.where(F.col(item).isin(list(extra)))
    rx = "|".join("^" + "".join(".*" if ch == "*" else "." if ch == "?" else "\\" + ch if not ch.isalnum() else ch for ch in p) + "$" for p in patterns)
    return df.where(F.col(item).rlike(f"(?i){rx}") | F.col(item).isin(list(extra)))


# Joins.


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join in which null matches null."""
    other = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    return left.join(other, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), how).drop(*(f"_{k}" for k in keys))


def attach(df: DataFrame, other: DataFrame, overwrite: bool, text: bool = False) -> DataFrame:
    """The columns of another source by normalised lot and wafer, one row a wafer of it: the smallest, by its columns in order, nulls last.

    overwrite: its columns replace those of the same name; else existing ones stay. Reserved columns always stay.
    """
    names = [c for c in other.columns if c not in ("lot", "wafer", *RESERVED) and (overwrite or c not in df.columns)]
    last = ((F.col(c).isNull().alias(f"no_{c}"), F.col(c).cast("string").alias(c) if text else F.col(c)) for c in names or ["lot"])
    row = F.struct(*(x for pair in last for x in pair))
    one = other.groupBy(C.norm_lot("lot").alias("_lot"), C.norm_wafer("wafer").alias("_wafer")).agg(F.min(row).alias("_row"))
    one = one.select("_lot", "_wafer", *(F.col(f"_row.{c}").alias(c) for c in names))
    keyed = df.drop(*names).withColumns({"_lot": C.norm_lot("lot"), "_wafer": C.norm_wafer("wafer")})
    return keyed.join(one, ["_lot", "_wafer"], "left").drop("_lot", "_wafer")


def attach_split(df: DataFrame, split: DataFrame) -> DataFrame:
    """Experiment codes as text; a numeric measurement of the same name stays."""
    kinds = dict(df.dtypes)
    own = [c for c in split.columns if c in ("lot", "wafer") or kinds.get(c, "string") == "string"]
    return attach(df, split.select(*own), overwrite=True, text=True)


def reattach_all(df: DataFrame, split: DataFrame, tracking: DataFrame, metrology: DataFrame) -> DataFrame:
    return attach(attach(attach_split(df, split), tracking, True), metrology, False)


def assign_gid(df: DataFrame, groups: DataFrame) -> DataFrame:
    """gid by normalised lot and wafer, '' where there is none."""
    return attach(df.drop("gid"), groups.withColumnRenamed("gid", "_gid"), True).withColumn("gid", F.coalesce("_gid", F.lit(""))).drop("_gid")


def assign_manual(df: DataFrame, manual: DataFrame) -> DataFrame:
    """Assignments (ord, lot, wafer, step, temp, site, gid) in which a null step, temp or site stands for any. The last one counts; '' clears."""
    m = manual.select("ord", C.norm_lot("lot").alias("_lot"), C.norm_wafer("wafer").alias("_wafer"), *(F.col(c).alias(f"_{c}") for c in ("step", "temp", "site")), F.col("gid").alias("_gid"))
    keyed = df.select("key", C.norm_lot("lot").alias("_lot"), C.norm_wafer("wafer").alias("_wafer"), "step", "temp", "site")
    fits = reduce(lambda a, b: a & b, [F.col(f"_{c}").isNull() | (F.col(f"_{c}") == F.col(c)) for c in ("step", "temp", "site")])
    last = keyed.join(m, ["_lot", "_wafer"]).where(fits).groupBy("key").agg(F.max(F.struct("ord", "_gid")).alias("m")).select("key", F.col("m._gid").alias("_gid"))
    return df.join(last, "key", "left").withColumn("gid", F.coalesce("_gid", "gid")).drop("_gid")


def join_values(keys: DataFrame, values: DataFrame, items: list[str]) -> DataFrame:
    """The key frame with the named item columns, by key; a key without values gets nulls."""
    return keys.drop(*items).join(values.select("key", *items), "key", "left")


def join_full(*sources: DataFrame, by: tuple[str, ...] = ("lot", "wafer")) -> DataFrame:
    """Columns found independently of each other, by lot and wafer; a wafer that any source has stands once."""
    return reduce(lambda a, b: a.join(b, list(by), "full"), sources)


def excluded_where(log: DataFrame, df: DataFrame) -> DataFrame:
    """key, lot, wafer of each exclusion; one whose key the data lacks stays, without a place."""
    return log.select("key").join(df.select("key", "lot", "wafer"), "key", "left")


def join_geometry(long: DataFrame, rules: DataFrame, size: str = "width") -> DataFrame:
    """Rows of the items that have a size in the rule sheet, with it."""
    return long.join(rules.where(F.col(size).isNotNull()).select("item", size), "item")


def item_diff(data: DataFrame, rules: DataFrame) -> DataFrame:
    """only_in (data or rules), item of the items that one of the two lacks."""
    data, rules = data.select("item").distinct(), rules.select("item").distinct()
    one = lambda name, a, b: a.subtract(b).select(F.lit(name).alias("only_in"), "item")
    return one("data", data, rules).unionByName(one("rules", rules, data))


FEW = 64  #: stored lots of a shared stretch that a typed lot's bound is taken from


def _stretches(df: DataFrame, c: str) -> DataFrame:
    """df with start, len and text of every stretch of a text column; the square of a lot's letters, not of the lots."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)))
    rows = df.withColumn("start", F.explode(starts)).withColumn("len", F.explode(F.sequence(F.lit(1), F.greatest(F.length(c) - F.col("start") + 1, F.lit(1)))))
    return rows.withColumn("text", F.substring(F.col(c), F.col("start"), F.col("len"))).where("text <> ''")


EQUAL = "size(filter(zip_with(split(own, ''), split(low, ''), (a, b) -> a = b AND a <> ''), x -> x))"


def _near_long(typed: DataFrame, stored: DataFrame, similar: int) -> DataFrame:
    """The pairs of `near_lots` for typed lots of any length.

    A stretch that `similar` stored lots have in the same place bounds
    from below what the last of them scores, and the scores of some lots that have the longest such stretch bound it
    better. Of m characters, a lot that scores s or more misses m - s at most, so of m - s + 1 parts it has one whole:
    only lots that share such a part in its place are candidates.
    """
    place = ["start", "len", "text"]
    mine = _stretches(typed, "own")
    path = scratch(typed.sparkSession, "stretches")
    _stretches(stored, "low").join(mine.select(*place).distinct(), place, "left_semi").write.parquet(path)
    theirs = typed.sparkSession.read.parquet(path)
    often = theirs.groupBy(*place).agg(F.count("*").alias("n")).where(F.col("n") >= similar)
    longest = F.min(F.struct((-F.col("len")).alias("l"), "n", "start", "text")).alias("m")
    best = mine.join(often, place).groupBy("typed", "own").agg(longest).select("typed", "own", (-F.col("m.l")).alias("len"), "m.start", "m.text")
    few = theirs.join(best.select(*place).distinct(), place, "left_semi").withColumn("n", F.row_number().over(Window.partitionBy(*place).orderBy("lot"))).where(F.col("n") <= FEW).drop("n")
    scores = best.join(few, place).withColumn("equal", F.expr(EQUAL)).withColumn("n", F.row_number().over(Window.partitionBy("typed").orderBy(F.col("equal").desc())))
    bound = scores.where(F.col("n") == similar).select("typed", "equal")
    sized = typed.join(bound, "typed", "left").withColumn("m", F.length("own"))
    parts = F.least(F.col("m") - F.coalesce("equal", F.lit(0)) + 1, F.col("m"))
    cut = sized.where("m > 0").withColumns({"parts": parts, "k": F.explode(F.sequence(F.lit(0), parts - 1))})
    whole, rest = F.expr("m div parts"), F.expr("m % parts")  # the first parts are longer by one: beginnings are what lots share
    cut = cut.withColumn("start", (F.col("k") * whole + F.least("k", rest) + 1).cast("int")).withColumn("len", (whole + (F.col("k") < rest).cast("int")).cast("int"))
    cut = cut.withColumn("text", F.substring(F.col("own"), F.col("start"), F.col("len"))).select("typed", "own", *place)
    return cut.join(theirs, place).select("typed", "own", "lot", "low")


SHORT = 8  #: characters of a typed lot up to which the places that it shares with stored ones are looked up as sets


def _places(text: str) -> Column:
    """The characters of a text column at the places set in the bits of `places`."""
    return F.concat(*(F.when(F.col("places").bitwiseAND(1 << i) != 0, F.substring(text, i + 1, 1)).otherwise("") for i in range(SHORT)))


def _near_short(typed: DataFrame, stored: DataFrame, similar: int) -> DataFrame:
    """The pairs of `near_lots` for typed lots of up to SHORT characters, a bounded number each whatever is stored.

    A lot that scores s has s of the typed one's characters in their places. Those that have a set of places in common
    with it score its size at least, so a set that `similar` lots have bounds what the last of them scores, and smaller sets
    count no more. At that score or above, a set is shared by fewer than `similar` lots that score more than its size;
    the others are taken by name. So the 2 * similar first lots of each set hold all that is wanted.
    """
    sign = ["places", "text"]
    bit = lambda c: F.explode(F.sequence(F.lit(0), F.least(F.length(c), F.lit(SHORT)) - 1)).alias("i")
    each = lambda df, c: df.where(F.length(c) > 0).select("*", bit(c)).withColumn("text", F.substring(F.col(c), F.col("i") + 1, F.lit(1)))
    alive = each(typed, "own").join(each(stored, "low").select("i", "text").distinct(), ["i", "text"], "left_semi")  # others match nothing
    alive = alive.groupBy("typed", "own").agg(F.sum(F.expr("shiftleft(1, i)")).cast("int").alias("alive"))
    sets = F.explode(F.expr("filter(sequence(1, alive), p -> p & alive = p)")).alias("places")
    mine = alive.select("typed", "own", sets).withColumn("text", _places("own"))
    asked = mine.select("places").distinct()  # 255 rows at most
    theirs = stored.crossJoin(F.broadcast(asked)).where(F.col("places") < F.expr(f"shiftleft(1, least(length(low), {SHORT}))")).withColumn("text", _places("low"))
    theirs = theirs.join(mine.select(*sign).distinct(), sign, "left_semi")
    first = theirs.withColumn("n", F.row_number().over(Window.partitionBy(*sign).orderBy("lot"))).where(F.col("n") <= 2 * similar)
    lists = first.groupBy(*sign).agg(F.collect_list(F.struct("lot", "low")).alias("lots"))  # 2 * similar at most
    met = mine.join(lists, sign).withColumn("size", F.bit_count("places"))
    least = F.max(F.when(F.size("lots") >= similar, F.col("size"))).over(Window.partitionBy("typed"))
    return met.withColumn("least", F.coalesce(least, F.lit(0))).where("size >= least").select("typed", "own", F.explode("lots").alias("s")).select("typed", "own", "s.*")


def near_lots(typed: DataFrame, stored: DataFrame, similar: int = 5) -> DataFrame:
    """typed, own, lot, low: all pairs that may be among the `similar` stored lots with the most equal characters of a typed one.

    typed: typed, own (as compared); stored: lot, low. Short typed lots meet a bounded number of lots by sets of places,
    longer ones by parts; and all meet the first lots, which fill up a short list.
    """
    typed = written(typed)
    long = typed.where(F.length("own") > SHORT)
    first = stored.orderBy("lot").limit(2 * similar)  # a stated number of rows, met by all
    pairs = typed.select("typed", "own").crossJoin(F.broadcast(first)).unionByName(_near_short(typed.where(F.length("own") <= SHORT), stored, similar))
    return (pairs if long.isEmpty() else pairs.unionByName(_near_long(long, stored, similar))).distinct()


def resolve_lot(typed: DataFrame, lots: DataFrame, similar: int = 5) -> DataFrame:
    """typed, lot, how: the stored lot for typed text. exact, then case, then a unique substring; else up to 5 of the most equal characters.

    Exact and case matches are joins by the text. Lots that hold the typed text are counted by their stretches of its
    length. Only what is left is compared, with the candidates of `near_lots`.
    """
    kinds = F.array(*map(F.lit, ("exact", "case", "part", "similar")))
    stored = lots.select("lot", F.lower("lot").alias("low")).distinct()
    typed = typed.select("typed", F.lower("typed").alias("own")).distinct()
    same = typed.join(stored, F.col("own") == F.col("low")).groupBy("typed").agg(F.min(F.struct(F.when(F.col("typed") == F.col("lot"), 1).otherwise(2).alias("rank"), "lot")).alias("m"))
    same = same.select("typed", "m.lot", "m.rank")
    left = typed.join(same.select("typed"), "typed", "left_anti")
    wanted = left.select(F.col("own").alias("text")).distinct()
    holds = _stretches(stored, "low").select("lot", "text").join(wanted, "text", "left_semi").distinct().groupBy("text").agg(F.count("*").alias("n"), F.min("lot").alias("lot")).where("n = 1")
    parts = left.join(holds, F.col("own") == F.col("text")).select("typed", "lot", F.lit(3).alias("rank"))
    near = near_lots(left.join(parts.select("typed"), "typed", "left_anti"), stored, similar).withColumn("equal", F.expr(EQUAL))
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("typed").orderBy(F.col("equal").desc(), "lot"))).where(F.col("n") <= similar)
    out = same.unionByName(parts).unionByName(near.select("typed", "lot", F.lit(4).alias("rank")))
    return out.select("typed", "lot", F.element_at(kinds, F.col("rank")).alias("how"))


def resolve_wafer(typed: DataFrame, stored: DataFrame) -> DataFrame:
    """typed, wafer: the first stored spelling (by ord) of the same wafer."""
    first = stored.groupBy(C.norm_wafer("wafer").alias("_w")).agg(F.min_by("wafer", "ord").alias("wafer"))
    return typed.withColumn("_w", C.norm_wafer("typed")).join(first, "_w", "left").drop("_w")


def category(df: DataFrame, by: str, names: DataFrame | None = None) -> DataFrame:
    """Adds category: lot·wafer, a group's name, or a column's text; null is (none)."""
    if by == "lot_wafer":
        return df.withColumn("category", F.concat_ws("·", "lot", "wafer"))
    if by == "gid" and names is not None:
        return df.join(names, "gid", "left").withColumn("category", F.coalesce("name", F.lit("(none)"))).drop("name")
    return df.withColumn("category", F.coalesce(F.col(by).cast("string"), F.lit("(none)")))


def part_lookup(store: DataFrame, tracking: DataFrame) -> DataFrame:
    """lot, wafer, part: from the store where it names any part, else from tracking."""
    own = store.where("part IS NOT NULL").select("lot", "wafer", "part")
    there = own.limit(1).agg((F.count("*") > 0).alias("_any"))  # one row, decided when the query runs
    other = tracking.select("lot", "wafer", "part").crossJoin(F.broadcast(there)).where("NOT _any").drop("_any")
    return own.unionByName(other).groupBy("lot", "wafer").agg(F.min("part").alias("part"))


# Exclusions: key, reason, item, at, kind.


def exclude(log: DataFrame, keys: DataFrame, reason: str, at: Column, kind: str = "manual", item: Column | None = None) -> DataFrame:
    """The log with more exclusions; of a key and kind the latest stays."""
    new = keys.select("key", F.lit(reason).alias("reason"), (F.lit(None).cast("string") if item is None else item).alias("item"), at.alias("at"), F.lit(kind).alias("kind"))
    last = F.max(F.struct("at", "reason", "item")).alias("m")
    return log.unionByName(new).groupBy("key", "kind").agg(last).select("key", "m.reason", "m.item", "m.at", "kind")


def include(log: DataFrame, keys: DataFrame | None = None, kind: str | None = None) -> DataFrame:
    """The log without the keys, or without one kind."""
    return log.where(F.col("kind") != kind) if keys is None else log.join(keys.select("key").distinct(), "key", "left_anti")


def exclusion_groups(df: DataFrame, log: DataFrame) -> DataFrame:
    """lot, wafer, reason, at, n, keys of the excluded points, newest first."""
    g = log.join(df.select("key", "lot", "wafer").distinct(), "key", "left").groupBy("lot", "wafer", "reason", "at")
    return g.agg(F.count("*").alias("n"), F.sort_array(F.collect_list("key")).alias("keys")).orderBy(F.col("at").desc_nulls_last(), "lot", "wafer")
