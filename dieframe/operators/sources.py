"""Fab tracking, inline metrology and experiment splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.tables import stored
from .joins import numeric_aware

# Summary subitems, and what items of interest are called.
SUMMARY = ["Q2", "STD", "MIN", "MAX", "RANGE", "VALUE", "SLOTID"]
ITEMS = "(?i)CD|THK|DEPTH|TIP|RCS"

# Metrology.


def site_rows(m: DataFrame) -> DataFrame:
    """Rows of single sites: no summary subitem; null stays."""
    return m.where(F.col("subitem").isNull() | ~F.upper(F.trim("subitem")).isin(SUMMARY))


def wafer_rows(m: DataFrame) -> DataFrame:
    return m.where(F.upper(F.trim("subitem")) == "Q2")


def wanted_pairs(spark: SparkSession, text: str) -> DataFrame:
    """step, item of each line of pasted text: the first two cells that aren't blank, between tabs, commas or semicolons.

    A line that begins with step_id or step is a heading; one with fewer cells is left out.
    """
    lines = spark.createDataFrame([(text,)], "t string").select(F.explode(F.split("t", r"\r?\n")).alias("line"))
    cells = lines.select(F.filter(F.transform(F.split("line", r"[\t,;]"), lambda c: F.trim(c)), lambda c: c != "").alias("c")).where("size(c) >= 2")
    return cells.select(F.get("c", F.lit(0)).alias("step"), F.get("c", F.lit(1)).alias("item")).where("lower(step) NOT IN ('step_id', 'step')").distinct()


def of_pairs(m: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of the step and item pairs."""
    return m.join(pairs, ["step", "item"], "left_semi")


def met_name(step: str = "step", item: str = "item") -> Column:
    return F.concat_ws("::", step, item)


def met_wafer_values(m: DataFrame, per_site: bool = True, mean: Column | None = None) -> DataFrame:
    rows = (site_rows(m) if per_site else wafer_rows(m)).withColumn("value", C.number("fab_value"))
    return rows.groupBy("lot", "wafer", met_name().alias("met")).agg((F.avg("value") if mean is None else mean).alias("value"))


def met_wide(values: DataFrame, names: list[str]) -> DataFrame:
    return values.groupBy("lot", "wafer").pivot("met", names).agg(F.max("value"))


# Tracking.


def latest_values(t: DataFrame, keys: list[str], values: dict[str, Column], time: str = "ts") -> DataFrame:
    """Per key the value of the last time that isn't null, for each name; a null time is the earliest, ties go to the larger value.

    First the last time of each key and value, a hash aggregate with fixed-size buffers that shrinks rows before the
    shuffle; what compares texts meets one row a key and value.
    """
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), v.alias("v")) for i, v in enumerate(values.values())))).alias("e")
    last = t.select(*keys, F.col(time).alias("_t"), each).groupBy(*keys, "e.i", "e.v").agg(F.max("_t").alias("_t"))
    best = lambda i: F.max(F.when((F.col("i") == i) & F.col("v").isNotNull(), F.struct(F.col("_t").isNotNull(), "_t", "v")))["v"]
    return last.groupBy(*keys).agg(*(best(i).alias(name) for i, name in enumerate(values)))


def track_condition(t: DataFrame) -> DataFrame:
    """Per wafer and step: the ppid, else the reticle, of the last pass."""
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return latest_values(t, ["lot", "wafer", "step"], {"condition": F.coalesce(blank("ppid"), blank("reticle"))})


def track_split_steps(conditions: DataFrame) -> DataFrame:
    """Steps whose condition takes several values over two wafers or more, in numeric-aware order."""
    g = conditions.where("condition IS NOT NULL").groupBy("step").agg(F.countDistinct("condition").alias("values"), F.count("*").alias("wafers"))
    return g.where("values > 1 AND wafers >= 2").orderBy(*numeric_aware("step"))


def majority(df: DataFrame, by: list[str], code: str = "condition") -> DataFrame:
    """Per group the most frequent code, of equals the smallest."""
    counts = df.where(F.col(code).isNotNull()).groupBy(*by, code).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col(code).alias("code"))).alias("m")
    return counts.groupBy(*by).agg(best).select(*by, F.col("m.code").alias("baseline"))


def track_matrix(conditions: DataFrame, steps: list[str]) -> DataFrame:
    """lot x wafer x varying step; blanks take the lot's baseline, voted before they were filled."""
    rows = conditions.where(F.col("step").isin(steps))
    grid = rows.select("lot", "wafer").distinct().withColumn("step", F.explode(F.array(*map(F.lit, steps)))).join(rows.select("step").distinct(), "step", "left_semi")
    full = grid.join(rows, ["lot", "wafer", "step"], "left").join(majority(rows, ["lot", "step"]), ["lot", "step"], "left")
    return full.groupBy("lot", "wafer").pivot("step", steps).agg(F.max(F.coalesce("condition", "baseline")))


def track_derive(t: DataFrame, columns: list[tuple[str, str, str | None]]) -> DataFrame:
    """User-named columns (name, source column or auto, step or None): the last value that isn't null, in one aggregate."""
    auto = F.coalesce("ppid", "reticle")
    of = lambda source, step: F.when(F.lit(True) if step is None else F.col("step") == step, auto if source == "auto" else F.col(source))
    return latest_values(t, ["lot", "wafer"], {name: of(source, step) for name, source, step in columns})


def track_summary(conditions: DataFrame) -> DataFrame:
    return conditions.agg(F.countDistinct("lot").alias("lots")).crossJoin(track_split_steps(conditions).agg(F.count("*").alias("varying")))


# Splits.


def split_headers(df: DataFrame) -> DataFrame:
    """The headings of a split sheet as lot, wafer, step_id and code; the name itself comes before a variant. Without lot and wafer: an error."""
    lower = {c.strip().lower(): c for c in reversed(df.columns)}
    found = {name: next((lower[v] for v in variants if v in lower), None) for name, variants in HEADERS.items()}
    if not found["lot"] or not found["wafer"]:
        raise ValueError("a split sheet needs a lot and a wafer column")
    long = found["step_id"] and found["code"]
    return df.withColumnsRenamed({c: name for name, c in found.items() if c and (long or name in ("lot", "wafer"))})


# Headings of split sheets.
HEADERS = {"lot": ["lot", "root_lot_id"], "wafer": ["wafer", "wafer_id"], "step_id": ["step_id"], "code": ["code", "condition"]}


def split_load(df: DataFrame, steps: list[str]) -> DataFrame:
    """A long (lot, wafer, step_id, code) or wide condition table as a wide one; blank cells take the step's majority.

    lot may also be headed root_lot_id, wafer wafer_id and code condition, all in any case.
    """
    df = split_headers(df)
    if {"step_id", "code"} <= set(df.columns):
        df = df.groupBy("lot", "wafer").pivot("step_id", steps).agg(F.min(F.when(F.trim("code") != "", F.trim("code"))))
    long = df.unpivot(["lot", "wafer"], steps, "step", "condition")
    base = majority(long, ["step"]).groupBy().pivot("step", steps).agg(F.max("baseline")).select(*(F.col(s).alias(f"_{s}") for s in steps))
    return df.crossJoin(F.broadcast(base)).select("lot", "wafer", *(F.coalesce(s, f"_{s}").alias(s) for s in steps))


def split_combos(split: DataFrame, factors: list[str], baseline: dict[str, str], order: list[str] = ("lot", "wafer")) -> DataFrame:
    """Factor code tuples with their wafers; groups x0, x1, ... in order of appearance; is_ref if all codes are the baseline.

    Combinations are numbered on their own rows, which are few against wafers.
    """
    g = split.groupBy(*factors).agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("wafers"))
    ref = F.lit(True)
    for f in factors:
        ref = ref & F.col(f).eqNullSafe(F.lit(baseline[f]))
    return g.select(F.concat(F.lit("x"), (F.row_number().over(Window.orderBy("first")) - 1).cast("string")).alias("gid"), *factors, "wafers", ref.alias("is_ref"))


def split_confounds(split: DataFrame, factors: list[str], others: list[str]) -> DataFrame:
    """Per factor combination the other steps with two codes or more."""
    long = split.unpivot([*factors], others, "step", "code")
    return long.where("code IS NOT NULL").groupBy(*factors, "step").agg(F.sort_array(F.collect_set("code")).alias("codes")).where(F.size("codes") > 1)


# Factors.


def split_gains(rows: DataFrame) -> DataFrame:
    """factor, gain, n: the share of a target's variance that the best single cut of each factor takes away. rows: factor, x, y.

    Exact: wafers of equal x stand together, and sums up to each cut give the squares on both sides of it.
    """
    at = rows.where("x IS NOT NULL AND y IS NOT NULL").groupBy("factor", "x").agg(F.count("*").alias("m"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
    upto, whole = Window.partitionBy("factor").orderBy("x"), Window.partitionBy("factor")
    left = at.select("factor", F.sum("m").over(upto).alias("m"), F.sum("s").over(upto).alias("s"), *(F.sum(c).over(whole).alias(f"all_{c}") for c in "msq"))
    between = F.col("s") ** 2 / F.col("m") + F.try_divide((F.col("all_s") - F.col("s")) ** 2, F.col("all_m") - F.col("m")) - F.col("all_s") ** 2 / F.col("all_m")
    total = F.col("all_q") - F.col("all_s") ** 2 / F.col("all_m")
    return left.groupBy("factor").agg(F.coalesce(F.max(F.when(total > 0, between / total)), F.lit(0.0)).alias("gain"), F.max("all_m").alias("n"))


def vote_factors(wafers: DataFrame, target: str, names: list[str], top: int = 10, least: int = 6, seed: int = 0) -> DataFrame:
    """factor, mean_rank, votes, r, n, gain: metrology factors ranked by three tree models for one item's wafer means.

    wafers: lot, wafer, the target and the factors as columns. Factors that are missing for more than half or
    constant go; the rest is centred by lot if there are several, and gaps take the median. Below `least` wafers: no rows.
    Models: random forest, gradient-boosted trees and one decision tree of MLlib. gain is the exact one of `split_gains`.
    """
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor

    spark = wafers.sparkSession
    schema = "factor string, mean_rank double, votes int, r double, n long, gain double"
    df = stored(wafers.where(F.col(target).isNotNull()))  # read by five passes
    about = df.agg(F.count("*").alias("n"), F.countDistinct("lot").alias("lots"), *(F.count(c).alias(f"n_{c}") for c in names), *(F.stddev_pop(c).alias(f"s_{c}") for c in names)).first()
    kept = [c for c in names if about[f"n_{c}"] * 2 >= about["n"] and (about[f"s_{c}"] or 0) > 0]
    if about["n"] < least or not kept:
        return spark.createDataFrame([], schema)
    if about["lots"] > 1:
        by_lot = Window.partitionBy("lot")
        df = df.withColumns({c: F.col(c) - F.avg(c).over(by_lot) for c in [target, *kept]})
    full = Imputer(strategy="median", inputCols=kept, outputCols=[f"f_{c}" for c in kept]).fit(df).transform(df)
    data = VectorAssembler(inputCols=[f"f_{c}" for c in kept], outputCol="features").transform(full).select(F.col(target).alias("label"), "features").persist()
    models = [RandomForestRegressor(numTrees=50, maxDepth=5, seed=seed), GBTRegressor(maxIter=20, maxDepth=3, seed=seed), DecisionTreeRegressor(maxDepth=5, seed=seed)]
    scores = [m.fit(data).featureImportances.toArray() for m in models]
    data.unpersist()
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("factor"), F.col(f"f_{c}").alias("x"), F.col(target).alias("y")) for c in kept))).alias("p")
    gains = {r.factor: r.gain for r in split_gains(full.select(pairs).select("p.*")).collect()}  # a row a factor
    ranks = [{i: k + 1 for k, i in enumerate(sorted(range(len(kept)), key=lambda i: (-s[i], kept[i])))} for s in scores]
    r = df.agg(*(F.corr(target, c).alias(c) for c in kept)).first()
    rows = [(c, float(sum(k[i] for k in ranks)) / len(ranks), sum(k[i] <= top for k in ranks), r[c], about[f"n_{c}"], gains.get(c, 0.0)) for i, c in enumerate(kept)]
    return spark.createDataFrame(rows, schema).orderBy("mean_rank", F.col("votes").desc(), "factor").limit(top)
