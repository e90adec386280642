"""The rule sheet: real items rescaled and renamed, derived items from formulas, group deviations, mixed sequences."""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.formula import FormulaError, build, compile_formula, parse, references

STD_KEYS = ["lot", "wafer", "step", "seq", "site", "temp"]


def validate(rules: list[dict]) -> tuple[list[dict], list[str]]:
    """Rules in an order that derived items can be computed in, and warnings. The sheet is small and stays on the driver.

    Of rows with one alias the last counts. A derived item without formula, with forbidden syntax, an unknown name
    or a cycle goes, and with it what needs it.
    """
    last = {r["alias"]: r for r in rules}
    kept = [r for r in rules if last[r["alias"]] is r]
    notes = [f"{r['alias']}: an earlier row is replaced" for r in rules if last[r["alias"]] is not r]
    real = [r for r in kept if r["category"] == "REAL"]
    waiting = {}
    for r in kept:
        if r["category"] != "ADDP":
            continue
        try:
            parse(r.get("formula") or "")
            waiting[r["alias"]] = r
        except FormulaError as e:
            notes.append(f"{r['alias']}: {e}")
    done, order = {r["alias"] for r in real}, []
    while ready := [a for a, r in waiting.items() if set(references(r["formula"])) <= done]:
        order += [waiting.pop(a) for a in ready]
        done |= set(ready)
    notes += [f"{a}: an unknown name or a cycle" for a in waiting]
    return real + order, notes


def apply_real(long: DataFrame, rules: DataFrame) -> DataFrame:
    """Items of the sheet only: value * scale, absolute if flagged, under their alias. rules: item, alias, scale, absolute."""
    scaled = F.col("value") * F.coalesce(F.when(F.col("scale") != 0, F.col("scale")), F.lit(1.0))
    out = long.join(rules, "item")
    return out.withColumn("value", F.when(F.coalesce("absolute", F.lit(False)), F.abs(scaled)).otherwise(scaled)).withColumn("item", F.col("alias")).drop("alias", "scale", "absolute")


def reapply_absolute(wide: DataFrame, items: list[str], seen: Observation | None = None) -> DataFrame:
    """Absolute values again on read (which changes nothing a second time); scales never.

    seen counts what the read itself meets: applied (items of the frame) and turned (values that were negative).
    """
    own = [i for i in items if i in wide.columns]
    if seen is not None:
        turned = [F.count_if(F.col(f"`{i}`") < 0) for i in own]
        wide = wide.observe(seen, F.lit(len(own)).cast("long").alias("applied"), sum(turned, F.lit(0).cast("long")).alias("turned"))
    return wide.withColumns({i: F.abs(F.col(f"`{i}`")) for i in own})


def _std_columns(formula: str, available: dict[str, str]) -> list[ast.Call]:
    tree, _ = parse(formula)
    calls = [n for n in ast.walk(tree) if isinstance(n, ast.Call) and n.func.id.lower() in ("std", "stdev", "stddev")]
    nested = any(m is not n and isinstance(m, ast.Call) and m in calls for n in calls for m in ast.walk(n))
    return [] if nested or not set(references(formula)) <= available.keys() else calls


def std_group(wide: DataFrame, formula: str, out: str, keys: list[str] = STD_KEYS, absolute: bool = False) -> DataFrame:
    """A formula whose Std(...) runs over all argument values of all chips of the group, given to each of its rows.

    Repeated arguments count once. Without the key columns or the items, or with a Std inside a Std, every Std of
    the formula runs over its own row instead.
    """
    available = {c: c for c in wide.columns}
    calls = _std_columns(formula, available) if set(keys) <= available.keys() else []
    if not calls:
        return wide.withColumn(out, compile_formula(formula, available, absolute))
    _, names = parse(formula)
    refs = [F.col(f"`{n}`").cast("double") for n in names]
    group = Window.partitionBy(*keys)
    columns: dict[str, Column] = {}
    for call in calls:
        args = list({ast.dump(a): a for a in call.args}.values())
        values = [C.finite(build(a, refs)) for a in args]
        n = sum((F.count(v).over(group) for v in values), F.lit(0))
        mean = F.try_divide(sum((F.coalesce(F.sum(v).over(group), F.lit(0.0)) for v in values), F.lit(0.0)), n)
        at = f"_mean{len(columns)}"
        wide = wide.withColumn(at, mean).withColumn(at + "n", n)
        square = sum((F.coalesce(F.sum((v - F.col(at)) * (v - F.col(at))).over(group), F.lit(0.0)) for v in values), F.lit(0.0))
        columns[ast.dump(call)] = F.when(F.col(at + "n") > 1, F.sqrt(square / (F.col(at + "n") - 1)))
    made = compile_formula(formula, available, absolute, lambda node: columns.get(ast.dump(node)))
    return wide.withColumn(out, made).drop(*(f"_mean{k}{s}" for k in range(len(columns)) for s in ("", "n")))


def addp_chain(wide: DataFrame, rules: list[dict]) -> DataFrame:
    """Derived items by dependency level, one projection a level; Std(...) over groups where it can."""
    ready, _ = validate(rules)
    level = {r["alias"]: 0 for r in ready if r["category"] == "REAL"}
    by_level: dict[int, list[dict]] = {}
    for r in (r for r in ready if r["category"] == "ADDP"):
        level[r["alias"]] = 1 + max((level.get(n, 0) for n in references(r["formula"])), default=0)
        by_level.setdefault(level[r["alias"]], []).append(r)
    for k in sorted(by_level):
        available = {c: c for c in wide.columns}
        plain = [r for r in by_level[k] if not _std_columns(r["formula"], available)]
        wide = wide.withColumns({r["alias"]: compile_formula(r["formula"], available, r.get("absolute", False)) for r in plain})
        for r in by_level[k]:
            if r not in plain:
                wide = std_group(wide, r["formula"], r["alias"], absolute=r.get("absolute", False))
    return wide


def seq_common(long: DataFrame, items: list[str]) -> DataFrame:
    """seq: those that every one of the items has."""
    return long.where(F.col("item").isin(items) & F.col("value").isNotNull()).groupBy("seq").agg(F.countDistinct("item").alias("n")).where(F.col("n") == len(items)).select("seq")


def addp_cross_seq(long: DataFrame, formula: str, alias: str, keys: list[str]) -> DataFrame:
    """A formula whose items share no sequence: computed on points merged over sequences, for rows of the point's last time.

    Returns keys, seq, ts, item, value. Null keys match null keys.
    """
    from .merge import exact_mean, merge_retest, merge_seq, pivot_wide

    items = references(formula)
    one = pivot_wide(merge_seq(merge_retest(long.where(F.col("item").isin(items)), keys), keys, exact_mean()), items, keys)
    made = one.withColumn("value", compile_formula(formula, {i: i for i in items})).where("value IS NOT NULL").select(*(F.col(k).alias(f"m_{k}") for k in keys), "value")
    rows = latest_rows(long.select(*keys, "seq", "ts").distinct(), keys).where("latest").drop("latest")
    same = [F.col(k).eqNullSafe(F.col(f"m_{k}")) for k in keys]
    return rows.join(made, same).select(*keys, "seq", "ts", F.lit(alias).alias("item"), "value")


def latest_rows(df: DataFrame, keys: list[str], time: str = "ts") -> DataFrame:
    """Adds latest: the row's time is the point's last; without any time, every row's is."""
    last = F.max(time).over(Window.partitionBy(*keys))
    return df.withColumn("latest", F.coalesce(F.col(time) == last, last.isNull()))


def unpivot_items(wide: DataFrame, items: list[str]) -> DataFrame:
    return wide.unpivot([c for c in wide.columns if c not in items], items, "item", "value").where("value IS NOT NULL")


# The corner columns of a rule sheet.
CORNERS = {"global": ["FFG", "FSG", "SSG", "SFG"], "functional": ["FF", "SS", "SF", "FS"]}


def corners_of(rules: DataFrame, kind: str) -> DataFrame:
    """item, corner, limit of the corner columns of one kind that the sheet has, whatever their case; an unknown kind has none."""
    own = {c.upper(): c for c in rules.columns}
    found = rules.select("item", *(F.col(own[c]).cast("double").alias(c) for c in CORNERS.get(kind, []) if c in own))
    if len(found.columns) == 1:
        return found.select("item", F.lit(None).cast("string").alias("corner"), F.lit(None).cast("double").alias("limit")).where("false")
    return corners(found, found.columns[1:])


def corners(rules: DataFrame, names: list[str]) -> DataFrame:
    """item, corner, limit of each finite corner specification."""
    return rules.unpivot(["item"], names, "corner", "limit").where("limit IS NOT NULL AND NOT isnan(limit) AND abs(limit) < double('Infinity')")


def corner_pairs(c: DataFrame, x: str, y: str) -> DataFrame:
    """corner, x, y: limits of two items (item, corner, limit) paired by the corner's name."""
    return c.where(F.col("item") == x).select("corner", F.col("limit").alias("x")).join(c.where(F.col("item") == y).select("corner", F.col("limit").alias("y")), "corner")
