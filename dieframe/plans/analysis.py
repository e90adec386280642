"""Queries over filters, joins, statistics, windows, sets, report tables, groups and incremental loads."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import joins as J
from ..operators import merge as M
from ..operators import report as P
from ..operators import rules as R
from ..operators import sources as O
from ..operators import stats as S
from ..sources import schema as SC
from ..sources import tables as T
from ..streaming import load as L
from ..streaming.days import run_days
from . import base as B
from .base import EXACT, query, read

ITEMS = ["QTY", "PRICE", "DISC"]
EXCLUDED = "SELECT key, CASE WHEN QTY < 3 THEN 'low' ELSE 'high' END AS reason, DATE '2026-01-01' + CAST(QTY AS INTEGER) AS \"at\" FROM pts WHERE QTY < 3 OR QTY > 49"
B.PARTS["excluded"] = (("pts",), EXCLUDED)
mean = M.exact_mean


def _exact(v: str) -> str:
    return EXACT.replace("value", v)


def _excluded(spark, sf, points=None):
    """points: those of `B.points`, where they are stored already."""
    p = (B.points(spark, sf) if points is None else points).where("QTY < 3 OR QTY > 49")
    return p.select("key", F.when(F.col("QTY") < 3, "low").otherwise("high").alias("reason"), F.lit(None).cast("string").alias("item"), F.date_add(F.lit("2026-01-01").cast("date"), F.round("QTY").cast("int")).alias("at"), F.lit("manual").alias("kind"))


B.PARTS["excluded"] = (("pts",), EXCLUDED.replace("CAST(QTY AS INTEGER)", "CAST(round(QTY) AS INTEGER)"))


def _values(spark, rows: str, columns: str):
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")


# Filters.


@query("filt_cond", "SELECT lot, count(*) AS n FROM pts WHERE step = 'A' AND cast(site AS varchar) = '6' GROUP BY lot", "pts")
def filt_cond(spark, sf):
    return J.by_condition(B.points(spark, sf), step="A", site="6").groupBy("lot").agg(F.count("*").alias("n"))


@query("cond_choices", "SELECT DISTINCT cast(site AS varchar) AS site FROM pts", "pts")
def cond_choices(spark, sf):
    return J.choices(B.points(spark, sf), "site")


@query("filt_active", "SELECT lot, count(*) AS n FROM pts WHERE key NOT IN (SELECT key FROM excluded) GROUP BY lot", "excluded")
def filt_active(spark, sf):
    return J.active(B.points(spark, sf), _excluded(spark, sf)).groupBy("lot").agg(F.count("*").alias("n"))


@query("filt_hidden", "SELECT key, lot FROM pts WHERE key IN (SELECT key FROM excluded)", "excluded")
def filt_hidden(spark, sf):
    return J.hidden(B.points(spark, sf), _excluded(spark, sf)).select("key", "lot")


@query("filt_visible_groups", "SELECT gid, count(*) AS n FROM pts WHERE gid NOT IN ('', 'g1') GROUP BY gid", "pts")
def filt_visible_groups(spark, sf):
    return J.visible_groups(B.points(spark, sf), ["g1"]).groupBy("gid").agg(F.count("*").alias("n"))


@query("filt_item_regex", "SELECT p_type AS item FROM part WHERE regexp_matches(p_type, '(?i)CD|THK|DEPTH|TIP|RCS|mo')")
def filt_item_regex(spark, sf):
    return read(spark, sf, "part").select(F.col("p_type").alias("item")).where(F.col("item").rlike(O.ITEMS + "|mo"))


@query("filt_subitem_site", "SELECT lot, count(*) AS n FROM metrology WHERE upper(subitem) NOT IN ('Q2', 'STD', 'MIN', 'MAX', 'RANGE', 'VALUE', 'SLOTID') OR subitem IS NULL GROUP BY lot", "metrology")
def filt_subitem_site(spark, sf):
    return O.site_rows(B.metrology(spark, sf)).groupBy("lot").agg(F.count("*").alias("n"))


@query("filt_subitem_wafer", "SELECT lot, count(*) AS n FROM metrology WHERE upper(subitem) = 'Q2' GROUP BY lot", "metrology")
def filt_subitem_wafer(spark, sf):
    return O.wafer_rows(B.metrology(spark, sf)).groupBy("lot").agg(F.count("*").alias("n"))


@query("filt_log_items", "SELECT item, count(*) AS n FROM long WHERE regexp_matches(item, '(?i)^pr.*$') OR item = 'DISC' GROUP BY item", "long")
def filt_log_items(spark, sf):
    return J.by_globs(B.long(spark, sf), ["pr*"], ["DISC"]).groupBy("item").agg(F.count("*").alias("n"))


# Joins.


@query("join_null_safe", "SELECT count(*) AS n, count(b.top) AS met FROM tracking a LEFT JOIN (SELECT ppid, max(ts) AS top FROM tracking GROUP BY ppid) b ON a.ppid IS NOT DISTINCT FROM b.ppid", "tracking")
def join_null_safe(spark, sf):
    t = B.tracking(spark, sf)
    return J.null_safe(t, t.groupBy("ppid").agg(F.max("ts").alias("top")), ["ppid"]).agg(F.count("*").alias("n"), F.count("top").alias("met"))


@query("join_values", "SELECT key, QTY, DISC FROM pts", "pts")
def join_values(spark, sf):
    p = B.points(spark, sf)
    return J.join_values(p.select("key"), p, ["QTY", "DISC"])


CONDITIONS = "SELECT lot, wafer, step, c AS condition FROM (SELECT *, coalesce(ppid, reticle) AS c, row_number() OVER (PARTITION BY lot, wafer, step ORDER BY ts DESC, coalesce(ppid, reticle) DESC) AS rn FROM tracking) t WHERE rn = 1"
B.PARTS["conditions"] = (("tracking",), CONDITIONS)
WAFER_OF = "cast(cast(substr(p.wafer, 2) AS integer) AS varchar)"


@query("attach_tracking", f"SELECT p.key, t.ppid FROM pts p LEFT JOIN (SELECT lot, wafer, min(ppid) AS ppid FROM tracking GROUP BY lot, wafer) t ON p.lot = t.lot AND {WAFER_OF} = t.wafer", "pts", "tracking")
def attach_tracking(spark, sf):
    df = B.points(spark, sf).withColumn("ppid", F.lit("old"))
    return J.attach(df, B.tracking(spark, sf).select("lot", "wafer", "ppid", "step"), overwrite=True).select("key", "ppid")


@query("attach_metrology", "SELECT p.key, p.QTY, t.thick FROM pts p LEFT JOIN (SELECT lot, wafer, min(fab_value) AS thick FROM metrology GROUP BY lot, wafer) t ON p.lot = t.lot AND substr(p.wafer, 2) = t.wafer", "pts", "metrology")
def attach_metrology(spark, sf):
    m = B.metrology(spark, sf).select("lot", "wafer", F.col("fab_value").alias("thick"), F.lit(0.0).alias("QTY"))
    return J.attach(B.points(spark, sf), m, overwrite=False).select("key", "QTY", "thick")


SPLIT = "SELECT lot, wafer, M1, CASE WHEN lot = '1' AND M2 = 'P' THEN NULL ELSE M2 END AS M2 FROM (SELECT lot, wafer, max(CASE WHEN step = '1-URGENT' THEN condition END) AS M1, max(CASE WHEN step = '2-HIGH' THEN condition END) AS M2 FROM conditions GROUP BY lot, wafer) s WHERE M1 IS NOT NULL"
B.PARTS["split"] = (("conditions",), SPLIT)


def _split(spark, sf):
    return spark.sql("WITH conditions AS (SELECT * FROM {c}) " + SPLIT, c=O.track_condition(B.tracking(spark, sf)))


@query("attach_split", f"SELECT p.key, p.QTY, t.M1 FROM pts p LEFT JOIN split t ON p.lot = t.lot AND {WAFER_OF} = t.wafer", "pts", "split")
def attach_split(spark, sf):
    return J.attach_split(B.points(spark, sf), _split(spark, sf).withColumn("QTY", F.lit("x"))).select("key", "QTY", "M1")


@query("reattach_all", f"SELECT p.key, s.M1, t.ppid, m.thick FROM pts p LEFT JOIN split s ON p.lot = s.lot AND {WAFER_OF} = s.wafer LEFT JOIN (SELECT lot, wafer, min(ppid) AS ppid FROM tracking GROUP BY lot, wafer) t ON p.lot = t.lot AND {WAFER_OF} = t.wafer LEFT JOIN (SELECT lot, wafer, min(fab_value) AS thick FROM metrology GROUP BY lot, wafer) m ON p.lot = m.lot AND substr(p.wafer, 2) = m.wafer", "pts", "split", "metrology")
def reattach_all(spark, sf):
    m = B.metrology(spark, sf).select("lot", "wafer", F.col("fab_value").alias("thick"))
    return J.reattach_all(B.points(spark, sf), _split(spark, sf), B.tracking(spark, sf).select("lot", "wafer", "ppid"), m).select("key", "M1", "ppid", "thick")


@query("assign_gid", f"SELECT p.key, coalesce(s.M1, '') AS gid FROM pts p LEFT JOIN split s ON p.lot = s.lot AND {WAFER_OF} = s.wafer", "pts", "split")
def assign_gid(spark, sf):
    return J.assign_gid(B.points(spark, sf), _split(spark, sf).select("lot", "wafer", F.col("M1").alias("gid"))).select("key", "gid")


@query("assign_manual", "SELECT key, CASE WHEN lot = '1' AND wafer = 'W01' AND site = 6 THEN '' WHEN lot = '1' AND wafer = 'W01' AND step = 'A' THEN 'b' WHEN lot = '1' AND wafer = 'W01' THEN 'a' ELSE gid END AS gid FROM pts", "pts")
def assign_manual(spark, sf):
    manual = _values(spark, "(1, '1', 'w1', NULL, CAST(NULL AS double), CAST(NULL AS int), 'a'), (2, ' 1', '#01', 'A', NULL, NULL, 'b'), (3, '1', 'W01', NULL, NULL, 6, '')", "ord, lot, wafer, step, temp, site, gid")
    return J.assign_manual(B.points(spark, sf), manual).select("key", "gid")


@query("join_full_coalesce", "SELECT lot, wafer, a.top, b.low FROM (SELECT lot, wafer, max(ts) AS top FROM tracking WHERE step < '3' GROUP BY lot, wafer) a FULL JOIN (SELECT lot, wafer, min(ts) AS low FROM tracking WHERE step > '4' GROUP BY lot, wafer) b USING (lot, wafer)", "tracking")
def join_full_coalesce(spark, sf):
    t = B.tracking(spark, sf)
    a, b = t.where("step < '3'").groupBy("lot", "wafer").agg(F.max("ts").alias("top")), t.where("step > '4'").groupBy("lot", "wafer").agg(F.min("ts").alias("low"))
    return J.join_full(a, b)


NEAREST = "list_sort(list(value))[CAST(floor((count(value) - 1) * {0} + 0.5) AS BIGINT) + 1]"
BOUNDS = f"SELECT item, {NEAREST.format(0.25)} AS q1, {NEAREST.format(0.75)} AS q3 FROM plong GROUP BY item"
B.PARTS["bounds"] = (("plong",), f"SELECT item, q1 - 0.4 * (q3 - q1) AS lo, q3 + 0.4 * (q3 - q1) AS hi FROM ({BOUNDS}) b")


@query("join_bounds", "SELECT item, count(*) AS n FROM plong JOIN bounds USING (item) WHERE value BETWEEN lo AND hi GROUP BY item", "bounds")
def join_bounds(spark, sf):
    p = T.stored(B.points_long(spark, sf))
    return S.join_bounds(p, S.tukey_bounds(p, 0.4)).where("value BETWEEN lo AND hi").groupBy("item").agg(F.count("*").alias("n"))


@query("join_excl_where", "SELECT e.key, p.lot, p.wafer FROM excluded e LEFT JOIN pts p ON e.key = p.key AND p.QTY < 3", "excluded")
def join_excl_where(spark, sf):
    p = T.stored(B.points(spark, sf).select("key", "lot", "wafer", "QTY"))
    return J.excluded_where(_excluded(spark, sf, p), p.where("QTY < 3"))


@query("part_lookup", "SELECT lot, wafer, min(reticle) AS part FROM tracking GROUP BY lot, wafer", "tracking")
def part_lookup(spark, sf):
    t = B.tracking(spark, sf).withColumnRenamed("reticle", "part")
    return J.part_lookup(B.points(spark, sf).withColumn("part", F.lit(None).cast("string")), t)


@query("join_geometry", "SELECT item, width, count(*) AS n FROM plong JOIN specs USING (item) WHERE width IS NOT NULL GROUP BY item, width", "plong", "specs")
def join_geometry(spark, sf):
    return J.join_geometry(B.points_long(spark, sf), B.specs(spark)).groupBy("item", "width").agg(F.count("*").alias("n"))


RESOLVED = """WITH lots AS (SELECT 'PA' || s_suppkey AS lot FROM supplier),
typed AS (SELECT CASE s_suppkey % 4 WHEN 0 THEN 'PA' WHEN 1 THEN 'pa' WHEN 2 THEN 'a' ELSE 'QX' END || s_suppkey AS typed FROM supplier),
ranks AS (
  SELECT typed, lot, CASE WHEN typed = lot THEN 1 WHEN lower(typed) = lower(lot) THEN 2 WHEN contains(lower(lot), lower(typed)) THEN 3 ELSE 4 END AS r,
    len(list_filter(range(1, least(length(typed), length(lot)) + 1), lambda i: lower(typed)[i] = lower(lot)[i])) AS same FROM typed, lots),
unique_parts AS (SELECT typed, lot, same, CASE WHEN r = 3 AND count(*) FILTER (r = 3) OVER (PARTITION BY typed) > 1 THEN 4 ELSE r END AS r FROM ranks),
best AS (SELECT *, min(r) OVER (PARTITION BY typed) AS best FROM unique_parts)
SELECT typed, lot, ['exact', 'case', 'part', 'similar'][r] AS how FROM best WHERE r = best
QUALIFY row_number() OVER (PARTITION BY typed ORDER BY same DESC, lot) <= CASE WHEN best = 4 THEN 5 ELSE 1 END"""


@query("resolve_lot", RESOLVED)
def resolve_lot(spark, sf):
    key = F.col("s_suppkey")
    lead = F.when(key % 4 == 0, "PA").when(key % 4 == 1, "pa").when(key % 4 == 2, "a").otherwise("QX")
    lots = B.read(spark, sf, "supplier").select(F.concat(F.lit("PA"), key.cast("string")).alias("lot"), F.concat(lead, key.cast("string")).alias("typed"))
    return J.resolve_lot(lots.select("typed"), lots.select("lot"))


@query("resolve_wafer", "SELECT DISTINCT cast(cast(substr(wafer, 2) AS integer) AS varchar) AS typed, wafer FROM base", "base")
def resolve_wafer(spark, sf):
    w = B.base(spark, sf).select("wafer").distinct()
    return J.resolve_wafer(w.select(C.norm_wafer("wafer").alias("typed")), w.withColumn("ord", F.col("wafer")))


@query("met_name", "SELECT step || '::' || item AS met, count(*) AS n FROM metrology GROUP BY 1", "metrology")
def met_name(spark, sf):
    return B.metrology(spark, sf).groupBy(O.met_name().alias("met")).agg(F.count("*").alias("n"))


@query("cat_value", "SELECT CASE gid WHEN 'g0' THEN 'Reference' ELSE '(none)' END AS category, count(*) AS n FROM pts GROUP BY 1 UNION ALL SELECT lot || '·' || wafer, count(*) FROM pts GROUP BY 1", "pts")
def cat_value(spark, sf):
    p = B.points(spark, sf)
    a = J.category(p, "gid", _values(spark, "('g0', 'Reference')", "gid, name"))
    return a.groupBy("category").agg(F.count("*").alias("n")).unionByName(J.category(p, "lot_wafer").groupBy("category").agg(F.count("*").alias("n")))


# Statistics.


@query("wafer_stats", f"SELECT lot, wafer, item, {EXACT} AS avg, median(value) AS med, round(stddev_samp(value), 4) AS std FROM plong GROUP BY lot, wafer, item", "plong")
def wafer_stats(spark, sf):
    return S.wafer_stats(B.points_long(spark, sf), {"avg": mean(), "med": F.median("value"), "std": F.round(F.stddev_samp("value"), 4)})


@query("wafer_excluded", "SELECT lot, wafer, count(*) AS n FROM pts WHERE key IN (SELECT key FROM excluded) GROUP BY lot, wafer", "excluded")
def wafer_excluded(spark, sf):
    return S.wafer_excluded(B.points(spark, sf), _excluded(spark, sf))


WAFER_MEANS = f"(SELECT gid, item, lot, wafer, {EXACT} AS value FROM plong GROUP BY gid, item, lot, wafer)"
GROUPS = f"SELECT gid, item, {EXACT} AS value, count(*) AS wafers FROM {WAFER_MEANS} w GROUP BY gid, item"
B.PARTS["reps"] = (("plong",), GROUPS)
B.PARTS["refs"] = (("plong",), f"SELECT item, {EXACT} AS ref FROM plong WHERE gid = 'g0' GROUP BY item")


def _reps(spark, sf):
    return S.group_rep(B.points_long(spark, sf), mean(), mean())


def _refs(spark, sf):
    return S.ref_value(B.points_long(spark, sf), "g0", mean())


@query("group_rep", "SELECT * FROM reps", "reps")
def group_rep(spark, sf):
    return _reps(spark, sf)


@query("ref_value", "SELECT * FROM refs", "refs")
def ref_value(spark, sf):
    return _refs(spark, sf)


@query("group_mean", "SELECT gid, item, value FROM reps WHERE gid <> ''", "reps")
def group_mean(spark, sf):
    return S.group_rep(J.visible_groups(B.points_long(spark, sf)), mean(), mean()).drop("wafers")


@query("delta_ref", "SELECT gid, item, value, value - ref AS delta FROM reps JOIN refs USING (item)", "reps", "refs")
def delta_ref(spark, sf):
    return S.delta(_reps(spark, sf).drop("wafers"), _refs(spark, sf))


@query("wafer_index", "SELECT lot, wafer, step, temp, site, count(DISTINCT (x, y)) AS points FROM wide GROUP BY lot, wafer, step, temp, site", "wide")
def wafer_index(spark, sf):
    return S.wafer_index(B.wide(spark, sf))


@query("lot_index", "SELECT lot, count(DISTINCT wafer) AS wafers FROM base GROUP BY lot", "base")
def lot_index(spark, sf):
    return S.lot_index(B.base(spark, sf))


@query("lot_context", "SELECT array_to_string(list_sort(list(DISTINCT line))[1:20], ',') AS line, min(ts)::DATE AS first, max(ts)::DATE AS last, (min(ts)::DATE - 180)::DATE AS since FROM tracking", "tracking")
def lot_context(spark, sf):
    return S.lot_context(B.tracking(spark, sf)).withColumn("line", F.array_join("line", ","))


COV = "SELECT * FROM plong WHERE NOT (cast(lot AS int) % 4 = 1 AND item = 'DISC') AND NOT (cast(lot AS int) % 5 = 2 AND step = 'A')"
B.PARTS["cov"] = (("plong",), COV)


@query("coverage_items", "SELECT lot, array_to_string(list_sort(list(DISTINCT item)), ',') AS items, count(DISTINCT item)::INTEGER AS n FROM cov GROUP BY lot", "cov")
def coverage_items(spark, sf):
    return S.coverage_items(_cov(spark, sf)).withColumn("items", F.array_join("items", ","))


def _cov(spark, sf):
    return T.stored(B.points_long(spark, sf).where("NOT (cast(lot AS int) % 4 = 1 AND item = 'DISC') AND NOT (cast(lot AS int) % 5 = 2 AND step = 'A')"))


COV_LOTS = """SELECT l.lot, l.wafers, l.n_items, l.points, b.lot AS base_lot, array_to_string(list_sort(list_filter(b.items, lambda x: NOT list_contains(l.items, x))), ',') AS missing_items,
  len(list_filter(b.conds, lambda x: NOT list_contains(l.conds, x)))::INTEGER AS missing_conditions, len(list_filter(l.conds, lambda x: NOT list_contains(b.conds, x)))::INTEGER AS extra_conditions, abs(l.points / b.points - 1) > 0.2 AS off
  FROM lots l, (SELECT * FROM lots ORDER BY n_items DESC, lot LIMIT 1) b"""
B.PARTS["lots"] = (("cov",), """SELECT lot, count(*) AS wafers, median(p) AS points, max(n_items) AS n_items, max(items) AS items, max(conds) AS conds FROM
  (SELECT lot, wafer, count(DISTINCT key) AS p FROM cov GROUP BY lot, wafer) w JOIN (SELECT lot, list(DISTINCT item) AS items, count(DISTINCT item)::INTEGER AS n_items, list(DISTINCT step || '/' || temp || '/' || site) AS conds FROM cov GROUP BY lot) i USING (lot) GROUP BY lot""")


@query("coverage_lot", COV_LOTS, "lots")
def coverage_lot(spark, sf):
    return _coverage(_cov(spark, sf))


def _coverage(rows):
    t = S.coverage_lots(rows).withColumn("missing_items", F.array_join("missing_items", ","))
    return t.select("lot", "wafers", "n_items", "points", "base_lot", "missing_items", F.size("missing_conditions").alias("missing_conditions"), F.size("extra_conditions").alias("extra_conditions"), "off")


COV_TEXT = "SELECT * REPLACE ('PA' || lot AS lot) FROM plong WHERE NOT (cast(lot AS int) % 4 = 1 AND item = 'DISC') AND NOT (cast(lot AS int) % 5 = 2 AND step = 'A')"
B.PARTS["cov_text"] = (("plong",), COV_TEXT)
B.PARTS["lots_text"] = (("cov_text",), B.PARTS["lots"][1].replace("FROM cov ", "FROM cov_text "))


@query("coverage_lot_text", COV_LOTS.replace("FROM lots", "FROM lots_text").replace("lots l,", "lots_text l,"), "lots_text")
def coverage_lot_text(spark, sf):
    """The same where lots are text: the base lot is the lowest as text."""
    return _coverage(_cov(spark, sf).withColumn("lot", F.concat(F.lit("PA"), "lot")))


@query("coverage_notes", f"SELECT lot, concat_ws('; ', CASE WHEN missing_items <> '' THEN 'missing items: ' || replace(missing_items, ',', ', ') END, CASE WHEN missing_conditions > 0 THEN 'missing conditions: ' || missing_conditions END, CASE WHEN extra_conditions > 0 THEN 'extra conditions: ' || extra_conditions END, CASE WHEN off THEN 'points differ' END) AS note FROM ({COV_LOTS}) c WHERE note <> ''", "lots")
def coverage_notes(spark, sf):
    return S.coverage_notes(S.coverage_lots(_cov(spark, sf)))


@query("set_missing_items", "SELECT lot, 'DISC' AS item FROM (SELECT DISTINCT lot FROM cov) t WHERE cast(lot AS int) % 4 = 1", "cov")
def set_missing_items(spark, sf):
    return S.coverage_lots(_cov(spark, sf)).select("lot", F.explode("missing_items").alias("item"))


# Outliers.


def _fences(quantile: str) -> str:
    return f"""SELECT item, step, temp, CASE WHEN n >= 12 THEN round(q1 - 1.5 * (q3 - q1), 8) END AS lo, CASE WHEN n >= 12 THEN round(q3 + 1.5 * (q3 - q1), 8) END AS hi, n
  FROM (SELECT item, step, temp, {quantile.format(0.25)} AS q1, {quantile.format(0.75)} AS q3, count(value) AS n FROM plong GROUP BY item, step, temp) q"""



def _tukey_bounds(spark, sf, **of):
    return S.tukey_bounds(T.stored(B.points_long(spark, sf)), by=("item", "step", "temp"), **of).withColumns({"lo": F.round("lo", 8), "hi": F.round("hi", 8)})


@query("tukey_bounds", _fences(NEAREST), "plong")
def tukey_bounds(spark, sf):
    return _tukey_bounds(spark, sf)


@query("tukey_bounds_linear", _fences("quantile_cont(value, {0})"), "plong")
def tukey_bounds_linear(spark, sf):
    return _tukey_bounds(spark, sf, interp="linear")


TUKEY = "SELECT key, arg_min(item, CASE item WHEN 'QTY' THEN 1 WHEN 'PRICE' THEN 2 ELSE 3 END) AS item FROM plong JOIN bounds USING (item) WHERE value < lo OR value > hi GROUP BY key"


@query("tukey_flag", TUKEY, "bounds")
def tukey_flag(spark, sf):
    p = _key_values(spark, sf)
    return S.tukey_flag(p, S.tukey_bounds(p, 0.4), ITEMS)


@query("tukey_summary", f"SELECT item, count(*) AS n FROM ({TUKEY}) t GROUP BY item ORDER BY n DESC, item LIMIT 3", "bounds")
def tukey_summary(spark, sf):
    p = _key_values(spark, sf)
    return S.tukey_summary(S.tukey_flag(p, S.tukey_bounds(p, 0.4), ITEMS))


# Metrology and tracking.

MET = f"SELECT lot, wafer, step || '::' || item AS met, {_exact('fab_value')} AS value FROM metrology WHERE upper(subitem) = 'S1' GROUP BY 1, 2, 3"


@query("met_wafer_values", MET, "metrology")
def met_wafer_values(spark, sf):
    return O.met_wafer_values(B.metrology(spark, sf), mean=mean())


@query("met_wide", f"SELECT lot, wafer, max(value) FILTER (met = 'A::PROMO') AS \"A::PROMO\", max(value) FILTER (met = 'N::SMALL') AS \"N::SMALL\" FROM ({MET}) m GROUP BY lot, wafer", "metrology")
def met_wide(spark, sf):
    return O.met_wide(O.met_wafer_values(B.metrology(spark, sf), mean=mean()), ["A::PROMO", "N::SMALL"])


@query("track_condition", "SELECT * FROM conditions", "conditions")
def track_condition(spark, sf):
    return O.track_condition(B.tracking(spark, sf))


def _conditions(spark, sf):
    return O.track_condition(B.tracking(spark, sf))


@query("track_split_steps", "SELECT step, count(DISTINCT condition) AS \"values\", count(*) AS wafers FROM conditions GROUP BY step HAVING count(DISTINCT condition) > 1 AND count(*) >= 2", "conditions")
def track_split_steps(spark, sf):
    return O.track_split_steps(_conditions(spark, sf))


MAJORITY = "SELECT lot, step, condition AS baseline FROM (SELECT *, row_number() OVER (PARTITION BY lot, step ORDER BY n DESC, condition) AS rn FROM (SELECT lot, step, condition, count(*) AS n FROM conditions GROUP BY lot, step, condition) c) t WHERE rn = 1"


@query("majority_code", MAJORITY, "conditions")
def majority_code(spark, sf):
    return O.majority(_conditions(spark, sf), ["lot", "step"])


@query("track_matrix", f"""SELECT lot, wafer, max(v) FILTER (step = '1-URGENT') AS a, max(v) FILTER (step = '2-HIGH') AS b FROM
  (SELECT g.lot, g.wafer, g.step, coalesce(c.condition, m.baseline) AS v FROM (SELECT * FROM (SELECT DISTINCT lot, wafer FROM conditions WHERE step IN ('1-URGENT', '2-HIGH')) w, (SELECT DISTINCT step FROM conditions WHERE step IN ('1-URGENT', '2-HIGH')) s) g
  LEFT JOIN conditions c USING (lot, wafer, step) LEFT JOIN ({MAJORITY}) m ON g.lot = m.lot AND g.step = m.step) x GROUP BY lot, wafer""", "conditions")
def track_matrix(spark, sf):
    return O.track_matrix(_conditions(spark, sf), ["1-URGENT", "2-HIGH"]).toDF("lot", "wafer", "a", "b")


@query("track_derive", """SELECT lot, wafer, arg_max(coalesce(ppid, reticle), (ts, coalesce(ppid, reticle))) FILTER (step = '2-HIGH') AS recipe, arg_max(reticle, (ts, reticle)) AS mask FROM tracking GROUP BY lot, wafer""", "tracking")
def track_derive(spark, sf):
    return O.track_derive(B.tracking(spark, sf), [("recipe", "auto", "2-HIGH"), ("mask", "reticle", None)])


@query("track_suggest", "SELECT step AS name FROM conditions GROUP BY step HAVING count(DISTINCT condition) > 1 AND count(*) >= 2", "conditions")
def track_suggest(spark, sf):
    return O.track_split_steps(_conditions(spark, sf)).select(F.col("step").alias("name"))


@query("track_summary", "SELECT count(DISTINCT lot) AS lots, (SELECT count(*) FROM (SELECT step FROM conditions GROUP BY step HAVING count(DISTINCT condition) > 1 AND count(*) >= 2) s) AS varying FROM conditions", "conditions")
def track_summary(spark, sf):
    return O.track_summary(_conditions(spark, sf))


MODE = "(SELECT {0} FROM (SELECT {0}, count(*) AS n FROM split WHERE {0} IS NOT NULL GROUP BY {0} ORDER BY n DESC, {0} LIMIT 1) m)"
B.PARTS["loaded"] = (("split",), f"SELECT lot, wafer, coalesce(M1, {MODE.format('M1')}) AS M1, coalesce(M2, {MODE.format('M2')}) AS M2 FROM split")


@query("split_load", "SELECT * FROM loaded", "loaded")
def split_load(spark, sf):
    """From a long sheet under other headings."""
    long = _split(spark, sf).unpivot(["lot", "wafer"], ["M1", "M2"], "step_id", "code").withColumn("code", F.coalesce("code", F.lit(" ")))
    return O.split_load(long.withColumnsRenamed({"lot": "Root_Lot_Id", "wafer": "WAFER_ID", "step_id": "STEP_ID", "code": "Condition"}), ["M1", "M2"])


def _loaded(spark, sf):
    return O.split_load(_split(spark, sf), ["M1", "M2"])


@query("split_combos", "SELECT 'x' || (row_number() OVER (ORDER BY first) - 1) AS gid, M1, M2, wafers, M1 = 'O' AND M2 = 'O' AS is_ref FROM (SELECT M1, M2, min((lot, wafer)) AS first, count(*) AS wafers FROM loaded GROUP BY M1, M2) g", "loaded")
def split_combos(spark, sf):
    return O.split_combos(_loaded(spark, sf), ["M1", "M2"], {"M1": "O", "M2": "O"})


@query("split_confounds", "SELECT M1, 'M2' AS step, array_to_string(list_sort(list(DISTINCT M2)), ',') AS codes FROM loaded GROUP BY M1 HAVING count(DISTINCT M2) > 1", "loaded")
def split_confounds(spark, sf):
    return O.split_confounds(_loaded(spark, sf), ["M1"], ["M2"]).withColumn("codes", F.array_join("codes", ","))


@query("pearson", "SELECT lot, CASE WHEN count(*) >= 3 AND stddev_pop(QTY) > 0 AND stddev_pop(PRICE) > 0 THEN round(corr(QTY, PRICE), 6) END AS r, count(*) AS n FROM pts WHERE QTY IS NOT NULL AND PRICE IS NOT NULL GROUP BY lot", "pts")
def pearson(spark, sf):
    return S.pearson(B.points(spark, sf), "QTY", "PRICE", ("lot",)).withColumn("r", F.round("r", 6))


@query("vote_factors")
def vote_factors(spark, sf):
    return O.vote_factors(_wafers(spark, sf), "PRICE", ["QTY", "DISC", "points"])


def _wafers(spark, sf):
    long = B.points_long(spark, sf).groupBy("lot", "wafer", "item").agg(mean().alias("value"), F.count("*").alias("n"))
    of = lambda item, c="value": F.max(F.when(F.col("item") == item, F.col(c)))
    return long.groupBy("lot", "wafer").agg(*(of(i).alias(i) for i in ITEMS), of("QTY", "n").cast("double").alias("points"))


FACTORS = f"""WITH means AS (SELECT lot, wafer, item, {EXACT} AS value, count(*) AS n FROM plong GROUP BY lot, wafer, item),
  w AS (SELECT lot, wafer, max(value) FILTER (item = 'QTY') AS QTY, max(value) FILTER (item = 'PRICE') AS PRICE, max(value) FILTER (item = 'DISC') AS DISC, (max(n) FILTER (item = 'QTY'))::DOUBLE AS points FROM means GROUP BY lot, wafer),
  c AS (SELECT lot, wafer, PRICE - avg(PRICE) OVER l AS y, QTY - avg(QTY) OVER l AS QTY, DISC - avg(DISC) OVER l AS DISC, points - avg(points) OVER l AS points FROM w WINDOW l AS (PARTITION BY lot)),
  long_c AS (SELECT 'QTY' AS factor, QTY AS x, y FROM c UNION ALL SELECT 'DISC', DISC, y FROM c UNION ALL SELECT 'points', points, y FROM c),
  spots AS (SELECT factor, x, count(*) AS m, sum(y) AS s, sum(y * y) AS q FROM long_c GROUP BY factor, x),
  cut AS (SELECT factor, sum(m) OVER u AS m, sum(s) OVER u AS s, sum(m) OVER a AS am, sum(s) OVER a AS asum, sum(q) OVER a AS aq FROM spots WINDOW u AS (PARTITION BY factor ORDER BY x), a AS (PARTITION BY factor))
SELECT factor, round(max(CASE WHEN am > m THEN (s * s / m + (asum - s) * (asum - s) / (am - m) - asum * asum / am) / (aq - asum * asum / am) END), 6) AS gain, max(am)::BIGINT AS n FROM cut GROUP BY factor"""


@query("tbl_factor", f"SELECT g.factor, g.gain, g.n, r.r FROM ({FACTORS}) g JOIN (SELECT factor, round(corr(x, y), 3) AS r FROM ({FACTORS.split('  spots AS')[0].rstrip().rstrip(',')} SELECT * FROM long_c) t GROUP BY factor) r USING (factor)", "plong")
def tbl_factor(spark, sf):
    """The factor table's exact columns; the votes beside them are those of `vote_factors`."""
    t = vote_factors(spark, sf)
    return t.select("factor", F.round("gain", 6).alias("gain"), "n", F.round("r", 3).alias("r"))


# Plot data.


@query("item_range", """SELECT item, CASE WHEN item = 'PRICE' THEN 0.0 ELSE round(a - (b - a) * 0.1, 8) END AS lo, round(b + (b - a) * 0.1, 8) AS hi FROM
  (SELECT item, CASE item WHEN 'QTY' THEN least(min(value), 0.5) ELSE least(min(value), min(lsl)) END AS a, CASE item WHEN 'QTY' THEN greatest(max(value), 70.5) ELSE greatest(max(value), max(usl)) END AS b FROM plong JOIN specs USING (item) GROUP BY item) t""", "plong", "specs")
def item_range(spark, sf):
    corners = R.corners_of(_values(spark, "('QTY', 70.5D, CAST(NULL AS double), 0.5D), ('DISC', NULL, NULL, NULL)", "item, FF, SS, SF"), "functional")
    t = S.item_range(B.points_long(spark, sf), B.specs(spark), manual=_values(spark, "('PRICE', 0.0D, CAST(NULL AS double))", "item, lo, hi"), corners=corners)
    return t.select("item", F.round("lo", 8).alias("lo"), F.round("hi", 8).alias("hi"))


@query("scatter_pairs", "SELECT 'QTY:PRICE' AS pair, key, QTY AS x, PRICE AS y FROM pts WHERE QTY IS NOT NULL AND PRICE IS NOT NULL UNION ALL SELECT 'DISC:PRICE', key, DISC, PRICE FROM pts WHERE DISC IS NOT NULL AND PRICE IS NOT NULL", "pts")
def scatter_pairs(spark, sf):
    return S.scatter_pairs(B.points(spark, sf), [("QTY", "PRICE"), ("DISC", "PRICE")]).select("pair", "key", "x", "y")


@query("scatter_unpaired", "SELECT count(QTY) FILTER (step = 'A') > 0 AND count(DISC) FILTER (step <> 'A') > 0 AS unpaired FROM pts", "pts")
def scatter_unpaired(spark, sf):
    p = B.points(spark, sf).select(F.when(F.col("step") == "A", F.col("QTY")).alias("x"), F.when(F.col("step") != "A", F.col("DISC")).alias("y"))
    return S.scatter_unpaired(p, "x", "y")


@query("scatter_keys", "SELECT lot, wafer, array_to_string(list_sort(list(key)), ',') AS keys FROM pts GROUP BY lot, wafer", "pts")
def scatter_keys(spark, sf):
    return S.scatter_keys(B.points(spark, sf)).withColumn("keys", F.array_join("keys", ","))


@query("box_values", f"SELECT step AS category, lot, wafer, {_exact('QTY')} AS value FROM pts WHERE QTY IS NOT NULL GROUP BY step, lot, wafer", "pts")
def box_values(spark, sf):
    return S.box_values(J.category(B.points(spark, sf), "step"), "QTY", mean())


@query("box_stats", """SELECT gid, item, round(q1, 8) AS q1, round(med, 8) AS med, round(q3, 8) AS q3, min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low, max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high,
  count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS fliers FROM plong JOIN (SELECT gid, item, quantile_cont(value, 0.25) AS q1, median(value) AS med, quantile_cont(value, 0.75) AS q3 FROM plong GROUP BY gid, item) q USING (gid, item) GROUP BY gid, item, q1, med, q3""", "plong")
def box_stats(spark, sf):
    return S.box_stats(T.stored(B.points_long(spark, sf).select("gid", "item", "value")), ("gid", "item")).withColumns({c: F.round(c, 8) for c in ("q1", "med", "q3")})


@query("bar_means", f"SELECT gid, step AS category, {_exact('QTY')} AS value FROM pts GROUP BY gid, step", "pts")
def bar_means(spark, sf):
    return S.bar_means(B.points(spark, sf).withColumn("category", F.col("step")), "QTY", mean())


@query("box_points", "SELECT step AS category, lot, wafer, key, QTY AS value FROM pts WHERE QTY IS NOT NULL", "pts")
def box_points(spark, sf):
    """The point mode: a value each."""
    return S.box_values(J.category(B.points(spark, sf), "step"), "QTY")


TREND = f"""WITH each AS (SELECT gid, lot, wafer, item, width AS x, {EXACT} AS value FROM plong JOIN specs USING (item) WHERE width IS NOT NULL GROUP BY gid, lot, wafer, item, width)
SELECT CASE WHEN grouping(wafer) = 0 THEN 'strip' WHEN grouping(lot) = 0 THEN 'lot' ELSE 'group' END AS kind, gid, lot, wafer, item, x, {EXACT} AS value
  FROM each GROUP BY GROUPING SETS ((gid, item, x, lot, wafer), (gid, item, x, lot), (gid, item, x))
UNION ALL SELECT 'target', NULL, NULL, NULL, item, width, target FROM specs WHERE width IS NOT NULL AND target IS NOT NULL"""


@query("trend_points", f"SELECT * FROM ({TREND}) t", "plong", "specs")
def trend_points(spark, sf):
    specs = B.specs(spark)
    return S.trend_points(B.points_long(spark, sf), specs.select("item", F.col("width").alias("x")), mean(), mean(), specs.select("item", "target"))


@query("lot_parts", f"SELECT gid, lot, item, {EXACT} AS value, count(*) AS wafers FROM (SELECT gid, lot, wafer, item, {EXACT} AS value FROM plong GROUP BY gid, lot, wafer, item) w GROUP BY gid, lot, item", "plong")
def lot_parts(spark, sf):
    return S.lot_parts(B.points_long(spark, sf), mean(), mean())


@query("excl_groups", "SELECT lot, wafer, reason, \"at\", count(*) AS n, array_to_string(list_sort(list(key)), ',') AS keys FROM excluded JOIN pts USING (key) GROUP BY lot, wafer, reason, \"at\"", "excluded")
def excl_groups(spark, sf):
    return J.exclusion_groups(B.points(spark, sf), _excluded(spark, sf)).withColumn("keys", F.array_join("keys", ","))


@query("deck_meta", "SELECT array_to_string(list_sort(list(DISTINCT step)), ',') AS steps, count(DISTINCT lot) AS lots, count(DISTINCT temp) AS temps, min(line) AS line, max(ts) AS last FROM rounded", "rounded")
def deck_meta(spark, sf):
    return P.deck_meta(B.rounded(spark, sf)).withColumn("steps", F.array_join("steps", ","))


@query("group_counts", "SELECT gid, count(*) AS n FROM pts WHERE key NOT IN (SELECT key FROM excluded) GROUP BY gid", "excluded")
def group_counts(spark, sf):
    return J.active(B.points(spark, sf), _excluded(spark, sf)).groupBy("gid").agg(F.count("*").alias("n"))


@query("scope_counts", "SELECT count(DISTINCT (lot, wafer)) AS wafers, sum(points)::BIGINT AS points FROM (SELECT lot, wafer, step, temp, site, count(DISTINCT (x, y)) AS points FROM wide WHERE lot IN ('1', '2') AND step = 'A' GROUP BY lot, wafer, step, temp, site) i", "wide")
def scope_counts(spark, sf):
    i = SC.in_lots(S.wafer_index(B.wide(spark, sf)), ["1", "2"]).where("step = 'A'")
    return i.agg(F.countDistinct("lot", "wafer").alias("wafers"), F.sum("points").alias("points"))


# Windows, orders, sets.


@query("win_retest_latest", "SELECT lot, wafer, x, y, seq, QTY FROM (SELECT *, row_number() OVER (PARTITION BY lot, wafer, x, y, temp, step, site, seq ORDER BY ts DESC NULLS LAST, QTY DESC) AS rn FROM base) t WHERE rn = 1", "base")
def win_retest_latest(spark, sf):
    return SC.latest_retest(B.base(spark, sf), [*SC.KEY7, "seq"], "ts", "QTY").select("lot", "wafer", "x", "y", "seq", "QTY")


@query("win_latest_flag", "SELECT latest, count(*) AS n FROM (SELECT ts = max(ts) OVER (PARTITION BY lot, wafer, x, y) AS latest FROM base) t GROUP BY latest", "base")
def win_latest_flag(spark, sf):
    return R.latest_rows(B.base(spark, sf), ["lot", "wafer", "x", "y"]).groupBy("latest").agg(F.count("*").alias("n"))


@query("win_center", "SELECT key, round(QTY - avg(QTY) OVER (PARTITION BY lot), 6) AS QTY FROM pts", "pts")
def win_center(spark, sf):
    return P.center(B.points(spark, sf), ["QTY"]).select("key", F.round("QTY", 6).alias("QTY"))


@query("win_median_fill", "SELECT key, coalesce(CASE WHEN step <> 'A' THEN QTY END, (SELECT median(QTY) FROM pts WHERE step <> 'A')) AS QTY FROM pts", "pts")
def win_median_fill(spark, sf):
    p = B.points(spark, sf).withColumn("QTY", F.when(F.col("step") != "A", F.col("QTY")))
    return P.median_fill(p, ["QTY"]).select("key", "QTY")


@query("win_rank", "SELECT lot, step, n, row_number() OVER (PARTITION BY step ORDER BY n DESC, lot)::INTEGER AS rank FROM (SELECT lot, step, count(*) AS n FROM base GROUP BY lot, step) t", "base")
def win_rank(spark, sf):
    return P.ranked(B.base(spark, sf).groupBy("lot", "step").agg(F.count("*").alias("n")), F.col("n").desc(), F.col("lot"), by=["step"])


@query("win_day_spans", """SELECT user_id, min(day) AS first, max(day) AS last FROM (SELECT *, (row_number() OVER (PARTITION BY user_id, island ORDER BY day) - 1) // 3 AS part FROM
  (SELECT user_id, day, day - row_number() OVER (PARTITION BY user_id ORDER BY day)::INTEGER AS island FROM (SELECT DISTINCT user_id, ts::DATE AS day FROM events) d) i) p GROUP BY user_id, island, part""")
def win_day_spans(spark, sf):
    days = read(spark, sf, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    return P.day_spans(days, 3, ["user_id"])


@query("win_runs", """SELECT event_id, sum(b1) OVER w AS type_run, sum(b2) OVER w AS big_run FROM (SELECT *, CASE WHEN b1 = 1 OR big IS DISTINCT FROM lag(big) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS b2 FROM
  (SELECT user_id, event_id, value > 50 AS big, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS b1 FROM events) a) b WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def win_runs(spark, sf):
    e = read(spark, sf, "events").select("user_id", "event_id", F.col("event_type").alias("type"), (F.col("value") > 50).alias("big"))
    return P.runs(e, ["user_id"], ["event_id"], ["type", "big"]).select("event_id", "type_run", "big_run")


WAFERS = "(SELECT DISTINCT lot, wafer FROM tracking) w"


@query("win_page_split", f"""SELECT lot, wafer, (before + (rn - 1) // 12 + 1)::BIGINT AS page FROM (SELECT lot, wafer, row_number() OVER (PARTITION BY lot ORDER BY wafer::INTEGER) AS rn FROM {WAFERS}) r
  JOIN (SELECT lot, coalesce(sum(pages) OVER (ORDER BY lot::INTEGER ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT lot, (count(*) - 1) // 12 + 1 AS pages FROM {WAFERS} GROUP BY lot) p) b USING (lot)""", "tracking")
def win_page_split(spark, sf):
    return P.pages(B.tracking(spark, sf).select("lot", "wafer").distinct())


@query("win_col_order", f"SELECT lot, wafer, row_number() OVER (ORDER BY lot::INTEGER, wafer::INTEGER)::INTEGER AS place FROM {WAFERS}", "tracking")
def win_col_order(spark, sf):
    return P.column_order(B.tracking(spark, sf).select("lot", "wafer").distinct())


@query("sort_numeric_aware", "SELECT lot, row_number() OVER (ORDER BY lot::INTEGER)::INTEGER AS place FROM (SELECT DISTINCT lot FROM tracking) t", "tracking")
def sort_numeric_aware(spark, sf):
    return P.ranked(B.tracking(spark, sf).select("lot").distinct(), *J.numeric_aware("lot"), name="place")


@query("sort_natural", "SELECT wafer, row_number() OVER (ORDER BY substr(wafer, 2)::INTEGER)::INTEGER AS place FROM (SELECT DISTINCT wafer FROM base) t", "base")
def sort_natural(spark, sf):
    return P.ranked(B.base(spark, sf).select("wafer").distinct(), C.natural_key("wafer"), name="place")


@query("top_k", "SELECT lot, count(*) AS n FROM base GROUP BY lot ORDER BY n DESC, lot LIMIT 5", "base")
def top_k(spark, sf):
    return P.most_frequent(B.base(spark, sf), "lot", 5)


@query("set_item_diff", "SELECT 'data' AS only_in, item FROM (SELECT item FROM long EXCEPT SELECT item FROM rules) a UNION ALL SELECT 'rules', item FROM (SELECT item FROM rules EXCEPT SELECT item FROM long WHERE item <> 'QTY') b", "long", "rules")
def set_item_diff(spark, sf):
    data, rules = B.long(spark, sf).select("item"), B.rules(spark).select("item")
    return J.item_diff(data, rules).where("only_in = 'data'").unionByName(J.item_diff(data.where("item <> 'QTY'"), rules).where("only_in = 'rules'"))


def _key_values(spark, sf):
    """key, item, value of the points, stored for several passes."""
    return T.stored(B.points_long(spark, sf).select("key", "item", "value"))


def _excluded_of(spark, sf, p):
    return _excluded(spark, sf, p.where("item = 'QTY'").select("key", F.col("value").alias("QTY")))


def _two_logs(spark, sf, p):
    flags = S.tukey_flag(p, S.tukey_bounds(p, 0.4), ITEMS)
    return J.exclude(_excluded_of(spark, sf, p), flags, "tukey", F.lit("2026-03-01").cast("date"), "filter", F.col("item"))


@query("set_union_excl", f"SELECT key FROM excluded UNION SELECT key FROM ({TUKEY}) t", "excluded", "bounds")
def set_union_excl(spark, sf):
    return _two_logs(spark, sf, _key_values(spark, sf)).select("key").dropDuplicates(["key"])


@query("excl_add", f"SELECT key, 'manual' AS kind, reason, \"at\" FROM excluded UNION ALL SELECT key, 'filter', 'tukey', DATE '2026-03-01' FROM ({TUKEY}) t", "excluded", "bounds")
def excl_add(spark, sf):
    return _two_logs(spark, sf, _key_values(spark, sf)).select("key", "kind", "reason", "at")


@query("excl_remove", "SELECT key, reason FROM excluded WHERE reason <> 'low'", "excluded")
def excl_remove(spark, sf):
    p = _key_values(spark, sf)
    log = J.include(_two_logs(spark, sf, p), kind="filter")
    return J.include(log, _excluded_of(spark, sf, p).where("reason = 'low'")).select("key", "reason")


@query("set_union_files", "SELECT item_id, count(*) AS n FROM (SELECT item AS item_id FROM long) t GROUP BY item_id", "long")
def set_union_files(spark, sf):
    a, b = T.scratch(spark, "a"), T.scratch(spark, "b")
    long = T.as_long(B.long(spark, sf))
    T.write_chunk(long.where("item_id = 'QTY'"), a)
    T.write_chunk(long.where("item_id <> 'QTY'"), b)
    return SC.read_long(spark, a, b).groupBy("item_id").agg(F.count("*").alias("n"))


# Report tables.

TEMPLATE = "('QTY', 'Basic'), ('DISC', 'Other'), ('NONE', 'Other')"
SUMMARY = "SELECT item, cat1, lot, wafer, avg{0} AS avg, lsl, target, usl{1} FROM wafer JOIN (SELECT * FROM (VALUES ('QTY', 'Basic'), ('DISC', 'Other')) AS t(item, cat1)) t USING (item) JOIN specs USING (item){2}"


def _template(spark):
    return _values(spark, TEMPLATE, "item, cat1")


def _wafer_means(spark, sf):
    return S.wafer_stats(B.points_long(spark, sf), {"avg": mean()})


@query("tbl_summary", SUMMARY.format("", ", avg < lsl OR avg > usl AS offspec", ""), "wafer", "specs")
def tbl_summary(spark, sf):
    return P.summary(_template(spark), _wafer_means(spark, sf), B.specs(spark)).drop("width")


@query("tbl_group_wafer", SUMMARY.format(" - ref", ", false AS offspec, CASE cast(lot AS int) % 3 WHEN 0 THEN 'g0' ELSE 'g1' END AS gid", " JOIN refs USING (item) WHERE cast(lot AS int) % 3 < 2"), "wafer", "specs", "refs")
def tbl_group_wafer(spark, sf):
    stats = S.wafer_stats(J.visible_groups(B.points_long(spark, sf)), {"avg": mean()}, ("gid", "lot", "wafer", "item"))
    return P.summary(_template(spark), stats, B.specs(spark), ref=_refs(spark, sf)).drop("width")


@query("tbl_group", "SELECT item, cat1, gid, value, wafers, lsl, target, usl, value < lsl OR value > usl AS offspec FROM reps JOIN (SELECT * FROM (VALUES ('QTY', 'Basic'), ('DISC', 'Other')) AS t(item, cat1)) t USING (item) JOIN specs USING (item)", "reps", "specs")
def tbl_group(spark, sf):
    return P.group_table(_template(spark), _reps(spark, sf), B.specs(spark)).drop("width")


@query("tbl_spec_cols", "SELECT DISTINCT item, lsl, target, usl FROM long JOIN specs USING (item)", "long", "specs")
def tbl_spec_cols(spark, sf):
    return P.spec_columns(B.long(spark, sf), B.specs(spark))


PLOTS = """(1, 1, 0, 0, '1', 'R', 'Scatter', 'QTY,DISC', 'PRICE'), (2, 1, 0, 0, '2', 'R', 'box', 'lot', 'QTY'), (3, 1, 1, 0, 'x', 'R', 'bar', 'lot', 'QTY'), (4, 1, 2, 0, '3', 'R', 'pie', 'lot', 'QTY'),
  (5, 2, 0, 0, '1', 'R', 'xy', 'QTY', 'NOPE'), (6, 2, 1, 0, '1', 'R', 'scatter', 'QTY,DISC,QTY', 'PRICE,DISC'), (7, 2, 2, 0, '1', 'R', 'trend', 'Z', 'QTY'), (8, 2, 3, 0, '1', 'R', 'bar', ' ', 'QTY'), (9, 2, 4, 0, '1', 'R', 'trend', 'w', 'QTY')"""
PLOT_COLUMNS = 'id, page, x, y, "order", Report, Type, x_name, y_name'


def _plots(spark):
    return _values(spark, PLOTS, PLOT_COLUMNS.replace('"', "`"))


CHECKED = """WITH k AS (SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN 'scatter' WHEN 1 THEN 'scatter' WHEN 2 THEN 'box' WHEN 4 THEN 'trend' END AS kind, s_suppkey % 5 AS t, s_suppkey % 11 AS o, s_suppkey % 4 AS n FROM supplier),
  named AS (SELECT *, CASE WHEN t < 2 THEN n WHEN t = 2 THEN NULL ELSE NULL END AS m FROM k)
SELECT id, kind, CASE WHEN kind IS NULL THEN 'type' WHEN o = 0 THEN 'order' WHEN t < 2 AND n = 1 THEN 'unknown NOPE' WHEN t < 2 AND n = 2 THEN 'counts' WHEN t = 4 AND n <> 3 THEN 'axis' WHEN t = 2 AND n = 3 THEN 'category' END AS problem,
  count(*) OVER (PARTITION BY id % 3, id % 6, id % 2) > 1 AS twice FROM named"""


@query("tpl_validate", CHECKED)
def tpl_validate(spark, sf):
    """A template with a plot for each supplier."""
    k = F.col("s_suppkey")
    pick = lambda by, *of: F.element_at(F.array(*map(F.lit, of)), (k % by + 1).cast("int"))
    x = F.when(k % 5 < 2, pick(4, "QTY,DISC", "QTY", "QTY,DISC,QTY", "QTY")).when(k % 5 == 4, pick(4, "Z", "lot", "x", "w")).otherwise(pick(4, "lot", "step", "gid", " "))
    y = F.when(k % 5 < 2, pick(4, "PRICE", "NOPE", "PRICE,DISC", "DISC")).otherwise("QTY")
    plots = B.read(spark, sf, "supplier").select(
        k.alias("id"), (k % 3).alias("page"), (k % 6).alias("x"), (k % 2).alias("y"), F.when(k % 11 == 0, "x").otherwise((k % 11).cast("string")).alias("order"), F.lit("R").alias("Report"),
        pick(5, "Scatter", " xy", "BoxPlot", "pie", "Trend").alias("Type"), x.alias("x_name"), y.alias("y_name"))
    return P.validate_plots(plots, B.long(spark, sf).select("item").distinct()).select("id", "kind", "problem", "twice")


@query("tpl_pairs", """SELECT x, y, count(*) AS n FROM (SELECT unnest(CASE p_size % 3 WHEN 0 THEN ['QTY', 'DISC'] WHEN 1 THEN [p_brand] ELSE ['QTY', 'QTY'] END) AS x,
  unnest(CASE p_size % 3 WHEN 0 THEN ['PRICE', 'PRICE'] WHEN 1 THEN ['PRICE'] ELSE ['DISC', p_brand] END) AS y FROM part) p GROUP BY x, y""")
def tpl_pairs(spark, sf):
    """Plot rows of each part: two against one, one against one, one against two."""
    size = F.col("p_size") % 3
    x = F.when(size == 0, "QTY, DISC").when(size == 1, F.col("p_brand")).otherwise("QTY")
    y = F.when(size < 2, "PRICE").otherwise(F.concat(F.lit("DISC ,"), "p_brand"))
    p = read(spark, sf, "part").select(F.explode(P.pairs(x, y)).alias("p"))
    return p.groupBy("p.x", "p.y").agg(F.count("*").alias("n"))


@query("tpl_needed_items", "SELECT DISTINCT item FROM long", "long")
def tpl_needed_items(spark, sf):
    need = P.needed_items(_plots(spark).where("Type IN ('Scatter', 'xy')"), _template(spark))
    return B.long(spark, sf).join(need, "item", "left_semi").select("item").distinct()


@query("tbl_tsv", "SELECT lot, wafer, item, round(avg, 3) AS avg FROM wafer", "wafer")
def tbl_tsv(spark, sf):
    path = T.scratch(spark, "tsv")
    T.export(_wafer_means(spark, sf).select("lot", "wafer", "item", F.round("avg", 3).alias("avg")), path, "csv", "\t")
    return spark.read.schema("lot string, wafer string, item string, avg double").option("header", True).option("sep", "\t").csv(path)


# Groups.


@query("grp_auto_wafer", f"SELECT lot, wafer, 'g' || (row_number() OVER (ORDER BY lot::INTEGER, wafer::INTEGER) - 1) AS gid, lot || '-' || wafer AS name, row_number() OVER (ORDER BY lot::INTEGER, wafer::INTEGER) = 1 AS is_ref FROM {WAFERS}", "tracking")
def grp_auto_wafer(spark, sf):
    return P.auto_groups(B.tracking(spark, sf).select("lot", "wafer").distinct(), ["lot", "wafer"])


@query("grp_auto_lot", f"SELECT lot, wafer, 'g' || (dense_rank() OVER (ORDER BY lot::INTEGER) - 1) AS gid, lot AS name, dense_rank() OVER (ORDER BY lot::INTEGER) = 1 AS is_ref FROM {WAFERS}", "tracking")
def grp_auto_lot(spark, sf):
    return P.auto_groups(B.tracking(spark, sf).select("lot", "wafer").distinct(), ["lot"])


@query("grp_auto_part", "SELECT lot, wafer, 'g' || (dense_rank() OVER (ORDER BY part::INTEGER) - 1) AS gid, part AS name FROM (SELECT lot, wafer, substr(min(reticle), 1, 7) AS part FROM tracking GROUP BY lot, wafer) p", "tracking")
def grp_auto_part(spark, sf):
    t = B.tracking(spark, sf).withColumnRenamed("reticle", "part")
    parts = J.part_lookup(t.where("false"), t).withColumn("part", C.part_prefix("part")).where("part IS NOT NULL")
    return P.auto_groups(parts, ["part"]).select("lot", "wafer", "gid", "name")


@query("grp_auto_factor", "SELECT i.lot, i.wafer, l.M1 || '/' || l.M2 AS name FROM (SELECT DISTINCT lot, cast(cast(substr(wafer, 2) AS integer) AS varchar) AS wafer FROM base) i JOIN loaded l USING (lot, wafer)", "base", "loaded")
def grp_auto_factor(spark, sf):
    index = B.base(spark, sf).select("lot", C.norm_wafer("wafer").alias("wafer")).distinct()
    split = _loaded(spark, sf)
    combos = O.split_combos(split, ["M1", "M2"], {"M1": "O", "M2": "O"})
    return index.join(split, ["lot", "wafer"]).join(combos, ["M1", "M2"]).select("lot", "wafer", F.concat_ws("/", "M1", "M2").alias("name"))


@query("grp_table", "SELECT lot, wafer, 'A' AS gid FROM (SELECT DISTINCT lot, wafer FROM base) b WHERE lot = '1' UNION ALL SELECT lot, wafer, 'B' FROM (SELECT DISTINCT lot, wafer FROM base) b WHERE lot = '2' AND wafer = 'W03' UNION ALL SELECT '3', '1', 'bad group' UNION ALL SELECT '4', '99', 'bad wafer'", "base")
def grp_table(spark, sf):
    table = _values(spark, "('1', '', 'A'), (' 2', '#3', 'B'), ('3', '1', 'Z'), ('4', '99', 'A')", "lot, wafer, group")
    good, bad = P.table_groups(table, B.base(spark, sf).select("lot", "wafer").distinct(), ["A", "B"])
    return good.unionByName(bad.select("lot", "wafer", F.concat(F.lit("bad "), "problem").alias("gid")))


@query("split_text", "SELECT lot, wafer, M1, M2 FROM split", "split")
def split_text(spark, sf):
    path = T.scratch(spark, "split")
    T.export(_split(spark, sf), path, "csv", "\t")
    return T.read_sheet(spark, path, "\t").select(F.col("lot").cast("int").cast("string").alias("lot"), F.col("wafer").cast("int").cast("string").alias("wafer"), "M1", "M2")


@query("met_pairs", "SELECT step, item, count(*) AS n FROM metrology WHERE (step = 'A' AND item = 'PROMO') OR (step = 'N' AND item = 'SMALL') GROUP BY step, item", "metrology")
def met_pairs(spark, sf):
    pairs = O.wanted_pairs(spark, "step_id\titem_id\r\nA\tPROMO\tx\n; N ;SMALL\nalone\n\n")
    return O.of_pairs(B.metrology(spark, sf), pairs).groupBy("step", "item").agg(F.count("*").alias("n"))


# Incremental loads.


@query("inc_load_log", "SELECT year(ts) AS year, count(*) AS rows FROM long GROUP BY 1", "long")
def inc_load_log(spark, sf):
    """The load log of a store that took in a folder of files by year."""
    folder = T.scratch(spark, "in")
    T.write_chunk(B.long(spark, sf).withColumn("year", F.year("ts")), folder, "year")
    into = L.Store(spark, T.scratch(spark, "store"), mean(), buckets=8)
    files = spark.read.parquet(folder)
    into.load(files.drop("year"), "all", L.load_log(files))
    year = F.regexp_extract("file", r"/year=(\d+)/", 1).cast("long").alias("year")
    return into.log().groupBy(year).agg(F.sum("rows").alias("rows"))


RECENT = f"""WITH w AS (SELECT *, cast(ts AS date) AS day FROM rounded WHERE ts >= DATE '1996-12-28' AND ts < DATE '1997-01-02'),
  p AS (SELECT *, min(day) OVER (PARTITION BY {B.KEYS}) AS first FROM (SELECT DISTINCT {B.KEYS}, day FROM w) d)
SELECT day, rows_in, points_new, points_updated FROM (SELECT day, count(*) AS rows_in FROM w GROUP BY day) r
  JOIN (SELECT day, count(*) FILTER (day = first) AS points_new, count(*) FILTER (day > first) AS points_updated FROM p GROUP BY day) q USING (day)"""


@query("inc_recent_days", f"SELECT * FROM ({RECENT}) t", "rounded")
def inc_recent_days(spark, sf):
    """What the job of the last five days counted for each, from a source laid out by month into a store."""
    path = T.scratch(spark, "months")
    T.lay_out(B.long(spark, sf), path, unit="month")
    rules = lambda df: df.withColumn("temp", C.temp_round5("temp"))
    done = run_days(spark.read.parquet(path), L.Store(spark, T.scratch(spark, "store"), mean(), buckets=8), "L1", 5, dt.date(1997, 1, 1), rules)
    if done.code:
        raise RuntimeError(done.summary())
    rows = [(day, c["rows_in"], c["points_new"], c["points_updated"]) for day, c in done.loaded.items()]
    return spark.createDataFrame(rows, "day date, rows_in long, points_new long, points_updated long")


@query("inc_stream", f"SELECT {B.KEYS}, item, value, ts FROM merged JOIN (SELECT {B.KEYS}, max(ts) AS ts FROM rounded GROUP BY {B.KEYS}) k USING ({B.KEYS})", "merged")
def inc_stream(spark, sf):
    folder = T.scratch(spark, "in")
    long = T.as_long(B.long(spark, sf))
    T.write_chunk(long.where("cast(root_lot_id AS int) % 2 = 0"), folder)
    back = {v: k for k, v in {"line": "line_id", "lot": "root_lot_id", "wafer": "wafer_id", "x": "chip_x_pos", "y": "chip_y_pos", "temp": "temperature", "step": "step_id", "seq": "step_seq", "site": "total_site_cnt", "ts": "tkout_time", "item": "item_id", "value": "et_value"}.items()}
    shape = lambda df: df.withColumnsRenamed(back).drop("part_id").withColumn("temp", C.temp_round5("temp"))
    into = L.Store(spark, T.scratch(spark, "store"), mean(), buckets=8)
    L.stream_into(folder, SC.LONG, into, shape, files=100)
    long.where("cast(root_lot_id AS int) % 2 = 1").write.mode("append").parquet(folder)  # a later delivery
    L.stream_into(folder, SC.LONG, into, shape, files=100)  # goes on where the first one stopped
    return into.table().select(*SC.KEY7, "ts", "item", "value")


@query("inc_run", f"""SELECT (SELECT count(*) FROM long WHERE line = 'L1' AND ts >= DATE '1996-01-01' AND ts < DATE '1998-01-01') AS rows_in,
  count(*) FILTER (ts >= DATE '1996-01-01' AND ts < DATE '1998-01-01' AND first >= DATE '1996-01-01') AS points_new, count(*) FILTER (ts >= DATE '1996-01-01' AND first < DATE '1996-01-01') AS points_updated
  FROM (SELECT {B.KEYS}, min(ts) AS first, max(ts) AS ts FROM rounded WHERE ts < DATE '1998-01-01' GROUP BY {B.KEYS}) p""", "rounded")
def inc_run(spark, sf):
    """Counts of the second of two composed runs (extraction, rules, load) into one store."""
    into = L.Store(spark, T.scratch(spark, "store"), mean(), buckets=8)
    rules = lambda df: df.withColumn("temp", C.temp_round5("temp"))
    L.run(B.long(spark, sf), into, "1", "L1", "1990-01-01", "1995-12-31", rules)
    counts = L.run(B.long(spark, sf), into, "2", "L1", "1996-01-01", "1997-12-31", rules)
    names = ("rows_in", "points_new", "points_updated")
    return spark.createDataFrame([tuple(counts[c] for c in names)], ", ".join(f"{c} long" for c in names))
