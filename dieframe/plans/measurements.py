"""Queries over sources, normalisation, conditions, rules, formulas, merging and loading."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.formula import compile_formula
from ..functions.predicates import all_of, condition
from ..operators import merge as M
from ..operators import rules as R
from ..sources import schema as S
from ..sources import tables as T
from ..streaming import load as L
from . import base as B
from .base import KEYS, query, read

# Sources and sinks.


@query("src_long", "SELECT lot, item, count(*) AS n, max(value) AS top FROM long GROUP BY lot, item", "long")
def src_long(spark, sf):
    raw = T.as_long(B.long(spark, sf))
    path = T.scratch(spark, "long")
    T.write_chunk(raw, path)
    return S.read_long(spark, path).groupBy(F.col("root_lot_id").alias("lot"), F.col("item_id").alias("item")).agg(F.count("*").alias("n"), F.max("value").alias("top"))


@query("src_extract", "SELECT lot, wafer, item, ts, value FROM long WHERE line = 'L1' AND ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1997-01-01' AND item IN ('QTY', 'PRICE') AND temp >= 22 AND step <> 'R'", "long")
def src_extract(spark, sf):
    where = all_of([("temp", ">=22", "number")], [("step", "!R", "text"), ("wafer", "", "text")])
    return T.extract(B.long(spark, sf), line="L1", first="1996-01-01", last="1996-12-31", items=["QTY", "PRICE"], where=where).select("lot", "wafer", "item", "ts", "value")


@query("src_date_window", "SELECT step, count(*) AS n FROM base WHERE ts >= TIMESTAMP '1995-03-01' AND ts < TIMESTAMP '1995-04-01' GROUP BY step", "base")
def src_date_window(spark, sf):
    """Laid out by month: the window reads its own folder."""
    path = T.scratch(spark, "months")
    T.lay_out(B.base(spark, sf), path, unit="month")
    return T.date_window(spark.read.parquet(path), "ts", "1995-03-01", "1995-03-31").groupBy("step").agg(F.count("*").alias("n"))


@query("src_item_filter", "SELECT item, count(*) AS n FROM long WHERE item IN (SELECT item FROM rules) GROUP BY item", "long", "rules")
def src_item_filter(spark, sf):
    return T.item_filter(B.long(spark, sf), B.rules(spark)).groupBy("item").agg(F.count("*").alias("n"))


@query("probe_days", "SELECT DISTINCT cast(ts AS date) AS day FROM base WHERE step = 'A'", "base")
def probe_days(spark, sf):
    """Of an extraction laid out by day: from its folders, without opening a file."""
    path = T.scratch(spark, "days")
    T.lay_out(B.base(spark, sf).where("step = 'A'"), path)
    return T.laid_days(spark, path).select("day")


@query("probe_items", "SELECT DISTINCT event_type AS item FROM events")
def probe_items(spark, sf):
    return T.probe_items(read(spark, sf, "events"), "event_type", 5000).withColumnRenamed("event_type", "item")


B.PARTS["tracked"] = (("tracking",), "SELECT *, ppid AS process, reticle AS part FROM tracking")


@query("src_tracking", """SELECT lot, wafer, step, ppid, ts FROM tracked WHERE line = 'L1' AND ecn IS NOT NULL AND lot IN ('3', '7')
  AND process IN ('O', 'F') AND part IN ('1995', '1996') AND ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '1997-01-01'""", "tracked")
def src_tracking(spark, sf):
    tracked = B.tracking(spark, sf).withColumns({"process": F.col("ppid"), "part": F.col("reticle")})
    out = T.tracking_source(tracked, "L1", lots=["3", "7"], first="1995-01-01", last="1996-12-31", processes=["O", "F"], parts=["1995", "1996"])
    return out.select("lot", "wafer", "step", "ppid", "ts")


@query("src_metrology", "SELECT lot, wafer, step, item, fab_value FROM metrology WHERE lot IN ('3', '7') AND regexp_matches(item, '^S|MO')", "metrology")
def src_metrology(spark, sf):
    return T.metrology_source(B.metrology(spark, sf), lots=["3", "7"], item_pattern="^S|MO").select("lot", "wafer", "step", "item", "fab_value")


@query("src_profile", "SELECT 'wide' AS layout, 'lot' AS lot, 'ts' AS time, 'QTY,PRICE,DISC' AS items, count(*) AS n FROM base", "base")
def src_profile(spark, sf):
    df = B.base(spark, sf)
    p = S.Profile(df)
    return df.agg(F.lit(p.layout).alias("layout"), F.lit(p.roles["lot"]).alias("lot"), F.lit(p.roles["time"]).alias("time"), F.lit(",".join(p.items)).alias("items"), F.count("*").alias("n"))


LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lot, wafer, x, y, temp, step, site, seq ORDER BY ts DESC NULLS LAST, QTY DESC, PRICE DESC, DISC DESC) AS rn FROM base {}) t WHERE rn = 1"


@query("src_select_wide", f"SELECT lot, wafer, step, round(temp / 5) * 5 AS temp, site, QTY, PRICE FROM ({LATEST.format('WHERE lot IN (' + chr(39) + '3' + chr(39) + ')')}) u", "base")
def src_select_wide(spark, sf):
    return S.select_wide(B.base(spark, sf), ["QTY", "PRICE", "DISC"], ["3"]).select("lot", "wafer", "step", "temp", "site", "QTY", "PRICE")


@query("src_select_long", "SELECT lot, wafer, step, round(temp / 5) * 5 AS temp, site, max(value) FILTER (item = 'QTY') AS QTY, max(value) FILTER (item = 'DISC') AS DISC FROM long WHERE lot = '5' GROUP BY lot, wafer, x, y, step, temp, site, seq", "long")
def src_select_long(spark, sf):
    return S.select_long(B.long(spark, sf), ["QTY", "DISC"], ["5"]).select("lot", "wafer", "step", "temp", "site", "QTY", "DISC")


@query("src_rules_csv", "SELECT p_partkey AS partkey, lpad(cast(p_size AS varchar), 4, '0') AS code, p_retailprice AS price, CASE WHEN p_size % 2 = 0 THEN p_brand END AS brand FROM part")
def src_rules_csv(spark, sf):
    path = T.scratch(spark, "csv")
    read(spark, sf, "part").selectExpr("p_partkey AS ` partkey `", "lpad(cast(p_size AS string), 4, '0') AS code", "p_retailprice AS price", "CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '  ' END AS brand").write.option("header", True).csv(path)
    return T.read_sheet(spark, path).select(F.col("partkey").cast("bigint").alias("partkey"), "code", "price", "brand")


@query("list_items", "SELECT DISTINCT item FROM long", "long")
def list_items(spark, sf):
    return T.list_items(B.long(spark, sf))


@query("sink_chunk", "SELECT count(*) AS n, count(DISTINCT lot) AS lots FROM long", "long")
def sink_chunk(spark, sf):
    path = T.scratch(spark, "chunk")
    T.write_chunk(B.long(spark, sf).withColumn("year", F.year("ts")), path, "year")
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.countDistinct("lot").alias("lots"))


@query("sink_materialize", "SELECT lot, count(*) AS n FROM long WHERE lot IN ('1', '2') AND item = 'QTY' GROUP BY lot", "long")
def sink_materialize(spark, sf):
    return T.materialize(B.long(spark, sf), ["1", "2"], ["QTY"]).groupBy("lot").agg(F.count("*").alias("n"))


@query("sink_export", "SELECT lot, QTY, DISC FROM base WHERE step = 'A'", "base")
def sink_export(spark, sf):
    path = T.scratch(spark, "export")
    T.export(B.base(spark, sf).where("step = 'A'").select("lot", "QTY", "DISC"), path, "csv")
    return spark.read.schema("lot string, QTY double, DISC double").option("header", True).csv(path)


@query("sql_adhoc", "SELECT lot, wafer, count(*) AS n, max(QTY) AS top FROM base GROUP BY lot, wafer ORDER BY n DESC, lot, wafer LIMIT 200", "base")
def sql_adhoc(spark, sf):
    return T.preview(B.base(spark, sf), "SELECT lot, wafer, count(*) AS n, max(QTY) AS top FROM et_data GROUP BY lot, wafer ORDER BY n DESC, lot, wafer", 200)


@query("sink_report_merge", "SELECT item, lsl, 'R1' AS report FROM specs UNION ALL SELECT p_brand, NULL, 'R2' FROM (SELECT DISTINCT p_brand FROM part) p", "specs")
def sink_report_merge(spark, sf):
    brands = read(spark, sf, "part").select(F.col("p_brand").alias("item"), F.lit("R2").alias("report")).distinct()
    old = brands.unionByName(brands.limit(3).withColumn("report", F.lit("R1")))
    return T.replace_report(old, B.specs(spark).select("item", "lsl"), "R1").select("item", "lsl", "report")


# Schema normalisation.


def _messy(spark, sf):
    return B.base(spark, sf).select(
        F.col("lot").alias(" ROOT_LOT_ID"), F.col("wafer").alias("Wafer_Id"), F.when(F.col("x") == 2, "bad").otherwise(F.concat(F.lit(" "), F.col("x").cast("string"))).alias("chip_x_pos"), F.col("temp").cast("string").alias("temperature"),
        F.when(F.col("seq") == "O", "1.0").when(F.col("y") == 0, " ").otherwise(F.col("seq")).alias("step_seq"), F.when(F.col("x") == 1, "never").otherwise(F.col("ts").cast("string")).alias("TKOUT_TIME"), F.col("QTY").cast("decimal(10,2)").alias("et_value"), F.lit(None).cast("double").alias("total_site_cnt"),
    )


@query("norm_columns", "SELECT lot AS root_lot_id, wafer AS wafer_id, count(*) AS n FROM base GROUP BY lot, wafer", "base")
def norm_columns(spark, sf):
    return S.norm_columns(_messy(spark, sf)).groupBy("root_lot_id", "wafer_id").agg(F.count("*").alias("n"))


@query("norm_numeric", "SELECT CASE WHEN x <> 2 THEN x END AS chip_x_pos, max(QTY) AS top, count(*) AS n FROM base GROUP BY 1", "base")
def norm_numeric(spark, sf):
    return S.norm_numeric(S.norm_columns(_messy(spark, sf))).groupBy("chip_x_pos").agg(F.max("et_value").alias("top"), F.count("*").alias("n"))


@query("norm_seq_text", "SELECT CASE WHEN seq = 'O' THEN '1' WHEN y = 0 THEN NULL ELSE seq END AS step_seq, count(*) AS n FROM base GROUP BY 1", "base")
def norm_seq_text(spark, sf):
    return S.norm_seq(S.norm_columns(_messy(spark, sf))).groupBy("step_seq").agg(F.count("*").alias("n"))


@query("norm_time", "SELECT CASE WHEN x <> 1 THEN ts END AS tkout_time, count(*) AS n FROM base GROUP BY 1", "base")
def norm_time(spark, sf):
    return S.norm_time(S.norm_columns(_messy(spark, sf))).groupBy("tkout_time").agg(F.count("*").alias("n"))


@query("norm_fill_missing", "SELECT count(*) AS n, 13 AS columns, 0 AS items FROM base", "base")
def norm_fill_missing(spark, sf):
    df = S.fill_missing(S.norm_columns(_messy(spark, sf)))
    return df.agg(F.count("*").alias("n"), F.lit(len(df.columns)).alias("columns"), F.count("item_id").cast("int").alias("items"))


@query("norm_all", "SELECT lot AS root_lot_id, round(temp / 5) * 5 AS temperature, CASE WHEN seq = 'O' THEN '1' WHEN y = 0 THEN NULL ELSE seq END AS step_seq, count(*) AS n, max(QTY) AS top FROM base GROUP BY 1, 2, 3", "base")
def norm_all(spark, sf):
    return S.normalize(_messy(spark, sf)).groupBy("root_lot_id", "temperature", "step_seq").agg(F.count("*").alias("n"), F.max("et_value").alias("top"))


EMPTIED = """SELECT name AS "column", reason FROM (VALUES ('total_site_cnt', 'absent'), ('step_seq', 'lost'), ('temperature', 'lost')) AS v(name, reason), (SELECT count(*) AS n FROM base WHERE y = 0 AND seq <> 'O') t WHERE n > 0
  UNION ALL SELECT 'tkout_time', 'lost' FROM base WHERE y = 0 AND seq <> 'O' HAVING count(*) > 0 AND count(*) FILTER (x <> 1) = 0"""


@query("check_emptied_keys", EMPTIED, "base")
def check_emptied_keys(spark, sf):
    """Rows whose temperatures are all unreadable text and whose sequences are all blank."""
    rows = _messy(spark, sf).where(" trim(step_seq) = ''").withColumn("temperature", F.concat("temperature", F.lit(" C")))
    raw = S.norm_columns(rows)
    return S.emptied_keys(raw, S.normalize(raw))


@query("temp_round5", "SELECT l_tax AS tax, round((20 + l_tax * 100 - 2.5) / 5) * 5 AS t, round(-(20 + l_tax * 100 + 2.5) / 5) * 5 AS u, count(*) AS n FROM lineitem GROUP BY l_tax")
def temp_round5(spark, sf):
    t = B.read(spark, sf, "lineitem").groupBy(F.col("l_tax").alias("tax")).agg(F.count("*").alias("n"))
    return t.select("tax", C.temp_round5(20 + F.col("tax") * 100 - 2.5).alias("t"), C.temp_round5(-(20 + F.col("tax") * 100 + 2.5)).alias("u"), "n")


@query("read_text_numeric", "SELECT user_id, count(*) FILTER (event_id % 2 = 0) AS n, max(value) FILTER (event_id % 2 = 0) AS top FROM events GROUP BY user_id")
def read_text_numeric(spark, sf):
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" "), F.col("value").cast("string"))).otherwise(F.concat(F.col("value").cast("string"), F.lit("C")))
    return read(spark, sf, "events").withColumn("v", C.number(text)).groupBy("user_id").agg(F.count("v").alias("n"), F.max("v").alias("top"))


# Conditions: (id, column, text, kind, mode, SQL).
for _id, _col, _text, _kind, _mode, _sql in [
    ("pred_in", "step", 'A "R"', "text", "in", "step IN ('A', 'R')"),
    ("pred_not_in_null", "ppid", "!F !P", "text", "in", "ppid NOT IN ('F', 'P') OR ppid IS NULL"),
    ("pred_glob", "wafer", "W0* W12", "text", "in", "wafer IN ('W12') OR wafer LIKE 'W0%'"),
    ("pred_like", "lot", "1_ %5", "text", "like", "lot LIKE '1_' OR lot LIKE '%5'"),
    ("pred_regexp", "lot", "^1 9$", "text", "regexp", "regexp_matches(lot, '^1|9$')"),
    ("pred_cmp", "QTY", ">=25 <40", "number", "in", "QTY >= 25 AND QTY < 40"),
    ("pred_between", "QTY", "10~12", "number", "in", "QTY BETWEEN 10 AND 12"),
    ("pred_num_eq_in", "QTY", "25 30 41", "number", "in", "QTY IN (25, 30, 41)"),
    ("pred_num_ne", "x", "!0", "number", "in", "x <> 0 OR x IS NULL"),
    ("pred_time_range", "ts", "1995-01-01 ~ 1996-01-01", "time", "in", "ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '1996-01-01'"),
]:
    _view = "tracking" if _col == "ppid" else "base"

    def _run(spark, sf, view=_view, args=(_col, _text, _kind, _mode)):
        return getattr(B, view)(spark, sf).where(condition(*args)).groupBy("lot", "step").agg(F.count("*").alias("n"))

    query(_id, f"SELECT lot, step, count(*) AS n FROM {_view} WHERE {_sql} GROUP BY lot, step", _view)(_run)


@query("pred_and", "SELECT lot, count(*) AS n FROM base WHERE step IN ('A', 'N') AND QTY >= 10 AND (seq NOT IN ('F') OR seq IS NULL) GROUP BY lot", "base")
def pred_and(spark, sf):
    return B.base(spark, sf).where(all_of([("step", "A N", "text"), ("QTY", ">=10", "number")], [("seq", "!F", "text"), ("wafer", " ", "text")])).groupBy("lot").agg(F.count("*").alias("n"))


@query("filt_lots", "SELECT lot, count(*) AS n FROM base WHERE lot IN ('2', '4') GROUP BY lot", "base")
def filt_lots(spark, sf):
    return S.in_lots(B.base(spark, sf), ["2", "4", "2"]).groupBy("lot").agg(F.count("*").alias("n"))


# Formulas over the merged wide view.
for _id, _formula, _sql in [
    ("fn_arith", "-{QTY} + {PRICE} * 2 - +{DISC}", "-QTY + PRICE * 2 - DISC"),
    ("fn_div", "{PRICE} / ({DISC} - 0.05)", "CASE WHEN DISC - 0.05 <> 0 THEN PRICE / (DISC - 0.05) END"),
    ("fn_pow", "({DISC} - 0.05) ** 0.5 + {QTY} ^ 2", "CASE WHEN DISC - 0.05 >= 0 THEN pow(DISC - 0.05, 0.5) + pow(QTY, 2) END"),
    ("fn_abs", "Abs({DISC} - 0.05)", "abs(DISC - 0.05)"),
    ("fn_sqrt", "Sqrt({QTY} - 25)", "CASE WHEN QTY - 25 >= 0 THEN sqrt(QTY - 25) END"),
    ("fn_ln", "Ln({DISC})", "CASE WHEN DISC > 0 THEN ln(DISC) END"),
    ("fn_log", "Log({PRICE})", "CASE WHEN PRICE > 0 THEN log10(PRICE) END"),
    ("fn_log10", "LOG10({DISC})", "CASE WHEN DISC > 0 THEN log10(DISC) END"),
    ("fn_exp", "Exp({QTY} / 10) + 0 * Exp({DISC})", "exp(QTY / 10) + 0 * exp(DISC)"),
    ("fn_min", "Min({QTY}, {PRICE} / 1000, {DISC} * 500)", "least(QTY, PRICE / 1000, DISC * 500)"),
    ("fn_max", "Max({QTY}, {PRICE} / 1000) + Max({DISC})", "greatest(QTY, PRICE / 1000) + DISC"),
    ("fn_avg", "Avg({QTY}, {DISC})", "(QTY + DISC) / 2"),
    ("fn_sum", "Sum({QTY}, {DISC}, {MISSING})", "QTY + DISC"),
    ("fn_std_row", "Stdev({QTY}, {DISC})", "abs(QTY - DISC) / sqrt(2)"),
    ("addp_formula", "({QTY} * 2 - {DISC}) / ({PRICE} + 1e-9) + Abs(Min({QTY}, 30) - Max({DISC}, 0.02))", "(QTY * 2 - DISC) / (PRICE + 1e-9) + abs(least(QTY, 30) - greatest(DISC, 0.02))"),
    ("addp_missing_ref", "Sum({QTY}, {NOPE}) + Avg({NOPE2}, {DISC})", "QTY + DISC"),
]:

    def _run(spark, sf, formula=_formula):
        items = {c: c for c in ("QTY", "PRICE", "DISC")}
        return B.wide(spark, sf).select("lot", "wafer", "x", F.round(compile_formula(formula, items), 6).alias("value"))

    query(_id, f"SELECT lot, wafer, x, round({_sql}, 6) AS value FROM wide", "wide")(_run)


# Rules.


@query("rule_flag", "SELECT l_returnflag AS cell, CASE l_returnflag WHEN 'N' THEN false END AS flag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def rule_flag(spark, sf):
    return read(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("cell")).agg(F.count("*").alias("n")).withColumn("flag", C.rule_flag("cell"))


SHEET = [
    {"category": "REAL", "alias": "QTY"}, {"category": "REAL", "alias": "PRICE"}, {"category": "REAL", "alias": "DISC"}, {"category": "ADDP", "alias": "R", "formula": "{QTY} - 1"},
    {"category": "ADDP", "alias": "D", "formula": "{R} / 2", "absolute": True}, {"category": "ADDP", "alias": "R", "formula": "{QTY} - {DISC}"}, {"category": "ADDP", "alias": "A", "formula": "{B}"}, {"category": "ADDP", "alias": "B", "formula": "{A}"},
    {"category": "ADDP", "alias": "U", "formula": "{NOWHERE}"}, {"category": "ADDP", "alias": "X", "formula": "__import__('os')"}, {"category": "ADDP", "alias": "Y", "formula": "{X} + 1"},
]


VALIDATE_SQL = """WITH sheet AS (SELECT p_partkey AS k, 'P' || p_partkey AS alias, p_partkey % 3 AS r, p_partkey % 7 = 0 AS wrong FROM part),
  ok AS (SELECT k, alias, 0 AS level FROM sheet WHERE r = 0
    UNION ALL SELECT a.k, a.alias, 1 FROM sheet a JOIN sheet b ON b.k = a.k - 1 WHERE a.r = 1 AND NOT a.wrong
    UNION ALL SELECT a.k, a.alias, 2 FROM sheet a JOIN sheet b ON b.k = a.k - 1 JOIN sheet c ON c.k = a.k - 2 WHERE a.r = 2 AND NOT a.wrong AND NOT b.wrong)
SELECT alias, (row_number() OVER (ORDER BY level, k) - 1)::INTEGER AS place FROM ok"""


@query("rule_validate", VALIDATE_SQL)
def rule_validate(spark, sf):
    """A sheet with a row for each part: every third a real item, the two after it derived from the one before, every seventh broken."""
    k = F.col("p_partkey")
    kind = F.when(k % 3 == 0, "REAL").otherwise("ADDP").alias("category")
    formula = F.when(k % 7 == 0, F.when(k % 2 == 0, "{NOWHERE} + 1").otherwise("__import__('os')")).when(k % 3 > 0, F.concat(F.lit("{P"), (k - 1).cast("string"), F.lit("} * 2"))).alias("formula")
    sheet = read(spark, sf, "part").orderBy(k).select(F.concat(F.lit("P"), k.cast("string")).alias("alias"), kind, formula)
    ready, _ = R.validate([r.asDict() for r in sheet.collect()])  # a rule sheet is read by the driver
    return spark.createDataFrame([(r["alias"], i) for i, r in enumerate(ready)], "alias string, place int")


@query("rule_real", f"SELECT alias AS item, count(*) AS n, max(CASE WHEN absolute THEN abs(value * scale) ELSE value * scale END) AS top FROM long JOIN rules USING (item) GROUP BY alias", "long", "rules")
def rule_real(spark, sf):
    return R.apply_real(B.long(spark, sf), B.rules(spark)).groupBy("item").agg(F.count("*").alias("n"), F.max("value").cast("double").alias("top"))


@query("rule_abs_reapply", "SELECT lot, wafer, abs(QTY - 25) AS QTY FROM wide", "wide")
def rule_abs_reapply(spark, sf):
    return R.reapply_absolute(R.reapply_absolute(B.wide(spark, sf).withColumn("QTY", F.col("QTY") - 25), ["QTY"]), ["QTY"]).select("lot", "wafer", "QTY")


@query("addp_chain", "SELECT lot, wafer, x, QTY - DISC AS R, abs((QTY - DISC) / 2) AS D FROM wide", "wide")
def addp_chain(spark, sf):
    return R.addp_chain(B.wide(spark, sf), SHEET).select("lot", "wafer", "x", "R", "D")


STD_SQL = """SELECT lot, wafer, step, seq, CASE WHEN count(v) > 1 THEN round(stddev_samp(v), 4) END AS s, count(*) / 2 AS n FROM
  (SELECT lot, wafer, step, seq, site, temp, QTY AS v FROM base UNION ALL SELECT lot, wafer, step, seq, site, temp, DISC * 100 FROM base) t GROUP BY lot, wafer, step, seq, site, temp"""


@query("std_group", STD_SQL, "base")
def std_group(spark, sf):
    out = R.std_group(B.base(spark, sf), "Std({QTY}, {DISC} * 100, {QTY})", "s")
    return out.groupBy("lot", "wafer", "step", "seq", "site", "temp").agg(F.round(F.max("s"), 4).alias("s"), F.count("*").cast("double").alias("n")).drop("site", "temp")


POINT = "lot, wafer, x, y, step, site"
CROSS_SQL = f"""SELECT lot, wafer, seq, ts, round(d - q, 6) AS value FROM (SELECT DISTINCT {POINT}, seq, ts FROM (SELECT *, max(ts) OVER (PARTITION BY {POINT}) AS last FROM split_items) t WHERE ts = last) r JOIN
  (SELECT {POINT}, {B.EXACT.replace('value', 'CASE WHEN item = ' + chr(39) + 'DISC' + chr(39) + ' THEN value END')} AS d, {B.EXACT.replace('value', 'CASE WHEN item = ' + chr(39) + 'QTY' + chr(39) + ' THEN value END')} AS q FROM
    (SELECT *, row_number() OVER (PARTITION BY {POINT}, seq, item ORDER BY ts DESC, value DESC) AS rn FROM split_items) s WHERE rn = 1 GROUP BY {POINT}) m USING (lot, wafer, x, y, step, site) WHERE d IS NOT NULL AND q IS NOT NULL"""
B.PARTS["split_items"] = (("long",), "SELECT * FROM long WHERE seq = 'O' AND item = 'QTY' OR seq = 'F' AND item = 'DISC'")


@query("addp_cross_seq", CROSS_SQL, "split_items")
def addp_cross_seq(spark, sf):
    rows = B.long(spark, sf).where("seq = 'O' AND item = 'QTY' OR seq = 'F' AND item = 'DISC'")
    return R.addp_cross_seq(rows, "{DISC} - {QTY}", "G", ["lot", "wafer", "x", "y", "step", "site"]).select("lot", "wafer", "seq", "ts", F.round("value", 6).alias("value"))


@query("set_seq_common", "SELECT seq FROM long WHERE item IN ('QTY', 'DISC') GROUP BY seq HAVING count(DISTINCT item) = 2", "long")
def set_seq_common(spark, sf):
    return R.seq_common(B.long(spark, sf), ["QTY", "DISC"])


@query("unpivot_items", "SELECT item, count(*) AS n, max(value) AS top FROM merged WHERE value IS NOT NULL GROUP BY item", "merged")
def unpivot_items(spark, sf):
    return R.unpivot_items(B.wide(spark, sf), ["QTY", "PRICE", "DISC"]).groupBy("item").agg(F.count("*").alias("n"), F.max("value").alias("top"))


@query("key_hash", "SELECT DISTINCT md5(concat_ws('|', lot, wafer, cast(x AS varchar), cast(y AS varchar), step, cast(site AS varchar), '~')) AS key FROM base", "base")
def key_hash(spark, sf):
    return B.base(spark, sf).select(C.key_hash("lot", "wafer", "x", "y", "step", "site", F.lit(None)).alias("key")).distinct()


@query("key_expr", "SELECT DISTINCT md5(concat_ws('|', cast(user_id AS varchar), event_type)) AS key FROM events")
def key_expr(spark, sf):
    return read(spark, sf, "events").select(F.col("user_id").alias("lot_id"), F.col("event_type").alias("step_id")).select(S.row_key(S.Profile(read(spark, sf, "events").select(F.col("user_id").alias("lot_id"), F.col("event_type").alias("step_id")))).alias("key")).distinct()


@query("ctx_cols", "SELECT cast(user_id AS varchar) AS lot, cast(NULL AS varchar) AS step, cast(NULL AS double) AS temp, cast(NULL AS integer) AS site, count(*) AS n FROM events GROUP BY user_id")
def ctx_cols(spark, sf):
    df = read(spark, sf, "events").select(F.col("user_id").alias("lot_id"), "value")
    return df.select(*S.context(S.Profile(df))).groupBy("lot", "step", "temp", "site").agg(F.count("*").alias("n"))


@query("norm_wafer", "SELECT wafer, cast(cast(substr(wafer, 2) AS integer) AS varchar) AS plain, cast(cast(substr(wafer, 2) AS integer) AS varchar) AS slot, count(*) AS n FROM base GROUP BY wafer", "base")
def norm_wafer(spark, sf):
    g = B.base(spark, sf).groupBy("wafer").agg(F.count("*").alias("n"))
    return g.select("wafer", C.norm_wafer(F.lower("wafer")).alias("plain"), C.norm_wafer(F.concat(F.lit("slot "), F.substring("wafer", 2, 9))).alias("slot"), "n")


@query("norm_lot", "SELECT upper(trim(p_name)) AS lot, count(*) AS n FROM part GROUP BY 1")
def norm_lot(spark, sf):
    return read(spark, sf, "part").groupBy(C.norm_lot(F.concat(F.lit(" "), "p_name")).alias("lot")).agg(F.count("*").alias("n"))


@query("part_prefix", "SELECT substr(p_brand, 1, 7) AS family, count(*) AS n FROM part GROUP BY 1")
def part_prefix(spark, sf):
    return read(spark, sf, "part").groupBy(C.part_prefix("p_brand").alias("family")).agg(F.count("*").alias("n"))


@query("fmt_value", "SELECT l_orderkey, l_linenumber, CASE WHEN abs(v) < 1 THEN printf('%.3f', v) WHEN abs(v) <= 10 THEN printf('%.2f', v) ELSE printf('%.1f', v) END AS shown FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_discount ELSE l_quantity - 20 END AS v FROM lineitem) t")
def fmt_value(spark, sf):
    v = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount")).otherwise(F.col("l_quantity") - 20)
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", C.fmt_value(v).alias("shown"))


@query("off_spec", "SELECT item, count(*) AS n FROM merged JOIN specs USING (item) WHERE value < lsl OR value > usl GROUP BY item", "merged", "specs")
def off_spec(spark, sf):
    return B.merged(spark, sf).join(B.specs(spark), "item").where(C.off_spec("value", "lsl", "usl")).groupBy("item").agg(F.count("*").alias("n"))


CORNER_SHEET = """SELECT event_type AS item, max(value) FILTER (WHERE event_id % 4 = 0) AS FFG, min(value) FILTER (WHERE event_id % 4 = 1) AS fsg,
  max(value) FILTER (WHERE event_id % 4 = 2) AS SSG, min(value) FILTER (WHERE event_id % 4 = 3) AS FF FROM {e} GROUP BY event_type"""


@query("spec_corner", """SELECT corner, x, y FROM (SELECT 'FFG' AS corner, max(value) FILTER (event_id % 4 = 0 AND event_type = 'click') AS x, max(value) FILTER (event_id % 4 = 0 AND event_type = 'view') AS y FROM events
  UNION ALL SELECT 'FSG', min(value) FILTER (event_id % 4 = 1 AND event_type = 'click'), min(value) FILTER (event_id % 4 = 1 AND event_type = 'view') FROM events
  UNION ALL SELECT 'SSG', max(value) FILTER (event_id % 4 = 2 AND event_type = 'click'), max(value) FILTER (event_id % 4 = 2 AND event_type = 'view') FROM events) c WHERE x IS NOT NULL AND y IS NOT NULL""")
def spec_corner(spark, sf):
    """Global corners of a sheet that has three of them, one in small letters, beside a functional one."""
    sheet = spark.sql(CORNER_SHEET, e=read(spark, sf, "events"))
    return R.corner_pairs(R.corners_of(sheet, "global"), "click", "view")


# Merging.


@query("merge_retest", f"SELECT {KEYS}, seq, item, value FROM retest", "retest")
def merge_retest(spark, sf):
    return M.merge_retest(B.rounded(spark, sf)).select(*S.KEY7, "seq", "item", "value")


@query("merge_seq", f"SELECT {KEYS}, item, value, n FROM merged", "merged")
def merge_seq(spark, sf):
    return B.merged(spark, sf)


@query("merge_seq_count", "SELECT item, count(*) AS cells FROM merged WHERE n > 1 GROUP BY item", "merged")
def merge_seq_count(spark, sf):
    return M.averaged_cells(B.merged(spark, sf))


@query("merge_keys", f"SELECT {KEYS}, max(ts) AS ts, min(line) AS line FROM rounded GROUP BY {KEYS}", "rounded")
def merge_keys(spark, sf):
    return M.merge_keys(B.rounded(spark, sf)).drop("key")


@query("pivot_wide", f"SELECT {KEYS}, QTY, PRICE, DISC FROM wide", "wide")
def pivot_wide(spark, sf):
    return B.wide(spark, sf)


@query("store_build", f"SELECT {KEYS}, item, value, ts FROM merged JOIN (SELECT {KEYS}, max(ts) AS ts FROM rounded GROUP BY {KEYS}) k USING ({KEYS})", "merged")
def store_build(spark, sf):
    return M.store(B.rounded(spark, sf), mean=M.exact_mean()).drop("key")


def _half(spark, sf, late: bool):
    return M.store(B.rounded(spark, sf).where(f"ts {'>=' if late else '<'} TIMESTAMP_NTZ'1996-01-01'"), mean=M.exact_mean())


def _halves(op: str) -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY {KEYS}, seq, item ORDER BY ts DESC NULLS LAST, value DESC) AS rn, max(ts) OVER (PARTITION BY {KEYS}) AS pts FROM rounded WHERE ts {op} TIMESTAMP '1996-01-01')"


UPSERT_SQL = f"""SELECT {KEYS}, item, coalesce(b.value, a.value) AS value, greatest(pa.ts, pb.ts) AS ts FROM
  (SELECT {KEYS}, item, {B.EXACT} AS value FROM {_halves('<')} t WHERE rn = 1 GROUP BY {KEYS}, item) a FULL JOIN (SELECT {KEYS}, item, {B.EXACT} AS value FROM {_halves('>=')} t WHERE rn = 1 GROUP BY {KEYS}, item) b USING ({KEYS}, item)
  LEFT JOIN (SELECT {KEYS}, max(ts) AS ts FROM rounded WHERE ts < TIMESTAMP '1996-01-01' GROUP BY {KEYS}) pa USING ({KEYS}) LEFT JOIN (SELECT {KEYS}, max(ts) AS ts FROM rounded WHERE ts >= TIMESTAMP '1996-01-01' GROUP BY {KEYS}) pb USING ({KEYS})"""


@query("inc_upsert", UPSERT_SQL, "rounded")
def inc_upsert(spark, sf):
    return M.upsert(_half(spark, sf, False), _half(spark, sf, True)).drop("key")


@query("join_new_keys", f"SELECT count(*) AS n FROM (SELECT DISTINCT {KEYS} FROM rounded WHERE ts >= TIMESTAMP '1996-01-01' EXCEPT SELECT DISTINCT {KEYS} FROM rounded WHERE ts < TIMESTAMP '1996-01-01') t", "rounded")
def join_new_keys(spark, sf):
    return M.new_points(_half(spark, sf, True), _half(spark, sf, False)).agg(F.count("*").alias("n"))


LATE = "rounded WHERE ts >= TIMESTAMP '1996-01-01'"
COUNTS_SQL = f"""SELECT (SELECT count(*) FROM {LATE}) AS rows_in, (SELECT coalesce(sum(r), 0)::BIGINT FROM (SELECT count(*) AS r FROM {LATE} GROUP BY {KEYS}, item HAVING count(value) = 0) e) AS rows_empty,
  count(*) AS cells, count(*) FILTER (n > 1) AS averaged, (SELECT count(*) FROM (SELECT DISTINCT {KEYS}, item FROM rounded WHERE value IS NOT NULL) c) AS rows_out,
  count(DISTINCT point) FILTER (ta IS NULL) AS points_new, count(DISTINCT point) FILTER (ta IS NOT NULL) AS points_updated,
  count(DISTINCT point) FILTER (ta IS NOT NULL AND (old IS NULL OR tb > ta AND old <> value)) AS points_changed,
  count(*) FILTER (ta IS NOT NULL AND old IS NULL) AS cells_filled, count(*) FILTER (ta IS NOT NULL AND tb > ta AND old <> value) AS cells_replaced
FROM (SELECT ({KEYS}) AS point, a.value AS old, b.value AS value, b.n AS n, ta, tb FROM (SELECT {KEYS}, item, {B.EXACT} AS value, count(value) AS n FROM {_halves('>=')} t WHERE rn = 1 GROUP BY {KEYS}, item) b
  LEFT JOIN (SELECT {KEYS}, item, {B.EXACT} AS value FROM {_halves('<')} t WHERE rn = 1 GROUP BY {KEYS}, item) a USING ({KEYS}, item)
  LEFT JOIN (SELECT {KEYS}, max(ts) AS ta FROM rounded WHERE ts < TIMESTAMP '1996-01-01' GROUP BY {KEYS}) pa USING ({KEYS}) JOIN (SELECT {KEYS}, max(ts) AS tb FROM {LATE} GROUP BY {KEYS}) pb USING ({KEYS})) m"""


@query("load_counts", COUNTS_SQL, "rounded")
def load_counts(spark, sf):
    """What the second of two loads into a store counted."""
    into, rows = L.Store(spark, T.scratch(spark, "store"), M.exact_mean(), buckets=8), B.rounded(spark, sf)
    into.load(rows.where("ts < TIMESTAMP_NTZ'1996-01-01'"), "early")
    counts = into.load(rows.where("ts >= TIMESTAMP_NTZ'1996-01-01'"), "late")
    return spark.createDataFrame([tuple(counts[c] for c in L.COUNTS)], ", ".join(f"{c} long" for c in L.COUNTS))
