"""Scalar rules, conditions and formulas on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from dieframe.functions import columns as C
from dieframe.functions.formula import FormulaError, compile_formula, parse, references
from dieframe.functions.predicates import ConditionError, all_of, condition


def one(spark, column, **values):
    row = {k: v for k, v in values.items()} or {"_": 1}
    ddl = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'long'}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], ddl).select(column.alias("r")).first().r


@pytest.mark.parametrize("text,want", [("22.5", 25.0), ("-22.5", -25.0), (" 84.6", 85.0), ("148.5", 150.0), ("25C", None), ("", None), (None, None)])
def test_temp_round5(spark, text, want):
    assert one(spark, C.temp_round5("t"), t=text) == want


@pytest.mark.parametrize("text,want", [("1", "1"), ("1.0", "1"), (" ", None), ("LN08", "LN08"), ("1.5", "1.5"), ("007", "7"), (None, None)])
def test_seq_text(spark, text, want):
    assert one(spark, C.seq_text("t"), t=text) == want


@pytest.mark.parametrize("text,want", [("W01", "1"), ("w1", "1"), ("01", "1"), ("#1", "1"), ("slot 1", "1"), ("W10", "10"), ("W01A", "W01A"), ("W01.2", "W01.2"), ("SPARE", "SPARE"), ("0", "0"), (None, "")])
def test_norm_wafer(spark, text, want):
    assert one(spark, C.norm_wafer("t"), t=text) == want


@pytest.mark.parametrize("text,want", [("y", True), ("O", True), ("1", True), ("x", False), ("", False), (None, False), ("maybe", None)])
def test_rule_flag(spark, text, want):
    assert one(spark, C.rule_flag("t"), t=text) is want


def test_key_hash_tells_null_from_blank(spark):
    df = spark.createDataFrame([(None, "a"), ("", "a"), ("a", None), ("a", "")], "x string, y string")
    assert df.select(C.key_hash("x", "y").alias("k")).distinct().count() == 4


@pytest.mark.parametrize("v,want,delta", [(0.12345, "0.123", "+0.123"), (10.0, "10.00", "+10.00"), (-12.34, "-12.3", "-12.3"), (1234.56, "1234.6", "+1234.6")])
def test_fmt_value(spark, v, want, delta):
    assert one(spark, C.fmt_value("v"), v=v) == want and one(spark, C.fmt_value("v", True), v=v) == delta


@pytest.mark.parametrize("formula,want", [
    ("{A} + {B} * 2 - -{C}", 11.0), ("{A} / 0", None), ("1 / ({A} / 0)", None), ("(-1) ** 0.5", None), ("{A} ^ 2", 4.0), ("Exp(1000)", None), ("Max(Exp(1000), 1)", 1.0), ("Sqrt(-{A})", None), ("Log(100)", 2.0), ("LOG10(0)", None), ("Ln(-1)", None),
    ("Min({A})", 2.0), ("Max({A}, {N}, {C})", 3.0), ("Avg({A}, {N})", 2.0), ("Sum({N})", None), ("Sum({N}, {A})", 2.0), ("{N} + 1", None), ("Std({A}, {B})", math.sqrt(2)), ("Stdev({A}, {N})", None), ("Sum({MISSING}, 1)", 1.0), ("{MISSING} * 0", None), ("Abs({A} - {B}) / 2", 1.0),
])
def test_formula(spark, formula, want):
    df = spark.createDataFrame([(2.0, 4.0, 3.0 - 2.0, None)], "A double, B double, c double, n double").withColumn("c", F.lit(1.0)).withColumn("c", F.col("A") - 1)
    df = spark.sql("SELECT 2.0D AS A, 4.0D AS B, 1.0D AS C, CAST(NULL AS double) AS N") if "Max({A}, {N}" not in formula else spark.sql("SELECT 2.0D AS A, 4.0D AS B, 3.0D AS C, CAST(NULL AS double) AS N")
    got = df.select(compile_formula(formula, {c: c for c in df.columns}).alias("r")).first().r
    assert got is None if want is None else got == pytest.approx(want)


@pytest.mark.parametrize("formula", ["__import__('os')", "A + 1", "{A}.x", "{A}[0]", "Foo({A})", "{A} if 1 else 2", "", "{A} +", "Abs({A}, {B})", "lambda: 1", "'x'", "Abs(x=1)", "{A} and {B}", "True"])
def test_formula_refuses(formula):
    with pytest.raises(FormulaError):
        parse(formula)


def test_references():
    assert references("{A b/c} + { x } * {A b/c}") == ["A b/c", "x"]


@pytest.mark.parametrize("text,kind,mode,want", [
    ("a", "text", "in", ["a"]), ('"b c" a', "text", "in", ["a", "b c"]), ("!a", "text", "in", ["b c", "a_d", None]), ("a*", "text", "in", ["a", "a_d"]), ("a_*", "text", "in", ["a_d"]), ("%c a", "text", "like", ["a", "b c"]), ("c d", "text", "regexp", ["b c", "a_d"]), ("^a$|b", "text", "regexp", ["a", "b c"]),
])
def test_text_conditions(spark, text, kind, mode, want):
    df = spark.createDataFrame([("a",), ("b c",), ("a_d",), (None,)], "x string")
    assert sorted((r.x for r in df.where(condition("x", text, kind, mode)).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("text,mode,want", [(">=2 <3", "in", [2.0, 2.5]), ("2~3", "in", [2.0, 2.5, 3.0]), ("1 3", "in", [1.0, 3.0]), ("!1", "in", [2.0, 2.5, 3.0, None]), ("2.5", ">", [3.0])])
def test_number_conditions(spark, text, mode, want):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.5,), (3.0,), (None,)], "x double")
    assert sorted((r.x for r in df.where(condition("x", text, "number", mode)).collect()), key=str) == sorted(want, key=str)


def test_conditions_that_fail(spark):
    with pytest.raises(ConditionError, match="lot"):
        all_of([("lot", " ", "text")])
    with pytest.raises(ConditionError, match="temp"):
        condition("temp", "warm", "number")
