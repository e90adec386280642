"""Scalar rules as Column expressions. Unreadable input gives null, never an error; results are finite or null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def number(x: ColumnLike) -> Column:
    """Text or number as double; blank and unreadable text is null."""
    return F.trim(_c(x).cast("string")).try_cast("double")


def finite(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def temp_round5(x: ColumnLike) -> Column:
    """To the nearest multiple of 5, halves away from zero. A unit behind the number (25C) is not read: null."""
    return F.round(number(x) / 5) * 5


def seq_text(x: ColumnLike) -> Column:
    """A step sequence as text: whole numbers without decimals, blank as null, other codes as they are."""
    text = F.trim(_c(x).cast("string"))
    n = text.try_cast("double")
    whole = n.isNotNull() & (n == F.floor(n)) & (F.abs(n) < 1e15)
    return F.when(text == "", None).when(whole, n.cast("bigint").cast("string")).otherwise(text)


# What a cell of a rule sheet says for true and for false.
YES = ["TRUE", "T", "Y", "1", "O"]
NO = ["FALSE", "F", "N", "0", "X", ""]


def rule_flag(x: ColumnLike) -> Column:
    """TRUE/T/Y/1/O and FALSE/F/N/0/X/blank, or a number that is 1 or 0; anything else is null (taken as false, with a warning)."""
    t = F.upper(F.trim(F.coalesce(_c(x).cast("string"), F.lit(""))))
    n = t.try_cast("double")
    return F.when(t.isin(YES) | (n == 1), True).when(t.isin(NO) | (n == 0), False)


def norm_lot(x: ColumnLike) -> Column:
    return F.coalesce(F.upper(F.trim(_c(x))), F.lit(""))


def norm_wafer(x: ColumnLike) -> Column:
    """W01, W1, 01, #1 and slot 1 are 1; what has no plain number is kept in upper case."""
    t = F.upper(F.trim(_c(x)))
    digits = F.regexp_extract(t, r"^(?:SLOT|WAFER|WF|W|#)?[ _\-#]*0*(\d+)$", 1)
    return F.coalesce(F.when(digits != "", digits).otherwise(t), F.lit(""))


def key_hash(*columns: ColumnLike) -> Column:
    """md5 of the columns' texts joined by '|'. Null has a sign of its own (~); where a text has one of the signs, a backslash stands before it, so no two points share a key."""
    sign = lambda text, c: F.replace(text, F.lit(c), F.lit("\\" + c))
    return F.md5(F.concat_ws("|", *(F.coalesce(reduce(sign, "\\~|", _c(x).cast("string")), F.lit("~")) for x in columns)))


def part_prefix(x: ColumnLike, size: int = 7) -> Column:
    return F.substring(_c(x), 1, size)


def fmt_value(x: ColumnLike, delta: bool = False) -> Column:
    """Three digits below 1, two up to 10, else one; deltas carry their sign."""
    v, sign = _c(x), "+" if delta else ""
    return F.when(F.abs(v) < 1, F.format_string(f"%{sign}.3f", v)).when(F.abs(v) <= 10, F.format_string(f"%{sign}.2f", v)).when(v.isNotNull(), F.format_string(f"%{sign}.1f", v))


def off_spec(value: ColumnLike, low: ColumnLike, high: ColumnLike) -> Column:
    """Below low or above high; what is null can't be off."""
    v = _c(value)
    return F.coalesce(v < _c(low), F.lit(False)) | F.coalesce(v > _c(high), F.lit(False))


def div(a: Column, b: Column) -> Column:
    return finite(F.try_divide(a.cast("double"), b.cast("double")))


def power(a: Column, b: Column) -> Column:
    return finite(F.pow(a.cast("double"), b.cast("double")))


def sqrt(a: Column) -> Column:
    return F.when(a >= 0, F.sqrt(a))


def exp(a: Column) -> Column:
    return finite(F.exp(a))


def _valid(xs: tuple[Column, ...]) -> list[Column]:
    return [finite(x.cast("double")) for x in xs]


def row_min(*xs: Column) -> Column:
    v = _valid(xs)
    return v[0] if len(v) == 1 else F.least(*v)


def row_max(*xs: Column) -> Column:
    v = _valid(xs)
    return v[0] if len(v) == 1 else F.greatest(*v)


def _plus(xs: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, xs)


def row_count(*xs: Column) -> Column:
    return _plus([F.when(x.isNotNull(), 1).otherwise(0) for x in _valid(xs)])


def row_sum(*xs: Column) -> Column:
    """Without nulls; null if all are."""
    return F.when(row_count(*xs) > 0, _plus([F.coalesce(x, F.lit(0.0)) for x in _valid(xs)]))


def row_avg(*xs: Column) -> Column:
    return F.try_divide(row_sum(*xs), row_count(*xs))


def row_std(*xs: Column) -> Column:
    """Sample deviation over the valid arguments; null with fewer than two."""
    n, mean = row_count(*xs), row_avg(*xs)
    return F.when(n > 1, F.sqrt(_plus([F.coalesce((x - mean) * (x - mean), F.lit(0.0)) for x in _valid(xs)]) / (n - 1)))


def natural_key(x: ColumnLike) -> Column:
    """(text before the first number, the number, the rest): W2 stands before W10."""
    t = F.coalesce(_c(x), F.lit(""))
    return F.struct(F.regexp_extract(t, r"^(\D*)", 1).alias("text"), F.regexp_extract(t, r"(\d+)", 1).try_cast("bigint").alias("number"), t.alias("rest"))
