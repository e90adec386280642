"""The condition language: a few tokens typed for a column become one Column predicate."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r'"([^"]*)"|(\S+)')
NUMBER = r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"


class ConditionError(ValueError):
    """A condition that is empty or can't be read; the message names the column."""


def tokens(text: str | None) -> list[str]:
    return [a or b for a, b in TOKEN.findall(text or "")]


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def _glob(col: Column, token: str) -> Column:
    literal = token.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return col.like(literal.replace("*", "%").replace("?", "_"))


def text_condition(col: Column, words: list[str], mode: str = "in") -> Column:
    """in: equality, IN, !x for NOT IN or null, * as glob. like: raw patterns. regexp: partial match, blanks as 'or'."""
    if mode == "like":
        return _any([col.like(w) for w in words])
    if mode == "regexp":
        joined = " ".join(words)
        return col.rlike(joined if re.search(r"[|\[\](){}]", joined) else "|".join(words))
    no = [w[1:] for w in words if w.startswith("!")]
    yes = [w for w in words if not w.startswith("!") and "*" not in w]
    globs = [_glob(col, w) for w in words if not w.startswith("!") and "*" in w]
    parts = ([col.isin(yes)] if yes else []) + globs
    found = [_any(parts)] if parts else []
    if no:
        found.append(~col.isin(no) | col.isNull())
    return _all(found)


def number_condition(col: Column, words: list[str], mode: str = "=") -> Column:
    """>=25, <85 (ANDed), 25~85 inclusive, bare numbers as IN (or compared by mode), !0 for <> or null."""
    compare = {">=": col.__ge__, "<=": col.__le__, ">": col.__gt__, "<": col.__lt__, "=": col.__eq__}
    parts: list[Column] = []
    bare: list[float] = []
    for w in words:
        if m := re.fullmatch(rf"(>=|<=|>|<)({NUMBER})", w):
            parts.append(compare[m[1]](float(m[2])))
        elif m := re.fullmatch(rf"({NUMBER})~({NUMBER})", w):
            parts.append(col.between(float(m[1]), float(m[2])))
        elif m := re.fullmatch(rf"!({NUMBER})", w):
            parts.append((col != float(m[1])) | col.isNull())
        elif re.fullmatch(NUMBER, w) and mode != "=":
            parts.append(compare[mode](float(w)))
        elif re.fullmatch(NUMBER, w):
            bare.append(float(w))
        else:
            raise ValueError(w)
    return _all(parts + ([col.isin(bare)] if bare else []))


def time_condition(col: Column, text: str) -> Column:
    """'lo ~ hi', half open; only lo: from there on."""
    low, _, high = (x.strip() for x in text.partition("~"))
    out = col >= F.lit(low).cast("timestamp_ntz")
    return out & (col < F.lit(high).cast("timestamp_ntz")) if high else out


def condition(name: str, text: str | None, kind: str, mode: str = "in") -> Column:
    words = tokens(text)
    if not words:
        raise ConditionError(f"{name}: the condition is empty")
    col = F.col(name)
    try:
        if kind == "time":
            return time_condition(col, text)
        return number_condition(col, words, "=" if mode == "in" else mode) if kind == "number" else text_condition(col, words, mode)
    except (ValueError, TypeError) as e:
        raise ConditionError(f"{name}: can't read {e}") from e


def all_of(required: list[tuple], optional: list[tuple] = ()) -> Column:
    """ANDs conditions (name, text, kind[, mode]); empty optional ones are skipped."""
    return _all([condition(*c) for c in required] + [condition(*c) for c in optional if tokens(c[1])])
