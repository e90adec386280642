"""Formulas such as Abs({A} - {B}) / 2, compiled to a Column. Only the syntax below is allowed; nothing is evaluated."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import columns as C

REFERENCE = re.compile(r"\{([^{}]+)\}")
FUNCTIONS: dict[str, tuple[Callable[..., Column], int | None]] = {
    "abs": (F.abs, 1), "sqrt": (C.sqrt, 1), "ln": (F.ln, 1), "log": (F.log10, 1), "log10": (F.log10, 1), "exp": (C.exp, 1),
    "min": (C.row_min, None), "max": (C.row_max, None), "avg": (C.row_avg, None), "sum": (C.row_sum, None), "std": (C.row_std, None), "stdev": (C.row_std, None), "stddev": (C.row_std, None),
}
BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: C.div, ast.Pow: C.power}


class FormulaError(ValueError):
    pass


def references(formula: str) -> list[str]:
    """Names in braces, in order, each once."""
    return list(dict.fromkeys(x.strip() for x in REFERENCE.findall(formula or "")))


def parse(formula: str) -> tuple[ast.expr, list[str]]:
    """The syntax tree with ref_0, ref_1, ... for the names; raises FormulaError on anything not allowed."""
    names = references(formula)
    text = REFERENCE.sub(lambda m: f"ref_{names.index(m[1].strip())}", formula or "").replace("^", "**")
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except (SyntaxError, ValueError) as e:
        raise FormulaError(f"can't read {formula!r}") from e
    for node in ast.walk(tree):
        ok = isinstance(node, (ast.operator, ast.unaryop, ast.expr_context, ast.BinOp, ast.UnaryOp, ast.Call, ast.Name))
        if isinstance(node, ast.Constant):
            ok = isinstance(node.value, (int, float)) and not isinstance(node.value, bool)
        elif isinstance(node, ast.BinOp):
            ok = type(node.op) in BINARY
        elif isinstance(node, ast.UnaryOp):
            ok = isinstance(node.op, (ast.UAdd, ast.USub))
        elif isinstance(node, ast.Call):
            known = FUNCTIONS.get(node.func.id.lower()) if isinstance(node.func, ast.Name) else None
            ok = known is not None and not node.keywords and bool(node.args) and known[1] in (None, len(node.args))
        if not ok:
            raise FormulaError(f"{ast.unparse(node) if isinstance(node, ast.expr) else type(node).__name__} isn't allowed in {formula!r}")
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    for node in ast.walk(tree):
        if isinstance(node, ast.Name) and id(node) not in called and not node.id.startswith("ref_"):
            raise FormulaError(f"{node.id} needs braces in {formula!r}")
    return tree, names


def build(node: ast.expr, refs: list[Column], std: Callable[[ast.Call], Column | None] = lambda _: None) -> Column:
    if isinstance(node, ast.Constant):
        return F.lit(float(node.value))
    if isinstance(node, ast.Name):
        return refs[int(node.id[4:])]
    if isinstance(node, ast.UnaryOp):
        return -build(node.operand, refs, std) if isinstance(node.op, ast.USub) else build(node.operand, refs, std)
    if isinstance(node, ast.BinOp):
        return BINARY[type(node.op)](build(node.left, refs, std), build(node.right, refs, std))
    if (own := std(node)) is not None:
        return own
    return FUNCTIONS[node.func.id.lower()][0](*(build(a, refs, std) for a in node.args))


def compile_formula(formula: str, available: dict[str, str], absolute: bool = False, std: Callable[[ast.Call], Column | None] = lambda _: None) -> Column:
    """available: column by name. A name that has none counts as null."""
    tree, names = parse(formula)
    refs = [F.col(f"`{available[n]}`").cast("double") if n in available else F.lit(None).cast("double") for n in names]
    out = C.finite(build(tree, refs, std))
    return F.abs(out) if absolute else out
