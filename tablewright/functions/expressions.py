"""Algebraic expressions over columns, turned into Spark SQL expressions."""

from __future__ import annotations

import ast
import math
from collections.abc import Sequence
from functools import reduce
from operator import mul

from pyspark.sql import Column, functions as F

from tablewright.core.types import quoted


class ExpressionError(ValueError):
    """An expression uses something outside the algebraic subset."""


def _within(name: str, fn, ok):
    """``fn`` that stops with an error outside its domain, as an expression without a value must."""
    def checked(x: Column) -> Column:
        bad = F.raise_error(F.concat(F.lit(f"{name} has no value at "), x.cast("string"))).cast("double")
        return F.when(x.isNull() | F.isnan(x) | ok(x), fn(x)).otherwise(bad)

    return checked


def _not_negative(x: Column) -> Column:
    return x >= 0


def _positive(x: Column) -> Column:
    return x > 0


def _unit(x: Column) -> Column:
    return F.abs(x) <= 1


# Functions users may call in an expression.
FUNCTIONS = {
    "sqrt": _within("sqrt", F.sqrt, _not_negative), "exp": F.exp,
    "log": _within("log", F.ln, _positive), "ln": _within("ln", F.ln, _positive),
    "sin": F.sin, "cos": F.cos, "tan": F.tan,
    "asin": _within("asin", F.asin, _unit), "acos": _within("acos", F.acos, _unit), "atan": F.atan,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
    "abs": F.abs, "Abs": F.abs, "sign": F.signum, "floor": F.floor, "ceiling": F.ceil,
}
VARIADIC = {"Max": F.greatest, "Min": F.least}
CONSTANTS = {"pi": math.pi, "E": math.e}


def _power(base: Column, node: ast.expr, names: Sequence[str]) -> Column:
    if isinstance(node, ast.Constant) and isinstance(node.value, int) and 1 <= node.value <= 4:
        return reduce(mul, [base] * node.value)
    return F.pow(base, _column(node, names))


def _column(node: ast.expr, names: Sequence[str]) -> Column:
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
        return F.lit(float(node.value))
    if isinstance(node, ast.Name):
        if node.id in names:
            return quoted(node.id).cast("double")
        if node.id in CONSTANTS:
            return F.lit(CONSTANTS[node.id])
        raise ExpressionError(f"unknown column {node.id!r}")
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        inner = _column(node.operand, names)
        return -inner if isinstance(node.op, ast.USub) else inner
    if isinstance(node, ast.BinOp):
        left = _column(node.left, names)
        if isinstance(node.op, ast.Pow):
            return _power(left, node.right, names)
        right = _column(node.right, names)
        if isinstance(node.op, ast.Add):
            return left + right
        if isinstance(node.op, ast.Sub):
            return left - right
        if isinstance(node.op, ast.Mult):
            return left * right
        if isinstance(node.op, ast.Div):
            return left / right  # division by zero raises under ANSI mode
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
        args = [_column(a, names) for a in node.args]
        if node.func.id in VARIADIC and len(args) > 1:
            return VARIADIC[node.func.id](*args)
        if node.func.id == "log" and len(args) == 2:
            return FUNCTIONS["ln"](args[0]) / FUNCTIONS["ln"](args[1])
        if node.func.id in FUNCTIONS and len(args) == 1:
            return FUNCTIONS[node.func.id](args[0])
    raise ExpressionError(f"unsupported expression {ast.unparse(node)!r}")


def compile_expression(expression: str, names: Sequence[str]) -> Column:
    """Column for an algebraic expression such as ``a^2 + sqrt(b)/3``."""
    try:
        tree = ast.parse(expression.replace("^", "**"), mode="eval")
    except SyntaxError as exc:
        raise ExpressionError(f"cannot read {expression!r}") from exc
    value = _column(tree.body, names)
    endless = F.raise_error(F.lit(f"{expression} has no finite value")).cast("double")
    return F.when(F.abs(value) == math.inf, endless).otherwise(value)
