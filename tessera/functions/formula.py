"""Expressions over v, r and c, checked against a whitelist and left to Catalyst."""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

FUNCTIONS = {"pow": F.pow, "min": F.least, "max": F.greatest, "abs": F.abs, "sqrt": F.sqrt, "floor": F.floor, "ceil": F.ceil, "round": F.round}


def formula(text: str, **names: Column) -> Column:
    """The column of an arithmetic expression; a division by zero is null. Raises ValueError on anything else."""

    def build(node: ast.AST) -> Column:
        match node:
            case ast.Expression(body=body):
                return build(body)
            case ast.Constant(value=int() | float() as value) if not isinstance(value, bool):
                return F.lit(float(value))
            case ast.Name(id=name) if name in names:
                return names[name].cast("double")
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -build(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return build(x)
            case ast.BinOp(left=a, op=ast.Add(), right=b):
                return build(a) + build(b)
            case ast.BinOp(left=a, op=ast.Sub(), right=b):
                return build(a) - build(b)
            case ast.BinOp(left=a, op=ast.Mult(), right=b):
                return build(a) * build(b)
            case ast.BinOp(left=a, op=ast.Div(), right=b):
                return F.try_divide(build(a), build(b))
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in FUNCTIONS and len(args) == (2 if name in ("pow", "min", "max") else 1):
                return FUNCTIONS[name](*map(build, args)).cast("double")
        raise ValueError(f"not allowed in a formula: {ast.dump(node)[:60]}")

    try:
        return build(ast.parse(text, mode="eval"))
    except SyntaxError as e:
        raise ValueError(f"not a formula: {text}") from e


def linear_form(text: str | None, variable: str = "X") -> tuple[float, float] | None:
    """``a, b`` with a * variable + b equal to an expression of numbers, + - * / and brackets; None if it isn't linear or not an expression.

    Case and blanks don't matter. Numbers may be written as in Python, and with zeros before them.
    """

    def build(node: ast.AST) -> tuple[float, float]:
        match node:
            case ast.Expression(body=body):
                return build(body)
            case ast.Constant(value=int() | float() as value) if not isinstance(value, bool):
                return 0.0, float(value)
            case ast.Name(id=name) if name.upper() == variable.upper():
                return 1.0, 0.0
            case ast.UnaryOp(op=ast.USub() | ast.UAdd() as sign, operand=x):
                a, b = build(x)
                return (-a, -b) if isinstance(sign, ast.USub) else (a, b)
            case ast.BinOp(left=left, op=ast.Add() | ast.Sub() as sign, right=right):
                (a, b), (c, d) = build(left), build(right)
                return (a + c, b + d) if isinstance(sign, ast.Add) else (a - c, b - d)
            case ast.BinOp(left=left, op=ast.Mult(), right=right):
                (a, b), (c, d) = build(left), build(right)
                if a and c:
                    raise ValueError("not linear")
                return a * d + c * b, b * d
            case ast.BinOp(left=left, op=ast.Div(), right=right):
                (a, b), (c, d) = build(left), build(right)
                if c or not d:
                    raise ValueError("not linear")
                return a / d, b / d
        raise ValueError("not an expression")

    try:
        return build(ast.parse(re.sub(r"(?<![\w.])0+(?=[0-9])", "", (text or "").strip()), mode="eval"))
    except (SyntaxError, ValueError, RecursionError, MemoryError, OverflowError):
        return None
