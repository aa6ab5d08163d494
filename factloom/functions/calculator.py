"""Arithmetic over untrusted expressions: a parsed tree, an operator allowlist, never eval."""

from __future__ import annotations

import ast
import operator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom import scope

_BINARY = {
    ast.Add: operator.add,
    ast.Sub: operator.sub,
    ast.Mult: operator.mul,
    ast.Div: operator.truediv,
    ast.Mod: operator.mod,
    ast.Pow: operator.pow,
}
_RESULT = T.StructType().add("value", T.DoubleType()).add("error", T.StringType())
_UNARY = {ast.UAdd: operator.pos, ast.USub: operator.neg}


def _value(node: ast.AST) -> float:
    match node:
        case ast.Constant(value=number) if type(number) in (int, float):
            return float(number)
        case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
            return _BINARY[type(op)](_value(a), _value(b))
        case ast.UnaryOp(op=op, operand=a) if type(op) in _UNARY:
            return _UNARY[type(op)](_value(a))
    raise ValueError(f"not allowed: {type(node).__name__}")


def calculate(expression: str | None) -> tuple[float | None, str | None]:
    """(value, None) or (None, reason)."""
    if not expression or len(expression) > scope.MAX_EXPRESSION_CHARS:
        return None, "expression length out of range"
    try:
        result = _value(ast.parse(expression, mode="eval").body)
        return float(result), None
    except ZeroDivisionError:
        return None, "division by zero"
    except (SyntaxError, ValueError, TypeError, OverflowError, RecursionError, MemoryError) as problem:
        return None, str(problem) or type(problem).__name__


@F.arrow_udf(_RESULT)
def evaluate(expression: pa.Array) -> pa.Array:
    values, errors = zip(*[calculate(text) for text in expression.to_pylist()]) if len(expression) else ((), ())
    return pa.StructArray.from_arrays([pa.array(values, pa.float64()), pa.array(errors, pa.string())], names=["value", "error"])
