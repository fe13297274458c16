"""Formulas of conversion rules compiled to Columns: never evaluated as Python, on executors or elsewhere.

Two dialects are read: Python expressions, and the C-like one with ``cond ? a : b``, ``&&``, ``||`` and ``!``. Anything
that is not on the list raises FormulaError. Semantics are Python's: true division, floored ``//`` and ``%``, ``round``
half to even; division by zero and bad input give null, which stands for an error record.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


class FormulaError(ValueError):
    """The formula uses what the language does not have."""


def _all(f, *x: Column) -> Column:
    """Of all values; null where one is missing, which least and greatest would skip."""
    given = x[0].isNotNull()
    for c in x[1:]:
        given = given & c.isNotNull()
    return F.when(given, f(*x))


def _signed(bits: Column, width: Column) -> Column:
    return F.when(bits >= F.pow(F.lit(2.0), width - 1), bits - F.pow(F.lit(2.0), width)).otherwise(bits)


FUNCTIONS = {
    "abs": lambda x: F.abs(x),
    "round": lambda x, n=None: F.bround(x, 0) if n is None else F.bround(x, n),
    "int": lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double"),
    "float": lambda x: x.cast("double"),
    "floor": lambda x: F.floor(x).cast("double"),
    "ceil": lambda x: F.ceil(x).cast("double"),
    "pow": lambda x, y: F.pow(x, y),
    "min": lambda *x: _all(F.least, *x),
    "max": lambda *x: _all(F.greatest, *x),
    "clip": lambda x, a, b: _all(F.least, _all(F.greatest, x, a), b),
    "clamp": lambda x, a, b: _all(F.least, _all(F.greatest, x, a), b),
    "scale": lambda x, f, o=None: x * f if o is None else x * f + o,
    "signed": _signed,
    "unsigned": lambda x, w: F.when(x < 0, x + F.pow(F.lit(2.0), w)).otherwise(x),
}
_BINARY = {
    ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: F.try_divide(a, b), ast.Pow: lambda a, b: F.pow(a, b),
    ast.FloorDiv: lambda a, b: F.floor(F.try_divide(a, b)).cast("double"), ast.Mod: lambda a, b: a - F.floor(F.try_divide(a, b)) * b,
    ast.BitAnd: lambda a, b: a.cast("bigint").bitwiseAND(b.cast("bigint")), ast.BitOr: lambda a, b: a.cast("bigint").bitwiseOR(b.cast("bigint")), ast.BitXor: lambda a, b: a.cast("bigint").bitwiseXOR(b.cast("bigint")),
    ast.LShift: lambda a, b: F.call_function("shiftleft", a.cast("bigint"), b.cast("int")), ast.RShift: lambda a, b: F.call_function("shiftright", a.cast("bigint"), b.cast("int")),
}
_COMPARE = {ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}


def to_python(text: str) -> str:
    """The C-like dialect as Python."""
    text = text.replace("&&", " and ").replace("||", " or ")
    text = re.sub(r"!(?!=)", " not ", text)
    depth = 0
    for i, c in enumerate(text):
        depth += (c in "([") - (c in ")]")
        if c == "?" and depth == 0:
            rest, level, nest = text[i + 1 :], 0, 0
            for j, e in enumerate(rest):
                level += (e in "([") - (e in ")]")
                if level == 0 and e == "?":
                    nest += 1
                elif level == 0 and e == ":":
                    if nest == 0:
                        return f"(({to_python(rest[:j])}) if ({to_python(text[:i])}) else ({to_python(rest[j + 1 :])}))"
                    nest -= 1
            raise FormulaError("'?' without ':'")
    return re.sub(r"\(([^()]*\?[^()]*)\)", lambda m: "(" + to_python(m[1]) + ")", text)


def names(text: str) -> set[str]:
    """The fields a formula reads."""
    tree = ast.parse(to_python(text).strip(), mode="eval")
    called = {n.func.id for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)}
    return {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} - called


def compile_formula(text: str, fields: dict[str, Column]) -> Column:
    """The Column of a formula over named Columns; names are matched in upper case."""
    known = {k.upper(): v for k, v in fields.items()}
    try:
        tree = ast.parse(to_python(text).strip(), mode="eval")
    except (SyntaxError, ValueError) as e:
        raise FormulaError(str(e)) from e

    def go(n) -> Column:
        match n:
            case ast.Expression():
                return go(n.body)
            case ast.Constant() if isinstance(n.value, bool):
                return F.lit(n.value)
            case ast.Constant() if isinstance(n.value, (int, float)):
                return F.lit(float(n.value))
            case ast.Constant() if isinstance(n.value, str):
                return F.lit(n.value)
            case ast.Name():
                if n.id.upper() not in known:
                    raise FormulaError(f"unknown name {n.id}")
                return known[n.id.upper()]
            case ast.BinOp() if type(n.op) in _BINARY:
                return _BINARY[type(n.op)](go(n.left), go(n.right))
            case ast.UnaryOp(op=ast.USub()):
                return -go(n.operand)
            case ast.UnaryOp(op=ast.UAdd()):
                return go(n.operand)
            case ast.UnaryOp(op=ast.Not()):
                return ~go(n.operand)
            case ast.BoolOp():
                parts = [go(v) for v in n.values]
                out = parts[0]
                for p in parts[1:]:
                    out = out & p if isinstance(n.op, ast.And) else out | p
                return out
            case ast.Compare() if all(type(o) in _COMPARE for o in n.ops):
                sides = [go(n.left), *map(go, n.comparators)]
                out = None
                for o, a, b in zip(n.ops, sides, sides[1:]):
                    c = _COMPARE[type(o)](a, b)
                    out = c if out is None else out & c
                return out
            case ast.IfExp():
                return F.when(go(n.test), go(n.body)).otherwise(go(n.orelse))
            case ast.Call(func=ast.Name()) if n.func.id in FUNCTIONS and not n.keywords:
                if n.func.id == "round" and len(n.args) == 2:
                    if not (isinstance(n.args[1], ast.Constant) and isinstance(n.args[1].value, int)):
                        raise FormulaError("round takes a whole number")
                    return F.bround(go(n.args[0]), n.args[1].value)
                return FUNCTIONS[n.func.id](*map(go, n.args))
        raise FormulaError(f"not allowed: {type(n).__name__}")

    return go(tree)


RANGE = re.compile(r"(-?\d+(?:\.\d+)?)\s*(?:-|~|to)\s*(-?\d+(?:\.\d+)?)\s*(?:=|->|→)\s*([A-Za-z_][\w./\-]*)")
EXACT = re.compile(r"(-?\d+)\s*(?:=|->|→)\s*([A-Za-z_][\w./\-]*)")


def compile_mapping(text: str, value: Column) -> Column:
    """A mapping table as a Column: the exact text of the value first, then the first range that holds it, else null."""
    exact = {k: v for k, v in EXACT.findall(text)}
    out = None
    for k, v in exact.items():
        out = F.when(value.cast("string") == k, v) if out is None else out.when(value.cast("string") == k, v)
    for a, b, v in RANGE.findall(text):
        cond = value.cast("double").between(float(a), float(b))
        out = F.when(cond, v) if out is None else out.when(cond, v)
    if out is None:
        raise FormulaError("no mapping pairs")
    return out


def is_mapping(text: str) -> bool:
    return bool(EXACT.search(text)) and not re.search(r"[<>!]=|==", text)
